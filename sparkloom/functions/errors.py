"""Expressions that never raise: every fallible function as a value and an error code.

A function's risks are conditions on its arguments, each with a code. Where one holds, the value is null and the code is the value's error;
else the function is computed as ever, inside `when`, so nothing that could raise is evaluated. Errors of arguments come
first, and branches that are not taken have none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import Scope, Value, build, first_error, map_value
from .conversion import TARGETS, boolean_of, java_format
from .core import WHOLE
from .dates import UNITS, local_time
from .registry import NAMES, NULL_AWARE, any_absent

Risk = tuple[Column, str]
RISKS: dict[str, Callable[..., list[Risk]]] = {}
#: Functions of numbers, which read numbers from text, and the places of moments in those of dates.
OF_NUMBERS = frozenset("subtract multiply divide modulo negate abs floor ceil power sqrt round min max least greatest to_decimal".split())
OF_MOMENTS = {"date_add": (0,), "date_diff": (0, 1), "date_trunc": (0,), "extract": (0, 1), "date_part": (0, 1), "to_timezone": (0,), "from_utc": (0,), "at_timezone": (0,), "to_utc": (0,),
              "format_date": (0,), "format_datetime": (0,)}
#: How far a date may move, by unit: ten thousand years.
FARTHEST = {"year": 10_000, "month": 120_000, "day": 3_652_500, "hour": 87_660_000, "minute": 5_259_600_000}
WHOLE_MIN = -(1 << 63)


def risks(*names: str):
    """Register a function (scope, *values) -> [(condition, code)] for functions."""

    def keep(fn):
        for name in names:
            RISKS[name] = fn
        return fn

    return keep


def whole(scope: Scope, *values: Value) -> bool:
    return all(isinstance(scope.type_of(v), WHOLE) for v in values)


def text(scope: Scope, v: Value) -> bool:
    return isinstance(scope.type_of(v), T.StringType)


def lost(found: Column, *args: Value) -> Column:
    """Whether a try form gave null for arguments that are there."""
    there = found.isNull()
    for a in args:
        there = there & a.col.isNotNull()
    return there


for _name, _try in (("add", F.try_add), ("subtract", F.try_subtract), ("multiply", F.try_multiply)):
    risks(_name)(lambda scope, a, b, f=_try: [(lost(f(a.col, b.col), a, b), "overflow")] if whole(scope, a, b) else [])


@risks("negate", "abs")
def turned(scope: Scope, a: Value) -> list[Risk]:
    return [(a.col == F.lit(WHOLE_MIN), "overflow")] if whole(scope, a) else []


@risks("divide", "modulo")
def divided(scope: Scope, a: Value, b: Value) -> list[Risk]:
    return [(b.col == 0, "division_by_zero"), *([((a.col == F.lit(WHOLE_MIN)) & (b.col == -1), "overflow")] if whole(scope, a, b) else [])]


risks("sqrt")(lambda scope, x: [(x.col < 0, "negative_number")])


def in_whole_range(x: Column) -> Column:
    return (x >= float(WHOLE_MIN)) & (x < -float(WHOLE_MIN))


def casting(scope: Scope, v: Value, target: str) -> list[Risk]:
    if target == "boolean" and text(scope, v):
        return [(lost(boolean_of(v.col), v), "invalid_cast")]
    return [(lost(v.col.try_cast(TARGETS[target]), v), "invalid_cast")] if target in TARGETS else []


risks("cast")(lambda scope, v, target: casting(scope, v, scope.constant(target, "cast: type")))
risks("try_cast")(lambda scope, v, target, policy=None: casting(scope, v, scope.constant(target, "cast: type")) if policy and policy.literal == "fail" else [])


@risks("to_integer")
def to_integer(scope: Scope, v: Value) -> list[Risk]:
    if isinstance(scope.type_of(v), (T.DoubleType, T.FloatType)):
        return [(~in_whole_range(v.col), "out_of_range"), (v.col != F.floor(v.col), "fraction")]
    return casting(scope, v, "integer")


risks("to_decimal", "parse_decimal")(lambda scope, v: casting(scope, v, "decimal"))
risks("parse_boolean")(lambda scope, v: [(lost(boolean_of(v.col), v), "invalid_boolean")])


def parsing(name: str, default: str, zoned: bool = False) -> None:
    @risks(name)
    def found(scope: Scope, s: Value, fmt: Value | None = None) -> list[Risk]:
        read = F.try_to_timestamp(s.col, F.lit(java_format(scope.constant(fmt, f"{name}: format") if fmt else default)))
        return [(lost(F.coalesce(F.try_to_timestamp(F.when(F.rlike(s.col, F.lit(r"[Zz]|[+-]\d\d:?\d\d$")), s.col)), read) if zoned else read, s), "invalid_" + name.removeprefix("parse_"))]


parsing("parse_date", "%Y-%m-%d")
parsing("parse_time", "%H:%M:%S")
parsing("parse_datetime", "%Y-%m-%dT%H:%M:%S", True)

risks("substr")(lambda scope, s, start, n=None: [(start.col < 0, "negative_start"), *([(n.col < 0, "negative_length")] if n else [])])
risks("pad_left", "pad_right")(lambda scope, s, n, fill=None: [(n.col < 0, "negative_length"), *([(fill.col == "", "empty_fill")] if fill else [])])
risks("repeat")(lambda scope, s, n: [((n.col < 0) | (n.col > 1_000_000), "out_of_range")])
risks("join_strings")(lambda scope, parts, sep: [(F.exists(parts.col, lambda x: x.isNull()), "null_element")])


@risks("regex_extract", "regex_extract_all")
def group(scope: Scope, s: Value, pattern: Value, at: Value | None = None) -> list[Risk]:
    try:
        most = re.compile(scope.constant(pattern, "pattern")).groups
    except re.error:
        return []
    return [((at.col < 0) | (at.col > most), "no_such_group")] if at else []


def repeated(keys: Column) -> Column:
    return F.size(F.array_distinct(keys)) < F.size(keys)


@risks("map")
def map_keys(scope: Scope, *kv: Value) -> list[Risk]:
    keys = F.array(*[k.col for k in kv[::2]])
    return [(F.exists(keys, lambda k: k.isNull()), "null_key"), (repeated(keys), "repeated_key")] if kv else []


@risks("map_from_entries")
def entries(scope: Scope, v: Value) -> list[Risk]:
    kind = scope.type_of(v)
    name = kind.elementType.names[0] if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else "key"
    keys = F.transform(v.col, lambda e: e[name])
    return [(F.exists(keys, lambda k: k.isNull()), "null_key"), (repeated(keys), "repeated_key")]


@risks("map_concat")
def joined(scope: Scope, *args: Value) -> list[Risk]:
    *maps, policy = args
    return [(repeated(F.concat(*[F.map_keys(m.col) for m in maps])), "repeated_key")] if policy.literal == "error" else []


@risks("date_add")
def far(scope: Scope, v: Value, n: Value, unit: Value | None = None) -> list[Risk]:
    most = FARTHEST.get(unit.literal if unit else "day")
    return [(F.abs(n.col.cast("double")) > most, "out_of_range")] if most else []


def zones(zone: Value) -> list[Risk]:
    known = sorted(available_timezones())
    if zone.is_literal:
        return [] if zone.literal in known or re.fullmatch(r"[+-](0\d|1[0-7]):[0-5]\d|[+-]18:00", str(zone.literal)) else [(F.lit(True), "unknown_zone")]
    return [(~(zone.col.isin(known) | F.rlike(zone.col, F.lit(r"^([+-](0\d|1[0-7]):[0-5]\d|[+-]18:00)$"))), "unknown_zone")]


risks("to_timezone", "from_utc", "at_timezone")(lambda scope, t, zone: zones(zone))


@risks("to_utc")
def local(scope: Scope, t: Value, zone: Value, ambiguous: Value | None = None, nonexistent: Value | None = None) -> list[Risk]:
    wrong = zones(zone)
    if zone.is_literal and wrong:
        return wrong
    known = F.when(~wrong[0][0], zone.col) if wrong else zone.col
    _, _, gap, overlap = local_time(t.col, known)
    if not nonexistent or nonexistent.literal not in ("shift_forward", "shiftForward"):
        wrong.append((gap, "nonexistent_time"))
    if not ambiguous or ambiguous.literal not in ("earliest", "earlier", "latest", "later"):
        wrong.append((overlap & ~gap, "ambiguous_time"))
    return wrong


def read(v: Value, target: str, code: str) -> Value:
    """Text as a number or moment, with an error where it is none."""
    def lenient(x: Column) -> Column:
        return x.try_cast(target)

    return Value(lenient(v.col), lenient(v.probe), error=first_error(v.error, F.when(lost(lenient(v.col), v), code)), state=v.state)


def as_needed(name: str, scope: Scope, built: list[Value]) -> list[Value]:
    """Arguments with text read as the numbers or moments that the function takes."""
    texts = [text(scope, v) for v in built]
    mixed = name in ("add", "lt", "lte", "gt", "gte", "between") and any(texts) and not all(texts) and any(isinstance(scope.type_of(v), T.NumericType) for v in built)
    if name in OF_NUMBERS or mixed:
        return [read(v, "double", "invalid_number") if t else v for v, t in zip(built, texts)]
    if name in OF_MOMENTS:
        return [read(v, "timestamp", "invalid_moment") if t and i in OF_MOMENTS[name] and not (v.is_literal and v.literal in UNITS) else v for i, (v, t) in enumerate(zip(built, texts))]
    return built


def whichever(tests: list[tuple[Column, Column | None]], last: Column | None) -> Column | None:
    """The error of the branch that is taken."""
    if last is None and all(e is None for _, e in tests):
        return None
    none = F.lit(None).cast("string")
    out = None
    for test, error in tests:
        error = none if error is None else error
        out = F.when(test, error) if out is None else out.when(test, error)
    return out.otherwise(none if last is None else last) if out is not None else last


def branches(name: str, built: list[Value]) -> Column | None:
    """The error of functions that do not evaluate every argument."""
    if name == "and":
        return first_error(built[0].error, whichever([(built[0].col, built[1].error)], None))
    if name == "or":
        return first_error(built[0].error, whichever([(built[0].col, None)], built[1].error))
    if name in ("coalesce", "if_null"):
        error = built[-1].error
        for v in reversed(built[:-1]):
            error = first_error(v.error, whichever([(v.col.isNotNull(), None)], error))
        return error
    tests = built[: len(built) // 2 * 2]
    error = built[-1].error if len(built) % 2 else None
    for test, value in reversed(list(zip(tests[::2], tests[1::2]))):
        error = first_error(test.error, whichever([(test.col, value.error)], error))
    return error


LAZY = frozenset("and or coalesce if_null case_when".split())


def kept(name: str, args: list, scope: Scope) -> Value:
    """A call whose errors are kept as codes."""
    fn, _, _, kind = NAMES[name]
    if kind == "nodes":
        out = fn(scope, *args)
        return out if out.error is None else Value(F.when(out.error.isNull(), out.col), out.probe, error=out.error)
    built = [build(a, scope) for a in args]
    if name == "is_invalid":
        found = first_error(built[0].error, built[0].state)
        return map_value(lambda _: F.lit(False) if found is None else found.isNotNull(), Value(built[0].col, built[0].probe))
    built = as_needed(name, scope, built)
    own = [(F.coalesce(bad, F.lit(False)), code) for bad, code in RISKS[name](scope, *built)] if name in RISKS else []
    if scope.strict and built and name not in NULL_AWARE:
        own.append((any_absent(name, tuple(v.col for v in built)), "null_argument"))
    out = fn(scope, *built) if kind == "values" else map_value(fn, *built)
    error = branches(name, built) if name in LAZY else first_error(*[v.error for v in built])
    col = out.col
    if own:  # where an argument has failed it is null, so only what this call adds has to be kept from being evaluated
        mine = F.when(own[0][0], own[0][1])
        for bad, code in own[1:]:
            mine = mine.when(bad, code)
        error, col = first_error(error, mine), F.when(mine.isNull(), col)
    state = None
    if name == "try_cast" and (len(built) < 3 or built[2].literal == "invalid"):  # an invalid value, not an error
        found = casting(scope, built[0], scope.constant(built[1], "cast: type"))
        state = F.when(F.coalesce(found[0][0], F.lit(False)), found[0][1]) if found else None
    if error is None:
        return Value(out.col, out.probe, out.literal, out.is_literal, state=state)
    return Value(col, out.probe, error=error, state=state)
