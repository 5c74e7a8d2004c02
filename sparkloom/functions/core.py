"""Operators, conditionals, null states and mathematics."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import Scope, Value, literal, map_value
from .registry import columns, values

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
RUN_ID, RUN_TIMESTAMP = str(uuid.uuid4()), datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")

columns("eq null_safe_eq", 2)(lambda a, b: a.eqNullSafe(b))
columns("not_eq", 2)(lambda a, b: ~a.eqNullSafe(b))
columns("lt", 2)(lambda a, b: a < b)
columns("lte", 2)(lambda a, b: a <= b)
columns("gt", 2)(lambda a, b: a > b)
columns("gte", 2)(lambda a, b: a >= b)
# `when` keeps the right side from being evaluated where the left decides.
columns("and", 2)(lambda a, b: F.when(a, b).otherwise(a))
columns("or", 2)(lambda a, b: F.when(a, a).otherwise(b))
columns("not", 1)(lambda a: ~a)
columns("subtract", 2)(lambda a, b: a - b)
columns("multiply", 2)(lambda a, b: a * b)
columns("modulo", 2)(lambda a, b: a % b)
columns("negate", 1)(lambda a: -a)
columns("between", 3)(lambda v, low, high: v.between(low, high))


@values("add", 2)
def add(scope: Scope, a: Value, b: Value) -> Value:
    text = isinstance(scope.type_of(a), T.StringType) and isinstance(scope.type_of(b), T.StringType)
    return map_value(F.concat if text else (lambda x, y: x + y), a, b)


@values("divide", 2)
def divide(scope: Scope, a: Value, b: Value) -> Value:
    """Whole numbers divide to whole numbers (towards zero); a zero divisor raises."""
    if isinstance(scope.type_of(a), WHOLE) and isinstance(scope.type_of(b), WHOLE):
        return map_value(lambda x, y: F.call_function("div", x, y), a, b)
    return map_value(lambda x, y: F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(x / y), a, b)


@values("in", 2)
def member(scope: Scope, item: Value, of: Value) -> Value:
    if isinstance(scope.type_of(of), T.ArrayType):
        return map_value(lambda x, y: F.exists(y, lambda e: e.eqNullSafe(x)), item, of)
    return map_value(lambda x, y: F.contains(y, x), item, of)


@values("has", 2)
def has(scope: Scope, of: Value, item: Value) -> Value:
    return member(scope, item, of)


columns("coalesce", 1, None)(F.coalesce)
columns("if_null", 2)(lambda v, d: F.coalesce(v, d))
columns("is_null", 1)(lambda v: v.isNull())


@values("is_invalid", 1)
def is_invalid(scope: Scope, v: Value) -> Value:
    """Whether the frame marks the field as invalid."""
    return literal(False) if v.state is None else Value(v.state.isNotNull(), F.lit(None).cast("boolean"))


@values("is_missing", 1)
def is_missing(scope: Scope, v: Value) -> Value:
    """Whether the row lacks the field, where the frame knows, or else whether the frame lacks the column (an absent column is a typeless null)."""
    if v.missing is not None:
        return Value(v.missing, F.lit(None).cast("boolean"))
    return literal(isinstance(scope.type_of(v), T.NullType))


@values("null_if", 2)
def null_if(scope: Scope, a: Value, b: Value) -> Value:
    """Null where both are equal and of one type."""
    if scope.type_of(a) != scope.type_of(b):
        return a
    return map_value(lambda x, y: F.when(x.eqNullSafe(y), F.lit(None)).otherwise(x), a, b)


@columns("case_when", 2, None)
def case_when(*args):
    pairs, rest = args[: len(args) // 2 * 2], args[len(args) // 2 * 2:]
    out = None
    for test, value in zip(pairs[::2], pairs[1::2]):
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(rest[0]) if rest else out


columns("abs", 1)(F.abs)
columns("floor", 1)(lambda x: F.floor(x).cast("double"))
columns("ceil", 1)(lambda x: F.ceil(x).cast("double"))
columns("power", 2)(lambda x, y: F.pow(x.cast("double"), y.cast("double")))
columns("sqrt", 1)(lambda x: F.when(x < 0, F.raise_error(F.lit("sqrt of a negative number")).cast("double")).otherwise(F.sqrt(x.cast("double"))))


@columns("round", 1, 2)
def round_(x, digits=None):
    """Half away from zero at the scaled number, as a double."""
    scale = F.pow(F.lit(10.0), F.lit(0) if digits is None else digits)
    scaled = x.cast("double") * scale
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / scale


def any_null(args):
    out = args[0].isNull()
    for a in args[1:]:
        out = out | a.isNull()
    return out


@columns("min least", 2, None)
def least(*args):
    return F.when(~any_null(args), F.least(*[a.cast("double") for a in args]))


@columns("max greatest", 2, None)
def greatest(*args):
    return F.when(~any_null(args), F.greatest(*[a.cast("double") for a in args]))


columns("uuid", 0)(lambda: F.uuid())
columns("run_id", 0)(lambda: F.lit(RUN_ID))
columns("run_timestamp", 0)(lambda: F.lit(RUN_TIMESTAMP))


#: Constants of the xorshift64* generator (fixed values): what a zero seed becomes, the shifts, the multiplier.
ZERO_SEED, SHIFTS, MULTIPLIER = 0xD7C53A21, (13, 7, 17), 0x2545F4914F6CDD1D
WORD = (1 << 64) - 1


def step(state: int) -> int:
    """The generator's next state."""
    state = state or ZERO_SEED
    state ^= state << SHIFTS[0] & WORD
    state ^= state >> SHIFTS[1]
    return (state ^ state << SHIFTS[2]) & WORD


def draws(seed: int, n: int) -> list[float]:
    """The first n numbers in [0, 1) of a seed; a constant seed gives constants."""
    state, out = seed & WORD, []
    for _ in range(n):
        state = step(state)
        out.append((state * MULTIPLIER & WORD) >> 11)
    return [x / (1 << 53) for x in out]


@values("random", 0, 1)
def random(scope: Scope, seed: Value | None = None) -> Value:
    if seed is None:
        return map_value(lambda: F.rand())
    return literal(draws(int(scope.constant(seed, "seed")), 1)[0])


@values("random_normal", 0, 3)
def random_normal(scope: Scope, seed: Value | None = None, mean: Value | None = None, sd: Value | None = None) -> Value:
    import math

    mu, sigma = (float(scope.constant(v, "parameter")) if v else d for v, d in ((mean, 0.0), (sd, 1.0)))
    if sigma < 0:
        raise ValueError("random_normal: negative standard deviation")
    if seed is None:
        return map_value(lambda: F.randn() * sigma + mu)
    a, b = draws(int(scope.constant(seed, "seed")), 2)
    return literal(mu + sigma * math.sqrt(-2 * math.log(max(a, 1e-300))) * math.cos(2 * math.pi * b))
