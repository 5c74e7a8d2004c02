"""Casts, parsing and formatting."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import Scope, Value, map_value
from ..expressions.parse import ExpressionError
from .registry import columns, values

TARGETS = {"string": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean"}
#: strftime directives that formats may use, with Java's letters (fixed values).
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%%": "'%'"}


def java_format(fmt: str) -> str:
    out = []
    for part in re.findall(r"%.?|[^%]+", fmt, flags=re.S):
        if part[0] == "%":
            if part not in DIRECTIVES:
                raise ExpressionError(f"format directive not allowed: {part!r}")
            out.append(DIRECTIVES[part])
        else:
            out.append(re.sub(r"[A-Za-z']+", lambda m: "'" + m[0].replace("'", "''") + "'", part))
    return "".join(out)


def boolean_of(text):
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def number_text(x):
    """The shortest digits that give the number again, plain: without exponent and without a fraction of zero."""
    text = F.regexp_replace(x.cast("string"), r"\.0$", "")
    sign, digits = F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"(?<=\d)\.0$|^-|\.", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    large = F.call_function("rpad", digits, F.greatest(power + 1, F.char_length(digits)), F.lit("0"))
    large = F.when(F.char_length(digits) > power + 1, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.char_length(digits)))).otherwise(large)
    small = F.concat(F.lit("0."), F.call_function("repeat", F.lit("0"), -power - 1), digits)
    return F.when(~F.contains(text, F.lit("E")), text).otherwise(F.concat(sign, F.when(power < 0, small).otherwise(large)))


def converted(scope: Scope, v: Value, target: str, lenient: bool) -> Value:
    if target not in TARGETS:
        raise ExpressionError(f"cannot cast to {target!r}")
    kind = scope.type_of(v)
    number = isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
    if target == "boolean" and isinstance(kind, T.StringType):
        def fn(x):
            found = boolean_of(x)
            return found if lenient else F.when(x.isNotNull() & found.isNull(), F.raise_error(F.lit("cast: not a boolean")).cast("boolean")).otherwise(found)
    elif target == "string" and number:
        fn = number_text
    elif lenient:
        fn = lambda x: x.try_cast(TARGETS[target])
    else:
        fn = lambda x: x.cast(TARGETS[target])
    return map_value(fn, v)


@values("cast", 2)
def cast(scope: Scope, v: Value, target: Value) -> Value:
    return converted(scope, v, scope.constant(target, "cast: type"), False)


@values("try_cast", 2, 3)
def try_cast(scope: Scope, v: Value, target: Value, policy: Value | None = None) -> Value:
    """What cannot be cast is null (policies invalid and null) or raises (fail)."""
    how = scope.constant(policy, "try_cast: policy") if policy else "invalid"
    if how not in ("invalid", "null", "fail"):
        raise ExpressionError(f"unknown try_cast policy {how!r}")
    return converted(scope, v, scope.constant(target, "try_cast: type"), how != "fail")


@values("to_string", 1)
def to_string(scope: Scope, v: Value) -> Value:
    return converted(scope, v, "string", False)


@values("to_integer", 1)
def to_integer(scope: Scope, v: Value) -> Value:
    if isinstance(scope.type_of(v), (T.DoubleType, T.FloatType)):
        return map_value(lambda x: F.when(x != F.floor(x), F.raise_error(F.lit("to_integer: fraction")).cast("bigint")).otherwise(x.cast("bigint")), v)
    return converted(scope, v, "integer", False)


columns("to_decimal parse_decimal", 1)(lambda v: v.cast("double"))


@columns("parse_boolean", 1)
def parse_boolean(s):
    found = boolean_of(s)
    return F.when(s.isNotNull() & found.isNull(), F.raise_error(F.lit("parse_boolean: not a boolean")).cast("boolean")).otherwise(found)


def formatted(name: str, default: str, fn) -> None:
    @values(name, 1, 2)
    def built(scope: Scope, s: Value, fmt: Value | None = None) -> Value:
        java = java_format(scope.constant(fmt, f"{name}: format") if fmt else default)
        return map_value(lambda x: fn(x, java, fmt is None), s)


formatted("parse_date", "%Y-%m-%d", lambda s, f, _: F.to_date(s, f))
formatted("parse_time", "%H:%M:%S", lambda s, f, _: F.date_format(F.to_timestamp(s, f), "HH:mm:ss"))
formatted("parse_datetime", "%Y-%m-%dT%H:%M:%S", lambda s, f, _: F.coalesce(F.try_to_timestamp(F.when(F.rlike(s, F.lit(r"[Zz]|[+-]\d\d:?\d\d$")), s)), F.to_timestamp(s, f)))
formatted("format_date", "%Y-%m-%d", lambda s, f, _: F.date_format(s.cast("date"), f))
formatted("format_datetime", "%Y-%m-%dT%H:%M:%S", lambda s, f, _: F.date_format(s.cast("timestamp"), f))
