"""String and regular-expression functions. Positions count code points from 0."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import Scope, Value, map_value
from ..expressions.parse import ExpressionError
from .registry import columns, values

columns("lower lower_unicode casefold", 1)(F.lower)
columns("upper upper_unicode", 1)(F.upper)
columns("normalize_whitespace", 1)(lambda s: F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "^ | $", ""))
columns("concat", 2, None)(F.concat)
columns("replace", 3)(lambda s, a, b: F.replace(s, a, b))
columns("contains", 2)(lambda s, n: F.contains(s, n))
columns("starts_with", 2)(lambda s, n: F.startswith(s, n))
columns("ends_with", 2)(lambda s, n: F.endswith(s, n))
columns("reverse", 1)(F.reverse)
columns("position", 2)(lambda s, n: F.call_function("locate", n, s).cast("bigint") - 1)
columns("split", 2, 3)(lambda s, sep, _=None: F.split(s, F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1))
columns("concat_ws", 2, None)(lambda sep, *v: F.call_function("concat_ws", sep, *v))


def trimmed(pattern: str, some):
    def fn(s, chars=None):
        return F.regexp_replace(s, pattern, "") if chars is None else some(s, chars)

    return fn


columns("trim", 1, 2)(trimmed(r"(?U)^\s+|\s+$", lambda s, c: F.btrim(s, c)))
columns("ltrim", 1, 2)(trimmed(r"(?U)^\s+", lambda s, c: F.ltrim(s, c)))
columns("rtrim", 1, 2)(trimmed(r"(?U)\s+$", lambda s, c: F.rtrim(s, c)))


@columns("substr", 2, 3)
def substr(s, start, n=None):
    bad = (start < 0) if n is None else (start < 0) | (n < 0)
    rest = F.char_length(s)
    part = F.substring(s, (start + 1).cast("int"), rest if n is None else n.cast("int"))
    return F.when(bad, F.raise_error(F.lit("substr: negative start or length"))).otherwise(part)


@values("length", 1)
def length(scope: Scope, s: Value) -> Value:
    """Code points of a string; for binary, the length of its base64 text."""
    if isinstance(scope.type_of(s), T.BinaryType):
        return map_value(lambda x: F.char_length(F.base64(x)).cast("bigint"), s)
    return map_value(lambda x: F.char_length(x).cast("bigint"), s)


@columns("join_strings", 2)
def join_strings(parts, sep):
    gap = F.exists(parts, lambda x: x.isNull())
    return F.when(gap, F.raise_error(F.lit("join_strings: null element"))).otherwise(F.call_function("array_join", parts, sep))


def padded(pad):
    def fn(s, n, fill=None):
        fill = F.lit(" ") if fill is None else fill
        return F.when((n < 0) | (fill == ""), F.raise_error(F.lit("pad: negative length or empty fill"))).when(
            F.char_length(s) >= n, s).otherwise(F.call_function(pad, s, n.cast("int"), fill))

    return fn


columns("pad_left", 2, 3)(padded("lpad"))
columns("pad_right", 2, 3)(padded("rpad"))


@columns("repeat", 2)
def repeat(s, n):
    return F.when((n < 0) | (n > 1_000_000), F.raise_error(F.lit("repeat: count out of range"))).otherwise(F.call_function("repeat", s, n.cast("int")))


@values("translate", 3)
def translate(scope: Scope, s: Value, old: Value, new: Value) -> Value:
    """A character without counterpart is kept."""
    a, b = scope.constant(old, "translate: characters"), scope.constant(new, "translate: characters")
    return map_value(lambda x: F.translate(x, a, b + a[len(b):]), s)


def gate(pattern: str) -> str:
    """Only patterns without look-around, backreferences and possessive quantifiers, of at most 16 KiB."""
    if len(pattern.encode()) > 16 * 1024 or re.search(r"\(\?<?[=!]|\\[1-9]|\\k<|[*+?}]\+|\(\?>", pattern):
        raise ExpressionError(f"regular expression not allowed: {pattern[:80]!r}")
    return "(?U)" + pattern


def with_pattern(name: str, least: int, most: int, fn) -> None:
    @values(name, least, most)
    def built(scope: Scope, s: Value, pattern: Value, *rest: Value) -> Value:
        text = gate(scope.constant(pattern, f"{name}: pattern"))
        return map_value(lambda x, *r: fn(x, text, *r), s, *rest)


def extracted(s, pattern, group=None):
    n = F.lit(0) if group is None else group.cast("int")
    return F.when(F.rlike(s, F.lit(pattern)), F.call_function("regexp_extract", s, F.lit(pattern), n))


with_pattern("regex_matches", 2, 2, lambda s, p: F.rlike(s, F.lit(f"\\A(?:{p})\\z")))
with_pattern("regex_contains", 2, 2, lambda s, p: F.rlike(s, F.lit(p)))
with_pattern("regex_replace", 3, 3, lambda s, p, r: F.regexp_replace(s, F.lit(p), r))
with_pattern("regex_extract", 2, 3, extracted)
with_pattern("regex_extract_all", 2, 3, lambda s, p, g=None: F.regexp_extract_all(s, F.lit(p), F.lit(0) if g is None else g.cast("int")))
with_pattern("regex_split", 2, 2, lambda s, p: F.split(s, p, -1))
