"""Dates, times and zones. Timestamps are instants shown in the session's zone, which is UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import Scope, Value, map_value
from ..expressions.parse import ExpressionError
from .registry import columns, values

#: The reference clock of current_date and current_timestamp; a run may set another.
CLOCK = {"now": datetime(2026, 1, 1)}
UNITS = ("year", "month", "day", "hour", "minute", "second")

columns("current_timestamp", 0)(lambda: F.lit(CLOCK["now"]))
columns("current_date", 0)(lambda: F.lit(CLOCK["now"].date()))


def unit_of(scope: Scope, unit: Value | None, allowed: tuple[str, ...] = UNITS) -> str:
    name = scope.constant(unit, "unit") if unit else "day"
    if name not in allowed:
        raise ExpressionError(f"unknown unit {name!r}")
    return name


def moment(scope: Scope, v: Value) -> Value:
    """Strings become timestamps, or dates if they hold no time."""
    if isinstance(scope.type_of(v), T.StringType):
        return map_value(lambda s: s.cast("timestamp"), v)
    return v


@values("date_add", 2, 3)
def date_add(scope: Scope, v: Value, n: Value, unit: Value | None = None) -> Value:
    name, v = unit_of(scope, unit, UNITS[:5]), moment(scope, v)
    if isinstance(scope.type_of(v), T.DateType) and name in ("day", "month", "year"):
        if name == "day":
            return map_value(lambda d, k: F.date_add(d, k.cast("int")), v, n)
        return map_value(lambda d, k: F.add_months(d, (k * (12 if name == "year" else 1)).cast("int")), v, n)
    if name in ("month", "year"):
        return map_value(lambda t, k: t + F.make_ym_interval(F.lit(0), (k * (12 if name == "year" else 1)).cast("int")), v, n)
    seconds = {"day": 86400, "hour": 3600, "minute": 60}[name]
    return map_value(lambda t, k: t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * seconds).cast("decimal(18,6)")), v, n)


@values("date_diff", 2, 3)
def date_diff(scope: Scope, a: Value, b: Value, unit: Value | None = None) -> Value:
    """a - b; months and years compare calendar fields only, hours and minutes drop the rest."""
    name, a, b = unit_of(scope, unit, UNITS[:5]), moment(scope, a), moment(scope, b)
    if name == "day":
        return map_value(lambda x, y: F.datediff(x, y).cast("bigint"), a, b)
    if name == "year":
        return map_value(lambda x, y: (F.year(x) - F.year(y)).cast("bigint"), a, b)
    if name == "month":
        return map_value(lambda x, y: (F.year(x) * 12 + F.month(x) - F.year(y) * 12 - F.month(y)).cast("bigint"), a, b)
    seconds = 3600 if name == "hour" else 60
    return map_value(lambda x, y: F.call_function("div", F.unix_timestamp(x.cast("timestamp")) - F.unix_timestamp(y.cast("timestamp")), F.lit(seconds).cast("bigint")), a, b)


@values("date_trunc", 2)
def date_trunc(scope: Scope, v: Value, unit: Value) -> Value:
    name = unit_of(scope, unit)
    return map_value(lambda t: F.date_trunc(name, t), moment(scope, v))


@values("extract date_part", 2)
def extract(scope: Scope, a: Value, b: Value) -> Value:
    """Unit and value in either order."""
    unit, v = (a, b) if a.is_literal and a.literal in UNITS else (b, a)
    name = unit_of(scope, unit)
    return map_value(lambda t: F.extract(F.lit(name), t).cast("bigint"), moment(scope, v))


def with_offset(t, zone):
    """RFC 3339 text of the instant t in a zone."""
    local = F.from_utc_timestamp(t, zone)
    minutes = F.call_function("div", F.unix_timestamp(local) - F.unix_timestamp(t), F.lit(60).cast("bigint"))
    size = F.abs(minutes)
    hours, rest = F.call_function("div", size, F.lit(60).cast("bigint")), size % 60
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(minutes < 0, "-").otherwise("+"),
                    F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.lpad(rest.cast("string"), 2, "0"))


columns("to_timezone from_utc at_timezone", 2)(lambda t, zone: with_offset(t.cast("timestamp"), zone))


def local_time(text, z):
    """(the earlier and the later instant of a local time, whether it never occurs, whether it occurs twice)"""
    t = text.cast("timestamp")
    early = F.to_utc_timestamp(t, z)
    late = early + F.expr("INTERVAL 1 HOUR")
    return early, late, F.from_utc_timestamp(early, z) != t, F.from_utc_timestamp(late, z) == t


@values("to_utc", 2, 4)
def to_utc(scope: Scope, local: Value, zone: Value, ambiguous: Value | None = None, nonexistent: Value | None = None) -> Value:
    """The instant of a local time; times that occur twice or never follow their policies (reject by default)."""
    twice = scope.constant(ambiguous, "to_utc: ambiguous") if ambiguous else "reject"
    never = scope.constant(nonexistent, "to_utc: nonexistent") if nonexistent else "reject"

    def fn(text, z):
        early, late, gap, overlap = local_time(text, z)
        refuse = lambda what: F.raise_error(F.lit(f"to_utc: {what} local time")).cast("timestamp")
        in_gap = early if never in ("shift_forward", "shiftForward") else refuse("nonexistent")
        in_overlap = {"earliest": early, "earlier": early, "latest": late, "later": late}.get(twice, refuse("ambiguous"))
        return F.when(gap, in_gap).when(overlap, in_overlap).otherwise(early)

    return map_value(fn, local, zone)
