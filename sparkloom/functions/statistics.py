"""Statistics over arguments or lists, without grouping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import Scope, Value, map_value
from .registry import columns, values


def numbers(scope: Scope, args) -> Value:
    """The non-null numbers of the arguments, or of the one list given."""
    if len(args) == 1 and isinstance(scope.type_of(args[0]), T.ArrayType):
        listed = map_value(lambda x: x.cast("array<double>"), args[0])
    else:
        listed = map_value(lambda *x: F.array(*[v.cast("double") for v in x]), *args)
    return map_value(lambda x: F.filter(x, lambda v: v.isNotNull()), listed)


def mode_of(args):
    if args and args[-1].is_literal and args[-1].literal in ("sample", "population"):
        return args[:-1], args[-1].literal
    return args, "sample"


def bound(value, fn):
    """fn of a value that is computed once, however often fn names it, lambdas included."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(xs):
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def spread(xs, mode):
    def around(xs, n, mean):
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1 if mode == "sample" else n)

    return bound(xs, lambda xs: F.when(F.size(xs) >= 2, bound(total(xs) / F.size(xs), lambda mean: around(xs, F.size(xs), mean))))


@values("variance", 1, None)
def variance(scope: Scope, *args: Value) -> Value:
    args, mode = mode_of(args)
    return map_value(lambda xs: spread(xs, mode), numbers(scope, args))


@values("stddev", 1, None)
def stddev(scope: Scope, *args: Value) -> Value:
    args, mode = mode_of(args)
    return map_value(lambda xs: F.sqrt(spread(xs, mode)), numbers(scope, args))


def paired(a, b):
    # The shorter list is filled up with nulls, which the filter drops.
    both = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.filter(both, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def moments(a, b, fn):
    """fn of the number of pairs and their sums of xy, xx and yy around the means, null for fewer than two pairs."""
    sums = lambda *names: F.struct(*[F.lit(0.0).alias(n) for n in names])
    added = lambda s, **more: F.struct(*[(s[n] + v).alias(n) for n, v in more.items()])

    def around(pairs, s):
        n = F.size(pairs)
        dx, dy = (lambda p: p["x"] - s["x"] / n), (lambda p: p["y"] - s["y"] / n)
        found = F.aggregate(pairs, sums("xy", "xx", "yy"), lambda t, p: added(t, xy=dx(p) * dy(p), xx=dx(p) * dx(p), yy=dy(p) * dy(p)))
        return bound(found, lambda t: fn(n, t["xy"], t["xx"], t["yy"]))

    return bound(paired(a, b), lambda pairs: F.when(F.size(pairs) >= 2, bound(
        F.aggregate(pairs, sums("x", "y"), lambda t, p: added(t, x=p["x"], y=p["y"])), lambda s: around(pairs, s))))


@values("covariance", 2, 3)
def covariance(scope: Scope, a: Value, b: Value, mode: Value | None = None) -> Value:
    sample = not (mode and scope.constant(mode, "covariance: mode") == "population")

    return map_value(lambda x, y: moments(x, y, lambda n, xy, xx, yy: xy / (n - 1 if sample else n)), a, b)


@columns("correlation", 2)
def correlation(a, b):
    return moments(a, b, lambda n, xy, xx, yy: F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy)))


def nearest_rank(xs, q):
    def pick(xs):
        return F.get(xs, (F.greatest(F.ceil(F.size(xs) * q), F.lit(1)) - 1).cast("int"))

    return bound(F.sort_array(xs), pick)


@values("median", 1, None)
def median(scope: Scope, *args: Value) -> Value:
    return map_value(lambda xs: nearest_rank(xs, F.lit(0.5)), numbers(scope, args))


@values("quantile", 2, None)
def quantile(scope: Scope, *args: Value) -> Value:
    q = float(scope.constant(args[-1], "quantile: q"))
    if not 0 <= q <= 1:
        raise ValueError("quantile: q must lie between 0 and 1")
    return map_value(lambda xs: nearest_rank(xs, F.lit(q)), numbers(scope, args[:-1]))


columns("first", 1, None)(lambda *v: v[0])
columns("last", 1, None)(lambda *v: v[-1])
columns("collect_set", 1, None)(lambda *v: F.array_sort(F.array_distinct(F.array(*v))))
