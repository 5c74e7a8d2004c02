"""Exact nearest-rank quantiles of all groups at once, without any group's values in one task.

Three passes narrow every group's answer down together. The first keeps a sketch of each group's values (mergeable, of bounded size) and
brackets the rank by two of its thousandths; the second counts exactly what lies below the bracket and sketches what lies inside; the
third counts the distinct values of the inner bracket, about a hundred-thousandth of the group, and picks the one whose running count reaches the
rank. Ranks come from exact counts only, so the sketches' errors decide how much is left to count, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEPS, ACCURACY = 1000, 10_000


@dataclass(frozen=True)
class Wanted:
    """name: of the result; column: of numbers in the frame; q: the share; distinct: each value once."""

    name: str
    column: str
    q: float
    distinct: bool = False


def grid(values: Column) -> Column:
    return F.percentile_approx(values, [k / STEPS for k in range(STEPS + 1)], ACCURACY)


def bracket(marks: Column, rank: Column, n: Column) -> tuple[Column, Column]:
    """The sketch's values two steps below and above a rank (from 1) of n."""
    share = (rank - 1) * F.lit(STEPS) / F.greatest(n - 1, F.lit(1))
    low = F.greatest(F.floor(share) - 2, F.lit(0)).cast("int")
    high = F.least(F.ceil(share) + 2, F.lit(STEPS)).cast("int")
    return F.get(marks, low), F.get(marks, high)


def quantiles(df: DataFrame, keys: list[tuple[str, Column]], wanted: list[Wanted]) -> DataFrame:
    """keys and one column for each wanted quantile, null where a group has no values; groups without any value are left out."""
    names = [f"__key_{i}" for i in range(len(keys))]
    by = [*names, "__which"]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(w.column).cast("double").alias("v")) for i, w in enumerate(wanted)]))
    rows = df.select(*[c.alias(n) for n, (_, c) in zip(names, keys)], cells.alias("c")).select(*names, F.col("c.which").alias("__which"), F.col("c.v").alias("__v")).filter("__v IS NOT NULL")
    once = [i for i, w in enumerate(wanted) if w.distinct]
    if once:
        single = rows.filter(F.col("__which").isin(once)).distinct()
        rows = single if len(once) == len(wanted) else rows.filter(~F.col("__which").isin(once)).unionByName(single)
    share = F.element_at(F.create_map(*[F.lit(x) for i, w in enumerate(wanted) for x in (i, float(w.q))]), F.col("__which"))

    def meets(other: DataFrame) -> Column:
        same = F.lit(True)
        for c in by:
            same = same & rows[c].eqNullSafe(other[f"o{c}"])
        return same

    def renamed(found: DataFrame) -> DataFrame:
        return found.select(*[F.col(c).alias(f"o{c}") for c in by], *[c for c in found.columns if c not in by])

    first = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), grid(F.col("__v")).alias("marks"))
    rank = F.greatest(F.ceil(share * F.col("n") - F.lit(1e-9)), F.lit(1))
    low, high = bracket(F.col("marks"), F.col("rank"), F.col("n"))
    first = renamed(first.withColumn("rank", rank).withColumn("low", low).withColumn("high", high).drop("marks"))

    v = F.col("__v")
    inside = (v >= F.col("low")) & (v <= F.col("high"))
    second = rows.join(first, meets(first)).groupBy(*by, "rank", "low", "high").agg(F.count_if(v < F.col("low")).alias("below"), F.count_if(inside).alias("n"), grid(F.when(inside, v)).alias("marks"))
    # Were a sketch ever wrong by more than its bound, the bracket is left open on that side.
    fits_low, fits_high = F.col("rank") > F.col("below"), F.col("rank") <= F.col("below") + F.col("n")
    low, high = bracket(F.col("marks"), F.col("rank") - F.col("below"), F.col("n"))
    second = renamed(second.select(*by, "rank", F.when(fits_low & fits_high, low).when(fits_low, F.col("low")).otherwise(F.lit(float("-inf"))).alias("low"),
                                   F.when(fits_low & fits_high, high).when(fits_high, F.col("high")).otherwise(F.lit(float("nan"))).alias("high")))

    third = rows.join(second, meets(second)).filter(v <= F.col("high"))
    counted = third.groupBy(*by, "rank", F.when(v >= F.col("low"), v).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") >= F.col("rank"))
    out = reached.groupBy(*names).agg(*[F.min(F.when(F.col("__which") == i, F.col("value"))).alias(w.name) for i, w in enumerate(wanted)])
    return out.select(*[F.col(n).alias(k) for n, (k, _) in zip(names, keys)], *[w.name for w in wanted])
