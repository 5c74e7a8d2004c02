"""Seeded samples and splits: rows are ranked by a digest of seed and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import ActionError, Context, action

#: Seed where none is given.
SEED = 20_26
#: Hexadecimal digits by which the place of a cut is narrowed down at a time, and the most rows in which it is then sought.
DIGITS, MOST_ROWS = 3, 4096


def rank_of(df: DataFrame, seed: int, ctx: Context) -> Column:
    """32 hexadecimal digits: a digest of the seed and the row id, or of the seed and the whole row where a frame has no row id."""
    names = sorted(df.columns)
    row = F.col(ctx.row_id).cast("string") if ctx.row_id in names else F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row).cast("binary"))


def least(ranked: DataFrame, n: int) -> DataFrame:
    """The n rows of least __rank. The cut is narrowed down by counts of rank prefixes, so no task takes up the rows before it."""
    prefix, below, inside = "", 0, None
    while inside is None or (inside > MOST_ROWS and len(prefix) < 30):
        counts = ranked.filter(F.startswith("__rank", F.lit(prefix))).groupBy(F.substring("__rank", 1, len(prefix) + DIGITS).alias("p")).count().orderBy("p").collect()
        for r in counts:
            if below + r["count"] > n:
                prefix, inside = r["p"], r["count"]
                break
            below += r["count"]
        else:
            return ranked  # as many rows as there are
    rest = ranked.filter(F.startswith("__rank", F.lit(prefix))).orderBy("__rank").limit(n - below)
    return ranked.filter(F.col("__rank") < prefix).unionByName(rest)


@action("sample")
def sample(frames, target, p, ctx: Context):
    """The rows of least rank, in rank order: `count` of them, or the whole part of `fraction` of all."""
    df = frames[target]
    ranked = df.withColumn("__rank", rank_of(df, int(p.get("seed", SEED)), ctx))
    n = int(p["count"]) if "count" in p else int(df.count() * float(p["fraction"]))
    if n < 0:
        raise ActionError("sample: a negative number of rows")
    return {target: least(ranked, n).orderBy("__rank").select(*df.columns)}


@action("random_split")
def random_split(frames, target, p, ctx: Context):
    """Each row goes to the output in whose share of the weights its rank falls."""
    df = frames[target]
    share = F.conv(F.substring("__rank", 1, 13), 16, 10).cast("double") / float(1 << 52)
    ranked = df.withColumn("__rank", rank_of(df, int(p.get("seed", SEED)), ctx)).withColumn("__share", share)
    weights, low, out = [float(w) for w in p["weights"]], 0.0, {}
    for k, (name, w) in enumerate(zip(p["outputs"], weights)):
        high = low + w / sum(weights)
        here = F.col("__share") >= low
        out[name] = ranked.filter(here if k == len(weights) - 1 else here & (F.col("__share") < high)).select(*df.columns)
        low = high
    return out
