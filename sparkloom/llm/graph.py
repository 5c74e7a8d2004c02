"""Connected components of an edge list by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) of every node of the edges; component is its smallest reachable node.

    Each round is two shuffles of the edge list (never larger than at the start); rounds grow with the logarithm of
    the longest path. Minima are pre-aggregated, so a hub of any degree costs one row a task; joins back to a hub are
    split by AQE.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    now = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b").distinct(), "edges")
    told = None
    while True:
        near = both(now)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges-large")
        # Every edge is (larger, smaller) now.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.*").filter("a <> b").distinct(), "edges")
        drop_materialized(large)
        drop_materialized(now)
        now = new
        said = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (said["n"], said["h"]) == told:
            break
        told = (said["n"], said["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
