"""Balanced label propagation over shards, native (operator 4).

Documents of one group (equal texts) are linked. Each starts in a shard chosen by a hash of its id; in every round each
group looks at the shards of its members (a join of the flow table with the group's preference) and moves members
towards the shard where most of them are, as far as that shard's capacity quota allows. Documents without links then
even out the shards exactly. State is kept per (group, shard) with a count, so a group of any size is at most
`n_shards` rows; only counts per shard (n_shards rows) reach the driver. Documents take their shards by rank in their
group, and ranks are salted, so a group that holds a third of all rows is never in one task.

Law of the result: `rows`, shard sizes differ by one row at most.

Defined cases: null text counts as empty (size 8, CRC 0), and all empty texts are one group; a null doc_id is kept and
ordered first; repeated rows are separate documents of one group; an empty table gives an empty result; extra columns
are not carried; ties between shards go to a hash of group and shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_materialized, global_rank, materialize, prefix_sum, whole_text


def per_shard(values: dict[int, int], n_shards: int, shard: Column) -> Column:
    """A driver-side count per shard as an expression (n_shards literals)."""
    return F.get(F.array(*[F.lit(int(values.get(s, 0))).cast("long") for s in range(n_shards)]), shard)


def loads(flows: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in flows.groupBy("shard").agg(F.sum("n").alias("n")).collect()}


def cut(linked: DataFrame) -> int:
    """Members of groups that are not in the shard that holds most of their group."""
    return linked.groupBy("grp").agg((F.sum("n") - F.max("n")).alias("off")).agg(F.sum("off")).first()[0] or 0


def propagate(linked: DataFrame, n_shards: int, capacity: int, rounds: int, patience: int = 2, gain: float = 0.01) -> DataFrame:
    """Move members of the groups in linked(grp, shard, n) together, under `capacity` linked documents a shard.

    Rounds go on until nothing is cut, nothing can move, or the cut has fallen by less than `gain` of itself for `patience` rounds.
    """
    least, idle = cut(linked), 0
    for turn in range(rounds):
        if not least or idle >= patience:
            break
        load = loads(linked)
        room = {s: max(0, capacity - load.get(s, 0)) for s in range(n_shards)}
        free = per_shard(room, n_shards, F.col("shard"))
        choice = linked.groupBy("grp").agg(
            F.max_by("shard", F.struct(free > 0, F.col("n"), F.xxhash64("grp", "shard", F.lit(turn)))).alias("to"))
        wish = linked.join(choice, "grp").filter(F.col("shard") != F.col("to"))
        wish = materialize(wish, "shard-wishes")
        queued = prefix_sum(wish, ["to"], F.col("n"), [F.col("grp"), F.col("shard")], "ahead")
        left = per_shard(room, n_shards, F.col("to")) - F.col("ahead")
        moves = queued.select("grp", "shard", "to", F.greatest(F.lit(0).cast("long"), F.least("n", left)).alias("m")).filter("m > 0")
        moves = materialize(moves, "shard-moves")
        stuck = moves.isEmpty()
        if not stuck:
            before, linked = linked, materialize(
                linked.unionByName(moves.select("grp", "shard", (-F.col("m")).alias("n")))
                .unionByName(moves.select("grp", F.col("to").alias("shard"), F.col("m").alias("n")))
                .groupBy("grp", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shard-linked")
            if turn:
                drop_materialized(before)
        drop_materialized(wish)
        drop_materialized(moves)
        if stuck:
            break
        now = cut(linked)
        least, idle = min(now, least), 0 if now < (1 - gain) * least else idle + 1
    return linked


def cut_links(placed: DataFrame) -> DataFrame:
    """One row for placed(text_crc32, size, shard): groups of equal texts, groups that lie in several shards, and members cut off."""
    per = placed.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("text_crc32", "size").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("shards")).filter("n > 1")
    return per.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.when(F.col("shards") > 1, 1).otherwise(0)), F.lit(0)).alias("split_groups"),
                   F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def even_out(flows: DataFrame, n_shards: int) -> DataFrame:
    """Move the surplus of each shard, documents without links first, to those that lack rows; sizes then differ by one at most."""
    load = loads(flows)
    total = sum(load.values())
    ranked = sorted(range(n_shards), key=lambda s: (-load.get(s, 0), s))
    target = {s: total // n_shards + (k < total % n_shards) for k, s in enumerate(ranked)}
    surplus = {s: max(0, load.get(s, 0) - target[s]) for s in target}
    before, bounds, lack = {}, [], 0
    for s in range(n_shards):
        before[s] = sum(surplus[x] for x in range(s))
        if (d := target[s] - load.get(s, 0)) > 0:
            bounds.append((lack, lack + d, s))
            lack += d
    if not lack:
        return flows
    queued = prefix_sum(flows, ["shard"], F.col("n"), [F.col("grp")], "ahead", first=["linked"])
    leaving = F.greatest(F.lit(0).cast("long"), F.least("n", per_shard(surplus, n_shards, F.col("shard")) - F.col("ahead")))
    queued = queued.withColumn("m", leaving)
    start = per_shard(before, n_shards, F.col("shard")) + F.col("ahead")
    open_shards = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(s).alias("s")) for a, b, s in bounds])
    gone = (
        queued.filter("m > 0").withColumn("__from", start).withColumn("__to", start + F.col("m"))
        .withColumn("x", F.explode(F.filter(open_shards, lambda x: (x["a"] < F.col("__to")) & (x["b"] > F.col("__from")))))
        .select("grp", F.col("x.s").alias("shard"), (F.least("x.b", "__to") - F.greatest("x.a", "__from")).alias("n"), "linked")
    )
    stay = queued.select("grp", "shard", (F.col("n") - F.col("m")).alias("n"), "linked").filter("n > 0")
    return stay.unionByName(gone).groupBy("grp", "shard", "linked").agg(F.sum("n").alias("n"))


def assign(docs: DataFrame, n_shards: int = 24, text: str = "text", doc_id: str = "doc_id", rounds: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    body = whole_text(docs, text)
    rows = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("grp")), "shard-rows")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int")
    flows = rows.withColumn("shard", first).groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    flows = materialize(flows.withColumn("linked", F.sum("n").over(Window.partitionBy("grp")) > 1), "shard-flows")
    total = flows.agg(F.sum("n")).first()[0] or 0
    linked = propagate(flows.filter("linked").drop("linked"), n_shards, math.ceil(total / n_shards), rounds)
    flows = materialize(flows.filter(~F.col("linked")).unionByName(linked.withColumn("linked", F.lit(True))), "shard-labels")
    flows = even_out(flows, n_shards)
    upto = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    shares = flows.withColumn("upto", F.sum("n").over(upto)).groupBy("grp").agg(
        F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("shares"))
    ranked = global_rank(rows, ["grp"], [F.col("doc_id")], "member")
    taken = F.filter("shares", lambda x: x["upto"] > F.col("member"))
    placed = materialize(
        ranked.join(shares, "grp").select("doc_id", "size", "text_crc32", "grp", F.get(taken, F.lit(0))["shard"].alias("shard")), "shard-placed")
    return global_rank(placed, ["shard"], [F.col("grp"), F.col("doc_id")], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
