"""Approximate nearest neighbours by a hash-prefix forest (operator 8).

Vectors are dealt over shards by a hash of their id, at most about `shard_rows` each, whatever the data look like. In a
shard every tree gives each vector a long hash string, a row of characters, each the largest coordinate (and its sign) of
a random projection to eight dimensions; a tree is the sorted array of these strings. A query descends every tree to
its longest matching prefixes by binary search and then ascends all trees in step, one character shorter at a time,
until at least `share` of the shard are candidates (in the end all are, so no query lacks neighbours). Candidates are
ranked by their exact cosine on the original vectors (scaled by their largest component first), and the shards' best are merged. Queries meet the shards in
blocks; a shard and a block have bounded sizes.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without vec_id take no
part; vectors meet only those of their own length; equal vectors and repeated ids are rows of their own, except that a
query never finds its own id; ties go to the smaller vec_id; an empty table gives an empty result; extra columns are not
carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TREES, CHARACTERS, WIDTH = 100, 8, 8
#: More than rounding can move a product of unit vectors.
MARGIN = 1e-9
RESULT = "query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def strings(unit: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The hash string of each unit vector as an integer, four bits a character."""
    rng = np.random.default_rng([seed, tree])
    out = np.zeros(len(unit), np.int64)
    for _ in range(CHARACTERS):
        p = unit @ rng.standard_normal((unit.shape[1], WIDTH)).astype(np.float32)
        top = np.abs(p).argmax(axis=1)
        out = out << 4 | (top * 2 + (p[np.arange(len(p)), top] > 0))
    return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that huge and tiny ones keep their direction."""
    if not vectors.size:
        return vectors
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in extended precision, rounded once; each row is summed on its own in one order, so equal rows have equal scores wherever they stand."""
    a, b = (x / np.abs(x).max(axis=-1, keepdims=True) for x in (rows.astype(np.longdouble), query.astype(np.longdouble)))
    found = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum())
    return np.clip(found.astype(np.float64), -1, 1)


def best_of(ids: np.ndarray, vectors: np.ndarray, unit: np.ndarray, at: np.ndarray, query: np.ndarray, unit_query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k nearest rows among `at`; rough products choose the rows that can be among them, ties included."""
    rough = unit[at] @ unit_query
    if len(at) > k:
        at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - MARGIN]
    score = cosines(vectors[at], query)
    best = np.lexsort((ids[at], -score))[:k]
    return ids[at][best], score[best]


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) ordered by id."""
    ids = table["vec_id"].to_numpy()
    flat = pa.concat_arrays([c.flatten() for c in table["vector"].chunks]).to_numpy() if len(table) else np.zeros(0)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0))


def search(share: float, k: int, seed: int):
    """A cogroup function: the k best of a shard for each query of a block."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        ids, vectors = matrix(index)
        q_ids, queries = matrix(asked)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(q_ids):
            double, q_double = unit_rows(vectors), unit_rows(queries)
            unit, q_unit = double.astype(np.float32), q_double.astype(np.float32)
            trees = []
            for tree in range(TREES):
                keys = strings(unit, tree, seed)
                order = np.argsort(keys, kind="stable")
                trees.append((order, keys[order], strings(q_unit, tree, seed)))
            enough = min(len(ids), max(10 * k, int(np.ceil(share * len(ids)))))
            # bounds[depth][tree]: where each query's prefix of that length begins and ends in the sorted array.
            bounds = []
            for depth in range(CHARACTERS + 1):
                shift = 4 * (CHARACTERS - depth)
                bounds.append([(np.searchsorted(keys, q >> shift << shift), np.searchsorted(keys, (q >> shift) + 1 << shift)) for _, keys, q in trees])
            for i in range(len(q_ids)):
                marked = np.zeros(len(ids), bool)
                for depth in range(CHARACTERS, -1, -1):
                    for (order, _, _), (low, high) in zip(trees, bounds[depth]):
                        if high[i] > low[i]:
                            marked[order[low[i]:high[i]]] = True
                        if not depth:
                            break
                    if marked.sum() > enough or marked.all():
                        break
                at = np.flatnonzero(marked & (ids != q_ids[i]))
                near, score = best_of(ids, vectors, double, at, queries[i], q_double[i], k)
                found.append((np.full(len(near), q_ids[i]), near, score))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)), "score": pa.array(parts[2].astype(np.float64))})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, share: float = 0.15, shard_rows: int = 16_384, block_rows: int = 2_048,
            vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of all rows for each row where `queries` holds."""
    rows = vectors.filter(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = materialize(rows.filter(usable("vector")).withColumn("dim", F.size("vector")), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // shard_rows)), max(1, -(-(n["q"] or 0) // block_rows))
    index = rows.select("dim", "vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = rows.filter("asks").select("dim", "vec_id", "vector", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(blocks)).cast("int").alias("block"),
                                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    keys = ["dim", "shard", "block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search(share, k, seed), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
