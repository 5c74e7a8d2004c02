"""Packing documents into fixed-length sequences by cutting-stock column generation (operator 2).

A document is cut into full sequences and one remainder. Remainders are counted in a histogram of 128 length classes
(at most 16 x 128 rows reach the driver). A linear program over patterns - how many remainders of each class go into one
sequence - is solved by column generation: a revised simplex basis whose new columns are priced by an unbounded-knapsack
dynamic programme over the capacity. Patterns are rounded down, the rest is packed first-fit decreasing, and the
documents of each class, ranked without a global sort, take the patterns' slots by rank. What rounding up to a class and
the patterns leave free is filled exactly by cutting a hash-chosen part of the documents freely; what remains of these
is cut into full sequences. Only the last of those sequences can be short, unless the chosen part is too small, in which
case a larger part is taken.

Defined cases: null or empty text has one token, the end id; null doc_id and repeated rows are kept as documents of
their own; an empty table gives an empty result; extra columns are not carried; ties in rank go by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, gathered, materialize, one_array, prefix_sum, global_rank, small_arrow_batches, texts_of
from .tokens import Encoder, tokenizer_path, with_end

LENGTH, CLASSES, PARTS = 4096, 128, 16
STEP = LENGTH // CLASSES
SCHEMA = "uid long, doc_id long, part int, doc_tokens long, crcs array<long>, ids binary"


def tokenised(path: str, end: int, kept_parts: range):
    """A mapInArrow function: each document's length, the CRC of each of its pieces on the grid, and its ids if its part is in kept_parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = Encoder.kept(path, spaces=False), TaskContext.get().partitionId() << 36
        for table in gathered(batches):
            counts, ids = with_end(*encoder.encode(texts_of(table)), end)
            parts, view = table["part"].to_pylist(), memoryview(ids).cast("B")
            crcs, binary, at = [], [], 0
            for n, part in zip((counts * 4).tolist(), parts):
                crcs.append([zlib.crc32(view[at + a:at + min(a + 4 * LENGTH, n)]) for a in range(0, n, 4 * LENGTH)])
                binary.append(bytes(view[at:at + n]) if part in kept_parts else None)
                at += n
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(uid, uid + len(counts))), one_array(table["doc_id"]), one_array(table["part"]), pa.array(counts),
                pa.array(crcs, pa.list_(pa.int64())), pa.array(binary, pa.binary())], ["uid", "doc_id", "part", "doc_tokens", "crcs", "ids"])
            uid += len(counts)

    return run


def priced(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within capacity (unbounded knapsack): its value and counts."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        best[c] = best[c - 1]
        if len(fits):
            worth = best[c - sizes[fits]] + values[fits]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], chosen[c] = worth[k], fits[k]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            counts[chosen[c]] += 1
            c -= int(sizes[chosen[c]])
    return float(best[capacity]), counts


def cutting_stock(demand: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(pattern, how many sequences use it) that hold at least `demand` items of each size; integers throughout."""
    use = np.flatnonzero(demand)
    if not len(use):
        return []
    d, s = demand[use].astype(float), sizes[use].astype(np.int64)
    patterns = np.diag(capacity // s).astype(float)
    inverse, x = np.diag(1.0 / (capacity // s)), d / (capacity // s)
    for _ in range(rounds):
        value, column = priced(inverse.sum(axis=0), s, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratio = np.full(len(x), np.inf)
        ok = direction > 1e-9
        ratio[ok] = x[ok] / direction[ok]
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * direction
        x[out] = step
        x[x < 0] = 0
        inverse[out] /= direction[out]
        others = np.arange(len(x)) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        patterns[:, out] = column
    times = np.floor(x + 1e-7).astype(np.int64)
    whole = np.rint(patterns).astype(np.int64)
    left = np.maximum(0, demand[use] - whole @ times)
    found = [(whole[:, p], int(times[p])) for p in range(len(times)) if times[p]]
    while left.any():  # the rest, a few items of each class: first fit decreasing
        room, pattern = capacity, np.zeros(len(use), np.int64)
        for k in np.argsort(-s, kind="stable"):
            n = int(min(left[k], room // s[k]))
            pattern[k] += n
            room -= n * int(s[k])
        n = max(1, int(min(left[k] // pattern[k] for k in np.flatnonzero(pattern))))
        found.append((pattern, n))
        left = left - n * pattern
    out = []
    for pattern, n in found:
        full = np.zeros(len(demand), np.int64)
        full[use] = pattern
        out.append((full, n))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       crc_fold(F.col(doc_id), PARTS).cast("int").alias("part"))
    drawn = materialize(docs.mapInArrow(tokenised(path, end, range(1)), SCHEMA), "tokenised")
    rest = (F.col("doc_tokens") % LENGTH).cast("int")
    level = F.floor((rest - 1) / STEP).cast("int")
    # At most PARTS x (CLASSES + 1) rows.
    histogram = drawn.groupBy("part", F.when(rest > 0, level).otherwise(-1).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_tokens").alias("tokens"), F.sum(rest.cast("long")).alias("rest")).collect()
    sizes = np.arange(1, CLASSES + 1)
    for taken in (1, 2, 4, 8, PARTS):
        demand = np.zeros(CLASSES, np.int64)
        for r in histogram:
            if r["part"] >= taken and r["level"] >= 0:
                demand[r["level"]] += r["n"]
        patterns = cutting_stock(demand, sizes, CLASSES)
        supply = sum(r["tokens"] for r in histogram if r["part"] < taken)
        free = LENGTH * sum(n for _, n in patterns) - sum(r["rest"] for r in histogram if r["part"] >= taken)
        if supply >= free:
            break
    if taken > 1:
        more = docs.filter(F.col("part").between(1, taken - 1)).mapInArrow(tokenised(path, end, range(1, taken)), SCHEMA)
        loose = materialize(drawn.filter("part = 0").unionByName(more.withColumn("uid", F.col("uid") + F.lit(1 << 62))), "tokenised-more")
    else:
        loose = drawn.filter("part = 0")
    fixed = drawn.filter(F.col("part") >= taken)
    base, slots, filled = 0, [], np.zeros(CLASSES, np.int64)
    for pattern, n in patterns:
        for k in np.flatnonzero(pattern).tolist():
            slots.append((k, int(filled[k]), int(filled[k] + n * pattern[k]), int(pattern[k]), base))
            filled[k] += n * pattern[k]
        base += n

    # Remainders take slots by their rank in their class; the slot table has at most a few thousand rows.
    items = fixed.filter(rest > 0).select("uid", "doc_id", "doc_tokens", level.alias("level"), rest.cast("long").alias("length"),
                                          F.element_at("crcs", -1).alias("ids_crc32"))
    ranked = global_rank(items, ["level"], [F.col("uid")], "rank")
    slot_rows = spark.createDataFrame(slots, "k int, first long, after long, each long, base long")
    within = (ranked["level"] == slot_rows["k"]) & (ranked["rank"] >= slot_rows["first"]) & (ranked["rank"] < slot_rows["after"])
    placed = ranked.join(F.broadcast(slot_rows), within).withColumn(
        "sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each")).cast("long"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("level"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("offset", F.sum("length").over(before) - F.col("length")).select(
        "doc_id", (F.col("doc_tokens") - F.col("length")).alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    placed = materialize(placed, "packed-remainders")

    # Full pieces are sequences of their own.
    full = fixed.filter(F.col("doc_tokens") >= LENGTH).select("uid", "doc_id", "doc_tokens", "crcs", F.floor(F.col("doc_tokens") / LENGTH).cast("long").alias("n"), F.lit(0).alias("all"))
    full = prefix_sum(full, ["all"], F.col("n"), [F.col("uid")], "ahead")
    full = full.select("doc_id", "doc_tokens", "ahead", F.posexplode(F.slice("crcs", F.lit(1), F.col("n").cast("int"))).alias("j", "ids_crc32")).select(
        "doc_id", (F.col("j") * LENGTH).cast("long").alias("start"), F.lit(LENGTH).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (base + F.col("ahead") + F.col("j")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    base += sum(r["tokens"] - r["rest"] for r in histogram if r["part"] >= taken) // LENGTH

    # The loose documents form a stream of ids that first fills the gaps, then whole sequences.
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).filter(F.col("used") < LENGTH).withColumn("all", F.lit(0))
    gaps = prefix_sum(materialize(used, "packed-used"), ["all"], LENGTH - F.col("used"), [F.col("sequence_id")], "g").select(
        "sequence_id", "used", "g", (F.col("g") + LENGTH - F.col("used")).alias("h"))
    gaps = materialize(gaps, "packed-gaps")
    free = gaps.agg(F.max("h")).first()[0] or 0
    stream = prefix_sum(loose.withColumn("all", F.lit(0)), ["all"], F.col("doc_tokens"), [F.col("uid")], "s").select(
        "uid", "doc_id", "doc_tokens", "ids", "s", (F.col("s") + F.col("doc_tokens")).alias("e"))
    stream = materialize(stream, "packed-loose")
    block = 2 * LENGTH
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(b) - 1) / block)))
    spans = stream.filter(F.col("s") < free).select("uid", "s", "e", cover("s", "e").alias("block"))
    holes = gaps.select("sequence_id", "used", "g", "h", cover("g", "h").alias("block"))
    begin, finish = F.greatest("s", "g"), F.least("e", "h")
    pieces = spans.join(holes, "block").filter((begin < finish) & (F.floor(begin / block) == F.col("block"))).select(
        "uid", (begin - F.col("s")).alias("start"), (finish - begin).alias("length"), "sequence_id", (F.col("used") + begin - F.col("g")).alias("offset"))
    late = stream.filter(F.col("e") > free).withColumn("from", F.greatest(F.col("s"), F.lit(free)) - free).withColumn("to", F.col("e") - free)
    late = late.select("uid", "s", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / LENGTH), F.floor((F.col("to") - 1) / LENGTH))).alias("q"))
    begin, finish = F.greatest("from", F.col("q") * LENGTH), F.least("to", (F.col("q") + 1) * LENGTH)
    late = late.select("uid", (begin + free - F.col("s")).alias("start"), (finish - begin).alias("length"), (F.col("q") + base).alias("sequence_id"),
                       (begin - F.col("q") * LENGTH).alias("offset"))
    cut = pieces.unionByName(late).join(stream.select("uid", "doc_id", "doc_tokens", "ids"), "uid")
    crc = F.crc32(F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")))
    cut = cut.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), crc.alias("ids_crc32"), "doc_tokens",
                     F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return placed.unionByName(full).unionByName(cut)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents of docs in sequences."""
    return pack(docs)
