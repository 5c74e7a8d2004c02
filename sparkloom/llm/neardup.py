"""Near-duplicate detection by fast similarity sketching, banding and exact verification (operator 3).

Sketch: a document's set of shingles is thrown into `coordinates` bins in rounds; in round i < t every shingle goes to a
bin by its i-th hash with value i + hash, in round t + k every shingle goes to bin k, and rounds stop when all bins are
filled (the least value stays). Every coordinate is therefore filled after 2 t rounds, and two sketches agree in a
coordinate with the Jaccard similarity as probability, with Chernoff-like concentration. Bands of `rows` coordinates
are hashed to bucket keys: as many bands of 5 as miss a pair at the least similarity with a probability below one in a
million (35 at 0.80, 24 at 0.85).

Verification: documents with the same set are one class (its smallest doc_id stands for it). In every bucket the smallest
member is compared with each other member on full sets, and these links are closed to components. Documents of buckets
that still hold several components are then joined exactly by their rarest shingles (a prefix filter), leaving out pairs
that are connected already or whose one-bit sketches of 2048 coordinates are too far apart (one in ten million), and candidates are confirmed on full sets. Thus no link of a bucket is lost and no group is
expanded into all pairs.

Defined cases: null or wordless text has an empty set, no links, component_id = doc_id; texts of one to four words have
one shingle, the whole sequence; rows that share a doc_id are one node, whatever their texts (sets are kept by content, so each text finds its links);
rows without doc_id are linked with nothing, component_id null and kept; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialized, gathered, materialize, one_array, ranges, small_arrow_batches, texts_of, word_codes
from .graph import connected_components

WORDS = 5
ROWS = 5
#: Coordinates of the one-bit sketches that thin out candidates before they become rows.
BITS = 2048
SKETCH_SCHEMA = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>"
#: Odd multipliers of the places of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, distinct 64-bit shingle hashes of each text in ascending order, one text after another)."""
    offsets, codes, dictionary = word_codes(pc.ascii_lower(texts))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in dictionary.to_pylist()), np.uint64, len(dictionary))[codes]
    counts = np.diff(offsets)
    rolling = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for place in range(words):
        rolling += hashes[place:place + len(rolling)] * PLACES[place]
    sets = []
    for start, n in zip(offsets[:-1].tolist(), counts.tolist()):
        if n >= words:
            sets.append(np.unique(mixed(rolling[start:start + n - words + 1])))
        elif n:
            sets.append(mixed((hashes[start:start + n] * PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return sizes, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def fast_sketch(sizes: np.ndarray, items: np.ndarray, coordinates: int) -> np.ndarray:
    """Fast similarity sketches (sets x coordinates) of non-empty sets of distinct 64-bit hashes."""
    empty = np.uint64(2**64 - 1)
    out = np.full((len(sizes), coordinates), empty, np.uint64)
    flat, t = out.reshape(-1), coordinates
    owner = np.repeat(np.arange(len(sizes)), sizes)
    live = np.ones(len(sizes), bool)
    for i in range(2 * t):
        x = mixed(items + np.uint64((i * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64))
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, owner * t + bins, np.uint64(i << 48) | (mixed(x) & np.uint64(2**48 - 1)))
        live[live] = (out[live] == empty).any(axis=1)
        if not live.any():
            break
        still = live[owner]
        if not still.all():
            items, owner = items[still], owner[still]
    return out


def bands_for(percent: int) -> int:
    """Bands of ROWS coordinates that miss a pair of that similarity with a probability of at most one in a million."""
    agree = (percent / 100) ** ROWS
    return max(1, math.ceil(math.log(1e-6) / math.log1p(-agree))) if agree < 1 else 1


def sketches(bands: int):
    """A mapInArrow function: each document's size, digests of its set and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            sizes, items = shingle_sets(texts_of(table))
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sizes), bands), np.uint64)
            digest = np.zeros((2, len(sizes)), np.uint64)
            if len(full):
                coordinates = fast_sketch(sizes[full], items, bands * ROWS).reshape(len(full), bands, ROWS)
                band = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * PLACES[0]
                for r in range(ROWS):
                    band = mixed(band + coordinates[:, :, r]) * PLACES[1]
                keys[full] = band
                starts = (np.cumsum(sizes) - sizes)[full]
                for k in range(2):
                    digest[k, full] = np.add.reduceat(mixed(items ^ PLACES[k + 2]), starts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([one_array(table["doc_id"]).cast(pa.int64()), one_array(table["text_key"]), pa.array(sizes), pa.array(digest[0].view(np.int64)),
                                              pa.array(digest[1].view(np.int64)), lists], ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"])

    return run


def bit_sketches(sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
    """(sets, BITS / 64) 64-bit words: the lowest bit of each of BITS sketch coordinates; zeros for empty sets."""
    out, ends = np.zeros((len(sizes), BITS // 64), np.int64), np.cumsum(sizes)
    for a in range(0, len(sizes), 500):
        full = a + np.flatnonzero(sizes[a:a + 500])
        if len(full):
            part = items[ends[a] - sizes[a]:ends[min(a + 500, len(sizes)) - 1]]
            low = (fast_sketch(sizes[full], part, BITS) & np.uint64(1)).astype(np.uint8)
            out[full] = np.packbits(low, axis=1).view(np.int64)
    return out


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, 4_000_000):
        sizes, items = shingle_sets(texts_of(table))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(items.view(np.int64)))
        words = bit_sketches(sizes, items)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * words.shape[1], pa.int32()), pa.array(words.reshape(-1)))
        yield pa.RecordBatch.from_arrays([one_array(table["rep"]), sets, bits], ["id", "items", "bits"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("id").alias(k), F.col("items").alias(f"of_{k}")) for k in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.filter(100 * F.col("common") >= percent * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b").distinct()


def alike(a: str, b: str, percent: int) -> Column:
    """Sets of too different sizes cannot be that similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of nodes(rep, component) in different components that may reach the similarity; none that does is missed.

    Two sets that similar share one of the n - ceil(percent/100 n) + 1 items of either that are rarest among all nodes.
    Items of one node only need no row. For an item, nodes of its most frequent component are paired with the others
    only, and only if their bit sketches allow the similarity.
    """
    items = sets.join(nodes.hint("merge"), sets["id"] == nodes["rep"]).select("rep", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    seen = items.groupBy("item").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = items.join(seen, "item").groupBy("rep", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("common"))
    room = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - (F.col("n") - F.size("common"))
    after = F.size("common") - 1 - F.col("place")  # items after this one in the set's own order
    prefix = shared.filter(room > 0).select("rep", "component", "n", "common", F.posexplode(F.transform(
        F.slice("common", F.lit(1), room.cast("int")), lambda x: x["item"])).alias("place", "item")).withColumn("after", after).drop("common", "place")
    prefix = first = materialize(prefix, "prefix-items")
    most = prefix.groupBy("item", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("item").agg(
        F.max_by("component", F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    bits = sets.select(F.col("id").alias("rep"), "bits")
    prefix = materialize(prefix.join(most.select("item", "most"), "item").join(bits.hint("merge"), "rep"), "prefix-open")
    others = prefix.filter("component <> most").select("item", F.col("rep").alias("x"), F.col("n").alias("x_n"), F.col("component").alias("x_c"), F.col("bits").alias("x_bits"), F.col("after").alias("x_after"))
    # The first item that two sets share leaves at most the items after it.
    enough = (100 + percent) * (1 + F.least("after", "x_after")) >= percent * (F.col("n") + F.col("x_n"))
    # Bits differ with probability (1 - similarity) / 2; beyond 5.3 standard deviations a pair cannot be that similar (1e-7).
    rate = (1 - percent / 100) / 2
    most_unlike = int(BITS * rate + 5.3 * (BITS * rate * (1 - rate)) ** 0.5) + 1
    unlike = sum(F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("x_bits", F.lit(k)))) for k in range(BITS // 64))
    found = others.join(prefix, "item").filter((F.col("x_c") != F.col("component")) & alike("n", "x_n", percent) & enough & (unlike <= most_unlike)).select(
        F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
    return found, [first, prefix]


def with_key(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text, and a hash of the text, by which rows that share a doc_id are told apart."""
    body = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))


def near_classes(docs: DataFrame, percent: int, one_node: bool) -> tuple[DataFrame, DataFrame]:
    """(sketches of docs(doc_id, text, text_key), and for each set that has shingles the least (doc_id, text_key) of its component).

    one_node: whether rows of one doc_id belong together even if their texts differ.
    """
    small_arrow_batches(docs.sparkSession)
    drawn = materialize(docs.mapInArrow(sketches(bands_for(percent)), SKETCH_SCHEMA), "sketches")
    nodes = drawn.filter("n_shingles > 0 and doc_id is not null")
    again = materialize(nodes.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    repeated = not again.isEmpty()
    # A class is one set of shingles, whatever the ids of its rows.
    classes = nodes.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "shingle-classes")
    banded = classes.select(F.explode("bands").alias("key"), "rep", "n", F.col("least.doc_id").alias("first"))
    # A bucket's leader is its member of the smallest doc_id: of a document and copies made from it, mostly the document.
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("first", "rep", "n")).alias("leader")).filter("size > 1")
    members = materialize(banded.join(buckets.drop("size"), "key").select("key", "rep", "n", F.col("leader.rep").alias("lead"), F.col("leader.n").alias("lead_n")), "band-members")

    wanted = members.select("rep").distinct().join(classes.select("rep", "least.*"), "rep")
    sets = docs.join(wanted.hint("merge"), ["doc_id", "text_key"]).select("rep", "text").mapInArrow(full_sets, "id long, items array<long>, bits array<long>")
    sets = materialize(sets.groupBy("id").agg(F.first("items").alias("items"), F.first("bits").alias("bits")) if repeated else sets, "shingle-sets")
    pairs = members.filter((F.col("rep") != F.col("lead")) & alike("n", "lead_n", percent)).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    links = materialize(verified(pairs, sets, percent), "links")
    of = connected_components(links)
    # Documents of buckets that still hold more than one component are compared exactly.
    placed = members.join(of.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = materialize(placed, "band-components")
    unsettled = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    open_nodes = materialize(placed.join(unsettled, "key").select("rep", "component").distinct(), "unsettled")
    candidates, used = prefix_pairs(open_nodes, sets, percent)
    rest = materialize(candidates.join(pairs, ["a", "b"], "left_anti"), "pairs-rest")
    more = materialize(verified(rest, sets, percent), "links-rest")
    edges = links if more.isEmpty() else links.unionByName(more)
    if repeated and one_node:
        of_id = nodes.join(again, "doc_id").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("doc_id", "rep").distinct()
        same = of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b"))
        edges = edges.unionByName(materialize(same, "links-of-ids"))
    if edges is not links:
        of = connected_components(edges)
    for table in (sets, members, pairs, placed, open_nodes, rest, *used):
        drop_materialized(table)
    labelled = classes.select("set_a", "set_b", "rep", "least").join(of.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = labelled.groupBy("component").agg(F.min("least").alias("smallest"))
    labels = materialize(labelled.join(least, "component").select("set_a", "set_b", "smallest"), "components")
    for table in (links, more, classes, again):
        drop_materialized(table)
    return drawn, labels


def near_duplicates(docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    drawn, labels = near_classes(with_key(docs, text, doc_id), percent, one_node=True)
    found = drawn.join(labels, ["set_a", "set_b"], "left").withColumn(
        "component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("smallest.doc_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs.

    Rows are judged by their texts: rows of one doc_id with unlike texts are groups of their own. The row with the least doc_id
    (then the least hash of its text) stays. Rows without doc_id, and texts without words, stay; an empty table stays empty;
    columns with clashing names are carried as they are.
    """
    drawn, labels = near_classes(with_key(docs, "text", "doc_id"), 80, one_node=False)
    grouped = drawn.filter("n_shingles > 0 and doc_id is not null").join(labels, ["set_a", "set_b"])
    gone = materialize(grouped.filter((F.col("doc_id") != F.col("smallest.doc_id")) | (F.col("text_key") != F.col("smallest.text_key"))).select(
        F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key")).distinct(), "near-duplicates")
    own, key = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    kept = docs.join(gone, (own == gone["__doc_id"]) & (key == gone["__text_key"]), "left_anti")
    again = grouped.groupBy("doc_id", "text_key").count().filter("count > 1").select(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key"))
    if not again.isEmpty():
        # Repeated rows of one id and text: one stays.
        again = materialize(again, "repeated-rows")
        same = (own == again["__doc_id"]) & (key == again["__text_key"])
        one = kept.join(again, same, "left_semi").withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).drop("__key")
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept
