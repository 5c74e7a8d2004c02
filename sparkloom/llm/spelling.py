"""Groups of spelling variants by a relational trie frontier (operator 13).

The distinct words form a trie that is never held in one place: it is a table of edges (node, first, label, child), where
a node is the 64-bit hash of a prefix and runs of nodes without a branch are one edge with a longer label. Frontier
states (word, position, node) without an edit are the word's own nodes from half of its length on. Joined with the edge
table, they get their one edit at the first difference from a label: the word's letter is replaced or left out. States with an edit
are joined with the edge table round by round and move on only along their own letters. States that have used up their word
at the end of a word become neighbours. A second trie of reversed words, in the same tables, finds the edits in
the first half, so no round ever fans out over the trie's crowded top. Rounds are bounded by the branches below half of a word, not
by its length. Each pair of words is found from its longer word (or the one with the smaller letter), confirmed by its edit
distance and mirrored; hashes that collide can add candidates but lose none.

A node has no more edges than there are letters, so states grow with the words; a node that many words pass is many
rows of states against a few of edges, which adaptive execution splits. Forms double their counts from step to step, so
roots are found by a few rounds of pointer jumping.

Defined cases: null, empty and letterless texts have no words; a null doc_id counts as an empty id; repeated rows count
each; ties between forms go to the word that is smallest in code-point order; an empty table gives an empty result; extra columns are not
carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialized, gathered, materialize, one_array, small_arrow_batches, texts_of

LETTERS = "A-Za-zÀ-ÿ"
#: Bits by which an edge tells what may follow it: one for each class of letters, and one for the end of a word.
CLASSES, END = 62, 62
#: One in so many occurrences loses a letter.
DAMAGED = 97
BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text of each run, the runs `[A-Za-z\\u00C0-\\u00FF]+` with only A-Z lower-cased)."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    # In UTF-8, U+00C0 to U+00FF are the byte C3 and one more.
    inside = ((lower >= 97) & (lower <= 122)) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    starts[heads] = inside[heads]
    at = np.flatnonzero(starts)
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(kept[at], kept[-1]).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(lower[inside])))
    return np.searchsorted(bounds, at, "right") - 1, runs


def counted(least_length: int, damaged: int):
    """An Arrow function: (doc_id, text) to the words of a batch with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 8_000_000):
            owners, runs = letter_runs(texts_of(table))
            if not len(runs):
                continue
            names = [b"%d:" % i if i is not None else b":" for i in one_array(table["doc_id"]).to_pylist()]
            # A run that is too short stays so with a letter less.
            coded = runs.dictionary_encode()
            long = pc.greater_equal(pc.utf8_length(coded.dictionary), least_length).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
            words = [w.encode() for w in coded.dictionary.to_pylist()]
            pairs, n = np.unique(owners[long] * len(words) + coded.indices.to_numpy()[long], return_counts=True)
            crc, heads = zlib.crc32, [zlib.crc32(x) for x in names]
            drawn = np.fromiter((crc(words[w], heads[d]) for d, w in zip((pairs // len(words)).tolist(), (pairs % len(words)).tolist())), np.uint32, len(pairs))
            hit = drawn % damaged == 0
            sums = np.bincount(pairs[~hit] % len(words), n[~hit], len(words)).astype(np.int64)
            found, more = pa.array(words, pa.binary()).cast(pa.string()), []
            for d, h in zip((pairs[hit] % len(words)).tolist(), drawn[hit].tolist()):
                word = words[d].decode()
                more.append(word[:h % len(word)] + word[h % len(word) + 1:])
            found = pa.concat_arrays([found, pa.array(more, pa.string())])
            sums = np.concatenate([sums, n[hit]])
            use = pc.and_(pc.greater_equal(pc.utf8_length(found), least_length), pa.array(sums > 0))
            yield pa.RecordBatch.from_arrays([found.filter(use), pa.array(sums, pa.int64()).filter(use)], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, damaged: int = DAMAGED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: the words of all whole texts, with one letter deleted from one in `damaged` of the occurrences."""
    small_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = docs.mapInArrow(counted(least_length, damaged), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An Arrow function: (dir, word) to a row for each prefix from half of the word on: depth, node, the letter that follows (-1: none), and its bit."""
    for table in gathered(batches, 500_000):
        words = one_array(table["word"]).to_pylist()
        ways = one_array(table["dir"]).to_numpy().astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes)
        place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        with np.errstate(over="ignore"):
            powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(int(sizes.max(initial=0)), 1), BASE))])
            sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * powers[place])])
            half = sizes // 2
            rows = sizes - half + 1
            word = np.repeat(np.arange(len(words)), rows)
            depth = np.arange(len(word)) - np.repeat(np.cumsum(rows) - rows, rows) + half[word]
            at = (ends - sizes)[word] + depth
            node = (sums[at] - sums[(ends - sizes)[word]]) * np.uint64(2) + ways[word]
            node ^= depth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        follows = np.where(depth < sizes[word], np.append(codes, 0)[np.minimum(at, len(codes))].astype(np.int64), -1)
        yield pa.RecordBatch.from_arrays([
            one_array(table["dir"]).take(pa.array(word)), one_array(table["word"]).take(pa.array(word)), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)),
            pa.array(follows.astype(np.int32)), pa.array(np.left_shift(np.int64(1), np.where(follows < 0, END, follows % CLASSES)))], ["dir", "word", "depth", "node", "follows", "bit"])


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, edges). paths: dir, word, depth, node of each word's kept nodes from half of its length on. edges: node, first, label, child, mask
    (the bits of what follows the child).

    A node is kept if it branches, if a word ends there, or if some word starts its search there.
    """
    both = words.select(F.lit(0).alias("dir"), "word").unionByName(words.select(F.lit(1).alias("dir"), F.reverse("word").alias("word")))
    rows = materialize(both.repartition("word").mapInArrow(prefixes, "dir int, word string, depth int, node long, follows int, bit long"), "trie-prefixes")
    half = F.floor(F.char_length("word") / 2)
    kept = rows.groupBy("node").agg(F.min("follows").alias("least"), F.max("follows").alias("most"), F.max(F.col("depth") == half).alias("start"), F.bit_or("bit").alias("mask")).filter(
        (F.col("least") != F.col("most")) | (F.col("least") == -1) | F.col("start")).select("node", "mask")
    path = F.array_sort(F.collect_list(F.struct("depth", "node", "mask")))
    # A word has at most as many rows as letters.
    paths = materialize(rows.join(kept, "node").groupBy("dir", "word").agg(path.alias("path")), "trie-paths")
    steps = paths.select("word", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("e"))
    label = F.substring("word", F.col("e.a.depth") + 1, F.col("e.b.depth") - F.col("e.a.depth"))
    edges = steps.select(F.col("e.a.node").alias("node"), F.col("e.b.node").alias("child"), F.col("e.b.mask").alias("mask"), label.alias("label")).distinct()
    edges = materialize(edges.select("node", F.substring("label", 1, 1).alias("first"), "label", "child", "mask"), "trie-edges")
    drop_materialized(rows)
    return paths, edges


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving, so that long labels cost few comparisons."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def may_go_on(mask: int, word: str, place: int) -> int:
    """Whether a node with this mask may have an edge for the word's next letter, or end a word where the word ends."""
    return mask >> (END if place == len(word) else ord(word[place]) % CLASSES) & 1


def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An Arrow function: states without an edit, joined with edges, to the states with one that follow and may get on."""
    for batch in batches:
        origin, places, nodes = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("word", "place", "label", "child", "mask")]
        for i, (word, place, label, child, mask) in enumerate(zip(*columns)):
            if word.startswith(label, place):
                continue
            same = 0 if word[place] != label[0] else common_prefix(word[place:place + len(label)], label)
            at = place + same
            if at >= len(word):
                continue
            end = place + len(label)
            if label[same] > word[at] and end <= len(word) and may_go_on(mask, word, end) and word.startswith(label[same + 1:], at + 1):
                origin.append(i)
                places.append(end)
                nodes.append(child)
            if end + 1 <= len(word) and may_go_on(mask, word, end + 1) and word.startswith(label[same:], at + 1):
                origin.append(i)
                places.append(end + 1)
                nodes.append(child)
        taken = pa.array(origin, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("dir").take(taken), batch.column("word").take(taken), pa.array(places, pa.int32()), pa.array(nodes, pa.int64())], ["dir", "word", "place", "node"])


def before_edit(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States without an edit along the edges that go on like the word, that have a later letter instead, or that have the letter after next."""
    letter = lambda k: F.substring("word", F.col("place") + k, F.lit(1))
    near = states.join(edges, "node").filter((F.col("first") >= letter(1)) | (F.col("first") == letter(2)))
    return near.select("dir", "word", "place", "label", "child", "mask").mapInArrow(moved, STATE)


def after_edit(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States with an edit go on only along their own letters, so by one edge at most."""
    asked = states.withColumn("first", F.substring("word", F.col("place") + 1, F.lit(1)))
    end = F.col("place") + F.char_length("label")
    follows = F.when(end == F.char_length("word"), F.lit(END)).otherwise(F.ascii(F.substring("word", end + 1, F.lit(1))) % CLASSES)
    fits = (F.substring("word", F.col("place") + 1, F.char_length("label")) == F.col("label")) & (F.call_function("shiftright", F.col("mask"), follows).bitwiseAND(F.lit(1)) == 1)
    return asked.join(edges, ["node", "first"]).filter(fits).select("dir", "word", end.cast("int").alias("place"), F.col("child").alias("node"))


STATE = "dir int, word string, place int, node long"


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: all ordered pairs of words that differ by one inserted, deleted or replaced code point."""
    paths, edges = trie(words)
    # Words by the node where they end; a row for each word and way.
    ends = paths.select("dir", F.element_at("path", -1)["node"].alias("node"), F.col("word").alias("other"))
    # Without an edit a word can only be at the nodes of its own path.
    own = paths.select("dir", "word", F.explode("path").alias("p")).select("dir", "word", F.col("p.depth").alias("place"), F.col("p.node").alias("node")).filter(F.col("place") < F.char_length("word"))
    # A state one letter before the end of its word without an edit, or at the end with one, may have reached another word.
    found = [materialize(own.filter(F.col("place") + 1 == F.char_length("word")).select("dir", "word", "node"), "arrived")]
    states = materialize(before_edit(own, edges), "frontier")
    while not states.isEmpty():
        found.append(materialize(states.filter(F.col("place") == F.char_length("word")).select("dir", "word", "node"), "arrived"))
        after = materialize(after_edit(states.filter(F.col("place") < F.char_length("word")), edges), "frontier")
        drop_materialized(states)
        states = after
    reached = found[0]
    for more in found[1:]:
        reached = reached.unionByName(more)
    pairs = reached.join(ends, ["dir", "node"]).filter(F.levenshtein("word", "other", 1) == 1)
    back = lambda c: F.when(F.col("dir") == 1, F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select(back("word").alias("a"), back("other").alias("b"))
    near = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-words")
    for table in (paths, edges, states, *found):
        drop_materialized(table)
    return near


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) with the last form that each word leads to, by pointer jumping."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop_materialized(now)
        moving = not after.filter("moved").isEmpty()
        now = after.drop("moved")
        if not moving:
            return now


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, n, form, root, n_near, form_n for words (word, n): the form is the commonest near word, if it is `factor` times as common."""
    words = materialize(words, "words")
    near = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("b"))).alias("best"))
    firm: Column = -F.col("best.n") >= factor * F.col("n")
    known = materialize(words.join(best, "word", "left").select(
        "word", F.when(firm, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(firm, -F.col("best.n")).alias("form_n")), "word-forms")
    last = roots(known.filter(F.col("form").isNotNull()))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: Checksums by halves of bytes, from a table that follows from the polynomial; near words meet in what is left without one letter.
OP13_SQL = """
WITH RECURSIVE nibbles AS (SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, u: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT d, run, count(*) AS n, hex(encode(d || ':' || run)) AS h FROM found GROUP BY ALL),
drawn AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h)), lambda i: CAST('0x' || substr(h, CAST(i + 2 - 2 * (i % 2) AS INT), 1) AS BIGINT))),
    lambda c, x: xor(c >> 4, t[CAST(xor(c, x) & 15 AS INT) + 1])), 4294967295) AS crc FROM runs, nibbles),
words AS (SELECT CASE WHEN crc % 97 = 0 THEN left(run, CAST(crc % length(run) AS INT)) || substr(run, CAST(crc % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
    FROM drawn GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cuts AS (SELECT word, i, left(word, CAST(i - 1 AS INT)) AS a, substr(word, CAST(i + 1 AS INT)) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT x.word, y.word AS other FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT cuts.word, words.word FROM cuts JOIN words ON a || b = words.word UNION SELECT words.word, cuts.word FROM cuts JOIN words ON a || b = words.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(o.word, (-o.n, encode(o.word))) AS form, max(o.n) AS form_n FROM near JOIN words o ON o.word = near.other GROUP BY 1),
known AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS root FROM known WHERE form IS NOT NULL UNION ALL SELECT walk.word, known.form FROM walk JOIN known ON walk.root = known.word WHERE known.form IS NOT NULL),
ends AS (SELECT word, root FROM walk WHERE root IN (SELECT word FROM known WHERE form IS NULL))
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)
"""
