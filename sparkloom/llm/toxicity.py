"""Toxicity by non-negative positive-unlabelled learning (operator 6).

Confirmed toxic documents (positives) and documents as they come (unlabelled, whatever their label) train a logistic
model with the class-prior-corrected, non-negative risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

the prior being the share of toxic labels. Inputs are presences of words (or of their first six, five or four letters where the word itself is not an input), that
the positives show clearly more often than negatives would (their rate there is estimated as (u - prior * p) / (1 - prior)).
Rates are counts of documents by counts of documents, each class of near-duplicates in the sample counting once.
The fit uses at most `positives` + `unlabelled` documents, chosen by a hash of doc_id, and at most `features` inputs;
scores are computed for every whole text. Labels are read only where crc32(doc_id) mod 3 is not 1.

Defined cases: null or empty text has no inputs and gets the model's base score; without any usable positive label every
score is the prior (0 if nothing is labelled); null doc_id is scored, its fold being that of the empty string; repeated
rows are scored each; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, drop_materialized, gathered, materialize, one_array, small_arrow_batches, texts_of, word_codes
from .neardup import near_duplicates

PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…¡¿"


def word_inputs(words: pa.Array) -> list[pa.Array]:
    """For each kind of input, its name for each word, null where the word has none."""
    core = pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)
    length = pc.utf8_length(core)
    none = pa.scalar(None, pa.string())
    kinds = [pc.if_else(pc.greater(length, 1), pc.binary_join_element_wise("w", core, ":"), none)]
    for k in PREFIXES:
        head = pc.utf8_slice_codeunits(core, 0, k)
        kinds.append(pc.if_else(pc.greater(length, k), pc.binary_join_element_wise(str(k), head, ":"), none))
    return kinds


#: Bound of the evidence of one document, so that many toxic words do not dominate the risk.
MOST_EVIDENCE = 10.0
#: Least bias: a text without evidence scores about 2 % at least, so that one clear word can carry a score.
LEAST_BIAS = -4.0


def evidence(sums: np.ndarray) -> np.ndarray:
    return MOST_EVIDENCE * np.tanh(sums / MOST_EVIDENCE)


def known_input(words: pa.Array, known: pa.Array) -> np.ndarray:
    """For each word the place in `known` of its most specific known input, -1 if it has none."""
    place = np.full(len(words), -1, np.int64)
    for kind in [*word_inputs(words)[1:], word_inputs(words)[0]]:
        found = pc.fill_null(pc.index_in(kind, known), -1).to_numpy()
        place = np.where(found >= 0, found, place)
    return place


def owners(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def input_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, positive, unlabelled, distinct inputs) of each document."""
    for table in gathered(batches, 4_000_000):
        offsets, codes, words = word_codes(texts_of(table))
        doc = owners(offsets)
        keys, lists = [], []
        for kind in word_inputs(words):
            code = kind.dictionary_encode()
            of_word = code.indices.fill_null(-1).to_numpy()[codes] if len(codes) else np.zeros(0, np.int64)
            at = np.flatnonzero(of_word >= 0)
            key = np.unique(doc[at] << 32 | of_word[at])
            lists.append(code.dictionary.take(pa.array(key & 0xFFFFFFFF)))
            keys.append(key >> 32)
        order = np.argsort(np.concatenate(keys), kind="stable")
        ends = np.searchsorted(np.concatenate(keys)[order], np.arange(len(offsets)))
        inputs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(lists).take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([one_array(table["row"]), one_array(table["p"]), one_array(table["u"]), inputs], ["row", "p", "u", "inputs"])


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, input) of each presence, and the number of rows."""
    return np.repeat(np.arange(len(lists)), [len(d) for d in lists]), np.array([i for d in lists for i in d], np.int64), len(lists)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risks(theta: np.ndarray, p: tuple, u: tuple, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * R_p(+) and R_u(-) - prior * R_p(-) for weights and bias, with the logistic loss, and their gradients."""
    def side(rows: np.ndarray, cols: np.ndarray, n: int):
        sums = np.bincount(rows, theta[cols], n)
        slope = 1 - np.tanh(sums / MOST_EVIDENCE) ** 2
        return theta[-1] + evidence(sums), lambda g: np.append(np.bincount(cols, (g * slope)[rows], len(theta) - 1), g.sum()) / n

    (z_p, back_p), (z_u, back_u) = side(*p), side(*u)
    s_p, s_u = sigmoid(z_p), sigmoid(z_u)
    plus, minus = prior * np.logaddexp(0, -z_p).mean(), np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    return plus, minus, prior * back_p(s_p - 1), back_u(s_u) - prior * back_p(s_p)


def fit(p: list[list[int]], u: list[list[int]], n_inputs: int, prior: float, rounds: int = 800, rate: float = 0.05, ridge: float = 2e-5, drop: float = 0.5):
    """Weights (never negative) and bias of the non-negative PU risk, by Adam on the whole sample from weights of zero.

    Where the negatives' corrected risk falls below zero, which only overfitting can bring about, a step raises it again. Each
    step leaves out a part `drop` of all presences at random, so that inputs which mostly occur together learn to stand for
    themselves.
    """
    rng = np.random.default_rng(1)
    theta = np.append(np.zeros(n_inputs), np.log(prior / (1 - prior)))
    m, v, p, u = np.zeros_like(theta), np.zeros_like(theta), flat(p), flat(u)
    for t in range(1, rounds + 1):
        some = [(rows[kept], cols[kept], n) for rows, cols, n in (p, u) for kept in [rng.random(len(rows)) >= drop]]
        _, minus, g_plus, g_minus = risks(theta, *some, prior)
        g = g_plus + g_minus if minus >= 0 else -g_minus
        g[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        np.maximum(theta[:-1], 0, out=theta[:-1])
        theta[-1] = max(theta[-1], LEAST_BIAS)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = 4096, unlabelled: int = 8192, features: int = 16384):
    """(input names, weights, bias) from the documents and labels of the training folds."""
    lab = labels.filter(crc_fold(F.col("doc_id"), 3) != 1).filter("toxic is not null and doc_id is not null")
    counts = lab.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    if not counts["p"]:
        return [], np.zeros(0), None
    prior = min(max(counts["p"] / counts["n"], 0.01), 0.9)
    # Two bounded samples by a hash; together at most positives + unlabelled ids.
    some_p = lab.filter("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(True).alias("p"))
    some_u = docs.filter(crc_fold(F.col("doc_id"), 3) != 1).filter("doc_id is not null").select("doc_id").orderBy(
        F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(unlabelled).distinct().select("doc_id", F.lit(True).alias("u"))
    wanted = some_p.join(some_u, "doc_id", "full").select("doc_id", F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("u", F.lit(False)).alias("u"))
    wanted = materialize(wanted, "toxic-sample-ids")
    sampled = materialize(docs.join(F.broadcast(wanted), "doc_id").select(F.monotonically_increasing_id().alias("row"), "p", "u", "text"), "toxic-sample-texts")
    # Copies and near copies are one class; wordless texts stay each their own.
    classes = near_duplicates(sampled, doc_id="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("class"))
    sample = sampled.mapInArrow(input_lists, "row long, p boolean, u boolean, inputs array<string>").join(classes, "row")
    sample = materialize(sample, "toxic-sample")
    each = sample.groupBy("class").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    n = each.agg(F.sum(F.col("p").cast("int")).alias("p"), F.sum(F.col("u").cast("int")).alias("u")).first()
    if not n["p"] or not n["u"]:
        return [], np.zeros(0), None
    used = sample.select("class", "p", "u", F.explode("inputs").alias("input")).groupBy("class", "input").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    used = used.groupBy("input").agg(F.sum(F.col("p").cast("int")).alias("n_p"), F.sum(F.col("u").cast("int")).alias("n_u"))
    p, u = F.col("n_p") / n["p"], F.col("n_u") / n["u"]
    negative = F.greatest(F.lit(0.0), (u - prior * p) / (1 - prior)) + 1.0 / n["u"]
    lift = F.log(p / negative)
    clear = F.col("n_p") * lift - (F.col("n_p") - n["p"] * negative)  # log-likelihood ratio of the count against the negatives' rate
    used = used.filter((F.col("n_p") >= 3) & (lift >= 1.6) & (clear >= 12.0)).orderBy(F.desc(clear), "input").limit(features).select("input")
    found = used.collect()
    names = [r["input"] for r in found]
    if not names:
        return [], np.zeros(0), None
    # Bounded: positives + unlabelled rows of the chosen inputs.
    rows = sampled.mapInArrow(known_lists(names), "p boolean, u boolean, inputs array<int>").toArrow()
    for table in (wanted, sampled, sample):
        drop_materialized(table)
    lists, is_p, is_u = rows["inputs"].to_pylist(), rows["p"].to_pylist(), rows["u"].to_pylist()
    weights, bias = fit([x for x, y in zip(lists, is_p) if y], [x for x, y in zip(lists, is_u) if y], len(names), prior)
    return names, weights, bias


def known_lists(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for table in gathered(batches, 4_000_000):
            offsets, codes, words = word_codes(texts_of(table))
            doc, place = owners(offsets), known_input(words, known)[codes] if len(codes) else np.zeros(0, np.int64)
            hit = np.flatnonzero(place >= 0)
            pairs = np.unique(doc[hit] * (1 << 32) + place[hit])
            ends = np.searchsorted(pairs >> 32, np.arange(len(offsets)))
            yield pa.RecordBatch.from_arrays([one_array(table["p"]), one_array(table["u"]), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))], ["p", "u", "inputs"])

    return run


def scorer(names: list[str], weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for table in gathered(batches):
            offsets, codes, words = word_codes(texts_of(table))
            doc, place = owners(offsets), known_input(words, known)[codes] if len(codes) else np.zeros(0, np.int64)
            hit = np.flatnonzero(place >= 0)
            pairs = np.unique(doc[hit] * (1 << 32) + place[hit])
            sums = np.bincount(pairs >> 32, weights[pairs & 0xFFFFFFFF], len(offsets) - 1) if len(pairs) else np.zeros(len(offsets) - 1)
            logit = bias + evidence(sums)
            yield pa.RecordBatch.from_arrays([one_array(table["doc_id"]), pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    small_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names, weights, bias = train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    if bias is None:
        share = labels.filter(crc_fold(F.col("doc_id"), 3) != 1).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
        scored = docs.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        scored = docs.mapInArrow(scorer(names, weights, bias), "doc_id long, score double")
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, with their own columns; each row is judged by its own text."""
    small_arrow_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    names, weights, bias = train(own, labels)
    if bias is None:
        return docs
    names_of = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer(names, weights, bias)
        for batch in batches:
            asked = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(names_of.index("text"))], ["doc_id", "text"])
            scores = np.concatenate([b.column(1).to_numpy() for b in judge(iter([asked]))]) if batch.num_rows else np.zeros(0)
            yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
