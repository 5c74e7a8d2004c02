"""Token-id files: documents in ascending doc_id order, as range-coded blocks (operator 10).

Texts are range-partitioned and sorted by doc_id, encoded with the tokenizer, and written as rows of (file, block, doc_ids,
lengths, n_ids, payload), where payload is one block of rangecoder.py over whole documents (about a million ids; a longer
document is a block of its own). A file is one range partition; (file, block) is the reading order. Blocks are
independent and checksummed, so a reader takes any subset, and a lost task rewrites its file only.

Defined cases: null or empty text has just the end id; null doc_id comes first; rows that share a doc_id stay separate
documents, ordered by a hash of their text; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rangecoder
from .common import gathered, one_array, shared_dir, small_arrow_batches, texts_of
from .tokens import Encoder, tokenizer_path, with_end

BLOCK_IDS = 1 << 20
BLOCKS = "file int, block int, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"


def block_writer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = Encoder.kept(path, spaces=True), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        block = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([x for _, _, x in held])
            names, counts = [i for names, _, _ in held for i in names], np.concatenate([c for _, c, _ in held])
            return pa.RecordBatch.from_arrays([
                pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([rangecoder.encode(ids)], pa.binary())],
                ["file", "block", "doc_ids", "lengths", "n_ids", "payload"])

        size = 0
        for table in gathered(batches):
            counts, ids = with_end(*encoder.encode(texts_of(table)), end)
            names, ends, at = one_array(table["doc_id"]).to_pylist(), np.cumsum(counts), 0
            while at < len(counts):
                done = int(ends[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + BLOCK_IDS - size, "right")))
                held.append((names[at:upto], counts[at:upto], ids[done:int(ends[upto - 1])]))
                size += len(held[-1][2])
                at = upto
                if size >= BLOCK_IDS or at < len(counts):
                    yield row()
                    held, size, block = [], 0, block + 1
        if held:
            yield row()

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = 0, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of all docs under folder."""
    small_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(block_writer(tokenizer or tokenizer_path("byte_bpe_50k.json"), end), BLOCKS).write.parquet(folder)


def block_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.ascontiguousarray(rangecoder.decode(r["payload"]), "<u4")
            view, at, n = memoryview(ids).cast("B"), 0, len(r["lengths"])
            counts, crcs = np.array(r["lengths"], np.int64), []
            for size in (counts * 4).tolist():
                crcs.append(zlib.crc32(view[at:at + size]))
                at += size
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, r["file"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), pa.array(r["doc_ids"], pa.int64()),
                pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                ["file", "block", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under folder."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    # Offsets of files, then of blocks in their file: block counts only, no ids.
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).withColumn(
        "file_start", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = blocks.select("file", "block", "n_ids").withColumn("block_start", F.coalesce(
        F.sum("n_ids").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(files.select("file", "file_start"), "file").select("file", "block", (F.col("file_start") + F.col("block_start")).alias("base"))
    docs = blocks.mapInArrow(block_reader, "file int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["file", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_ids(spark, folder)
