"""Helpers shared by the corpus operators: shared storage, ranks without a global sort, Arrow batches of words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHITE = " \t\n\x0b\x0c\r"
#: Java pattern of a run of the white space that separates words.
WHITE_RUN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on this machine alone may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Spark's setting that lets a query's shuffle files go when it ends, not when the driver's garbage is collected.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, short_shuffles: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. short_shuffles: its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHORT_SHUFFLES, "false")
    spark.conf.set(SHORT_SHUFFLES, "true" if short_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHORT_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete a table that materialize() wrote once nothing lazy depends on it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts may hold, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Native words `[^\\x20\\x09-\\x0D]+` of a non-null text."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE_RUN))


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def prefix_sum(df: DataFrame, keys: list[str], value: Column, order: list[Column], name: str, first: list[str] = (), salts: int | None = None) -> DataFrame:
    """Add the sum of value over the earlier rows of the same keys without bringing a key's rows into one task.

    Rows are dealt over `salts` sub-groups (one for each million rows, and 64 at least) by a hash of the ordering columns; each
    is summed on its own and shifted by the totals of those before it (keys x first x salts rows, pre-aggregated). The order is
    by `first`, then sub-group, then `order`: arbitrary but fixed. df is read several times, so it should be materialised.
    """
    salts = salts or max(64, df.count() // 1_000_000)
    df = df.withColumn("__value", value).withColumn("__salt", F.pmod(F.xxhash64(*order, F.lit("prefix")), F.lit(salts)))
    part = [*keys, *first, "__salt"]
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[F.col(f"__k{i}") for i in range(len(keys))]).orderBy(
        *[F.col(f"__k{i}") for i in range(len(keys), len(part))]).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        df.groupBy(*part).agg(F.sum("__value").alias("__sum"))
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(part)], "__sum")
        .withColumn("__shift", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    )
    summed = df.withColumn("__run", F.sum("__value").over(inner) - F.col("__value"))
    same = F.lit(True)
    for i, k in enumerate(part):
        same = same & summed[k].eqNullSafe(shift[f"__k{i}"])
    return (
        summed.join(shift, same)
        .withColumn(name, (F.col("__run") + F.col("__shift")).cast("long"))
        .drop("__value", "__salt", "__run", "__sum", "__shift", *[f"__k{i}" for i in range(len(part))])
    )


def global_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str, salts: int | None = None) -> DataFrame:
    """Add a gapless rank from 0 within keys, see prefix_sum()."""
    return prefix_sum(df, keys, F.lit(1).cast("long"), order, rank, salts=salts)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = 12_000_000) -> Iterator[pa.Table]:
    """Join Arrow batches into tables of about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A table column as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def texts_of(table: pa.Table, column: str = "text") -> pa.Array:
    return pc.fill_null(one_array(table[column]).cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text in the words, the words) of texts without nulls; words are `[^\\x20\\x09-\\x0D]+`."""
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return kept[offsets], flat.filter(full)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, code of each word, distinct words)."""
    offsets, words = split_words(texts)
    if len(words) == 0:
        return offsets, np.zeros(0, np.int64), pa.array([], pa.string())
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start+length-1 of each range, one range after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - begins, lengths) + np.arange(total)
