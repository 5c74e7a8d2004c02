"""Reading and writing datasets with Spark's own data sources."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Logical types of contract schemas.
TYPES = {"boolean": T.BooleanType(), "integer": T.LongType(), "decimal": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(),
         "date": T.DateType(), "time": T.StringType(), "datetime": T.TimestampType(), "duration": T.StringType()}
FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a session on one machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def logical_type(kind) -> T.DataType:
    """The Spark type of a logical type name or of {list|map|object|tuple: ...}."""
    if isinstance(kind, str):
        return TYPES.get(kind, T.StringType())
    (name, inner), = kind.items()
    if name in ("list", "array"):
        return T.ArrayType(logical_type(inner))
    if name == "map":
        return T.MapType(T.StringType(), logical_type(inner[-1] if isinstance(inner, list) else inner))
    if name == "tuple":
        return T.StructType([T.StructField(f"_{i + 1}", logical_type(k)) for i, k in enumerate(inner)])
    return T.StructType([T.StructField(n, logical_type(k)) for n, k in inner.items()])


def schema_of(interface: Mapping) -> T.StructType | None:
    fields = (interface.get("schema") or {}).get("fields")
    return None if fields is None else T.StructType([T.StructField(f["name"], logical_type(f["type"]), f.get("nullable", True)) for f in fields])


def read(spark: SparkSession, spec: Mapping, schema: T.StructType | None = None) -> DataFrame:
    """spec: {format, path, options} or {table}."""
    if "table" in spec:
        return spark.table(spec["table"])
    if spec.get("format", "parquet") not in FORMATS:
        raise ValueError(f"unknown format {spec['format']!r}")
    reader = spark.read.format(spec.get("format", "parquet")).options(**spec.get("options", {}))
    return (reader.schema(schema) if schema is not None and spec.get("format") in ("json", "csv") else reader).load(spec["path"])


def write(df: DataFrame, spec: Mapping) -> None:
    writer = df.write.mode(spec.get("mode", "errorifexists")).options(**spec.get("options", {}))
    if spec.get("partitionBy"):
        writer = writer.partitionBy(*spec["partitionBy"])
    if "table" in spec:
        writer.saveAsTable(spec["table"])
    else:
        writer.format(spec.get("format", "parquet")).save(spec["path"])
