"""The corpus pipeline: documents to packed training sequences, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import mixing, neardup, packing, quality, toxicity
from sparkloom.llm.common import shared_dir

STAGES = [
    ("quality rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("near duplicates", neardup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; returns the pieces of the packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: Expectation-maximisation, learning and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
