"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fillmiddle, licences, mixing, neardup, neighbours, packing, pieces, quality, scoring, sharding, spelling, tokenfile, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licences.op1,
        "op2_packing": packing.op2,
        "op3_near_duplicates": neardup.op3,
        "op4_sharding": sharding.op4,
        "op5_mixing": mixing.op5,
        "op6_toxicity": toxicity.op6,
        "op7_lm_scoring": scoring.op7,
        "op8_nearest_neighbours": neighbours.op8,
        "op9_quality_rules": quality.op9,
        "op10_token_files": tokenfile.op10,
        "op11_fill_in_middle": fillmiddle.op11,
        "op12_sentencepiece": pieces.op12,
        "op13_spelling_variants": spelling.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": fillmiddle.OP11_SQL, "op13_spelling_variants": spelling.OP13_SQL}
