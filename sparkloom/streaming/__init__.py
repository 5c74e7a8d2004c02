"""Unbounded inputs by Structured Streaming: actions that need no whole input, and windows by event time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ActionError, Context, apply

#: Actions that are defined row by row, or against a bounded dataset.
ALLOWED = frozenset("project filter select with_fields rename_fields drop_fields partition explode union join lowercase uppercase capitalize trim "
                    "normalize_whitespace hash_sha256 with_nested_fields rename_nested_fields drop_nested_fields distinct repartition".split())


def window_of(spec: Mapping) -> Column:
    """{field, size, slide} or {field, gap}: a tumbling, sliding or session window."""
    time = F.col(spec["field"])
    if "gap" in spec:
        return F.session_window(time, spec["gap"])
    return F.window(time, spec["size"], spec.get("slide"))


def windowed(df: DataFrame, time: str, delay: str, window: Mapping, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by event-time window and keys; rows later than `delay` are dropped."""
    out = df.withWatermark(time, delay).groupBy(window_of({"field": time, **window}).alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *[c for c in out.columns if c not in {"window", *keys}])


def apply_stream(actions: list[Mapping], frames: dict[str, DataFrame], watermark: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    """Apply actions to streaming frames; those that need all rows first are refused."""
    for a in actions:
        name, target = a["action"].rpartition(":")[2], a["target"].partition(".")[0]
        if frames[target].isStreaming and name not in ALLOWED:
            raise ActionError(f"{name} is not defined on an unbounded input")
        if name == "distinct" and frames[target].isStreaming:
            df = frames[target].withWatermark(*watermark) if watermark else frames[target]
            keys = (a.get("parameters") or {}).get("fields") or df.columns
            frames = {**frames, target: df.dropDuplicatesWithinWatermark(keys) if watermark else df.dropDuplicates(keys)}
        else:
            frames = apply(a["action"], a["target"], a.get("parameters"), frames, Context())
    return frames
