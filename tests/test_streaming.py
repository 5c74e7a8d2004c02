import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ActionError
from sparkloom.streaming import apply_stream, windowed


def source(spark, folder):
    spark.range(6).select(F.col("id"), F.timestamp_seconds(F.col("id") * 40).alias("ts"), (F.col("id") % 2).alias("g")).write.parquet(folder)
    return spark.readStream.schema("id long, ts timestamp, g long").parquet(folder)


def drained(spark, df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_row_actions_run_on_a_stream(spark, tmp_path):
    frames = apply_stream([{"action": "filter", "target": "s", "parameters": {"predicate": "id > 2"}}, {"action": "project", "target": "s", "parameters": {"fields": ["id"]}}], {"s": source(spark, str(tmp_path / "in"))})
    assert drained(spark, frames["s"], "rows_out") == [(3,), (4,), (5,)]


def test_windows_by_event_time(spark, tmp_path):
    df = windowed(source(spark, str(tmp_path / "in")), "ts", "10 seconds", {"size": "1 minute"}, ["g"], [F.count(F.lit(1)).alias("n")])
    out = drained(spark, df, "windows_out", "complete")
    assert sum(r[-1] for r in out) == 6 and len(out) == 6


def test_actions_that_need_all_rows_are_refused(spark, tmp_path):
    with pytest.raises(ActionError):
        apply_stream([{"action": "sort", "target": "s", "parameters": {"keys": ["id"]}}], {"s": source(spark, str(tmp_path / "in"))})
