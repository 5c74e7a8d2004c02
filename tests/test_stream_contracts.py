"""Contracts with unbounded inputs give what they give for the same rows at once, also after a restart."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ActionError, Context, apply
from sparkloom.streaming import window_of
from sparkloom.streaming.contracts import execute_stream

FIELDS = [{"name": "id", "type": "integer"}, {"name": "ts", "type": "datetime"}, {"name": "k", "type": "string"}, {"name": "v", "type": "integer"}]


def contract(actions, fields, rules=(), **more):
    stream = {"schema": {"fields": FIELDS}, "streaming": {"mode": "unbounded"}, "watermark": {"field": "ts", "delay": "10 minutes"}}
    return {"id": "c", "name": "c", "version": "1", "inputs": [{"id": "s", **stream}, *more.pop("inputs", [])], "outputs": [{"id": "o", "schema": {"fields": [{"name": n, "type": t} for n, t in fields]}}],
            "semanticActions": [{"id": f"a{i}", "action": n, "target": t, "parameters": p} for i, (n, t, p) in enumerate(actions)], "rules": list(rules),
            "semantics": {"ordering": {"mode": "explicit", "order": [f"a{i}" for i in range(len(actions))]}}, "lineage": {"mappings": [{"id": "m", "output": "o", "inputs": ["s"]}]}}


def rows(a, b):
    at = datetime.datetime(2024, 1, 1)
    return [(i, at + datetime.timedelta(minutes=7 * i), "abc"[i % 3], i % 5) for i in range(a, b)]


def put(spark, folder, part):
    spark.createDataFrame(part, "id long, ts timestamp, k string, v long").coalesce(1).write.mode("append").parquet(folder)


def run(spark, c, tmp_path, more=None, mode="fail"):
    """Two files, then a new start for the third."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spec = {"path": source, "options": {"maxFilesPerTrigger": "1"}}
    for part in ((0, 20), (20, 40), (40, 60)):
        put(spark, source, rows(*part))
        if part[0]:
            streams = execute_stream(c, spark, {"s": spec, **(more or {})}, out, mode=mode)
            streams.done()
    return streams


def test_rows_rules_and_quarantine_count_once(spark, tmp_path):
    c = contract([("with_fields", "s", {"assignments": [{"as": "q", "expr": "12 / v"}]}), ("join", "s", {"right": "names", "leftKey": "k", "rightKey": "n"})], [("id", "integer"), ("q", "integer"), ("name", "string")],
                 [{"id": "r", "rule": "range", "target": "o.q", "phase": "postcondition", "parameters": {"max": 6}}], inputs=[{"id": "names"}])
    names = spark.createDataFrame([("a", "x"), ("b", "y")], "n string, name string")
    c["semanticActions"] = c["semanticActions"][:1] + [c["semanticActions"][1]]
    streams = run(spark, {**c, "semanticActions": c["semanticActions"][:1], "semantics": {}, "outputs": [{"id": "o", "schema": {"fields": [{"name": "id", "type": "integer"}, {"name": "q", "type": "integer"}]}}]}, tmp_path, {"names": names}, mode="route")
    assert sorted(map(tuple, streams.output("o").collect())) == [(i, 12 // (i % 5)) for i in range(60) if i % 5]
    assert sorted((r["code"], r["field"]) for r in streams.quarantine("o").collect()) == [("division_by_zero", "q")] * 12
    assert [(o.outcome, o.violations, o.rows) for o in streams.outcomes("o")] == [("violated", 12, 48)]
    joined = run(spark, {**c, "rules": []}, tmp_path / "b", {"names": names}, mode="null")
    assert sorted(r["id"] for r in joined.output("o").collect()) == [i for i in range(60) if i % 3 < 2]


def test_first_of_each_key_over_restarts(spark, tmp_path):
    c = contract([("deduplicate", "s", {"keys": ["k", "v"], "retain": "first", "orderBy": ["id"]})], [("id", "integer"), ("k", "string"), ("v", "integer")])
    got = sorted(map(tuple, run(spark, c, tmp_path).output("o").collect()))
    batch = apply("deduplicate", "s", {"keys": ["k", "v"]}, {"s": spark.createDataFrame(rows(0, 60), "id long, ts timestamp, k string, v long").withColumn("__row_id", F.col("id"))}, Context())["s"]
    assert got == sorted(map(tuple, batch.select("id", "k", "v").collect())) and len(got) == 15


def test_windows_close_behind_the_watermark(spark, tmp_path):
    c = contract([("aggregate", "s", {"window": {"size": "1 hour"}, "groupBy": ["k"], "aggregates": [{"op": "sum", "field": "v", "as": "v"}, {"op": "count_all", "as": "id"}]})],
                 [("window_start", "datetime"), ("k", "string"), ("v", "decimal"), ("id", "integer")])
    got = sorted(map(tuple, run(spark, c, tmp_path).output("o").collect()))
    every = spark.createDataFrame(rows(0, 60), "id long, ts timestamp, k string, v long").groupBy(window_of({"field": "ts", "size": "1 hour"}).alias("w"), "k").agg(F.sum("v").cast("double").alias("v"), F.count(F.lit(1)).alias("id"))
    closed = every.filter(F.col("w.end") <= F.lit(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=7 * 59 - 10))).select("w.start", "k", "v", "id")
    assert got == sorted(map(tuple, closed.collect())) and len(got) > 10


def test_two_streams_meet_within_time(spark, tmp_path):
    other = [{"name": "id2", "type": "integer"}, {"name": "ts2", "type": "datetime"}, {"name": "k2", "type": "string"}]
    c = contract([("join", "s", {"right": "r", "leftKey": "k", "rightKey": "k2", "on": "ts2 <= ts && ts <= date_add(ts2, 50, \"minute\")"})], [("id", "integer"), ("id2", "integer")],
                 inputs=[{"id": "r", "schema": {"fields": other}, "streaming": {"mode": "unbounded"}, "watermark": {"field": "ts2", "delay": "5 minutes"}}])
    right = str(tmp_path / "right")
    spark.createDataFrame([(i, t, k) for i, t, k, _ in rows(0, 60)], "id2 long, ts2 timestamp, k2 string").coalesce(1).write.parquet(right)
    got = run(spark, c, tmp_path, {"r": {"path": right}}).output("o")
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i in range(60) for j in range(60) if 0 <= 7 * (i - j) <= 50 and i % 3 == j % 3)
    for p in ({"on": "ts2 <= ts", "leftKey": "k", "rightKey": "k2"}, {"leftKey": "id", "rightKey": "id2"}, {"on": "ts2 <= ts && ts <= date_add(ts2, 20, \"minute\")"}):
        bad = contract([("join", "s", {"right": "r", **p})], [("id", "integer")], inputs=c["inputs"][1:])
        with pytest.raises(ActionError):
            execute_stream(bad, spark, {"s": {"path": str(tmp_path / "in")}, "r": {"path": right}}, str(tmp_path / "x"))


def test_what_needs_all_rows_is_refused(spark, tmp_path):
    put(spark, str(tmp_path / "in"), rows(0, 2))
    for name, p in (("sort", {"keys": ["id"]}), ("limit", {"count": 1}), ("aggregate", {"groupBy": ["k"], "aggregates": [{"op": "count_all", "as": "n"}]}), ("deduplicate", {"keys": ["k"], "retain": "last"}),
                    ("window", {"orderBy": ["id"], "functions": [{"as": "n", "function": "row_number"}]}), ("distinct", {})):
        with pytest.raises(ActionError):
            execute_stream(contract([(name, "s", p)], [("id", "integer")]), spark, {"s": {"path": str(tmp_path / "in")}}, str(tmp_path / "o"))


def test_the_least_row_has_nulls_last_and_reads_no_more_columns_than_it_needs():
    import pandas as pd

    from sparkloom.streaming.contracts import first_row

    part = pd.DataFrame({"a": [2, None, 1, 1], "b": ["x", "w", None, "z"], "c": [1.0, 1.0, 1.0, 2.0], "d": [[1], {}, 3, "never compared"]})
    assert first_row(part, ["a", "b", "c", "d"]).values.tolist() == [[1, "z", 2.0, "never compared"]]
    assert first_row(part.assign(a=None), ["a", "b"])["b"].tolist() == ["w"]
    assert len(first_row(pd.concat([part, part]), ["a", "b", "c"])) == 1
