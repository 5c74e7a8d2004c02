"""Windows over one order by ranges, and medians over moving frames, against plain Python."""

import datetime
import math
import random
import time

import pyarrow as pa
import pytest

from sparkloom.operators import apply, ordered
from sparkloom.operators.sliding import Sorted, medians


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


ALL = [{"as": n, "function": n} for n in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist")] + [
    {"as": "tile", "function": "ntile", "n": 4}, {"as": "back", "function": "lag", "field": "v", "offset": 2, "default": -1}, {"as": "ahead", "function": "lead", "field": "v"},
    {"as": "total", "function": "sum", "field": "v"}, {"as": "seen", "function": "count", "field": "v"}, {"as": "least", "function": "min", "expr": "v * 2"}, {"as": "most", "function": "max", "field": "v"}]


def expected(rows, key, down, nulls_last):
    """rows: (key, v, row id) to the functions' values by row id."""
    null = [r for r in rows if key(r) is None]
    rest = sorted((r for r in rows if key(r) is not None), key=lambda r: r[2])
    rest.sort(key=key, reverse=down)
    order = rest + sorted(null, key=lambda r: r[2]) if nulls_last else sorted(null, key=lambda r: r[2]) + rest
    out, n, rank, dense, held = {}, len(order), 0, 0, []
    for i, r in enumerate(order):
        if not i or key(order[i - 1]) != key(r):
            rank, dense = i + 1, dense + 1
        peers = max(j for j in range(n) if key(order[j]) == key(r)) + 1
        held.append(r[1])
        there = [x for x in held if x is not None]
        out[r[2]] = (i + 1, rank, dense, (rank - 1) / (n - 1) if n > 1 else 0.0, peers / n, i * 4 // n + 1, order[i - 2][1] if i > 1 else -1, order[i + 1][1] if i + 1 < n else None,
                     float(sum(there)) if there else None, len(there), 2.0 * min(there) if there else None, float(max(there)) if there else None)
    return out


@pytest.mark.parametrize(("kind", "down", "nulls"), [("double", False, "last"), ("double", True, "last"), ("string", False, "first"), ("timestamp", True, "first"), ("boolean", False, "last"), ("long", False, "last")])
def test_one_order_of_all_rows(spark, monkeypatch, kind, down, nulls):
    monkeypatch.setattr(ordered, "BUCKETS", 9)
    rng = random.Random(kind)
    make = {"double": lambda: rng.choice([1.5, -2.0, 0.0, rng.gauss(0, 1e6), float("inf")]), "string": lambda: rng.choice(["", "a", "same prefix one", "same prefix two", "é", chr(rng.randint(97, 122))]),
            "timestamp": lambda: datetime.datetime(2024, 1, rng.randint(1, 28)), "boolean": lambda: rng.random() < 0.5, "long": lambda: rng.randint(-5, 5)}[kind]
    rows = [(None if rng.random() < 0.1 else make(), rng.choice([None, rng.randint(0, 9)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, f"k {kind}, v long, __row_id long").repartition(5)
    out = apply("window", "t", {"orderBy": [{"field": "k", "descending": down, "nulls": nulls}], "functions": ALL}, {"t": df})["t"]
    assert "SinglePartition" not in plan(out) and out.columns == ["k", "v", "__row_id", *[f["as"] for f in ALL]]
    want = expected(rows, lambda r: r[0], down, (nulls == "last") != down)
    for r in out.collect():
        assert tuple(r)[3:] == pytest.approx(want[r["__row_id"]]), r


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, 5)], "k double, v long")
    ask = lambda t: apply("window", "t", {"orderBy": [{"field": "k"}], "functions": ALL}, {"t": t})["t"]
    assert tuple(ask(df).first())[2:] == (1, 1, 1, 0.0, 1.0, 1, -1, None, 5.0, 1, 10.0, 5.0)
    assert ask(df.filter("k < 0")).count() == 0
    nan = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (None, 3), (float("nan"), 4)], "k double, v long")
    assert {r["v"]: r["rank"] for r in ask(nan).collect()} == {2: 1, 1: 2, 4: 2, 3: 4}


def test_frames_that_ranges_do_not_cover_stay_with_spark(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(9)], "k double, v long")
    out = apply("window", "t", {"orderBy": [{"field": "k"}], "frame": {"start": {"preceding": 1}, "end": "currentRow"}, "functions": [{"as": "s", "function": "sum", "field": "v"}]}, {"t": df})["t"]
    assert [r["s"] for r in out.orderBy("k").collect()] == [0.0, 1.0, 3.0, 5.0, 7.0, 9.0, 11.0, 13.0, 15.0]


def rank_median(values):
    values = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    return values[math.ceil(len(values) * 0.5) - 1] if values else None


@pytest.mark.parametrize(("low", "high"), [(None, 0), (None, 3), (None, -2), (-3, 0), (-2, 2), (0, 0), (1, 4), (-5, -2), (2, -1)])
def test_moving_medians(low, high):
    rng = random.Random(f"{low}{high}")
    value = lambda: rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 1), 1.0, 1.0])
    groups = [[value() for _ in range(n)] for n in (1, 50, 3, 0, 120)]
    rows = [(f"g{i}", v) for i, g in enumerate(groups) for v in g]
    batches = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows[a:a + 37]]), pa.array([v for _, v in rows[a:a + 37]], pa.float64())], ["__part", "__value"]) for a in range(0, len(rows), 37)]
    got = [x for b in medians(low, high)(iter(batches)) for x in b.column("__median").to_pylist()]
    want = [rank_median(g[max(0, 0 if low is None else i + low):max(0, i + high + 1)]) for g in groups for i in range(len(g))]
    same = lambda a, b: a == b or (a is not None and b is not None and a != a and b != b)
    assert len(got) == len(want) and all(map(same, got, want))
    assert list(medians(low, high)(iter([]))) == []


def test_long_partitions_take_linear_logarithmic_time():
    """Four times the rows take far less than sixteen times as long, and nothing is sorted for each row."""
    rng, took = random.Random(1), {}
    for n in (50_000, 200_000):
        values, held, began = [rng.random() for _ in range(n)], Sorted(), time.process_time()
        for v in values:
            held.add(v)
            held.median()
        took[n] = time.process_time() - began
        for v in values[: n - 1]:
            held.remove(v)
        assert held.median() == values[-1]
    assert took[200_000] < 10 * took[50_000] + 1


def test_medians_in_the_action(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([None, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    out = apply("window", "t", {"partitionBy": ["k"], "orderBy": [{"field": "i", "descending": True}], "functions": [
        {"as": "m", "function": "median", "field": "v"}, {"as": "e", "function": "median", "expr": "v * 2.0", "frame": {"start": {"preceding": 2}, "end": {"following": 1}}}, {"as": "n", "function": "row_number"}]}, {"t": df})["t"]
    assert out.columns == ["k", "i", "v", "m", "e", "n"]
    for k in "ab":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        got = sorted((r for r in out.collect() if r["k"] == k), key=lambda r: -r["i"])
        for j, r in enumerate(got):
            near = [x[2] for x in own[max(0, j - 2):j + 2]]
            assert (r["m"], r["e"], r["n"]) == (rank_median([x[2] for x in own[:j + 1]]), rank_median([None if x is None else 2 * x for x in near]), j + 1)


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_of_large_partitions_go_by_ranges(spark, monkeypatch, descending):
    """Equal to Spark's own windows, and no task sorts a whole partition."""
    from sparkloom.operators import apply_all, ordered

    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS p", "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN double('NaN') ELSE double(id * 7919 % 101) END AS x", "id % 2 AS y").unionAll(
        spark.sql("SELECT 3000L, 9L, 1.0D, 0L"))
    asked = [{"action": "window", "target": "t", "parameters": {"partitionBy": ["p"], "orderBy": [{"field": "x", "descending": descending}, {"field": "y"}],
                                                                "functions": [{"as": n, "function": n} for n in sorted(ordered.RANKS)]}}]
    plain = apply_all(asked, {"t": df})["t"]
    monkeypatch.setattr(ordered, "LARGE", 100)
    cut = apply_all(asked, {"t": df})["t"]
    assert "__range" in cut._jdf.queryExecution().optimizedPlan().toString() and cut.columns == plain.columns
    assert sorted(map(tuple, cut.drop("x").collect()), key=str) == sorted(map(tuple, plain.drop("x").collect()), key=str)


def test_medians_of_one_action_share_a_sort_and_carry_no_copies(spark):
    df = spark.createDataFrame([(i % 2, i, float(i * 7 % 11), i * 5 % 9) for i in range(40)], "k int, o int, v double, w long")
    frame = {"start": {"preceding": 2}, "end": {"preceding": 1}}
    out = apply("window", "t", {"partitionBy": ["k"], "orderBy": [{"field": "o"}], "functions": [
        {"as": "m", "function": "median", "field": "v"}, {"as": "n", "function": "median", "field": "w"}, {"as": "b", "function": "median", "field": "v", "frame": frame}]}, {"t": df})["t"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "__value" not in plan
    for k in (0, 1):
        own = sorted(r for r in out.collect() if r["k"] == k)
        for j, r in enumerate(own):
            assert (r["m"], r["n"], r["b"]) == (rank_median([x["v"] for x in own[:j + 1]]), rank_median([x["w"] for x in own[:j + 1]]), rank_median([x["v"] for x in own[max(0, j - 2):j]]))
