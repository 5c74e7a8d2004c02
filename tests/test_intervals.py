"""Joins on ranges against nested loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.expressions import parse
from sparkloom.operators import apply
from sparkloom.operators.intervals import bounds


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def joined(left, right, on, **more):
    return apply("join", "l", {"right": "r", "on": on, **more}, {"l": left, "r": right})["l"]


def tables(spark, seed):
    rng = random.Random(seed)
    number = lambda: rng.choice([None, rng.uniform(-50, 50), rng.uniform(-1, 1) * 10.0 ** rng.randint(-8, 12), float(rng.randint(-5, 5)), float("inf"), float("nan"), -0.0])
    left = [(i, number(), number(), rng.randint(-9, 9)) for i in range(150)]
    right = [(i, number(), number(), rng.randint(-9, 9)) for i in range(130)]
    return spark.createDataFrame(left, "a long, x double, y double, n int"), spark.createDataFrame(right, "b long, u double, v double, m int")


@pytest.mark.parametrize("on", [
    "u <= x && x < v", "x >= u && x <= v && a + b > 20", "u between x and y", "x <= v && u <= y", "x - 3.0 <= u && u <= x + 3.0", "m between n - 1 and n + 1", "n <= m && m <= n", "x < u && u < y && (a % 2 == 0 || b % 3 == 0)",
    "x > u && y < v"])
def test_matches_a_nested_loop(spark, on):
    left, right = tables(spark, 3)
    got = joined(left, right, on)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    text = on.replace("&&", "and").replace("||", "or").replace("==", "=")
    want = left.crossJoin(right).filter(F.expr(text)).select("a", "b")
    assert sorted(map(tuple, got.select("a", "b").collect())) == sorted(map(tuple, want.collect()))
    assert got.columns == ["a", "x", "y", "n", "b", "u", "v", "m"]


def test_moments_dates_and_shared_names(spark):
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)
    left = spark.createDataFrame([(i, day(i), day(i + i % 5)) for i in range(60)], "id int, starts timestamp, ends timestamp")
    right = spark.createDataFrame([(i, day(1.5 * i), (day(1.5 * i)).date()) for i in range(40)], "id int, ts timestamp, d date")
    got = joined(left, right, "starts <= ts && ts <= ends")
    assert sorted((r["starts"], r["ts"]) for r in got.collect()) == sorted((day(i), day(1.5 * k)) for i in range(60) for k in range(40) if i <= 1.5 * k <= i + i % 5)
    both = joined(left, right, "starts <= ts && ts <= ends", collisionPolicy="suffix").collect()
    assert all(r["id_left"] <= 1.5 * r["id_right"] <= r["id_left"] + r["id_left"] % 5 for r in both) and len(both) == got.count()
    assert joined(left, right, "d >= starts && d <= ends", collisionPolicy="preferRight").count() == sum(day(i) <= datetime.datetime.combine(day(1.5 * k).date(), datetime.time()) <= day(i + i % 5) for i in range(60) for k in range(40))


def test_empty_sides_and_other_predicates(spark):
    left, right = tables(spark, 5)
    assert joined(left.filter("a < 0"), right, "u <= x && x < v").count() == 0 and joined(left, right.filter("b < 0"), "u <= x && x < v").count() == 0
    assert joined(left, right, "x < u").count() == left.crossJoin(right).filter("x < u").count()
    assert joined(left, right, "n == m && x < u && x > v").count() == left.crossJoin(right).filter("n = m and x < u and x > v").count()
    assert joined(left, right, "u <= x && x < v", type="left").count() >= left.count()


def test_bounds_are_read_from_the_predicate():
    sides = {"x": "l", "y": "l", "u": "r", "v": "r"}
    found = bounds(parse("u <= x && x + 1 < v && x < y && u == 3"), sides)
    assert (len(found["upper"]), len(found["lower"]), found["equal"]) == (1, 1, []) and len(bounds(parse("x == u || x < u"), sides)["upper"]) == 0


def test_many_points_and_few_long_intervals_stay_small(spark):
    """One interval over everything and ten thousand short ones: bins made are a few for each row and size, not one for each bin that the long one covers."""
    left = spark.range(10_000).select("id", (F.col("id") * 10.0).alias("low"), (F.col("id") * 10.0 + F.when(F.col("id") == 5, 1e6).otherwise(3.0)).alias("high"))
    right = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") * 10.0 + 1).alias("t"))
    assert joined(left, right, "low <= t && t <= high").count() == 10_000 + 9_994


def test_full_bins_are_cut_into_slices(spark, monkeypatch):
    """All rows of one side in one bin: the pairs are those of the nested loop, and both sides deal them by slices."""
    from sparkloom.operators import apply_all, intervals

    a = spark.range(300).selectExpr("id AS i", "900.0 + id % 7 AS low", "map('k', id) AS m")
    b = spark.range(90).selectExpr("id AS j", "CASE WHEN id % 3 = 0 THEN 903.0 + id % 2 ELSE double(id * 40) END AS x")
    asked = [{"action": "join", "target": "a", "parameters": {"right": "b", "on": "x between low - 40.0 and low + 40.0 && (i + j) % 2 == 0"}}]
    want = sorted((p.i, q.j) for p in a.collect() for q in b.collect() if p.low - 40 <= q.x <= p.low + 40 and (p.i + q.j) % 2 == 0)
    monkeypatch.setattr(intervals, "CANDIDATES", 100, raising=False)
    got = apply_all(asked, {"a": a, "b": b})["a"]
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert "__slices" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_written_in_few_bytes(spark, tmp_path):
    """40 intervals with 25,000 points in each, too many to repeat within a page of a file: written, the million pairs take far fewer bytes than two numbers each."""
    a = spark.range(40).selectExpr("id AS i", "900.0 + id % 7 AS low", "1000.0 + id % 7 AS high")
    b = spark.range(25_000).selectExpr("id AS j", "907.0 + (id * 7919) % 25000 / 300 AS x")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined(a, b, "low <= x && x < high").select("i", "j").write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    back, want = spark.read.parquet(str(tmp_path / "out")), a.crossJoin(b).filter("low <= x and x < high").select("i", "j")
    assert want.count() == back.count() == 1_000_000 and back.exceptAll(want).isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 500_000


def test_rows_far_from_all_others_are_left_out_and_long_rows_end_blocks(spark, monkeypatch):
    from sparkloom.operators import intervals

    monkeypatch.setattr(intervals, "INNER", 3)
    monkeypatch.setattr(intervals, "OUTER", 50)
    monkeypatch.setattr(intervals, "BLOCK_BYTES", 400)
    a = spark.range(200).selectExpr("id AS i", "double(id) AS low", "double(id + id % 9) AS high", "map('k', id) AS m", "if(id % 5 = 0, null, repeat('x', int(id))) AS s")
    b = spark.range(120).selectExpr("id AS j", "id + 90.5 AS x", "array(struct(id)) AS n")
    got = joined(a, b, "low <= x && x <= high")
    assert sorted((r.i, r.j, r.m["k"], r.n[0].id, len(r.s or "")) for r in got.collect()) == sorted((i, j, i, j, i if i % 5 else 0) for i in range(200) for j in range(120) if i <= j + 90.5 <= i + i % 9)
    rows = a.withColumns({"__low": F.lit(0.0), "__high": F.col("low"), "__level": F.lit(0), "__bin": F.lit(0).cast("long")})
    made = [sum(len(r["s"] or "") for r in block["__rows"]) for block in intervals.blocks(rows, a.columns, 50, 2).collect()]
    assert max(made) < 400 + 200 and sum(made) == sum(i for i in range(200) if i % 5)


def test_pairs_are_made_as_they_are_read(spark):
    """2,000 rows that all meet 2,000 others: the first pair is there when a short list of pairs has been made, not when the pairs of whole blocks have."""
    a = spark.range(2_000).selectExpr("id AS i", "900.0 + id % 7 AS low", "1000.0 + id % 7 AS high")
    b = spark.range(2_000).selectExpr("id AS j", "907.0 + id / 100 AS x")
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        first = joined(a, b, "low <= x && x < high").select("i", "j").limit(1)
        taken = first._jdf.queryExecution().executedPlan()
        assert taken.executeTake(1) is not None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

    def made(node):
        own = [node.metrics().get("numOutputRows").get().value()] if node.nodeName() == "Generate" else []
        below = node.children()
        return own + [n for i in range(below.size()) for n in made(below.apply(i))]

    assert 0 < max(made(taken)) < 20_000


@pytest.mark.parametrize("most, full", [(50_000, 5_000_000), (50_000, 20), (3, 20), (3, 5_000_000)])
def test_rows_of_bins_that_the_other_side_lacks_stay_behind(spark, monkeypatch, most, full):
    """Short intervals far apart: rows between them take no part if the shared bins are few; the pairs are all there with few and with many, full or not."""
    from sparkloom.operators import intervals

    monkeypatch.setattr(intervals, "BINS", most, raising=False)
    monkeypatch.setattr(intervals, "CANDIDATES", full)
    kept, blocks = [], intervals.blocks
    monkeypatch.setattr(intervals, "blocks", lambda df, *more: kept.append(df) or blocks(df, *more))
    a = spark.range(80).selectExpr("id AS i", "double(id % 8 * 1000) AS low", "id % 8 * 1000 + 1.0 + id % 20 AS high")
    b = spark.range(8_000).selectExpr("id AS j", "double(id) AS x")
    got = joined(a, b, "low <= x && x < high")
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i in range(80) for j in range(i % 8 * 1000, i % 8 * 1000 + 1 + i % 20))
    if most == 50_000:
        assert kept[1].select("j").distinct().count() <= 8 * 64
