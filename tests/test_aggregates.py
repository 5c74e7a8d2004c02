"""Exact quantiles of groups against sorting, and the plans of distinct reductions."""

import collections
import math
import random

import pytest

from sparkloom.operators import ActionError, apply
from sparkloom.operators import quantiles as module


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def rank(values, q):
    values = sorted(v for v in values if v is not None)
    return values[max(math.ceil(q * len(values) - 1e-9), 1) - 1] if values else None


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300), 1.0, 1.0, float("inf"), float("-inf")]), rng.randint(0, 5)) for _ in range(6000)]
    rows += [("one", 7.5, 1), ("none", None, 1), ("none", None, 2), *[("same", 2.0, 3)] * 50]
    return rows, spark.createDataFrame(rows, "k string, x double, n int").repartition(5)


@pytest.mark.parametrize("steps", [4, module.STEPS])
def test_quantiles_of_groups(table, monkeypatch, steps):
    """With four steps the brackets are so wide that both narrowing passes matter."""
    monkeypatch.setattr(module, "STEPS", steps)
    rows, df = table
    shares = [0, 0.001, 0.25, 0.5, 0.9, 1]
    asked = [{"op": "quantile", "field": "x", "q": q, "as": f"q{i}"} for i, q in enumerate(shares)] + [{"op": "median", "field": "x", "as": "m"}, {"op": "median", "field": "x", "as": "d", "distinct": True},
                                                                                                      {"op": "median", "expr": "n * 2", "as": "e"}, {"op": "count_all", "as": "c"}]
    got = {r["k"]: tuple(r)[1:] for r in apply("aggregate", "t", {"groupBy": ["k"], "aggregates": asked}, {"t": df})["t"].collect()}
    groups = collections.defaultdict(list)
    for k, x, n in rows:
        groups[k].append((x, n))
    for k, own in groups.items():
        xs = [x for x, _ in own]
        assert got[k] == (*[rank(xs, q) for q in shares], rank(xs, 0.5), rank(set(xs), 0.5), rank([2.0 * n for _, n in own], 0.5), len(own))
    assert len(got) == len(groups)


def test_quantiles_without_groups(table, spark):
    rows, df = table
    asked = [{"op": "median", "field": "x", "as": "m"}, {"op": "sum", "field": "n", "as": "s"}]
    out = apply("aggregate", "t", {"aggregates": asked}, {"t": df})["t"].first()
    assert tuple(out) == (rank([x for _, x, _ in rows], 0.5), float(sum(n for *_, n in rows)))
    assert apply("aggregate", "t", {"aggregates": asked, "filter": "n > 99"}, {"t": df})["t"].count() == 0
    empty = apply("aggregate", "t", {"groupBy": ["k"], "aggregates": asked}, {"t": df.filter("n > 99")})["t"]
    assert empty.count() == 0 and empty.columns == ["k", "m", "s"]
    with pytest.raises(ActionError):
        apply("aggregate", "t", {"aggregates": [{"op": "quantile", "field": "x", "q": 2, "as": "z"}]}, {"t": df})


def test_no_group_is_collected(table):
    _, df = table
    text = plan(apply("aggregate", "t", {"groupBy": ["k"], "aggregates": [{"op": "median", "field": "x", "as": "m"}]}, {"t": df})["t"])
    assert "collect_" not in text and "percentile_disc" not in text and "approx_percentile" in text.lower().replace("percentile_approx", "approx_percentile")


def test_distinct_reductions_of_a_field_are_one_group(table):
    _, df = table
    asked = [{"op": op, "field": "n", "as": op, "distinct": True} for op in ("sum", "average", "variance", "stddev", "var_pop", "stddev_pop")]
    out = apply("aggregate", "t", {"groupBy": ["k"], "aggregates": asked}, {"t": df})["t"]
    assert "Expand" not in plan(out)
    assert {r["k"]: (r["sum"], r["average"]) for r in out.collect()}["one"] == (1.0, 1.0)


def test_pairs_skip_rows_with_a_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (None, 9.0), (3.0, None), (4.0, 7.0)], "x double, y double")
    asked = [{"op": "covariance", "field": "x", "other": "y", "as": "c"}, {"op": "correlation", "field": "x", "other": "y", "as": "r"}, {"op": "covariance", "field": "x", "other": "y", "as": "p", "mode": "population"}]
    out = apply("aggregate", "t", {"aggregates": asked}, {"t": df})["t"].first()
    assert out["c"] == pytest.approx(3.75) and out["p"] == pytest.approx(2.5) and out["r"] == pytest.approx(0.981, abs=1e-3)
    assert apply("aggregate", "t", {"aggregates": [{"op": "correlation", "expr": "x - x", "other": "y", "as": "r"}]}, {"t": df})["t"].first()["r"] is None
    with pytest.raises(ActionError):
        apply("aggregate", "t", {"aggregates": [{"op": "covariance", "field": "x", "as": "c"}]}, {"t": df})
