"""Statistics over arguments and lists: values, and each list built once however often a formula names it."""

import pytest

from sparkloom.operators import apply_all

XY = "list(a, b, c), list(1.0, 2.0, 4.0, 9.0)"


def asked(spark, expression):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (None, 2.0, 6.0), (None, None, 6.0), (None, None, None), (2.0, 2.0, 2.0)], "a double, b double, c double").coalesce(1)
    return apply_all([{"action": "project", "target": "t", "parameters": {"fields": [{"expr": expression, "as": "x"}]}}], {"t": df})["t"]


@pytest.mark.parametrize(("expression", "values"), [
    (f"covariance({XY})", [4.0, 4.0, None, None, 0.0]), (f'covariance({XY}, "population")', [8 / 3, 2.0, None, None, 0.0]), (f"correlation({XY})", [8 / (14 * 14 / 3) ** 0.5, 1.0, None, None, None]),
    ("variance(a, b, c)", [7.0, 8.0, None, None, 0.0]), ('stddev(a, b, c, "population")', [(14 / 3) ** 0.5, 2.0, None, None, 0.0])])
def test_spread_reads_each_list_once(spark, expression, values):
    df = asked(spark, expression)
    assert [r["x"] for r in df.collect()] == [v if v is None else pytest.approx(v) for v in values]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") == 1 and plan.count("aggregate(") == 2


@pytest.mark.parametrize(("expression", "values"), [("median(a, b, c)", [2.0, 2.0, 6.0, None, 2.0]), ("quantile(a, b, c, 0.75)", [6.0, 6.0, 6.0, None, 2.0]), ("quantile(a, b, c, 0.0)", [1.0, 2.0, 6.0, None, 2.0])])
def test_ranks_sort_each_list_once(spark, expression, values):
    df = asked(spark, expression)
    assert [r["x"] for r in df.collect()] == values
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") == 1 and plan.count("sort_array(") == 1
