"""Contracts as writing jobs: the graph's order, shared frames, checks inside the jobs, optional inputs, exact conversions."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import ContractError, RuleViolation, run, validate
from sparkloom.plans.contract_queries import SALES_CONTRACT
from sparkloom.plans.execution import execute
from sparkloom.plans.graph import graph_of


def counting(df, column):
    """(df whose rows are counted each time they are computed, the counter)"""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(count, df.schema[column].dataType).asNondeterministic()(column)), seen


@pytest.fixture
def tables(spark):
    orders = spark.createDataFrame([(i, i % 10, "FOP"[i % 3], float(i), 1, 1.5 * i) for i in range(300)], "o_orderkey long, o_custkey long, o_orderstatus string, whole double, n int, total double").repartition(3)
    customer = spark.createDataFrame([(i, f"SEG{i % 3}") for i in range(9)], "c_custkey long, c_mktsegment string").repartition(2)
    return {"orders": orders, "customer": customer}


def test_order_follows_from_reads_and_writes():
    names = [n if isinstance(n, str) else n["id"] for n in graph_of(SALES_CONTRACT).order]
    assert validate(SALES_CONTRACT) == [] and sorted(names) == sorted(["named", "priced", "sales", "segments", "rest", "sum"])
    assert names.index("named") < names.index("priced") < names.index("sales") < names.index("rest") and names.index("segments") < names.index("sum")
    assert graph_of(SALES_CONTRACT).readers == {"orders": 2, "customer": 1, "returns": 1}


def test_cycles_and_bad_orders_are_refused():
    bad = json.loads(json.dumps(SALES_CONTRACT))
    bad["semanticActions"].append({"id": "back", "action": "join", "target": "customer", "parameters": {"right": "orders", "leftKey": "c_custkey", "rightKey": "o_custkey"}})
    bad["semanticActions"] = [a for a in bad["semanticActions"] if a["id"] != "named"]
    assert any("cycle" in x for x in validate(bad))
    bad = json.loads(json.dumps(SALES_CONTRACT))
    bad["semantics"] = {"ordering": {"mode": "explicit", "order": ["named", "named", "nothing", "priced"]}}
    found = " ".join(validate(bad))
    assert "twice" in found and "'nothing'" in found and "lacks action 'sum'" in found
    bad["semantics"] = {"ordering": {"mode": "explicit", "order": ["sum", "priced", "rest", "named"]}}
    assert validate(bad) == []


def test_inputs_are_read_once_and_the_shared_join_is_kept(spark, tables, tmp_path):
    orders, seen = counting(tables["orders"], "o_orderkey")
    customer, other = counting(tables["customer"], "c_custkey")
    done = execute(SALES_CONTRACT, {"orders": orders, "customer": customer}, str(tmp_path), on_violation="report")
    assert (seen.value, other.value) == (300, 9)
    assert {o.id: (o.outcome, o.violations, o.indeterminate, o.rows) for o in done.outcomes} == {
        "status": ("violated", 100, 0, 300), "key": ("satisfied", 0, 0, 300), "segment": ("satisfied", 0, 0, 9), "yes": ("indeterminate", 0, 120, 270), "many": ("satisfied", 0, 0, 3), "sale": ("satisfied", 0, 0, 270)}
    assert done.outputs["sales"].count() == 270 and done.outputs["sales"].dtypes[2] == ("whole", "bigint")
    assert sorted(map(tuple, done.outputs["segments"].collect())) == [(f"SEG{s}", 90, sum(1.5 * i for i in range(300) if i % 10 < 9 and i % 10 % 3 == s)) for s in range(3)]


def test_violations_raise_with_all_outcomes(tables, tmp_path):
    with pytest.raises(RuleViolation) as error:
        execute(SALES_CONTRACT, tables, str(tmp_path))
    assert len(error.value.outcomes) == 6 and "status" in str(error.value) and "yes" not in str(error.value)
    firm = json.loads(json.dumps(SALES_CONTRACT))
    del firm["rules"][0], firm["rules"][2]["allowIndeterminate"]
    with pytest.raises(RuleViolation) as error:
        execute(firm, tables, str(tmp_path / "b"))
    assert [o.id for o in error.value.outcomes if o.outcome == "violated"] == ["yes"]


def test_inputs_are_checked_in_the_job(tables, tmp_path):
    with pytest.raises(ContractError, match="3 nulls in 'c_custkey'"):
        execute(SALES_CONTRACT, {**tables, "customer": tables["customer"].withColumn("c_custkey", F.expr("nullif(c_custkey % 3, 0)"))}, str(tmp_path / "a"))
    with pytest.raises(ContractError, match="customer: no rows"):
        execute(SALES_CONTRACT, {**tables, "customer": tables["customer"].filter("c_custkey < 0")}, str(tmp_path / "b"))
    with pytest.raises(ContractError, match="orders is missing"):
        execute(SALES_CONTRACT, {"customer": tables["customer"]}, str(tmp_path / "c"))


def small(**more):
    return {"id": "c", "name": "c", "version": "1", "inputs": [{"id": "a", "schema": {"fields": [{"name": "x", "type": "decimal"}]}}], "outputs": [{"id": "o", "schema": {"fields": [{"name": "x", "type": "integer"}]}}], **more}


def test_rules_below_a_limit_see_every_row(spark, tmp_path):
    contract = small(semanticActions=[{"id": "l", "action": "limit", "target": "a", "parameters": {"count": 2}}],
                     rules=[{"id": "r", "rule": "range", "target": "a.x", "phase": "precondition", "parameters": {"max": 50}}])
    done = execute(contract, {"a": spark.range(100).select(F.col("id").cast("double").alias("x")).repartition(7)}, str(tmp_path), on_violation="report")
    assert [(o.violations, o.rows) for o in done.outcomes] == [(49, 100)] and done.outputs["o"].count() == 2


def test_conversions_refuse_what_is_not_exact(spark, tmp_path):
    rows = spark.createDataFrame([(1.0,), (2.5,), (1e300,), (None,)], "x double")
    with pytest.raises(Exception, match="field x"):
        run(small(), {"a": rows})["o"].collect()
    assert [r["x"] for r in run(small(), {"a": rows}, mode="null")["o"].collect()] == [1, None, None, None]
    routed = run(small(), {"a": rows}, mode="route")
    assert [r["x"] for r in routed["o"].collect()] == [1, None] and sorted(r["code"] for r in routed["__quarantine"].collect()) == ["fraction", "out_of_range"]
    done = execute(small(rules=[{"id": "p", "rule": "not_null", "target": "o.x", "phase": "postcondition"}]), {"a": rows}, str(tmp_path), mode="route", on_violation="report")
    assert [r["x"] for r in done.outputs["o"].orderBy("x").collect()] == [None, 1] and sorted(r["code"] for r in done.quarantine.collect()) == ["fraction", "out_of_range"]
    assert [(o.violations, o.rows) for o in done.outcomes] == [(1, 2)]
    wide = small(inputs=[{"id": "a", "schema": {"fields": [{"name": "x", "type": "integer"}]}}], outputs=[{"id": "o", "schema": {"fields": [{"name": "x", "type": "decimal"}]}}])
    with pytest.raises(Exception, match="unsafe_integer"):
        run(wide, {"a": spark.createDataFrame([((1 << 53) + 1,)], "x long")})["o"].collect()


def test_bad_rows_stay_out_of_outputs_that_convert_nothing(spark, tmp_path):
    contract = small(inputs=[{"id": "a", "schema": {"fields": [{"name": "x", "type": "integer"}]}}], semanticActions=[{"id": "w", "action": "with_fields", "target": "a", "parameters": {"assignments": [{"as": "x", "expr": "6 / x"}]}}])
    rows = spark.createDataFrame([(0,), (2,)], "x long")
    routed = run(contract, {"a": rows}, mode="route")
    assert [r["x"] for r in routed["o"].collect()] == [3] and routed["__quarantine"].count() == 1
    done = execute(contract, {"a": rows}, str(tmp_path), mode="route")
    assert [r["x"] for r in done.outputs["o"].collect()] == [3] and done.quarantine.count() == 1
    two = {**contract, "outputs": [*contract["outputs"], {**contract["outputs"][0], "id": "p"}], "lineage": {"mappings": [{"output": o, "inputs": ["a"]} for o in "op"]}}
    routed, done = run(two, {"a": rows}, mode="route"), execute(two, {"a": rows}, str(tmp_path / "two"), mode="route")
    assert routed["__quarantine"].count() == 1 == done.quarantine.count() and routed["p"].count() == 1 == done.outputs["o"].count()


def test_absent_optional_inputs_are_empty(spark, tables):
    out = run(SALES_CONTRACT, tables, check=False)
    assert out["sales"].count() == 270
    gone = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "r_orderkey long")
    assert run(SALES_CONTRACT, {**tables, "returns": gone}, check=False)["sales"].count() == 120
    for key in ({"required": False}, {"optional": True}):
        contract = small(inputs=[*small()["inputs"], {"id": "b", "schema": {"fields": [{"name": "y", "type": "string"}]}, **key}])
        assert run(contract, {"a": spark.createDataFrame([(1.0,)], "x double")})["o"].count() == 1


def test_routed_rows_of_inputs_reach_the_quarantine_once(spark, tmp_path):
    contract = small(semanticActions=[{"id": "w", "action": "with_fields", "target": "a", "parameters": {"assignments": [{"as": "x", "expr": "6.0 / x"}]}}],
                     rules=[{"id": "p", "rule": "range", "target": "o.x", "phase": "postcondition", "parameters": {"max": 5}}])
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,)], "x double")
    done = execute(contract, {"a": rows}, str(tmp_path), mode="route", on_violation="report")
    assert sorted((r["action"], r["code"]) for r in done.quarantine.collect()) == [("materialize", "fraction"), ("with_fields", "division_by_zero")]
    assert sorted(r["x"] for r in done.outputs["o"].collect()) == [3, 6] and [(o.violations, o.rows) for o in done.outcomes] == [(1, 2)]
