"""Registered queries that run whole contracts and rule reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import read_table, shared_folder
from .execution import Execution, execute
from .rules import report

ORDERS_CONTRACT = {
    "id": "orders.clean", "name": "Clean orders", "version": "1.0.0",
    "inputs": [{"id": "orders", "schema": {"fields": [{"name": "o_orderkey", "type": "integer", "nullable": False}, {"name": "o_orderstatus", "type": "string"}]}}],
    "outputs": [{"id": "clean", "schema": {"fields": [{"name": "o_orderkey", "type": "integer"}, {"name": "o_orderstatus", "type": "string"}, {"name": "cents", "type": "decimal"}]}}],
    "semanticActions": [
        {"id": "lower", "action": "lowercase", "target": "orders.o_orderstatus"},
        {"id": "open", "action": "filter", "target": "orders", "parameters": {"field": "o_orderstatus", "equals": "o"}},
        {"id": "cents", "action": "with_fields", "target": "orders", "parameters": {"assignments": [{"as": "cents", "expr": "round(o_totalprice * 100.0)"}]}},
    ],
    "semantics": {"ordering": {"mode": "explicit", "order": ["lower", "open", "cents"]}},
    "rules": [{"id": "known", "rule": "one_of", "target": "orders.o_orderstatus", "phase": "precondition", "parameters": {"values": ["F", "O", "P"]}},
              {"id": "key", "rule": "not_null", "target": "clean.o_orderkey", "phase": "postcondition"}],
    "lineage": {"mappings": [{"id": "m", "output": "clean", "inputs": ["orders"]}]},
}
RULES = [
    {"id": "name_length", "rule": "max_length", "target": "part.p_name", "parameters": {"max": 12}}, {"id": "brand", "rule": "regex_match", "target": "part.p_brand", "parameters": {"pattern": "#[1-3]"}},
    {"id": "size", "rule": "range", "target": "part.p_size", "parameters": {"min": 5, "max": 40}}, {"id": "key", "rule": "not_null", "target": "part.p_partkey"},
    {"id": "type_length", "rule": "min_length", "target": "part.p_type", "parameters": {"min": 8}}, {"id": "one", "rule": "equals", "target": "part.p_brand", "parameters": {"value": "Brand#11"}},
]


def field(name: str, kind: str, **more) -> dict:
    return {"name": name, "type": kind, **more}


def interface(name: str, *fields: dict, **more) -> dict:
    return {"id": name, "schema": {"fields": list(fields)}, **more}


def rule(name: str, kind: str, target: str, phase: str, **more) -> dict:
    return {"id": name, "rule": kind, "target": target, "phase": phase, **more}


def act(name: str, kind: str, target: str, **parameters) -> dict:
    return {"id": name, "action": kind, "target": target, "parameters": parameters}


#: Two inputs, a shared join, two outputs, an optional input that is absent, and rules of every phase and outcome. The order of actions follows from what they read.
SALES_CONTRACT = {
    "id": "sales", "name": "Sales", "version": "1.0.0",
    "inputs": [interface("orders", field("o_orderkey", "integer", nullable=False), field("o_orderstatus", "string")), interface("customer", field("c_custkey", "integer", nullable=False)),
               interface("returns", field("r_orderkey", "integer"), optional=True)],
    "outputs": [interface("sales", field("o_orderkey", "integer"), field("c_mktsegment", "string"), field("whole", "integer"), field("asked", "string")),
                interface("segments", field("c_mktsegment", "string"), field("n", "integer"), field("total", "decimal"))],
    "semanticActions": [
        act("sum", "aggregate", "segments", groupBy=["c_mktsegment"], aggregates=[{"op": "count_all", "as": "n"}, {"op": "sum", "field": "total", "as": "total"}]),
        act("priced", "join", "orders", right="customer", leftKey="o_custkey", rightKey="c_custkey"),
        act("rest", "join", "sales", right="returns", leftKey="o_orderkey", rightKey="r_orderkey", type="anti"),
        act("named", "with_fields", "customer", assignments=[{"as": "asked", "expr": 'case_when(c_custkey % 2 == 0, "yes", null_if("a", "a"))'}]),
    ],
    "rules": [
        rule("status", "one_of", "orders.o_orderstatus", "precondition", parameters={"values": ["F", "O"]}), rule("key", "not_null", "orders.o_orderkey", "precondition"),
        rule("segment", "min_length", "customer.c_mktsegment", "execution", parameters={"min": 3}), rule("yes", "equals", "sales.asked", "postcondition", allowIndeterminate=True, parameters={"value": "yes"}),
        rule("many", "range", "segments.n", "postcondition", parameters={"min": 1}), rule("sale", "range", "sales.whole", "postcondition", parameters={"max": 400000}),
    ],
    "lineage": {"mappings": [{"id": "s", "output": "sales", "inputs": ["orders"]}, {"id": "g", "output": "segments", "inputs": ["orders"]}]},
}


def sales(spark: SparkSession, sf_dir: str) -> Execution:
    from pyspark.sql import functions as F

    orders = read_table(spark, sf_dir, "orders").withColumn("whole", F.floor("o_totalprice").cast("double")).withColumn("n", F.lit(1)).withColumnRenamed("o_totalprice", "total")
    return execute(SALES_CONTRACT, {"orders": orders, "customer": read_table(spark, sf_dir, "customer")}, shared_folder(spark, "sales"), on_violation="report")


def contract_two_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both outputs: the sales, and the sums of segments in whole cents."""
    from pyspark.sql import functions as F

    out = sales(spark, sf_dir).outputs
    sums = out["segments"].select(F.lit(None).cast("long").alias("o_orderkey"), "c_mktsegment", F.col("n").alias("whole"), F.round(F.col("total")).cast("long").cast("string").alias("asked"))
    return out["sales"].unionByName(sums)


def contract_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import dataclasses

    return spark.createDataFrame([dataclasses.asdict(o) for o in sales(spark, sf_dir).outcomes],
                                 "id string, rule string, phase string, frame string, field string, outcome string, violations long, indeterminate long, rows long")


#: The first event of each user and kind, from an unbounded input.
STREAM_CONTRACT = {
    "id": "firsts", "name": "First events", "version": "1.0.0",
    "inputs": [interface("events", field("event_id", "integer"), field("ts", "datetime"), field("user_id", "integer"), field("event_type", "string"), field("value", "decimal"),
                         streaming={"mode": "unbounded"}, watermark={"field": "ts", "delay": "1 hour"})],
    "outputs": [interface("firsts", field("event_id", "integer"), field("user_id", "integer"), field("event_type", "string"), field("ratio", "integer"))],
    "semanticActions": [
        act("ratio", "with_fields", "events", assignments=[{"as": "ratio", "expr": "1000 / (user_id % 7)"}]), act("worth", "filter", "events", predicate="value > 5.0 && ratio > 0"),
        act("firsts_only", "deduplicate", "events", keys=["user_id", "event_type"], retain="first", orderBy=["event_id"])],
    "semantics": {"ordering": {"mode": "explicit", "order": ["ratio", "worth", "firsts_only"]}}, "rules": [rule("known", "not_null", "firsts.event_id", "postcondition")],
    "lineage": {"mappings": [{"id": "m", "output": "firsts", "inputs": ["events"]}]},
}


def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from ..streaming.contracts import execute_stream

    folder = shared_folder(spark, "stream")
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.write.parquet(f"{folder}/in")
    streams = execute_stream(STREAM_CONTRACT, spark, {"events": {"path": f"{folder}/in"}}, f"{folder}/out", mode="null")
    streams.done()
    return streams.output("firsts")


def contract_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute(ORDERS_CONTRACT, {"orders": read_table(spark, sf_dir, "orders")}, shared_folder(spark, "orders")).outputs["clean"]


def rules_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "part"), RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"contract_pipeline": contract_pipeline, "rules_report": rules_report, "contract_two_outputs": contract_two_outputs, "contract_outcomes": contract_outcomes, "stream_first_events": stream_first_events}


def oracle_sql() -> dict[str, str]:
    tests = [("name_length", "max_length", "p_name", "length(p_name) > 12"), ("brand", "regex_match", "p_brand", "NOT regexp_matches(p_brand, '#[1-3]')"), ("size", "range", "p_size", "p_size < 5 OR p_size > 40"),
             ("key", "not_null", "p_partkey", "p_partkey IS NULL"), ("type_length", "min_length", "p_type", "length(p_type) < 8"), ("one", "equals", "p_brand", "p_brand <> 'Brand#11'")]
    joined = "FROM orders JOIN customer ON o_custkey = c_custkey"
    told = [("status", "one_of", "precondition", "orders", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')", "FALSE", "FROM orders"), ("key", "not_null", "precondition", "orders", "o_orderkey", "o_orderkey IS NULL", "FALSE", "FROM orders"),
            ("segment", "min_length", "execution", "customer", "c_mktsegment", "length(c_mktsegment) < 3", "FALSE", "FROM customer"), ("yes", "equals", "postcondition", "sales", "asked", "FALSE", "c_custkey % 2 <> 0", joined),
            ("many", "range", "postcondition", "segments", "n", "n < 1", "FALSE", f"FROM (SELECT count(*) AS n {joined} GROUP BY c_mktsegment)"), ("sale", "range", "postcondition", "sales", "whole", "floor(o_totalprice) > 400000", "FALSE", joined)]
    outcome = "CASE WHEN violations > 0 THEN 'violated' WHEN indeterminate > 0 THEN 'indeterminate' ELSE 'satisfied' END AS outcome"
    counts = " UNION ALL ".join(f"SELECT '{i}' AS id, '{r}' AS rule, '{p}' AS phase, '{f}' AS frame, '{c}' AS field, count(*) FILTER ({v}) AS violations, count(*) FILTER ({u}) AS indeterminate, count(*) AS \"rows\" {s}"
                                for i, r, p, f, c, v, u, s in told)
    return {
        "contract_two_outputs": f"SELECT o_orderkey, c_mktsegment, floor(o_totalprice)::BIGINT AS whole, CASE WHEN c_custkey % 2 = 0 THEN 'yes' END AS asked {joined} UNION ALL "
                                f"SELECT NULL, c_mktsegment, count(*), round(sum(o_totalprice))::BIGINT::VARCHAR {joined} GROUP BY c_mktsegment",
        "stream_first_events": "SELECT min(event_id) AS event_id, user_id, event_type, 1000 // (user_id % 7) AS ratio FROM events WHERE value > 5.0 AND user_id % 7 <> 0 GROUP BY user_id, event_type",
        "contract_outcomes": f"SELECT *, {outcome} FROM ({counts})",
        "contract_pipeline": "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, floor(o_totalprice * 100.0 + 0.5) AS cents FROM orders WHERE o_orderstatus = 'O'",
        "rules_report": " UNION ALL ".join(f"SELECT '{i}' AS id, '{r}' AS rule, '{f}' AS field, count(*) FILTER ({t}) AS violations, count(*) AS \"rows\" FROM part" for i, r, f, t in tests),
    }
