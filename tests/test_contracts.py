"""Actions, expressions, rules and contracts on small tables, one for each stated behaviour."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.expressions import ExpressionError, column_of, parse
from sparkloom.functions import names
from sparkloom.functions.core import draws
from sparkloom.operators import ACTIONS, ActionError, Context, apply, apply_all
from sparkloom.plans import ContractError, RuleViolation, load, run, validate
from sparkloom.plans.compatibility import compare, impact
from sparkloom.plans.contract_queries import ORDERS_CONTRACT
from sparkloom.plans.rules import report


def rows(df):
    return [tuple(r) for r in df.collect()]


def value(spark, text, row=None):
    df = spark.range(1) if row is None else spark.createDataFrame([tuple(row.values())], list(row))
    return df.select(column_of(text, df).alias("x")).first()[0]


@pytest.mark.parametrize(("text", "expected"), [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-7 / 2", -3), ("-7 % 3", -1), ("7.0 / 2", 3.5), ('"a" + "b"', "ab"), ("1 < 2 && !(2 < 1)", True), ("3 between 1 and 3", True), ('"an" in "banana"', True),
    ('"banana" contains "x"', False), ("2 in list(1, 2)", True), ("round(1.005, 2)", 1.0), ("round(-2.5)", -3.0), ('substr("hello", 1, 3)', "ell"), ('substr("hello", 9)', ""), ('position("hello", "z")', -1),
    ('pad_left("abc", 2)', "abc"), ('pad_left("a", 4, "xy")', "xyxa"), ('translate("abc", "ab", "x")', "xbc"), ('regex_extract("a1", "[0-9]")', "1"), ('regex_extract("a", "[0-9]")', None),
    ('regex_matches("ab", "a")', False), ("to_string(1.0)", "1"), ("to_string(0.1234567890123456)", "0.1234567890123456"), ("to_string(1.0 / 1000000000000000.0)", "0.000000000000001"), ("to_string(12345678901.5)", "12345678901.5"),
    ("to_string(-2.5 / 100000.0)", "-0.000025"), ("to_string(3.0 * 10000000.0)", "30000000"), ('try_cast("x", "integer", "null")', None), ('parse_boolean("No")', False), ('cast("12", "integer")', 12), ("median(1, 2, 3, 4)", 2.0),
    ("quantile(1, 2, 3, 4, 0.75)", 3.0), ("variance(1, 3)", 2.0), ("correlation(list(1, 2), list(2, 4))", 1.0), ("correlation(list(1, 1), list(2, 4))", None), ("min(2, 1)", 1.0), ('is_missing(nowhere)', True),
    ('coalesce(nowhere, "d")', "d"), ("null_if(1, 1) == null_if(2, 2)", True), ("null_if(1, 1) != 1", True), ("index(list(1, 2), -1)", 2), ("index(list(1, 2), 5)", None), ("list_position(list(1, 2), 9)", -1),
    ('format_date("2024-03-05", "%d.%m.%Y")', "05.03.2024"), ('date_diff("2024-02-01", "2024-01-31", "month")', 1), ('to_timezone("2024-01-01T12:00:00Z", "America/New_York")', "2024-01-01T07:00:00-05:00"),
    ('normalize_whitespace(" a \t b ")', "a b"), ('trim("\t a ")', "a"), ('trim("xxaxx", "x")', "a"), ('join_strings(split("a.b", "."), "-")', "a-b"), ("random(7)", 0.11272690821447051),
    ('element_at(map_concat(map("a", 1), map("a", 2), "right"), "a")', 2), ('extract("year", "2024-03-05")', 2024), ("collect_set(3, 1, 3)", [1, 3]), ('case_when(1 > 2, "a", "b")', "b")])
def test_expression(spark, text, expected):
    assert value(spark, text) == expected


def test_lambdas(spark):
    node = {"call": "reduce", "args": [{"call": "list", "args": [1, 2, 3]}, 0, {"lambda": ["a", "x"], "body": {"call": "add", "args": [{"field": "a"}, {"field": "x"}]}}]}
    assert value(spark, node) == 6
    assert value(spark, {"call": "zip_with", "args": [{"call": "list", "args": [1, 2, 3]}, {"call": "list", "args": [10, 20]}, {"lambda": ["a", "b"], "body": {"call": "add", "args": [{"field": "a"}, {"field": "b"}]}}]}) == [11, 22]


@pytest.mark.parametrize("text", ["1 +", "(1", "nofn(1)", "length()", 'regex_contains("a", "(?=a)")', 'parse_date("x", "%q")', "1 $ 2", 'map_concat(map("a", 1), map("b", 2))'])
def test_refused(spark, text):
    with pytest.raises(ExpressionError):
        column_of(text, spark.range(1))


@pytest.mark.parametrize("text", ["1 / 0", "1.0 / 0.0", "9223372036854775807 + 1", "sqrt(-1.0)", 'cast("x", "integer")', 'repeat("a", 2000000)', 'to_utc("2024-03-10T02:30:00", "America/New_York")', 'to_utc("2024-11-03T01:30:00", "America/New_York")'])
def test_raises_when_run(spark, text):
    with pytest.raises(Exception):
        value(spark, text)


def test_zone_policies(spark):
    assert str(value(spark, 'to_utc("2024-11-03T01:30:00", "America/New_York", "latest")')) == "2024-11-03 06:30:00"
    assert str(value(spark, 'to_utc("2024-11-03T01:30:00", "America/New_York", "earliest")')) == "2024-11-03 05:30:00"
    assert str(value(spark, 'to_utc("2024-03-10T02:30:00", "America/New_York", "reject", "shift_forward")')) == "2024-03-10 07:30:00"


def test_generator_and_catalog():
    assert draws(7, 1) == [0.11272690821447051]
    assert len(ACTIONS) == 34 and len(names()) >= 128


def t(spark, data, schema):
    return {"t": spark.createDataFrame(data, schema)}


def test_sort_reverses_null_placement(spark):
    frames = t(spark, [(1,), (None,), (2,)], "k int")
    assert rows(apply("sort", "t", {"keys": ["k"]}, frames)["t"]) == [(1,), (2,), (None,)]
    assert rows(apply("sort", "t", {"keys": [{"field": "k", "descending": True}]}, frames)["t"]) == [(None,), (2,), (1,)]


def test_aggregate_of_nulls_and_of_nothing(spark):
    frames = t(spark, [("a", None), ("a", None)], "g string, v double")
    asked = [{"op": "sum", "field": "v", "as": "s"}, {"op": "average", "field": "v", "as": "m"}, {"op": "count", "field": "v", "as": "n"}, {"op": "count_distinct", "field": "v", "as": "d"}, {"op": "collect_list", "field": "v", "as": "l"}]
    assert rows(apply("aggregate", "t", {"groupBy": ["g"], "aggregates": asked}, frames)["t"]) == [("a", 0.0, None, 0, 1, [None, None])]
    assert rows(apply("aggregate", "t", {"aggregates": asked, "filter": 'g == "z"'}, frames)["t"]) == []


def test_window_tiles_and_frames(spark):
    frames = t(spark, [(i,) for i in range(10)], "x int")
    out = apply("window", "t", {"orderBy": [{"field": "x"}], "functions": [{"as": "n", "function": "ntile", "n": 4}, {"as": "s", "function": "sum", "field": "x"}]}, frames)["t"].orderBy("x").collect()
    assert [r["n"] for r in out] == [1, 1, 1, 2, 2, 3, 3, 3, 4, 4] and out[3]["s"] == 6.0
    with pytest.raises(ActionError):
        apply("window", "t", {"orderBy": [{"field": "x"}], "frame": {"type": "groups"}, "functions": [{"as": "s", "function": "sum", "field": "x"}]}, frames)


def test_join_policies_and_nulls(spark):
    frames = {"l": spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string"), "r": spark.createDataFrame([(1, "x"), (None, "y"), (7, "z")], "k int, w string")}
    join = lambda **p: sorted(rows(apply("join", "l", {"right": "r", "leftKey": "k", **p}, frames)["l"]), key=str)
    assert join() == [(1, "a", "x")]
    assert join(nullSafe=True) == [(1, "a", "x"), (None, "b", "y")]
    assert (None, None, "z") in join(type="right")
    assert join(collisionPolicy="suffix") == [(1, "a", 1, "x")]
    assert join(type="anti") == [(None, "b")]
    with pytest.raises(ActionError):
        join(collisionPolicy="error")
    with pytest.raises(ActionError):
        join(type="sideways")


def test_sets_keep_rows_under_all(spark):
    frames = {"l": spark.createDataFrame([(1,), (1,), (2,)], "id int"), "r": spark.createDataFrame([(1,)], "id int")}
    assert rows(apply("intersect", "l", {"other": "r", "mode": "all"}, frames)["l"]) == [(1,), (1,)]
    assert rows(apply("intersect", "l", {"other": "r"}, frames)["l"]) == [(1,)]
    assert rows(apply("except", "l", {"other": "r", "mode": "all"}, frames)["l"]) == [(2,)]


def test_pivot_explode_unpivot(spark):
    frames = t(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, p string, v int")
    pivot = {"keys": ["k"], "pivot": "p", "value": "v", "categories": ["x", "y"]}
    assert sorted(rows(apply("pivot", "t", pivot, frames)["t"])) == [("a", 1, 2), ("b", 3, None)]
    with pytest.raises(Exception):
        apply("pivot", "t", {**pivot, "categories": ["x"]}, frames)["t"].collect()
    frames = t(spark, [(1, [5, 6]), (2, []), (3, None)], "id int, items array<int>")
    assert rows(apply("explode", "t", {"expr": "items", "as": ["e", "i"], "includePosition": True}, frames)["t"].select("id", "e", "i")) == [(1, 5, 0), (1, 6, 1)]
    assert rows(apply("explode", "t", {"expr": "items", "as": ["e"], "outer": True}, frames)["t"].select("id", "e")) == [(1, 5), (1, 6), (2, None), (3, None)]
    with pytest.raises(ActionError):
        apply("explode", "t", {"expr": "items", "as": ["id"]}, frames)


def test_explode_keeps_its_bound_and_pivot_aggregates(spark):
    frames = t(spark, [(1, [5, 6]), (2, []), (3, [7])], "id int, items array<int>")
    explode = lambda most, **more: apply("explode", "t", {"expr": "items", "as": ["e"], "maxExpansion": most, **more}, frames)["t"].count()
    assert explode(3) == 3 and explode(4, outer=True) == 4
    for most, more in ((2, {}), (3, {"outer": True})):
        with pytest.raises(ActionError):
            explode(most, **more)
    frames = t(spark, [("a", "x", 1), ("a", "x", 3), ("a", "y", 2), ("b", "x", None)], "k string, p string, v int")
    pivot = {"groupBy": ["k"], "pivot": "p", "categories": ["x", "y"], "aggregates": [{"op": "sum", "field": "v", "as": "s"}, {"op": "count_all", "as": "n"}]}
    out = apply("pivot", "t", pivot, frames)["t"]
    assert out.columns == ["k", "x_s", "x_n", "y_s", "y_n"] and sorted(rows(out)) == [("a", 4.0, 2, 2.0, 1), ("b", 0.0, 1, 0.0, 0)]
    assert sorted(rows(apply("pivot", "t", {**pivot, "aggregates": pivot["aggregates"][:1]}, frames)["t"])) == [("a", 4.0, 2.0), ("b", 0.0, 0.0)]
    with pytest.raises(ActionError):
        apply("pivot", "t", {**pivot, "aggregates": [{"op": "collect_list", "field": "v", "as": "l"}]}, frames)


def test_seeded_sample_order(spark):
    frames = t(spark, [(i,) for i in range(5)], "i int")
    frames["t"] = frames["t"].coalesce(1)
    by_rank = sorted(range(5), key=lambda i: hashlib.md5(f'42:{{"i":{i}}}'.encode()).hexdigest())
    assert rows(apply("sample", "t", {"count": 2, "seed": 42}, frames)["t"]) == [(i,) for i in by_rank[:2]]
    assert rows(apply("sample", "t", {"count": 9, "seed": 42}, frames)["t"]) == [(i,) for i in by_rank] and not rows(apply("sample", "t", {"fraction": 0.1}, frames)["t"])
    split = apply("random_split", "t", {"weights": [1, 1], "outputs": ["a", "b"], "seed": 1}, frames)
    assert sorted(rows(split["a"]) + rows(split["b"])) == [(i,) for i in range(5)]


def test_deduplicate_rename_nested(spark):
    frames = t(spark, [(1, "a", 0), (1, "b", 1), (2, "c", 2)], "k int, v string, __row_id long")
    assert sorted(rows(apply("deduplicate", "t", {"keys": ["k"], "retain": "last"}, frames)["t"].select("k", "v"))) == [(1, "b"), (2, "c")]
    assert sorted(rows(apply("rename_fields", "t", {"mapping": {"k": "v"}}, frames)["t"].select("v"))) == [(1,), (1,), (2,)]
    path = lambda *p: [{"kind": "field", "name": x} for x in p]
    out = apply("with_nested_fields", "t", {"assignments": [{"path": path("a", "b"), "value": 1}], "createParents": True}, frames)["t"]
    assert out.select("a.b").first()[0] == 1
    with pytest.raises(ActionError):
        apply("with_nested_fields", "t", {"assignments": [{"path": "a.b", "value": 1}]}, frames)


def test_strict_nulls_raise(spark):
    frames = t(spark, [(None,)], "s string")
    assert rows(apply("with_fields", "t", {"assignments": [{"as": "u", "expr": "upper(s)"}]}, frames)["t"]) == [(None, None)]
    with pytest.raises(Exception):
        apply("with_fields", "t", {"assignments": [{"as": "u", "expr": "upper(s)"}]}, frames, Context(strict=True))["t"].collect()


def test_strict_nulls_raise_in_every_kind_of_function(spark):
    frames = t(spark, [(None, 1.0)], "a double, b double")
    for expr in ("a + b", "a / b", "length(to_string(a))", "a in list(b)"):
        lenient = apply("with_fields", "t", {"assignments": [{"as": "u", "expr": expr}]}, frames)["t"].collect()
        assert lenient[0]["u"] in (None, False)
        with pytest.raises(Exception):
            apply("with_fields", "t", {"assignments": [{"as": "u", "expr": expr}]}, frames, Context(strict=True))["t"].collect()


def test_distinct_comes_before_every_reduction(spark):
    frames = t(spark, [(1.0,), (1.0,), (3.0,)], "x double")
    ops = {"variance": 2.0, "stddev": 2.0**0.5, "var_pop": 1.0, "stddev_pop": 1.0, "sum": 4.0, "average": 2.0, "median": 1.0, "count": 2}
    out = apply("aggregate", "t", {"aggregates": [{"op": op, "field": "x", "as": op, "distinct": True} for op in ops]}, frames)["t"].first().asDict()
    assert out == pytest.approx(ops)


def test_formats_round_trip(spark, tmp_path):
    from sparkloom.sources import read, schema_of, write

    df = t(spark, [(1, "a", 1.5), (2, None, -2.0)], "k long, s string, x double")["t"]
    schema = schema_of({"schema": {"fields": [{"name": "k", "type": "integer"}, {"name": "s", "type": "string"}, {"name": "x", "type": "decimal"}]}})
    for kind in ("parquet", "orc", "json", "csv"):
        spec = {"format": kind, "path": str(tmp_path / kind), "options": {"header": "true"} if kind == "csv" else {}}
        write(df, spec)
        assert sorted(rows(read(spark, spec, schema))) == sorted(rows(df))
    write(df, {"format": "parquet", "path": str(tmp_path / "parts"), "partitionBy": ["k"]})
    assert read(spark, {"path": str(tmp_path / "parts")}).filter("k = 1").count() == 1


def test_outputs_of_several_inputs_meet_by_place(spark):
    contract = {"id": "zip", "name": "zip", "version": "1.0.0", "inputs": [{"id": "a", "schema": {"fields": [{"name": "x", "type": "integer"}]}}, {"id": "b", "schema": {"fields": [{"name": "y", "type": "string"}]}}],
                "outputs": [{"id": "o", "schema": {"fields": [{"name": "x", "type": "integer"}, {"name": "y", "type": "string"}]}}],
                "semanticActions": [], "rules": [], "lineage": {"mappings": [{"output": "o", "inputs": ["a.x", "b.y"]}]}}
    a = spark.createDataFrame([(i,) for i in range(9)], "x long").repartitionByRange(3, "x").sortWithinPartitions("x")
    b = spark.createDataFrame([(i, f"y{i}") for i in reversed(range(9))], "__row_id long, y string")
    a = a.withColumn("__row_id", F.col("x"))
    assert sorted(rows(run(contract, {"a": a, "b": b})["o"])) == [(i, f"y{i}") for i in range(9)]
    gaps = run(contract, {"a": a.withColumn("__row_id", F.col("x") * 3 + 1), "b": b})["o"]
    assert sorted(rows(gaps)) == [(i, f"y{i}") for i in range(9)]
    plain = run(contract, {"a": spark.range(9).select(F.col("id").alias("x")), "b": spark.range(9).select(F.concat(F.lit("y"), F.col("id")).alias("y"))})["o"]
    assert sorted(rows(plain)) == [(i, f"y{i}") for i in range(9)]


def test_contract_runs_and_refuses(spark):
    orders = spark.createDataFrame([(1, "O", 1.25), (2, "F", 2.0)], "o_orderkey long, o_orderstatus string, o_totalprice double")
    assert rows(run(ORDERS_CONTRACT, {"orders": orders})["clean"]) == [(1, "o", 125.0)]
    with pytest.raises(RuleViolation):
        run(ORDERS_CONTRACT, {"orders": orders.withColumn("o_orderstatus", F.lit("Q"))})
    with pytest.raises(ContractError):
        run(ORDERS_CONTRACT, {"orders": orders.drop("o_orderstatus")})
    bad = json.loads(json.dumps(ORDERS_CONTRACT))
    bad["semanticActions"][0]["action"] = "vanish"
    del bad["semantics"]
    assert len(validate(bad)) == 2
    text = "id: a\nname: b\nversion: '1'\ninputs: [{id: i}]\noutputs: [{id: o}]\n"
    assert validate(load(text)) == [] and load(json.dumps(ORDERS_CONTRACT)) == ORDERS_CONTRACT


def test_rules_in_one_pass(spark):
    df = spark.createDataFrame([("ab", 1.5), (None, 2.0)], "s string, n double")
    found = report(df, [{"id": "a", "rule": "min_length", "target": "t.s", "parameters": {"min": 3}}, {"id": "b", "rule": "range", "target": "t.n", "parameters": {"min": 1}}])
    assert [(r["id"], r["violations"], r["rows"]) for r in found.collect()] == [("a", 2, 2), ("b", 1, 2)]


def test_compatibility_and_impact():
    new = json.loads(json.dumps(ORDERS_CONTRACT))
    assert compare(ORDERS_CONTRACT, new)[0] == "identical"
    new["outputs"][0]["schema"]["fields"].pop()
    assert compare(ORDERS_CONTRACT, new)[0] == "breaking"
    assert impact(ORDERS_CONTRACT, "orders") == {"clean"}


def test_parse_shapes():
    assert parse("a.b || c && d") == {"call": "or", "args": [{"field": "a.b"}, {"call": "and", "args": [{"field": "c"}, {"field": "d"}]}]}
    assert apply_all([], {}) == {}
