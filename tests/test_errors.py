"""Every error mode for every fallible function, and rows on their way to the quarantine."""

import datetime
import functools

import pytest
from pyspark.sql import functions as F

from sparkloom.expressions import value_of
from sparkloom.functions.errors import RISKS
from sparkloom.operators import Context, apply_all
from sparkloom.operators.errors import ERROR, write_split

BIG = (1 << 63) - 1
ROW = {"zero": 0, "one": 1, "big": BIG, "least": -BIG - 1, "half": 0.5, "huge": 1e300, "minus": -1.0, "word": "abc", "digits": "12", "empty": "", "far": 10**9, "when": datetime.date(2024, 1, 31),
       "gap": "2024-03-10T02:30:00", "twice": "2024-11-03T01:30:00", "zone": "America/New_York", "nowhere_zone": "Mars/North", "holes": ["a", None], "xs": [2, 0, 1], "pairs": [("a", 1), ("a", 2)]}
SCHEMA = ("zero long, one long, big long, least long, half double, huge double, minus double, word string, digits string, empty string, far long, when date, gap string, twice string, zone string, nowhere_zone string, "
          "holes array<string>, xs array<long>, pairs array<struct<key: string, value: long>>")
X = lambda name, *args: {"call": name, "args": list(args)}
ITEM = {"field": "x"}
CASES = [
    ("big + one", "overflow"), ("least - one", "overflow"), ("big * 2", "overflow"), ("-least", "overflow"), ("abs(least)", "overflow"), ("one / zero", "division_by_zero"), ("half / 0.0", "division_by_zero"),
    ("least / -one", "overflow"), ("one % zero", "division_by_zero"), ("sqrt(minus)", "negative_number"), ('cast(word, "integer")', "invalid_cast"), ('cast(word, "boolean")', "invalid_cast"),
    ('try_cast(word, "integer", "fail")', "invalid_cast"), ("to_integer(half)", "fraction"), ("to_integer(huge)", "out_of_range"), ("to_integer(word)", "invalid_cast"), ("to_decimal(word)", "invalid_number"),
    ("parse_decimal(word)", "invalid_cast"), ("parse_boolean(word)", "invalid_boolean"), ("parse_date(word)", "invalid_date"), ("parse_time(word)", "invalid_time"), ("parse_datetime(word)", "invalid_datetime"),
    ("substr(word, minus)", "negative_start"), ("substr(word, zero, minus)", "negative_length"), ("pad_left(word, minus)", "negative_length"), ("pad_right(word, 9, empty)", "empty_fill"), ("repeat(word, far)", "out_of_range"),
    ('join_strings(holes, "-")', "null_element"), ('regex_extract(word, "(b)", far)', "no_such_group"), ('regex_extract_all(word, "b", one)', "no_such_group"), ("map(word, 1, word, 2)", "repeated_key"),
    ("map_from_entries(pairs)", "repeated_key"), ('map_concat(map(word, 1), map(word, 2), "error")', "repeated_key"), ('date_add(when, far, "year")', "out_of_range"), ("to_timezone(gap, nowhere_zone)", "unknown_zone"),
    ('from_utc(gap, "Mars/North")', "unknown_zone"), ("to_utc(gap, zone)", "nonexistent_time"), ("to_utc(twice, zone)", "ambiguous_time"), ("to_utc(word, zone)", "invalid_moment"), ("date_diff(word, gap)", "invalid_moment"),
    ("one + word", "invalid_number"), ("word < one", "invalid_number"), ("round(word)", "invalid_number"), ("1 + one / zero", "division_by_zero"), ("coalesce(one / zero, 5)", "division_by_zero"), ("if_null(one / zero, 5)", "division_by_zero"),
    ("case_when(one / zero > 1, 2, 3)", "division_by_zero"), ("one == 1 && one / zero > 0", "division_by_zero"), ("one == 2 || one / zero > 0", "division_by_zero"), ("is_null(one / zero)", "division_by_zero"),
    (X("transform", {"field": "xs"}, {"lambda": ["x"], "body": X("divide", 6, ITEM)}), "division_by_zero"), (X("filter_values", {"field": "xs"}, {"lambda": ["x"], "body": X("gt", X("divide", 6, ITEM), 1)}), "division_by_zero"),
    (X("exists", {"field": "xs"}, {"lambda": ["x"], "body": X("gt", X("divide", 6, ITEM), 100)}), "division_by_zero"),
    (X("reduce", {"field": "xs"}, 1, {"lambda": ["a", "x"], "body": X("divide", {"field": "a"}, ITEM)}), "division_by_zero"),
    (X("zip_with", {"field": "xs"}, {"field": "xs"}, {"lambda": ["a", "b"], "body": X("modulo", {"field": "a"}, {"field": "b"})}), "division_by_zero"),
    (X("transform_values", X("map", {"literal": "k"}, {"field": "zero"}), {"lambda": ["k", "v"], "body": X("divide", 1, {"field": "v"})}), "division_by_zero")]
FINE = ["big - one", "one / 2", "sqrt(half * 2.0)", 'cast(digits, "integer")', "to_integer(digits)", "substr(word, 1, 1)", "coalesce(one, one / zero)", "case_when(one == 1, 2, one / zero)", "one == 2 && one / zero > 0",
        "one == 1 || one / zero > 0", 'to_utc(gap, zone, "reject", "shift_forward")', 'to_utc(twice, zone, "earliest")', "digits + one", 'regex_extract(word, "(b)", one)', 'try_cast(word, "integer", "null")', "parse_date(\"2024-02-03\")",
        "date_add(when, one)", 'to_timezone(gap, "+02:00")']


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([tuple(ROW.values())], SCHEMA).repartition(1)


def assign(expression):
    return [{"action": "with_fields", "target": "t", "parameters": {"assignments": [{"as": "out", "expr": expression}]}}]


def test_null_and_invalid_modes(df):
    fields = [{"expr": e, "as": f"out{i}"} for i, (e, _) in enumerate(CASES)]
    every = [{"action": "project", "target": "t", "parameters": {"fields": fields}}]
    assert apply_all(every, {"t": df}, Context(mode="null"))["t"].first() == tuple(None for _ in CASES)
    got = apply_all(every, {"t": df}, Context(mode="invalid"))["t"].first()
    assert got[:-1] == tuple(None for _ in CASES) and got["__invalid"] == {f"out{i}": code for i, (_, code) in enumerate(CASES)}


def test_route_mode(df):
    frames = {f"t{i}": df for i in range(len(CASES))}
    actions = [{**assign(e)[0], "target": f"t{i}"} for i, (e, _) in enumerate(CASES)]
    out = apply_all(actions, frames, Context(mode="route"))
    assert {tuple(r)[:4] for r in out["__quarantine"].collect()} == {(f"t{i}", "with_fields", "out", code) for i, (_, code) in enumerate(CASES)}
    good = [out[t].select(F.lit(t)) for t in frames]
    assert not functools.reduce(lambda a, b: a.unionByName(b), [g.toDF("t") for g in good]).collect()


@pytest.mark.parametrize("expression", [e for e, c in CASES if isinstance(e, str) and c not in ("no_such_group",)][:24:3])
def test_fail_raises(df, expression):
    with pytest.raises(Exception):
        apply_all(assign(expression), {"t": df})["t"].select("out").collect()


def test_values_that_can_be_computed(df):
    every = [{"action": "project", "target": "t", "parameters": {"fields": [{"as": f"out{i}", "expr": e} for i, e in enumerate(FINE)]}}]
    fail = apply_all(every, {"t": df})["t"].collect()
    routed = apply_all(every, {"t": df}, Context(mode="route"))
    assert routed["t"].collect() == fail and routed["__quarantine"].count() == 0


def test_every_risk_has_a_case():
    texts = " ".join(str(e) for e, _ in CASES)
    signs = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "modulo": "%", "negate": "-least"}
    assert not [n for n in RISKS if (signs.get(n) or n) not in texts and n not in ("at_timezone",)]


def test_unknown_mode():
    with pytest.raises(ValueError):
        Context(mode="ignore")


def test_strict_nulls_are_errors_too(spark):
    rows = spark.createDataFrame([(1, True), (2, None)], "a long, b boolean")
    out = apply_all([{"action": "filter", "target": "t", "parameters": {"predicate": "b && a > 0"}}], {"t": rows}, Context(strict=True, mode="route"))
    assert [r["a"] for r in out["t"].collect()] == [1] and [r["code"] for r in out["__quarantine"].collect()] == ["null_argument"]
    assert [r["a"] for r in apply_all([{"action": "filter", "target": "t", "parameters": {"predicate": "a == 2 || b"}}], {"t": rows}, Context(strict=True)).get("t").collect()] == [1, 2]
    with pytest.raises(Exception):
        apply_all([{"action": "filter", "target": "t", "parameters": {"predicate": "a > 0 && b"}}], {"t": rows}, Context(strict=True))["t"].collect()


CHAIN = [
    {"action": "with_fields", "target": "t", "parameters": {"assignments": [{"as": "q", "expr": "12 / n"}, {"as": "r", "expr": "sqrt(q + m)"}]}},
    {"action": "rename_fields", "target": "t", "parameters": {"mapping": {"q": "quotient"}}},
    {"action": "filter", "target": "t", "parameters": {"predicate": "quotient % (m + 3) >= 0"}},
    {"action": "project", "target": "t", "parameters": {"fields": ["n", "quotient", {"expr": "to_integer(r)", "as": "r"}]}}]


def test_a_chain_keeps_the_first_failure_and_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(3, 0), (0, 5), (2, -9), (4, -3), (1, 4), (5, 2)], "n long, m long")
    out = apply_all(CHAIN, {"t": rows}, Context(mode="route"))
    assert {tuple(r) for r in out["t"].collect()} == {(3, 4, 2), (1, 12, 4), (5, 2, 2)}
    assert {(r["action"], r["field"], r["code"], r["row"][:7]) for r in out["__quarantine"].collect()} == {
        ("with_fields", "q", "division_by_zero", '{"n":0,'), ("with_fields", "r", "negative_number", '{"n":2,'), ("filter", "predicate", "division_by_zero", '{"n":4,')}
    from sparkloom.operators import apply

    frames, seen = {"t": rows.withColumn("n", F.udf(lambda x: x, "long").asNondeterministic()("n"))}, spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    frames = {"t": rows.repartition(2).withColumn("n", F.udf(count, "long").asNondeterministic()("n"))}
    for a in CHAIN:
        frames = apply(a["action"], a["target"], a["parameters"], frames, Context(mode="route"))
    assert ERROR in frames["t"].columns and "__quarantine" not in frames
    good, bad = write_split(frames["t"], str(tmp_path))
    assert good.count() == 3 and bad.count() == 3 and seen.value == 6


def test_actions_on_whole_frames_see_good_rows_only(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2), ("c", 0)], "k string, n long")
    names = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, name string")
    actions = [{"action": "with_fields", "target": "t", "parameters": {"assignments": [{"as": "q", "expr": "6 / n"}]}},
               {"action": "join", "target": "t", "parameters": {"right": "names", "leftKey": "k"}},
               {"action": "aggregate", "target": "t", "parameters": {"groupBy": ["name"], "aggregates": [{"op": "sum", "expr": "q / (q - 3)", "as": "s"}]}}]
    out = apply_all(actions, {"t": rows, "names": names}, Context(mode="route"))
    assert [tuple(r) for r in out["t"].collect()] == [("x", 2.0)]
    assert sorted((r["action"], r["field"], r["code"]) for r in out["__quarantine"].collect()) == [("aggregate", "s", "division_by_zero"), ("with_fields", "q", "division_by_zero"), ("with_fields", "q", "division_by_zero")]


def test_invalid_marks_follow_their_fields(spark):
    rows = spark.createDataFrame([("1", 1), ("x", 2), (None, 3)], "s string, n long")
    actions = [{"action": "with_fields", "target": "t", "parameters": {"assignments": [{"as": "v", "expr": 'try_cast(s, "integer")'}, {"as": "w", "expr": "6 / (n - 1)"}]}},
               {"action": "rename_fields", "target": "t", "parameters": {"mapping": {"v": "value"}}}]
    out = apply_all(actions, {"t": rows}, Context(mode="invalid"))["t"]
    assert {r["n"]: r["__invalid"] for r in out.collect()} == {1: {"w": "division_by_zero"}, 2: {"value": "invalid_cast"}, 3: {}}
    more = [{"action": "with_fields", "target": "t", "parameters": {"assignments": [{"as": "w", "expr": "n"}, {"as": "bad", "expr": "is_invalid(value)"}]}},
            {"action": "project", "target": "t", "parameters": {"fields": ["n", "bad", {"field": "value", "as": "x"}]}}]
    got = apply_all(more, {"t": out}, Context(mode="invalid"))["t"].collect()
    assert {r["n"]: (r["bad"], r["x"], r["__invalid"]) for r in got} == {1: (False, 1, {}), 2: (True, None, {"x": "invalid_cast"}), 3: (False, None, {})}
    gone = apply_all([{"action": "drop_fields", "target": "t", "parameters": {"fields": ["value"]}}], {"t": out}, Context(mode="invalid"))["t"]
    assert {r["n"]: r["__invalid"] for r in gone.collect()}[2] == {}


def test_value_of_reports_nothing_for_safe_expressions(df):
    assert value_of("word + word", df).error is None and value_of("upper(word)", df).error is None
