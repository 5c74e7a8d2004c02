"""JSON rows decoded by declared types: values, states, tokens, and what does not fit."""

import datetime
import json

import pytest

from sparkloom.operators import Context, apply_all
from sparkloom.sources.typed_json import decoded

FIELDS = [{"name": n, "type": t} for n, t in (("b", "boolean"), ("i", "integer"), ("x", "decimal"), ("s", "string"), ("d", "date"), ("t", "datetime"), ("z", "time"), ("u", "duration"), ("raw", "binary"))] + [
    {"name": "l", "type": {"list": "integer"}}, {"name": "m", "type": {"map": "string"}}, {"name": "o", "type": {"object": {"a": "integer", "b": "string"}}}, {"name": 'odd "name"', "type": "integer"}]
GOOD = {"b": True, "i": 7, "x": 1.5, "s": "é", "d": {"$date": "2024-02-29"}, "t": {"$datetime": "2024-02-29T10:00:00Z"}, "z": "10:00:00", "u": "PT1H", "raw": "aGk=", "l": [1, 2], "m": {"k": "v"}, "o": {"a": 1, "b": "c"}, 'odd "name"': 3}
VALUES = (True, 7, 1.5, "é", datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 10), "10:00:00", "PT1H", bytearray(b"hi"), [1, 2], {"k": "v"}, (1, "c"), 3)


def frame(spark, *rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows)], "n int, text string").repartition(2)


def test_every_type_comes_back(spark):
    for mode in ("fail", "null", "invalid", "route"):
        row = decoded(frame(spark, GOOD), "text", FIELDS, mode).first()
        assert tuple(row)[:len(FIELDS)] == VALUES and row["__missing"] == [] and row["__invalid"] == {}
    plain = decoded(frame(spark, {"d": "2024-02-29", "t": "2024-02-29T10:00:00", "x": 3, "i": None}), "text", FIELDS).first()
    assert (plain["d"], plain["t"], plain["x"], plain["i"]) == (datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 10), 3.0, None)
    assert set(plain["__missing"]) == {f["name"] for f in FIELDS} - {"d", "t", "x", "i"}


def test_states_are_told_apart(spark):
    rows = frame(spark, {"i": 1}, {"i": None}, {}, {"i": {"$missing": True}}, {"i": {"$invalid": "late"}}, {"i": {"$mark": "missing"}}, {"i": {"$mark": "invalid", "reason": "odd"}}, {"i": {"$mark": "invalid"}})
    got = decoded(rows, "text", FIELDS[1:2], "invalid", ("n",))
    asked = [{"action": "with_fields", "target": "t", "parameters": {"assignments": [{"as": "m", "expr": "is_missing(i)"}, {"as": "w", "expr": "is_invalid(i)"}, {"as": "e", "expr": "is_null(i)"}]}}]
    out = {r["n"]: (r["i"], r["m"], r["w"], r["__invalid"].get("i")) for r in apply_all(asked, {"t": got})["t"].collect()}
    assert out == {0: (1, False, False, None), 1: (None, False, False, None), 2: (None, True, False, None), 3: (None, True, False, None), 4: (None, False, True, "late"), 5: (None, True, False, None),
                   6: (None, False, True, "odd"), 7: (None, False, True, "invalid")}


BAD = [({"i": 1.5}, "i", "wrong_type"), ({"i": "1"}, "i", "wrong_type"), ({"i": 2**63}, "i", "wrong_type"), ({"b": 1}, "b", "wrong_type"), ({"x": "1"}, "x", "wrong_type"), ({"s": 1}, "s", "wrong_type"), ({"d": "2024-02-30"}, "d", "wrong_type"),
       ({"d": {"$datetime": "2024-02-29T10:00:00"}}, "d", "wrong_type"), ({"t": "soon"}, "t", "wrong_type"), ({"l": ["a"]}, "l", "wrong_type"), ({"raw": "*"}, "raw", "wrong_type"), ({"i": {"$what": "else"}}, "i", "unknown_token"),
       ('{"i": 1', "b", "corrupt_row"), ('{"i": 1, "i": 2}', "b", "corrupt_row"), ("[1]", "b", "corrupt_row"), ("", "b", "corrupt_row"), (None, "b", "corrupt_row")]


def test_what_does_not_fit_follows_the_mode(spark):
    df = frame(spark, *[b for b, _, _ in BAD], GOOD)
    routed = apply_all([], {"t": decoded(df, "text", FIELDS, "route", ("n",))}, Context(mode="route"))
    assert [r["n"] for r in routed["t"].collect()] == [len(BAD)]
    assert sorted((r["field"], r["code"]) for r in routed["__quarantine"].collect()) == sorted((f, c) for _, f, c in BAD)
    marked = {r["n"]: r["__invalid"] for r in decoded(df, "text", FIELDS, "invalid", ("n",)).collect()}
    assert all(marked[i][f] == c for i, (_, f, c) in enumerate(BAD)) and marked[len(BAD)] == {} and len(marked[BAD.index(BAD[-1])]) == len(FIELDS)
    nulls = decoded(df, "text", FIELDS, "null", ("n",)).collect()
    assert len(nulls) == len(BAD) + 1 and all(r["__invalid"] == {} for r in nulls)
    for bad, _, _ in (BAD[0], BAD[-3]):
        with pytest.raises(Exception):
            decoded(frame(spark, bad), "text", FIELDS).collect()


def test_no_rows(spark):
    assert decoded(frame(spark, GOOD).filter("n > 5"), "text", FIELDS, "route").count() == 0


def test_the_quarantine_filters_decoded_rows_once(spark):
    """The filter reads the rows' errors; it is not rewritten in terms of the whole decoding."""
    routed = apply_all([], {"t": decoded(frame(spark, GOOD), "text", FIELDS[:4], "route", ("n",))}, Context(mode="route"))
    for name in ("t", "__quarantine"):
        filters = [line for line in routed[name]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line.split("(")[0]]
        assert filters and all("__error" in f and len(f) < 200 for f in filters)
