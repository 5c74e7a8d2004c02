"""Registered queries of the contract operators, each with its SQL: name -> (tables, actions, result, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import Context, apply_all
from .sources import read_table


def act(action: str, target: str, **parameters) -> dict:
    return {"action": action, "target": target, "parameters": parameters}


def agg(op: str, as_: str, field: str | None = None, **more) -> dict:
    return {"op": op, "as": as_, **({"field": field} if field else {}), **more}


def asc(*fields: str) -> list[dict]:
    return [{"field": f} for f in fields]


C: dict[str, tuple[list[str], list[dict], str, str, str]] = {}


def case(name: str, tables: str, actions: list[dict], sql: str, result: str | None = None, mode: str = "fail") -> None:
    C[name] = (tables.split(), actions, result or actions[-1]["target"], sql, mode)


KEEP = "o_orderkey o_custkey o_orderstatus o_totalprice".split()

case("pricing_summary", "lineitem", [
    act("filter", "lineitem", predicate='l_shipdate <= parse_datetime("1998-09-02T00:00:00")'),
    act("aggregate", "lineitem", groupBy=["l_returnflag", "l_linestatus"], aggregates=[
        agg("sum", "sum_qty", "l_quantity"), agg("sum", "sum_disc_price", expr="l_extendedprice * (1 - l_discount)"),
        agg("average", "avg_disc", "l_discount"), agg("count_all", "n")]),
    act("with_fields", "lineitem", assignments=[{"as": "sum_disc_price", "expr": "round(sum_disc_price, 2)"}, {"as": "avg_disc", "expr": "round(avg_disc, 6)"}]),
    act("sort", "lineitem", keys=["l_returnflag", "l_linestatus"]),
], """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)) * 100) / 100 AS sum_disc_price,
 round(avg(l_discount) * 1000000) / 1000000 AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
case("filter_predicate", "orders", [act("filter", "orders", predicate='o_totalprice > 100000.0 && o_orderstatus == "F" || o_orderpriority == "1-URGENT"'), act("project", "orders", fields=KEEP)],
     "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
case("filter_between", "part", [act("filter", "part", predicate="p_size between 5 and 10"), act("project", "part", fields=["p_partkey", "p_size"])],
     "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 10")
case("select_legacy", "orders", [act("select", "orders", field="o_orderstatus", equals="O"), act("project", "orders", fields=["o_orderkey"])],
     "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
case("project_expr", "part", [act("project", "part", fields=["p_partkey", {"expr": "p_size * 2 + 1", "as": "twice"}, {"expr": "p_size / 3", "as": "third"}, {"expr": "p_size % 7", "as": "rest"}])],
     "SELECT p_partkey, p_size::BIGINT * 2 + 1 AS twice, (p_size // 3)::BIGINT AS third, (p_size % 7)::BIGINT AS rest FROM part")
case("with_fields_chain", "lineitem", [act("with_fields", "lineitem", assignments=[{"as": "net", "expr": "l_extendedprice * (1 - l_discount)"}, {"as": "gross", "expr": "round(net * (1 + l_tax), 2)"}]),
                                      act("project", "lineitem", fields=["l_orderkey", "l_linenumber", "gross"])],
     "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100.0 + 0.5) / 100.0 AS gross FROM lineitem")
case("rename_fields", "nation", [act("rename_fields", "nation", mapping={"n_name": "name", "n_absent": "x"})], "SELECT n_nationkey, n_name AS name, n_regionkey FROM nation")
case("drop_fields", "nation", [act("drop_fields", "nation", fields=["n_regionkey"])], "SELECT n_nationkey, n_name FROM nation")
case("partition_field", "nation", [act("partition", "nation", field="n_regionkey")], "SELECT *, n_regionkey AS _partition FROM nation")
case("sort_limit_offset", "orders", [act("sort", "orders", keys=[{"field": "o_totalprice", "descending": True}, {"field": "o_orderkey"}]), act("limit", "orders", count=25, offset=10), act("project", "orders", fields=["o_orderkey", "o_totalprice"])],
     "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
case("distinct_rows", "lineitem", [act("project", "lineitem", fields=["l_returnflag", "l_linestatus"]), act("distinct", "lineitem")], "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
for _name, _keep in (("dedup_first", "first"), ("dedup_last", "last")):
    case(_name, "orders", [act("with_fields", "orders", assignments=[{"as": "__row_id", "expr": "o_orderkey"}]), act("deduplicate", "orders", keys=["o_custkey"], retain=_keep),
                           act("project", "orders", fields=["o_custkey", "o_orderkey"])],
         f"SELECT o_custkey, {'min' if _keep == 'first' else 'max'}(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
case("distinct_fields", "orders", [act("with_fields", "orders", assignments=[{"as": "__row_id", "expr": "o_orderkey"}]), act("distinct", "orders", fields=["o_orderstatus", "o_orderpriority"]),
                                   act("project", "orders", fields=["o_orderstatus", "o_orderpriority", "o_orderkey"])],
     "SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
case("union_by_name", "customer supplier", [
    act("project", "customer", fields=[{"field": "c_nationkey", "as": "nation"}, {"field": "c_name", "as": "name"}, {"field": "c_mktsegment", "as": "segment"}]),
    act("project", "supplier", fields=[{"field": "s_nationkey", "as": "nation"}, {"field": "s_name", "as": "name"}]),
    act("union", "customer", other="supplier", mode="byName")],
     "SELECT c_nationkey AS nation, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, s_name, NULL FROM supplier")
case("union_distinct", "customer supplier", [
    act("project", "customer", fields=[{"field": "c_nationkey", "as": "nation"}]), act("project", "supplier", fields=[{"field": "s_nationkey", "as": "nation"}]),
    act("union", "customer", other="supplier", duplicatePolicy="distinct")], "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
_SETS = [act("filter", "customer", predicate="c_acctbal < 0.0"), act("project", "customer", fields=[{"field": "c_nationkey", "as": "nation"}]),
         act("filter", "supplier", predicate="s_acctbal > 5000.0"), act("project", "supplier", fields=[{"field": "s_nationkey", "as": "nation"}])]
_L, _R = "(SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0)", "(SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000)"
case("intersect_distinct", "customer supplier", [*_SETS, act("intersect", "customer", other="supplier")], f"FROM {_L} INTERSECT FROM {_R}")
case("except_distinct", "customer supplier", [*_SETS, act("except", "customer", other="supplier")], f"FROM {_L} EXCEPT FROM {_R}")
case("intersect_all", "customer supplier", [*_SETS, act("intersect", "customer", other="supplier", mode="all")], f"SELECT nation FROM {_L} l WHERE EXISTS (FROM {_R} r WHERE r.nation IS NOT DISTINCT FROM l.nation)")
case("except_all", "customer supplier", [*_SETS, act("except", "customer", other="supplier", mode="all")], f"SELECT nation FROM {_L} l WHERE NOT EXISTS (FROM {_R} r WHERE r.nation IS NOT DISTINCT FROM l.nation)")

_TWO = [act("project", "customer", fields=["c_custkey", "c_name"]), act("filter", "orders", predicate="o_totalprice > 200000.0"), act("project", "orders", fields=["o_orderkey", "o_custkey"])]
_O = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000)"
for _t in ("inner", "left", "right", "full"):
    case(f"join_{_t}", "customer orders", [*_TWO, act("join", "customer", right="orders", leftKey="c_custkey", rightKey="o_custkey", type=_t)],
         f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer {_t.upper()} JOIN {_O} ON c_custkey = o_custkey")
for _t, _not in (("semi", ""), ("anti", "NOT ")):
    case(f"join_{_t}", "customer orders", [*_TWO, act("join", "customer", right="orders", leftKey="c_custkey", rightKey="o_custkey", type=_t)],
         f"SELECT c_custkey, c_name FROM customer WHERE {_not}EXISTS (FROM {_O} o WHERE o.o_custkey = c_custkey)")
case("join_cross", "nation region", [act("join", "nation", right="region", type="cross")], "SELECT * FROM nation CROSS JOIN region")
case("join_theta", "nation region", [act("join", "nation", right="region", type="inner", predicate="n_regionkey < r_regionkey")], "SELECT * FROM nation JOIN region ON n_regionkey < r_regionkey")
case("join_interval", "orders events", [
    act("project", "orders", fields=["o_orderkey", "o_custkey", {"expr": 'date_add(o_orderdate, 29, "year")', "as": "starts"}]),
    act("with_fields", "orders", assignments=[{"as": "ends", "expr": 'date_add(starts, o_custkey % 12, "hour")'}]), act("project", "events", fields=["event_id", "ts"]),
    act("join", "orders", right="events", on="starts <= ts && ts < ends"), act("project", "orders", fields=["o_orderkey", "event_id"])],
     "SELECT o_orderkey, event_id FROM orders JOIN events ON o_orderdate + INTERVAL 29 YEAR <= ts AND ts < o_orderdate + INTERVAL 29 YEAR + to_hours(o_custkey % 12)")
case("join_band", "part supplier", [
    act("project", "part", fields=["p_partkey", "p_retailprice"]), act("project", "supplier", fields=["s_suppkey", "s_acctbal"]),
    act("join", "part", right="supplier", on="s_acctbal between p_retailprice - 40.0 and p_retailprice + 40.0 && (p_partkey + s_suppkey) % 2 == 0"), act("project", "part", fields=["p_partkey", "s_suppkey"])],
     "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_acctbal BETWEEN p_retailprice - 40.0 AND p_retailprice + 40.0 AND (p_partkey + s_suppkey) % 2 = 0")
case("join_residual", "customer orders", [act("project", "customer", fields=["c_custkey", "c_acctbal"]), act("project", "orders", fields=["o_orderkey", "o_custkey", "o_totalprice"]),
                                          act("join", "customer", right="orders", leftKey="c_custkey", rightKey="o_custkey", on="o_totalprice > c_acctbal * 20")],
     "SELECT c_custkey, c_acctbal, o_orderkey, o_custkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20")
# Customers are counted by their nullable key first, so that the join's size does not grow with both sides.
case("join_null_safe", "customer supplier", [
    act("project", "customer", fields=["c_custkey", {"expr": "null_if(c_nationkey, cast(3, \"integer\"))", "as": "k"}]),
    act("aggregate", "customer", groupBy=["k"], aggregates=[agg("count_all", "customers"), agg("min", "first", "c_custkey")]),
    act("project", "supplier", fields=["s_suppkey", {"expr": "case_when(s_nationkey == 4, cast(to_string(\"9\"), \"integer\"), s_nationkey == 5, null_if(cast(1, \"integer\"), cast(1, \"integer\")), to_integer(s_nationkey))", "as": "k2"}]),
    act("join", "customer", right="supplier", leftKey="k", rightKey="k2", nullSafe=True)],
     """SELECT k, customers, first, s_suppkey, k2 FROM (SELECT c_nationkey AS k, count(*) AS customers, min(c_custkey)::DOUBLE AS first FROM customer GROUP BY ALL)
 JOIN (SELECT s_suppkey, CASE WHEN s_nationkey = 4 THEN 9 WHEN s_nationkey = 5 THEN NULL ELSE s_nationkey END::BIGINT AS k2 FROM supplier) ON k IS NOT DISTINCT FROM k2""")
for _p, _sel in (("suffix", "a.n_nationkey AS n_nationkey_left, a.n_name AS n_name_left, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right"),
                 ("preferRight", "b.n_nationkey, b.n_name")):
    case(f"join_{_p.lower()}", "nation", [act("project", "nation", fields=["n_nationkey", "n_name"]), act("join", "nation", right="nation", leftKey="n_nationkey", collisionPolicy=_p)],
         f"SELECT {_sel} FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
case("join_right_collision", "nation region", [
    act("filter", "nation", predicate="n_nationkey < 3"), act("project", "nation", fields=[{"field": "n_nationkey", "as": "k"}, "n_name"]),
    act("project", "region", fields=[{"field": "r_regionkey", "as": "k"}, "r_name"]), act("join", "nation", right="region", leftKey="k", type="right")],
     "SELECT l.n_nationkey AS k, n_name, r_name FROM (FROM nation WHERE n_nationkey < 3) l RIGHT JOIN region r ON l.n_nationkey = r.r_regionkey")

case("agg_multi", "lineitem", [act("aggregate", "lineitem", groupBy=["l_returnflag"], aggregates=[
    agg("count_all", "n"), agg("count", "n_tax", "l_tax"), agg("sum", "qty", "l_quantity"), agg("min", "low", "l_quantity"), agg("max", "high", "l_quantity"), agg("min", "first_day", "l_shipdate")])],
     "SELECT l_returnflag, count(*) AS n, count(l_tax) AS n_tax, sum(l_quantity) AS qty, min(l_quantity) AS low, max(l_quantity) AS high, min(l_shipdate) AS first_day FROM lineitem GROUP BY ALL")
case("agg_legacy", "orders", [act("group", "orders", groupBy="o_orderstatus", valueField="o_custkey", op="max")], "SELECT o_orderstatus, max(o_custkey)::DOUBLE AS o_custkey FROM orders GROUP BY ALL")
case("agg_expr_key", "lineitem", [act("aggregate", "lineitem", groupBy=[{"expr": 'extract("year", l_shipdate)', "as": "year"}], aggregates=[agg("count_all", "n")])],
     "SELECT year(l_shipdate)::BIGINT AS year, count(*) AS n FROM lineitem GROUP BY ALL")
case("agg_filter", "orders", [act("aggregate", "orders", filter="o_totalprice > 300000.0", groupBy=["o_orderpriority"], aggregates=[agg("count_all", "n")])],
     "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY ALL")
case("agg_global", "orders", [act("aggregate", "orders", aggregates=[agg("count_all", "n"), agg("max", "top", "o_totalprice")])], "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")
case("agg_count_distinct", "events", [act("with_fields", "events", assignments=[{"as": "u", "expr": "case_when(user_id % 5 == 0, null_if(1, 1), user_id)"}]),
                                      act("aggregate", "events", groupBy=["event_type"], aggregates=[agg("count_distinct", "users", "u"), agg("count", "known", "u", distinct=True)])],
     "SELECT event_type, count(DISTINCT u) + max(CASE WHEN u IS NULL THEN 1 ELSE 0 END) AS users, count(DISTINCT u) AS known FROM (SELECT event_type, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS u FROM events) GROUP BY ALL")
case("agg_stats", "orders", [act("aggregate", "orders", groupBy=["o_orderstatus"], aggregates=[agg("stddev", "sd", "o_totalprice"), agg("var_pop", "vp", "o_custkey")]),
                             act("with_fields", "orders", assignments=[{"as": "sd", "expr": "round(sd, 3)"}, {"as": "vp", "expr": "round(vp, 2)"}])],
     "SELECT o_orderstatus, round(stddev_samp(o_totalprice) * 1000) / 1000 AS sd, round(var_pop(o_custkey) * 100) / 100 AS vp FROM orders GROUP BY ALL")
case("agg_median_nearest_rank", "lineitem", [act("aggregate", "lineitem", groupBy=["l_linestatus"], aggregates=[agg("median", "mid", "l_extendedprice")])],
     "SELECT l_linestatus, quantile_disc(l_extendedprice, 0.5) AS mid FROM lineitem GROUP BY ALL")
case("agg_collect_set", "orders", [act("aggregate", "orders", groupBy=["o_orderstatus"], aggregates=[agg("collect_set", "kinds", "o_orderpriority")]),
                                   act("project", "orders", fields=["o_orderstatus", {"expr": 'join_strings(kinds, "|")', "as": "kinds"}])],
     "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY ALL")

_W = "lineitem"
_BY = dict(partitionBy=["o_custkey"], orderBy=asc("o_orderkey"))
_KEY = ["l_orderkey", "l_linenumber"]
case("window_rank_family", _W, [act("window", _W, partitionBy=["l_returnflag"], orderBy=[{"field": "l_quantity", "descending": True}], functions=[
    {"as": "r", "function": "rank"}, {"as": "d", "function": "dense_rank"}, {"as": "p", "function": "percent_rank"}, {"as": "c", "function": "cume_dist"}]),
    act("project", _W, fields=[*_KEY, "r", "d", {"expr": "round(p, 8)", "as": "p"}, {"expr": "round(c, 8)", "as": "c"}])],
     """SELECT l_orderkey, l_linenumber, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w * 1e8) / 1e8 AS p, round(cume_dist() OVER w * 1e8) / 1e8 AS c
 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)""")
case("window_lag_lead", "orders", [act("window", "orders", **_BY, functions=[{"as": "rn", "function": "row_number"}, {"as": "prev", "function": "lag", "field": "o_totalprice"},
                                                                {"as": "next2", "function": "lead", "field": "o_totalprice", "offset": 2, "default": 0.0}]), act("project", "orders", fields=["o_orderkey", "rn", "prev", "next2"])],
     "SELECT o_orderkey, row_number() OVER w AS rn, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, 0.0) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
case("window_rows_frame", "orders", [act("window", "orders", **_BY, frame={"type": "rows", "start": {"preceding": 2}, "end": "currentRow"}, functions=[
    {"as": "s", "function": "sum", "field": "o_totalprice"}, {"as": "n", "function": "count", "field": "o_totalprice"}, {"as": "m", "function": "median", "field": "o_totalprice"}]), act("project", "orders", fields=["o_orderkey", "s", "n", "m"])],
     "SELECT o_orderkey, sum(o_totalprice) OVER w AS s, count(o_totalprice) OVER w AS n, quantile_disc(o_totalprice, 0.5) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
case("window_range_frame", _W, [act("window", _W, partitionBy=["l_suppkey"], orderBy=asc("l_quantity"), frame={"type": "range", "start": {"preceding": 5}, "end": "currentRow"}, functions=[{"as": "n", "function": "count", "field": "l_orderkey"}]),
                                act("project", _W, fields=[*_KEY, "n"])],
     "SELECT l_orderkey, l_linenumber, count(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM lineitem")
case("window_first_last_nth", "orders", [act("window", "orders", **_BY, functions=[{"as": "f", "function": "first_value", "field": "o_totalprice"}, {"as": "l", "function": "last_value", "field": "o_totalprice"}, {"as": "n2", "function": "nth_value", "field": "o_totalprice", "n": 2}]),
                                   act("project", "orders", fields=["o_orderkey", "f", "l", "n2"])],
     "SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
case("window_ntile", "orders", [act("window", "orders", partitionBy=["o_orderstatus"], orderBy=asc("o_orderkey"), functions=[{"as": "tile", "function": "ntile", "n": 4}]), act("project", "orders", fields=["o_orderkey", "tile"])],
     "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) * 4) // count(*) OVER (PARTITION BY o_orderstatus) + 1 AS tile FROM orders")

case("explode_list", "embeddings", [act("project", "embeddings", fields=["vec_id", "embedding"]), act("explode", "embeddings", expr="embedding", includePosition=True, **{"as": ["x", "i"]}),
                                  act("drop_fields", "embeddings", fields=["embedding"])],
     "SELECT vec_id, unnest(embedding) AS x, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i FROM embeddings")
case("pivot_status", "orders", [act("aggregate", "orders", groupBy=["o_orderpriority", "o_orderstatus"], aggregates=[agg("count_all", "n")]),
                                act("pivot", "orders", keys=["o_orderpriority"], pivot="o_orderstatus", value="n", categories=["F", "O", "P"])],
     "SELECT o_orderpriority, " + ", ".join(f"nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY ALL")
case("unpivot_measures", "lineitem", [act("project", "lineitem", fields=[*_KEY, "l_discount", "l_tax"]), act("unpivot", "lineitem", fields=["l_discount", "l_tax"], nameField="k", valueField="v")],
     "SELECT l_orderkey, l_linenumber, 'l_discount' AS k, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
case("nested_fields", "nation", [
    act("with_nested_fields", "nation", assignments=[{"path": [{"kind": "field", "name": "at"}, {"kind": "field", "name": "key"}], "expr": "n_regionkey + 1"}, {"path": [{"kind": "field", "name": "at"}, {"kind": "field", "name": "gone"}], "value": 1}], createParents=True),
    act("drop_nested_fields", "nation", paths=[[{"kind": "field", "name": "at"}, {"kind": "field", "name": "gone"}]]),
    act("rename_nested_fields", "nation", mapping=[{"from": [{"kind": "field", "name": "at"}, {"kind": "field", "name": "key"}], "to": [{"kind": "field", "name": "next"}]}]),
    act("project", "nation", fields=["n_nationkey", "next"])], "SELECT n_nationkey, n_regionkey::BIGINT + 1 AS next FROM nation")
case("field_actions", "region", [act("lowercase", "region.r_name"), act("capitalize", "region.r_name"), act("trim", "region.r_name"), act("with_fields", "region", assignments=[{"as": "h", "expr": "r_name"}, {"as": "u", "expr": "r_name"}]),
                                 act("hash_sha256", "region.h"), act("uppercase", "region.u"), act("normalize_whitespace", "region.u")],
     "SELECT r_regionkey, upper(r_name[1]) || lower(r_name[2:]) AS r_name, sha256(upper(r_name[1]) || lower(r_name[2:])) AS h, upper(r_name) AS u FROM region", "region")


def expressions(name: str, table: str, keys: list[str], items: dict[str, tuple[str, str]]) -> None:
    """A query that evaluates expressions, with their SQL."""
    case(name, table, [act("project", table, fields=[*keys, *[{"expr": e, "as": n} for n, (e, _) in items.items()]])],
         f"SELECT {', '.join(keys)}, {', '.join(f'{s} AS {n}' for n, (_, s) in items.items())} FROM {table}")


expressions("fn_strings", "part", ["p_partkey"], {
    "lo": ("lower(p_name)", "lower(p_name)"), "sub": ("substr(p_name, 2, 4)", "p_name[3:6]"), "len": ("length(p_name)", "length(p_name)"), "pos": ('position(p_name, "a")', "instr(p_name, 'a')::BIGINT - 1"),
    "padl": ('pad_left(p_brand, 12, "*")', "CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '*') END"), "rep": ('replace(p_type, "E", "3")', "replace(p_type, 'E', '3')"),
    "cat": ('concat_ws("-", p_brand, p_type)', "concat_ws('-', p_brand, p_type)"), "tr": ('translate(p_brand, "Br", "x")', "replace(p_brand, 'B', 'x')"), "rev": ("reverse(p_brand)", "reverse(p_brand)"),
    "has": ('"an" in p_name', "contains(p_name, 'an')"), "words": ('join_strings(split(p_type, " "), "_")', "replace(p_type, ' ', '_')")})
expressions("fn_regex", "part", ["p_partkey"], {
    "m": ('regex_matches(p_brand, "Brand#[0-9]+")', "regexp_full_match(p_brand, 'Brand#[0-9]+')"), "c": ('regex_contains(p_type, "STEEL|TIN")', "regexp_matches(p_type, 'STEEL|TIN')"),
    "e": ('regex_extract(p_brand, "[0-9]")', "CASE WHEN regexp_matches(p_brand, '[0-9]') THEN regexp_extract(p_brand, '[0-9]') END"), "r": ('regex_replace(p_type, "[AEIOU]", "")', "regexp_replace(p_type, '[AEIOU]', '', 'g')")})
expressions("fn_dates", "orders", ["o_orderkey"], {
    "y": ('extract("year", o_orderdate)', "year(o_orderdate)::BIGINT"), "m": ('date_trunc(o_orderdate, "month")', "date_trunc('month', o_orderdate)::TIMESTAMP"), "nx": ('format_datetime(date_add(o_orderdate, 1, "month"), "%Y-%m-%d")', "strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d')"),
    "dd": ('date_diff(o_orderdate, parse_datetime("1995-01-31T00:00:00"), "day")', "date_diff('day', DATE '1995-01-31', o_orderdate::DATE)"),
    "dm": ('date_diff(o_orderdate, parse_datetime("1995-01-31T00:00:00"), "month")', "(year(o_orderdate) * 12 + month(o_orderdate) - 1995 * 12 - 1)::BIGINT"), "f": ('format_datetime(o_orderdate, "%d/%m/%Y")', "strftime(o_orderdate, '%d/%m/%Y')")})
expressions("fn_math", "lineitem", _KEY, {
    "r": ("round(l_extendedprice / 7.0, 1)", "floor(l_extendedprice / 7.0 * 10.0 + 0.5) / 10.0"), "f": ("floor(l_tax * 100.0)", "floor(l_tax * 100.0)"), "c": ("ceil(l_discount * 10.0)", "ceil(l_discount * 10.0)"), "a": ("abs(l_quantity - 25.0)", "abs(l_quantity - 25.0)"),
    "g": ("greatest(l_tax, l_discount)", "greatest(l_tax, l_discount)"), "l": ("min(l_tax, l_discount)", "least(l_tax, l_discount)"), "s": ("round(sqrt(l_quantity), 6)", "floor(sqrt(l_quantity) * 1e6 + 0.5) / 1e6"), "p": ("power(l_quantity, 2)", "power(l_quantity, 2)")})
expressions("fn_lists", "embeddings", ["vec_id"], {
    "n": ("size(embedding)", "len(embedding)::BIGINT"), "one": ("element_at(embedding, 0)", "embedding[1]"), "end": ("element_at(embedding, -1)", "embedding[-1]"), "none": ("is_null(index(embedding, 500))", "true"),
    "top": ("element_at(list_sort(embedding), -1)", "list_max(embedding)"), "sl": ("size(list_slice(embedding, 2, 5))", "3::BIGINT"), "ps": ("list_position(embedding, element_at(embedding, 3))", "list_position(embedding, embedding[4])::BIGINT - 1"),
    "has": ("list_contains(list(label, 3), 3)", "true")})
expressions("fn_maps", "nation", ["n_nationkey"], {
    "a": ('element_at(map("x", n_regionkey, "y", 7), "x")', "n_regionkey::BIGINT"), "k": ('join_strings(map_keys(map("x", 1, "y", 2)), ",")', "'x,y'"), "o": ('field(object("u", n_name, "v", 1), "u")', "n_name"),
    "c": ('element_at(map_concat(map("x", n_regionkey), map("x", 9, "z", 8), "left"), "z")', "8::BIGINT"), "z": ('size(map("x", 1))', "1::BIGINT")})
expressions("fn_casts", "orders", ["o_orderkey"], {
    "i": ('cast("12", "integer")', "12::BIGINT"), "t": ('try_cast(o_orderpriority, "integer", "null")', "NULL::BIGINT"), "s": ("to_string(o_custkey)", "o_custkey::VARCHAR"), "b": ('parse_boolean("Yes")', "true"),
    "d": ("to_decimal(o_custkey)", "o_custkey::DOUBLE"), "v": ("to_integer(floor(o_totalprice))", "floor(o_totalprice)::BIGINT"), "w": ('case_when(o_totalprice > 200000.0, "big", o_totalprice > 50000.0, "mid", "small")', "CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END"),
    "q": ('if_null(null_if(o_orderstatus, "F"), "-")', "coalesce(nullif(o_orderstatus, 'F'), '-')"), "ne": ('null_if(o_orderstatus, "F") != "O"', "nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'")})
expressions("fn_statistics", "lineitem", _KEY, {
    "v": ("round(variance(l_tax, l_discount, 0.5), 8)", "round(list_var_samp([l_tax, l_discount, 0.5]) * 1e8) / 1e8"), "m": ("median(l_tax, l_discount, 0.05, 0.5)", "list_sort([l_tax, l_discount, 0.05, 0.5])[2]"),
    "q": ("quantile(l_tax, l_discount, 0.05, 0.75)", "list_sort([l_tax, l_discount, 0.05])[3]"), "f": ("first(l_tax, l_discount)", "l_tax")})


def lam(names: list[str], body: dict) -> dict:
    return {"lambda": names, "body": body}


def fn(name: str, *args) -> dict:
    return {"call": name, "args": list(args)}


X, Y, K, E = {"field": "x"}, {"field": "y"}, {"field": "k"}, {"field": "embedding"}
_LAMBDAS = {
    "big": (fn("size", fn("filter_values", E, lam(["x"], fn("gt", X, {"literal": 0.1})))), "len(list_filter(embedding, lambda x: x > 0.1))::BIGINT"),
    "any_": (fn("exists", E, lam(["x"], fn("gt", X, {"literal": 0.4}))), "len(list_filter(embedding, lambda x: x > 0.4)) > 0"),
    "all_": (fn("forall", E, lam(["x"], fn("lt", X, {"literal": 2.0}))), "true"),
    "n": (fn("reduce", E, {"literal": 0}, lam(["k", "x"], fn("add", K, {"literal": 1}))), "len(embedding)::BIGINT"),
    "tw": (fn("element_at", fn("transform", E, lam(["x"], fn("multiply", X, {"literal": 2.0}))), {"literal": 0}), "embedding[1]::DOUBLE * 2.0"),
    "zp": (fn("size", fn("zip_with", E, fn("list", {"literal": 1.0}, {"literal": 2.0}), lam(["x", "y"], fn("add", X, Y)))), "2::BIGINT"),
    "mp": (fn("element_at", fn("transform_values", fn("map", {"literal": "a"}, {"field": "label"}), lam(["k", "x"], fn("add", X, {"literal": 1}))), {"literal": "a"}), "label::BIGINT + 1"),
    "mk": (fn("join_strings", fn("map_keys", fn("transform_keys", fn("map", {"literal": "a"}, {"literal": 1}), lam(["k", "x"], fn("concat", K, {"literal": "!"})))), {"literal": ""}), "'a!'"),
    "mf": (fn("size", fn("map_filter", fn("map", {"literal": "a"}, {"literal": 1}, {"literal": "b"}, {"literal": 2}), lam(["k", "x"], fn("gt", X, {"literal": 1})))), "1::BIGINT"),
}
expressions("fn_lambdas", "embeddings", ["vec_id"], _LAMBDAS)


expressions("fn_strings_more", "part", ["p_partkey"], {
    "cf": ("casefold(p_name)", "lower(p_name)"), "lu": ("lower_unicode(p_type)", "lower(p_type)"), "up": ("upper(p_name)", "upper(p_name)"), "uu": ("upper_unicode(p_name)", "upper(p_name)"),
    "con": ('contains(p_name, "an")', "contains(p_name, 'an')"), "sta": ('starts_with(p_type, "STANDARD")', "starts_with(p_type, 'STANDARD')"), "end_": ('ends_with(p_type, "TIN")', "ends_with(p_type, 'TIN')"),
    "tri": ('trim(concat("  ", p_brand, "  "))', "p_brand"), "ltr": ('ltrim(concat("  ", p_brand, " "))', "p_brand || ' '"), "rtr": ('rtrim(concat("  ", p_brand, " "))', "'  ' || p_brand"),
    "trc": ('trim(p_brand, "B")', "trim(p_brand, 'B')"), "nws": ('normalize_whitespace(concat(" ", p_type, "   x "))', "p_type || ' x'"),
    "padr": ('pad_right(p_brand, 12, "*")', "CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '*') END"), "twice": ("repeat(p_brand, 2)", "repeat(p_brand, 2)")})
expressions("fn_regex_more", "part", ["p_partkey"], {
    "sp": ('join_strings(regex_split(p_type, " +"), "_")', "regexp_replace(p_type, ' +', '_', 'g')"), "all_": ('join_strings(regex_extract_all(p_type, "[A-Z]+"), "|")', "array_to_string(regexp_extract_all(p_type, '[A-Z]+'), '|')")})
expressions("fn_logic", "orders", ["o_orderkey"], {
    "co": ('coalesce(null_if(o_orderstatus, "F"), o_orderpriority)', "coalesce(nullif(o_orderstatus, 'F'), o_orderpriority)"), "ge": ("gte(o_totalprice, 100000.0)", "o_totalprice >= 100000"),
    "no": ('not(o_orderstatus == "F")', "o_orderstatus <> 'F'"), "ns": ('null_safe_eq(null_if(o_orderstatus, "F"), null_if("F", "F"))', "o_orderstatus = 'F'"), "ha": ('has(list("F", "O"), o_orderstatus)', "o_orderstatus IN ('F', 'O')"),
    "mx": ("max(o_custkey, 100)", "greatest(o_custkey, 100)::DOUBLE"), "le": ("least(o_custkey, 100)", "least(o_custkey, 100)::DOUBLE"), "iv": ("is_invalid(o_custkey)", "false"),
    "mi": ("is_missing(no_such_field)", "true"), "mh": ("is_missing(o_custkey)", "false")})
expressions("fn_conversion_more", "orders", ["o_orderkey"], {
    "pd": ('parse_date("1995-03-04")', "DATE '1995-03-04'"), "pt": ('parse_time("10:11:12")', "'10:11:12'"), "pn": ('parse_decimal("12.5")', "12.5::DOUBLE"), "fd": ('format_date(o_orderdate, "%Y/%m/%d")', "strftime(o_orderdate, '%Y/%m/%d')"),
    "dp": ('date_part("month", o_orderdate)', "month(o_orderdate)::BIGINT"), "ts": ("to_string(o_totalprice)", "regexp_replace(o_totalprice::VARCHAR, '\\.0$', '')"), "tiny": ("to_string(o_custkey / 1000000000000.0)", "regexp_replace(rtrim(printf('%.12f', o_custkey / 1000000000000.0), '0'), '\\.$', '')")})
expressions("fn_zones", "orders", ["o_orderkey"], {
    "tz": ('to_timezone(o_orderdate, "Asia/Kolkata")', "strftime(o_orderdate::TIMESTAMP + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30'"), "fu": ('from_utc(o_orderdate, "Asia/Tokyo")', "strftime(o_orderdate::TIMESTAMP + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00'"),
    "at": ('at_timezone(o_orderdate, "UTC")', "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00'"),
    "ut": ('format_datetime(to_utc(format_datetime(o_orderdate, "%Y-%m-%dT%H:%M:%S"), "Asia/Tokyo"), "%Y-%m-%dT%H:%M:%S")', "strftime(o_orderdate::TIMESTAMP - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S')")})
_XY = "(l_tax + l_discount * 2 + 0.5 * 4 - (l_tax + l_discount + 0.5) * 7.0 / 3)"
expressions("fn_statistics_more", "lineitem", _KEY, {
    "sd": ("round(stddev(l_tax, l_discount, 0.5), 6)", "round(sqrt(list_var_samp([l_tax, l_discount, 0.5])) * 1e6) / 1e6"), "cv": ("round(covariance(list(l_tax, l_discount, 0.5), list(1.0, 2.0, 4.0)), 6)", f"round({_XY} / 2 * 1e6) / 1e6"),
    "cr": ("round(correlation(list(l_tax, l_discount, 0.5), list(1.0, 2.0, 4.0)), 6)", f"round({_XY} / sqrt(list_var_pop([l_tax, l_discount, 0.5]) * 3 * 14.0 / 3) * 1e6) / 1e6"),
    "la": ("last(l_tax, l_discount)", "l_discount"), "cs": ('join_strings(collect_set(l_returnflag, l_linestatus), "|")', "array_to_string(list_sort(list_distinct([l_returnflag, l_linestatus])), '|')"),
    "cl": ('join_strings(collect_list(l_returnflag, l_linestatus), "|")', "l_returnflag || '|' || l_linestatus")})
expressions("fn_collections_more", "nation", ["n_nationkey"], {
    "lc": ("element_at(list_concat(list(n_regionkey), list(n_nationkey)), 1)", "n_nationkey"), "mv": ('element_at(map_values(map("x", n_regionkey, "y", n_nationkey)), 0)', "n_regionkey"),
    "me": ('field(element_at(map_entries(map("x", n_regionkey)), 0), "value")', "n_regionkey"), "mf": ('element_at(map_from_entries(map_entries(map("x", n_regionkey))), "x")', "n_regionkey"),
    "on_": ('join_strings(object_names(object("u", 1, "v", 2)), ",")', "'u,v'"), "ov": ('join_strings(object_values(object("u", n_name, "v", "w")), ",")', "n_name || ',w'"), "tu": ('field(tuple(n_name, n_regionkey), "_1")', "n_name")})
expressions("fn_run_context", "region", ["r_regionkey"], {
    "cd": ("current_date()", "DATE '2026-01-01'"), "ct": ('format_datetime(current_timestamp(), "%Y-%m-%dT%H:%M:%S")', "'2026-01-01T00:00:00'"), "ra": ("random(7)", "0.11272690821447051::DOUBLE"), "rn": ("abs(random_normal(7, 0.0, 0.0))", "0.0::DOUBLE"),
    "uu": ("length(uuid())", "36::BIGINT"), "ri": ("length(run_id())", "36::BIGINT"), "rt": ('ends_with(run_timestamp(), "Z")', "true")})

case("agg_distinct_stats", "lineitem", [
    act("aggregate", "lineitem", groupBy=["l_returnflag"], aggregates=[agg(op, op, "l_quantity", distinct=True) for op in ("variance", "stddev", "var_pop", "stddev_pop", "sum", "average", "median")]),
    act("with_fields", "lineitem", assignments=[{"as": x, "expr": f"round({x}, 6)"} for x in ("variance", "stddev", "var_pop", "stddev_pop", "average")])],
     "SELECT l_returnflag, " + ", ".join(f"round({f}(DISTINCT l_quantity) * 1e6) / 1e6 AS {n}" for n, f in (("variance", "var_samp"), ("stddev", "stddev_samp"), ("var_pop", "var_pop"), ("stddev_pop", "stddev_pop"), ("average", "avg")))
     + ", sum(DISTINCT l_quantity) AS sum, quantile_disc(DISTINCT l_quantity, 0.5) AS median FROM lineitem GROUP BY ALL")
_ROWS = act("with_fields", "orders", assignments=[{"as": "__row_id", "expr": "o_orderkey"}])
case("agg_first_last", "orders", [_ROWS, act("aggregate", "orders", groupBy=["o_orderstatus"], aggregates=[agg("first", "f", "o_custkey"), agg("last", "l", "o_custkey")])],
     "SELECT o_orderstatus, arg_min(o_custkey, o_orderkey) AS f, arg_max(o_custkey, o_orderkey) AS l FROM orders GROUP BY ALL")
case("agg_collect_list", "orders", [act("aggregate", "orders", groupBy=["o_custkey"], aggregates=[agg("collect_list", "kinds", "o_orderpriority"), agg("collect_list", "once", "o_orderpriority", distinct=True)]),
                                    act("project", "orders", fields=["o_custkey", {"expr": 'join_strings(list_sort(kinds), "|")', "as": "kinds"}, {"expr": 'join_strings(list_sort(once), "|")', "as": "once"}])],
     "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS kinds, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS once FROM orders GROUP BY ALL")
case("agg_quantiles", "lineitem", [
    act("aggregate", "lineitem", groupBy=["l_returnflag", "l_linenumber"], aggregates=[agg("quantile", "q10", "l_extendedprice", q=0.1), agg("quantile", "q99", "l_extendedprice", q=0.99), agg("median", "m", "l_quantity"),
                                                                                       agg("quantile", "top", "l_quantity", q=1), agg("quantile", "d", "l_discount", q=0.75, distinct=True), agg("count_all", "n")])],
     """SELECT l_returnflag, l_linenumber, quantile_disc(l_extendedprice, 0.1) AS q10, quantile_disc(l_extendedprice, 0.99) AS q99, quantile_disc(l_quantity, 0.5) AS m, max(l_quantity) AS top,
 quantile_disc(DISTINCT l_discount, 0.75) AS d, count(*) AS n FROM lineitem GROUP BY ALL""")
case("agg_covariance", "orders", [
    act("aggregate", "orders", groupBy=["o_orderstatus"], aggregates=[agg("covariance", "c", "o_custkey", other="o_orderkey"), agg("covariance", "p", "o_custkey", other="o_orderkey", mode="population"), agg("correlation", "r", "o_custkey", other="o_totalprice")]),
    act("with_fields", "orders", assignments=[{"as": "c", "expr": "round(c, 3)"}, {"as": "p", "expr": "round(p, 3)"}, {"as": "r", "expr": "round(r, 9)"}])],
     """SELECT o_orderstatus, sign(c) * floor(abs(c) * 1000 + 0.5) / 1000 AS c, sign(p) * floor(abs(p) * 1000 + 0.5) / 1000 AS p, sign(r) * floor(abs(r) * 1e9 + 0.5) / 1e9 AS r FROM (
 SELECT o_orderstatus, covar_samp(o_custkey, o_orderkey) AS c, covar_pop(o_custkey, o_orderkey) AS p, corr(o_custkey, o_totalprice) AS r FROM orders GROUP BY ALL)""")
case("agg_spread", "orders", [act("aggregate", "orders", groupBy=["o_orderpriority"], aggregates=[agg("variance", "v", "o_custkey"), agg("stddev_pop", "s", "o_custkey")]),
                              act("with_fields", "orders", assignments=[{"as": "v", "expr": "round(v, 3)"}, {"as": "s", "expr": "round(s, 3)"}])],
     "SELECT o_orderpriority, round(var_samp(o_custkey) * 1000) / 1000 AS v, round(stddev_pop(o_custkey) * 1000) / 1000 AS s FROM orders GROUP BY ALL")
case("window_one_order", "orders", [
    act("with_fields", "orders", assignments=[{"as": "p", "expr": "case_when(o_custkey % 50 == 0, null_if(o_custkey, o_custkey), o_custkey)"}]),
    act("window", "orders", orderBy=[{"field": "p", "descending": True}, {"field": "o_orderstatus"}], functions=[
        {"as": "rk", "function": "rank"}, {"as": "dr", "function": "dense_rank"}, {"as": "pr", "function": "percent_rank"}, {"as": "cd", "function": "cume_dist"}]),
    act("window", "orders", orderBy=[{"field": "o_orderpriority"}, {"field": "o_orderkey"}], functions=[
        {"as": "rn", "function": "row_number"}, {"as": "t", "function": "ntile", "n": 7}, {"as": "prev", "function": "lag", "field": "o_custkey", "offset": 3, "default": -1}, {"as": "next", "function": "lead", "field": "o_custkey"},
        {"as": "s", "function": "sum", "field": "o_custkey"}, {"as": "c", "function": "count", "field": "p"}, {"as": "lo", "function": "min", "field": "o_totalprice"}, {"as": "hi", "function": "max", "field": "o_totalprice"}]),
    act("project", "orders", fields=["o_orderkey", "rk", "dr", {"expr": "round(pr, 9)", "as": "pr"}, {"expr": "round(cd, 9)", "as": "cd"}, "rn", "t", "prev", "next", "s", "c", "lo", "hi"])],
     """SELECT o_orderkey, rank() OVER v AS rk, dense_rank() OVER v AS dr, floor(percent_rank() OVER v * 1e9 + 0.5) / 1e9 AS pr, floor(cume_dist() OVER v * 1e9 + 0.5) / 1e9 AS cd, row_number() OVER w AS rn,
 (row_number() OVER w - 1) * 7 // count(*) OVER () + 1 AS t, lag(o_custkey, 3, -1) OVER w AS prev, lead(o_custkey) OVER w AS next, (sum(o_custkey) OVER r)::DOUBLE AS s, count(p) OVER r AS c, min(o_totalprice) OVER r AS lo, max(o_totalprice) OVER r AS hi
 FROM (SELECT *, CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS p FROM orders) WINDOW v AS (ORDER BY p DESC NULLS FIRST, o_orderstatus), w AS (ORDER BY o_orderpriority, o_orderkey),
 r AS (ORDER BY o_orderpriority, o_orderkey ROWS UNBOUNDED PRECEDING)""")
case("window_running_median", "orders", [
    act("window", "orders", partitionBy=["o_orderstatus"], orderBy=[{"field": "o_orderkey"}], functions=[
        {"as": "m", "function": "median", "field": "o_totalprice"}, {"as": "near", "function": "median", "field": "o_totalprice", "frame": {"type": "rows", "start": {"preceding": 5}, "end": {"following": 4}}},
        {"as": "before", "function": "median", "field": "o_custkey", "frame": {"type": "rows", "start": {"preceding": 100}, "end": {"preceding": 1}}}, {"as": "n", "function": "row_number"}]),
    act("project", "orders", fields=["o_orderkey", "m", "near", "before", "n"])],
     """SELECT o_orderkey, quantile_disc(o_totalprice, 0.5) OVER (w ROWS UNBOUNDED PRECEDING) AS m, quantile_disc(o_totalprice, 0.5) OVER (w ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS near,
 quantile_disc(o_custkey::DOUBLE, 0.5) OVER (w ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS before, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)""")
case("window_framed_aggregates", "orders", [
    act("with_fields", "orders", assignments=[{"as": "p", "expr": "case_when(o_custkey % 3 == 0, null_if(o_totalprice, o_totalprice), o_totalprice)"}]),
    act("window", "orders", **_BY, frame={"type": "rows", "start": {"preceding": 2}, "end": "currentRow"}, functions=[
        {"as": "v", "function": "variance", "field": "o_totalprice"}, {"as": "f", "function": "first", "field": "o_totalprice"}, {"as": "l", "function": "last", "field": "o_totalprice"},
        {"as": "c", "function": "collect_list", "field": "o_orderpriority"}, {"as": "lo", "function": "min", "field": "o_totalprice"}, {"as": "a", "function": "average", "field": "o_totalprice"},
        {"as": "i", "function": "last_value", "field": "p", "ignoreNulls": True}]),
    act("project", "orders", fields=["o_orderkey", {"expr": "round(v / 1000000.0, 1)", "as": "v"}, "f", "l", {"expr": 'join_strings(c, "|")', "as": "c"}, "lo", {"expr": "round(a, 4)", "as": "a"}, "i"])],
     """SELECT o_orderkey, round((var_samp(o_totalprice) OVER w) / 1000000.0 * 10) / 10 AS v, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, string_agg(o_orderpriority, '|') OVER w AS c,
 min(o_totalprice) OVER w AS lo, round(avg(o_totalprice) OVER w * 10000) / 10000 AS a, last_value(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END IGNORE NULLS) OVER w AS i
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
case("explode_map", "nation", [act("with_fields", "nation", assignments=[{"as": "m", "expr": 'map("a", n_nationkey, "b", n_regionkey)'}]), act("explode", "nation", expr="m", **{"as": ["e"]}),
                               act("project", "nation", fields=["n_nationkey", {"expr": 'field(e, "key")', "as": "k"}, {"expr": 'field(e, "value")', "as": "v"}])],
     "SELECT n_nationkey, 'a' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_regionkey FROM nation")
case("explode_outer", "orders", [act("with_fields", "orders", assignments=[{"as": "xs", "expr": 'case_when(o_orderstatus == "F", list(o_custkey, o_orderkey), list_slice(list(o_custkey), 0, 0))'}]),
                                 act("explode", "orders", expr="xs", outer=True, includePosition=True, **{"as": ["x", "i"]}), act("project", "orders", fields=["o_orderkey", "x", "i"])],
     "SELECT o_orderkey, o_custkey AS x, 0::BIGINT AS i FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, 0 FROM orders WHERE o_orderstatus <> 'F'")
case("pivot_last", "orders", [_ROWS, act("pivot", "orders", keys=["o_custkey"], pivot="o_orderstatus", value="o_totalprice", categories=["F", "O", "P"], collisionPolicy="last")],
     "SELECT o_custkey, " + ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{x}') AS \"{x}\"" for x in "FOP") + " FROM orders GROUP BY ALL")
case("pivot_aggregates", "orders", [act("pivot", "orders", groupBy=["o_orderpriority"], pivot="o_orderstatus", categories=["F", "O", "P"], aggregates=[agg("count_all", "n"), agg("max", "top", "o_totalprice"), agg("sum", "ids", "o_custkey")])],
     "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{x}') AS \"{x}_n\", max(o_totalprice) FILTER (o_orderstatus = '{x}') AS \"{x}_top\", (sum(o_custkey) FILTER (o_orderstatus = '{x}'))::DOUBLE AS \"{x}_ids\"" for x in "FOP")
     + " FROM orders GROUP BY ALL")
case("union_positional", "nation region", [act("project", "nation", fields=["n_nationkey", "n_name"]), act("project", "region", fields=["r_regionkey", "r_name"]), act("union", "nation", other="region")],
     "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
case("partitioning_keeps_rows", "orders", [act("project", "orders", fields=KEEP), act("repartition", "orders", keys=["o_custkey"]), act("coalesce_partitions", "orders", count=2)],
     "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
_RISKY = [
    act("with_fields", "events", assignments=[{"as": "k", "expr": 'to_integer(regex_extract(props, "[0-9]+"))'}, {"as": "ratio", "expr": "user_id / (k % 7)"}, {"as": "root", "expr": "floor(sqrt(value - 5.0))"}]),
    act("filter", "events", predicate="100 / (user_id % 5) > 20 && root >= 0.0")]
_FAILED = """WITH k AS (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events), e AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'with_fields|ratio|division_by_zero' WHEN value < 5.0 THEN 'with_fields|root|negative_number'
 WHEN user_id % 5 = 0 THEN 'filter|predicate|division_by_zero' END AS failed FROM k) """
case("route_good_rows", "events", [*_RISKY, act("project", "events", fields=["event_id", "ratio", "root", {"expr": "100 / (user_id % 5)", "as": "part"}])],
     _FAILED + "SELECT event_id, user_id // (k % 7) AS ratio, floor(sqrt(value - 5.0)) AS root, 100 // (user_id % 5) AS part FROM e WHERE failed IS NULL AND 100 // (user_id % 5) > 20", mode="route")
case("route_bad_rows", "events", [*_RISKY, act("aggregate", "events", groupBy=["event_type"], aggregates=[agg("count_all", "n")]),
                                  act("project", "__quarantine", fields=["frame", "action", "field", "code", {"expr": 'to_integer(regex_extract(row, "^.{12}([0-9]+)", 1))', "as": "event_id"}])],
     _FAILED + "SELECT 'events' AS frame, split_part(failed, '|', 1) AS action, split_part(failed, '|', 2) AS field, split_part(failed, '|', 3) AS code, event_id FROM e WHERE failed IS NOT NULL", mode="route")
case("null_bad_values", "events", [_RISKY[0], act("project", "events", fields=["event_id", "ratio", "root", {"expr": 'coalesce(100 / (user_id % 5), 7)', "as": "part"}])],
     "SELECT event_id, user_id // nullif(regexp_extract(props, '[0-9]+')::BIGINT % 7, 0) AS ratio, CASE WHEN value >= 5.0 THEN floor(sqrt(value - 5.0)) END AS root, 100 // nullif(user_id % 5, 0) AS part FROM events", mode="null")
case("invalid_values", "events", [
    _RISKY[0], act("with_fields", "events", assignments=[{"as": "digit", "expr": 'try_cast(case_when(user_id % 2 == 0, event_type, "7"), "integer")'}]),
    act("rename_fields", "events", mapping={"ratio": "share"}), act("filter", "events", predicate="is_invalid(share) || is_invalid(root) || is_invalid(digit)"),
    act("project", "events", fields=["event_id", "share", {"expr": "is_invalid(share)", "as": "s"}, {"expr": "is_invalid(root)", "as": "r"}, {"expr": "is_invalid(digit)", "as": "d"}, {"expr": "is_null(digit)", "as": "n"}]),
    act("drop_fields", "events", fields=["__invalid"])],
     """SELECT event_id, user_id // nullif(k % 7, 0) AS share, k % 7 = 0 AS s, value < 5.0 AS r, user_id % 2 = 0 AS d, user_id % 2 = 0 AS n FROM (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events) WHERE k % 7 = 0 OR value < 5.0 OR user_id % 2 = 0""", mode="invalid")


def one(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, actions, result, _, mode = C[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_all(actions, {t: read_table(spark, sf_dir, t) for t in tables}, Context(mode=mode))[result]

    return run


def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"orders": read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")}
    return apply_all([act("with_fields", "orders", assignments=[{"as": "__row_id", "expr": "o_orderkey"}]), act("sample", "orders", fraction=0.1, seed=42)], frames)["orders"]


JSON_FIELDS = [{"name": "id", "type": "integer"}, {"name": "v", "type": "decimal"}, {"name": "day", "type": "date"}, {"name": "tags", "type": {"list": "string"}}]


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON text: values that are missing, invalid, null or of another type, days in wrappers, and rows cut short."""
    from pyspark.sql import functions as F

    events = read_table(spark, sf_dir, "events")
    value = F.expr("""CASE user_id % 7 WHEN 0 THEN '"v": {"$missing": true}, ' WHEN 1 THEN '"v": {"$invalid": "late"}, ' WHEN 2 THEN '"v": null, ' WHEN 3 THEN '' WHEN 4 THEN '"v": {"$is": "invalid", "reason": "odd"}, '
        WHEN 5 THEN '"v": "text", ' ELSE concat('"v": ', cast(value AS string), ', ') END""")
    row = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(", "), value, F.lit('"day": {"$date": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}, "tags": ["a", "'), F.col("event_type"), F.lit('"]'))
    return events.select("event_id", F.concat(row, F.when(F.col("event_id") % 11 == 0, "").otherwise("}")).alias("text"))


def json_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.typed_json import decoded

    frames = {"events": decoded(json_rows(spark, sf_dir), "text", JSON_FIELDS, "invalid")}
    asked = ["id", "v", "day", {"expr": "is_missing(v)", "as": "missing"}, {"expr": "is_invalid(v)", "as": "invalid"}, {"expr": "is_invalid(tags)", "as": "corrupt"}, {"expr": "index(tags, 1)", "as": "tag"}]
    return apply_all([act("project", "events", fields=asked)], frames)["events"]


def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.typed_json import decoded

    return apply_all([], {"events": decoded(json_rows(spark, sf_dir), "text", JSON_FIELDS, "route", ("event_id",))}, Context(mode="route"))["__quarantine"].select("action", "field", "code", "row")


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"orders": read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")}
    out = apply_all([act("with_fields", "orders", assignments=[{"as": "__row_id", "expr": "o_orderkey"}]), act("random_split", "orders", weights=[3, 1], outputs=["train", "test"], seed=7)], frames)
    from pyspark.sql import functions as F

    return out["train"].withColumn("part", F.lit("train")).unionByName(out["test"].withColumn("part", F.lit("test"))).drop("__row_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .plans import contract_queries

    return {n: one(n) for n in C} | {"sample_seeded": sample_seeded, "random_split": random_split, "json_states": json_states, "json_rejects": json_rejects} | contract_queries.queries()


def oracle_sql() -> dict[str, str]:
    from .plans import contract_queries

    ranked = "SELECT o_orderkey, o_custkey, md5('{seed}:' || o_orderkey) AS rank FROM orders"
    share = "('0x' || substr(rank, 1, 13))::BIGINT / 4503599627370496.0"
    value = """CASE user_id % 7 WHEN 0 THEN '"v": {"$missing": true}, ' WHEN 1 THEN '"v": {"$invalid": "late"}, ' WHEN 2 THEN '"v": null, ' WHEN 3 THEN '' WHEN 4 THEN '"v": {"$is": "invalid", "reason": "odd"}, '
        WHEN 5 THEN '"v": "text", ' ELSE '"v": ' || value || ', ' END"""
    text = f"""'{{"id": ' || event_id || ', ' || {value} || '"day": {{"$date": "' || strftime(ts, '%Y-%m-%d') || '"}}, "tags": ["a", "' || event_type || '"]' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}}' END"""
    samples = {
        "json_states": """SELECT CASE WHEN whole THEN event_id END AS id, CASE WHEN whole AND k = 6 THEN value END AS v, CASE WHEN whole THEN ts::DATE END AS day, whole AND k IN (0, 3) AS missing,
 NOT whole OR k IN (1, 4, 5) AS invalid, NOT whole AS corrupt, CASE WHEN whole THEN event_type END AS tag FROM (SELECT *, event_id % 11 <> 0 AS whole, user_id % 7 AS k FROM events)""",
        "json_rejects": f"""SELECT 'decode' AS action, CASE WHEN event_id % 11 = 0 THEN 'id' ELSE 'v' END AS field, CASE WHEN event_id % 11 = 0 THEN 'corrupt_row' ELSE 'wrong_type' END AS code,
 to_json({{text: {text}}})::VARCHAR AS "row" FROM events WHERE event_id % 11 = 0 OR user_id % 7 = 5""",
        "sample_seeded": f"SELECT o_orderkey, o_custkey, o_orderkey AS __row_id FROM ({ranked.format(seed=42)}) ORDER BY rank LIMIT (SELECT count(*) // 10 FROM orders)",
        "random_split": f"SELECT o_orderkey, o_custkey, CASE WHEN {share} < 0.75 THEN 'train' ELSE 'test' END AS part FROM ({ranked.format(seed=7)})",
    }
    return {n: c[3] for n, c in C.items()} | samples | contract_queries.oracle_sql()
