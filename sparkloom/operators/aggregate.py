"""Grouping and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import Wanted, quantiles
from .registry import ActionError, Context, action, item_column


def as_number(col: Column, kind: T.DataType | None = None) -> Column:
    """Doubles; text that is no number counts as absent."""
    return col.try_cast("double") if kind is None or isinstance(kind, T.StringType) else col.cast("double")


def natural(col: Column, kind: T.DataType) -> Column:
    """min and max of dates and timestamps keep their type; all else is a number."""
    return col if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else as_number(col, kind)


def lists(col: Column) -> Column:
    """All values, nulls included."""
    return F.transform(F.collect_list(F.struct(col.alias("v"))), lambda x: x["v"])


NAMES = {"avg": "average", "var_samp": "variance", "stddev_samp": "stddev", "count(*)": "count_all"}


def aggregate_of(op: str, col: Column | None, kind: T.DataType | None, distinct: bool, order: Column) -> Column:
    op = op.rpartition(":")[2]
    if op == "count_all" or (op == "count" and col is None):
        return F.count(F.lit(1))
    if col is None:
        raise ActionError(f"{op} needs a field or an expression")
    n = None if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else as_number(col, kind)
    plain = {
        "count": lambda: F.count_distinct(col) if distinct else F.count(col),
        "count_distinct": lambda: F.count_distinct(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0)),
        "sum": lambda: F.coalesce(F.sum(n), F.lit(0.0)),
        "min": lambda: F.min(natural(col, kind)), "max": lambda: F.max(natural(col, kind)),
        "average": lambda: F.avg(n),
        "variance": lambda: F.var_samp(n), "var_pop": lambda: F.var_pop(n), "stddev": lambda: F.stddev_samp(n), "stddev_pop": lambda: F.stddev_pop(n),
        "first": lambda: F.min_by(F.struct(col.alias("v")), order)["v"], "last": lambda: F.max_by(F.struct(col.alias("v")), order)["v"],
        "collect_list": lambda: F.array_distinct(lists(col)) if distinct else lists(col),
        "collect_set": lambda: F.array_sort(F.array_distinct(lists(col))),
    }
    op = NAMES.get(op, op)
    if op not in plain:
        raise ActionError(f"unknown aggregate {op!r}")
    return plain[op]()


#: Reductions whose result distinct values change, by their names in SQL.
DISTINCT = {"sum": "sum", "average": "avg", "variance": "var_samp", "var_pop": "var_pop", "stddev": "stddev_samp", "stddev_pop": "stddev_pop"}


def over_distinct(op: str, field: str) -> Column:
    """A reduction of the distinct values of a number column."""
    found = F.expr(f"{DISTINCT[op]}(DISTINCT `{field}`)")
    return F.coalesce(found, F.lit(0.0)) if op == "sum" else found


def of_pair(op: str, x: Column, y: Column, population: bool) -> Column:
    """Of rows that have both values; a correlation with a constant is null."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    if op == "covariance":
        return F.covar_pop(x, y) if population else F.covar_samp(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread != 0, F.covar_pop(x, y) / spread)


@action("aggregate", "group")
def aggregate(frames, target, p, ctx: Context):
    """groupBy fields or expressions; `filter` applies to rows before grouping. Without keys, no rows give no row."""
    df: DataFrame = frames[target]
    if p.get("filter") is not None:
        df = df.filter(ctx.column(p["filter"], df))
    keys = p.get("groupBy", [])
    keys = [item_column(k, df, ctx) for k in ([keys] if isinstance(keys, (str, dict)) else keys)]
    if "aggregates" in p:
        asked = p["aggregates"]
    else:
        field, op = p.get("valueField"), p.get("op", "count")
        asked = [{"as": field or op, "op": op, **({"field": field} if field else {})}]
    order = ctx.order(df)[0]
    outs, wanted, held = [], [], {}

    def number(key: str, col: Column) -> str:
        """A helper column for a field or expression as a number; one for all its reductions, so that their distinct values are one group."""
        nonlocal df
        if key not in held:
            held[key] = f"__value_{len(held)}"
            df = df.withColumn(held[key], as_number(col, df.select(col.alias("x")).schema[0].dataType))
        return held[key]

    for a in asked:
        col = df[a["field"]] if a.get("field") else ctx.column(a["expr"], df) if a.get("expr") is not None else None
        kind = None if col is None else df.select(col.alias("x")).schema[0].dataType
        op = (a.get("op") or a.get("function") or "").rpartition(":")[2]
        op, distinct = NAMES.get(op, op), bool(a.get("distinct"))
        key = f"field {a['field']}" if a.get("field") else f"expr {a.get('expr')}"
        if col is not None and op in ("median", "quantile"):
            q = 0.5 if op == "median" else float(a.get("q", a.get("quantile", 0.5)))
            if not 0 <= q <= 1:
                raise ActionError(f"quantile: {q} is not a share")
            wanted.append(Wanted(a["as"], number(key, col), q, distinct))
        elif col is not None and op in ("covariance", "correlation"):
            if not a.get("other"):
                raise ActionError(f"{op} needs `other`, a second field")
            y = number(f"field {a['other']}", df[a["other"]])
            outs.append(of_pair(op, F.col(number(key, col)), F.col(y), a.get("mode") == "population").alias(a["as"]))
        elif col is not None and distinct and op in DISTINCT:
            outs.append(over_distinct(op, number(key, col)).alias(a["as"]))
        else:
            outs.append(aggregate_of(a.get("op") or a.get("function") or "count", col, kind, distinct, order).alias(a["as"]))
    found = with_quantiles(df, keys, outs, wanted) if wanted else None
    names = [n for n, _ in keys] + [a["as"] for a in asked]
    if keys:
        return {target: df.groupBy(*[c.alias(n) for n, c in keys]).agg(*outs) if found is None else found.select(*names)}
    if found is None:
        found = df.agg(*outs, F.count(F.lit(1)).alias("__rows"))
    return {target: found.filter("__rows > 0").select(*names)}


def with_quantiles(df: DataFrame, keys: list[tuple[str, Column]], outs: list[Column], wanted: list[Wanted]) -> DataFrame:
    """Other aggregates joined with the exact quantiles of the same groups."""
    keys = keys or [("__all", F.lit(0))]
    plain = df.groupBy(*[c.alias(n) for n, c in keys]).agg(*outs, F.count(F.lit(1)).alias("__rows"))
    more = quantiles(df, [(f"__k{i}", c) for i, (_, c) in enumerate(keys)], wanted)
    same = F.lit(True)
    for i, (n, _) in enumerate(keys):
        same = same & plain[n].eqNullSafe(more[f"__k{i}"])
    return plain.join(more, same, "left")
