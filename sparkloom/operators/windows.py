"""Window functions. Without an order, peers are all rows and positions follow the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from .aggregate import aggregate_of, as_number
from .ordered import RANKS, covered, over_order, ranks_in_parts
from .registry import ActionError, Context, action, item_column
from .relational import sort_key
from .sliding import with_medians

BOUNDS = {"unboundedPreceding": Window.unboundedPreceding, "unbounded_preceding": Window.unboundedPreceding, "currentRow": 0, "current_row": 0,
          "unboundedFollowing": Window.unboundedFollowing, "unbounded_following": Window.unboundedFollowing}


def bound(value) -> int:
    if isinstance(value, str):
        if value not in BOUNDS:
            raise ActionError(f"unknown frame bound {value!r}")
        return BOUNDS[value]
    if "preceding" in value:
        return -int(value["preceding"])
    return int(value["following"]) if "following" in value else 0


def framed(by: WindowSpec, frame: dict | None) -> WindowSpec:
    """ROWS from the start to the current row unless a frame says otherwise."""
    frame = frame or {}
    kind = (frame.get("type") or frame.get("unit") or "rows").lower()
    low, high = bound(frame.get("start", frame.get("lower", "unboundedPreceding"))), bound(frame.get("end", frame.get("upper", "currentRow")))
    if kind not in ("rows", "range"):
        raise ActionError(f"frames by {kind} are not supported")
    return by.rowsBetween(low, high) if kind == "rows" else by.rangeBetween(low, high)


def median_over(col: Column, spec: WindowSpec) -> Column:
    listed = F.array_sort(F.collect_list(col).over(spec))
    return F.when(F.size(listed) > 0, F.get(listed, (F.ceil(F.size(listed) * 0.5) - 1).cast("int")))


def one(f: dict, df: DataFrame, part: list, order: list[Column], rows: WindowSpec, frame: dict | None, ctx: Context) -> Column:
    name = f["function"].rpartition(":")[2]
    col = df[f["field"]] if f.get("field") else ctx.column(f["expr"], df) if f.get("expr") is not None else None
    whole = Window.partitionBy(*part)
    peers = whole.orderBy(*order) if order else None
    ignore = bool(f.get("ignoreNulls"))
    if name == "row_number":
        return F.row_number().over(rows).cast("bigint")
    if name in ("rank", "dense_rank"):
        return (getattr(F, name)().over(peers) if peers else F.lit(1)).cast("bigint")
    if name == "percent_rank":
        return F.percent_rank().over(peers) if peers else F.lit(0.0)
    if name == "cume_dist":
        return F.cume_dist().over(peers) if peers else F.lit(1.0)
    if name == "ntile":
        n = int(f.get("n") or f.get("buckets"))
        return F.call_function("div", ((F.row_number().over(rows) - 1) * n).cast("bigint"), F.count(F.lit(1)).over(whole)) + 1
    if name in ("lag", "lead"):
        return getattr(F, name)(col, abs(int(f.get("offset", 1))), f.get("default")).over(rows)
    spec = framed(rows, f.get("frame") or frame)
    if name == "first_value":
        return F.first_value(col, F.lit(ignore)).over(spec)
    if name == "last_value":
        return F.last_value(col, F.lit(ignore)).over(spec)
    if name == "nth_value":
        return F.nth_value(col, int(f["n"]), ignore).over(spec)
    if col is None:
        raise ActionError(f"{name} over a window needs a field or an expression")
    kind = df.select(col.alias("x")).schema[0].dataType
    if name == "median":
        return median_over(as_number(col, kind), spec)
    if name == "first":
        return F.first_value(col).over(spec)
    if name == "last":
        return F.last_value(col).over(spec)
    if name == "collect_list":
        return F.transform(F.collect_list(F.struct(col.alias("v"))).over(spec), lambda x: x["v"])
    if name == "collect_set":
        return F.array_sort(F.array_distinct(F.transform(F.collect_list(F.struct(col.alias("v"))).over(spec), lambda x: x["v"])))
    if name == "count":
        return F.count(col).over(spec)
    if name == "sum":  # an empty frame has no sum
        return F.sum(as_number(col, kind)).over(spec)
    return aggregate_of(name, col, kind, False, F.lit(0)).over(spec)


def streams(f: dict, frame: dict | None) -> tuple[int | None, int] | None:
    """(first row or None for the start, last row) of a median's frame by rows that ends near the current one."""
    frame = f.get("frame") or frame or {}
    if f["function"].rpartition(":")[2] != "median" or (frame.get("type") or frame.get("unit") or "rows").lower() != "rows":
        return None
    low, high = bound(frame.get("start", frame.get("lower", "unboundedPreceding"))), bound(frame.get("end", frame.get("upper", "currentRow")))
    if high >= Window.unboundedFollowing or low >= Window.unboundedFollowing or high <= Window.unboundedPreceding:
        return None
    return (None if low <= Window.unboundedPreceding else low), high


@action("window")
def window(frames, target, p, ctx: Context):
    df = frames[target]
    part, functions = list(p.get("partitionBy", [])), p["functions"]
    ranks = bool(part) and all(f["function"].rpartition(":")[2] in RANKS for f in functions)
    if p.get("orderBy") and (ranks or not part and covered(functions, p.get("frame"))):
        keys = [{"field": k} if isinstance(k, str) else k for k in p["orderBy"]]
        asked = [(item_column(k, df, ctx)[1], bool(k.get("descending")), (k.get("nulls", "last") == "last") != bool(k.get("descending"))) for k in keys]
        reads = {} if ranks else {f["as"]: df[f["field"]] if f.get("field") else ctx.column(f["expr"], df) if f.get("expr") is not None else None for f in functions}
        found = ranks_in_parts(df, part, asked, functions) if ranks else over_order(df, asked, ctx.order(df), functions, reads)
        if found is not None:
            return {target: found}
    order = [sort_key(df, k, ctx) for k in p.get("orderBy", [])]
    tie = [F.col(ctx.row_id)] if ctx.row_id in df.columns else []
    frame = p.get("frame") or {}
    by_range = (frame.get("type") or frame.get("unit") or "rows").lower() == "range"
    names, ready, asked = df.columns, {}, []
    for i, f in enumerate(functions):
        reach = streams(f, p.get("frame"))
        if reach is not None and (f.get("field") or f.get("expr") is not None):
            value = df[f["field"]] if f.get("field") else ctx.column(f["expr"], df)
            ready[i], kind = f"__median_{i}", df.select(value.alias("x")).schema[0].dataType
            plain = f.get("field") in df.columns and isinstance(kind, (T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType)
            asked.append((f["field"] if plain else as_number(value, kind), *reach, ready[i]))
    if asked:
        df = with_medians(df, part, [*(order or ctx.order(df)), *tie], asked)
        order = [sort_key(df, k, ctx) for k in p.get("orderBy", [])]
    rows = Window.partitionBy(*part).orderBy(*(order or ctx.order(df)), *([] if by_range else tie))
    outs = [F.col(ready[i]) if i in ready else one(f, df, part, order, rows, p.get("frame"), ctx) for i, f in enumerate(functions)]
    return {target: df.select(*[F.col(f"`{c}`") for c in names], *[c.alias(f["as"]) for c, f in zip(outs, functions)])}
