"""Explode, pivot, unpivot."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregate import NAMES, aggregate_of
from .registry import ActionError, Context, action

#: Aggregates that rows outside a cell do not change.
OF_CELLS = frozenset("count_all count sum min max average variance var_pop stddev stddev_pop".split())


@action("explode")
def explode(frames, target, p, ctx: Context):
    """One row per element in order, maps as key-value pairs; outer keeps rows without elements with null (position 0)."""
    df, field = frames[target], p["expr"] if "expr" in p else p["field"]
    names = [p["as"]] if isinstance(p["as"], str) else p["as"]
    place = (names[1] if len(names) > 1 else "position") if p.get("includePosition") else None
    for n in [names[0], *([place] if place else [])]:
        if n in df.columns:
            raise ActionError(f"explode: a field {n!r} exists")
    items = df[field]
    if isinstance(df.schema[field].dataType, T.MapType):
        items = F.map_entries(items)
    if p.get("maxExpansion") is not None:
        size = F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(1 if p.get("outer") else 0))
        if (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) > int(p["maxExpansion"]):
            raise ActionError("explode: more rows than maxExpansion allows")
    out = df.select("*", (F.posexplode_outer if p.get("outer") else F.posexplode)(items).alias("__pos", "__item"))
    position = [F.coalesce("__pos", F.lit(0)).cast("bigint").alias(place)] if place else []
    return {target: out.select(*df.columns, F.col("__item").alias(names[0]), *position)}


@action("unpivot")
def unpivot(frames, target, p, ctx: Context):
    df, fields = frames[target], p["fields"]
    ids = [c for c in df.columns if c not in fields]
    return {target: df.unpivot(ids, fields, p.get("nameField", "name"), p.get("valueField", "value"))}


@action("pivot")
def pivot(frames, target, p, ctx: Context):
    """Declared categories become columns in one aggregate; a category that is not declared, or two values in a cell, raise.

    With `aggregates` in place of `value`, a cell is an aggregate of its rows: a column for each category and aggregate, named by the category
    alone if there is one aggregate.
    """
    df = frames[target]
    keys, by = p.get("keys") or p.get("groupBy"), p["pivot"]
    categories, names = p["categories"], p.get("categoryNames") or [str(c) for c in p["categories"]]
    if len(categories) > int(p.get("maxColumns", 10_000)):
        raise ActionError("pivot: too many categories")
    known = F.coalesce(df[by].isin(categories), F.lit(False))
    df = df.filter(F.when(known, True).otherwise(F.raise_error(F.lit("pivot: undeclared category")).cast("boolean")))
    cells = []
    if "aggregates" in p:
        for c, n in zip(categories, names):
            for a in p["aggregates"]:
                op = NAMES.get(a["op"].rpartition(":")[2], a["op"].rpartition(":")[2])
                if op not in OF_CELLS:
                    raise ActionError(f"pivot: {op!r} is no aggregate of cells")
                here, col = F.col(by) == c, df[a["field"]] if a.get("field") else ctx.column(a["expr"], df) if a.get("expr") is not None else None
                cell = F.count_if(here) if op == "count_all" or col is None else aggregate_of(op, F.when(here, col), df.select(col.alias("x")).schema[0].dataType, False, F.lit(0))
                cells.append(cell.alias(n if len(p["aggregates"]) == 1 else f"{n}_{a['as']}"))
        return {target: df.groupBy(*keys).agg(*cells)}
    value = p["value"]
    for c, n in zip(categories, names):
        here = F.when(F.col(by) == c, F.struct(F.col(value).alias("v")))
        last = F.max_by(here, F.when(here.isNotNull(), ctx.order(df)[0]))["v"]
        if p.get("collisionPolicy", "error") == "error":
            last = F.when(F.count(here) > 1, F.raise_error(F.lit("pivot: two values in a cell"))).otherwise(F.max(here)["v"])
        cells.append(last.alias(n))
    return {target: df.groupBy(*keys).agg(*cells)}
