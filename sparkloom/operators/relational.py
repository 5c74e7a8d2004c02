"""Projection, filtering, ordering, duplicates, set operations and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import ActionError, Context, action, item_column


@action("project")
def project(frames, target, p, ctx: Context):
    """Keep the listed fields and expressions; plain names that the frame lacks are dropped."""
    df = frames[target]
    items = [i for i in p["fields"] if not isinstance(i, str) or i in df.columns]
    return {target: df.select(*[c.alias(n) for n, c in (item_column(i, df, ctx) for i in items)])}


@action("filter", "select")
def filter_(frames, target, p, ctx: Context):
    """Keep rows whose predicate is true. `field` alone means not null; with `equals`, equality."""
    df = frames[target]
    if "predicate" in p:
        return {target: df.filter(ctx.column(p["predicate"], df))}
    field = df[p["field"]]
    return {target: df.filter(field.eqNullSafe(F.lit(p["equals"])) if "equals" in p else field.isNotNull())}


@action("with_fields")
def with_fields(frames, target, p, ctx: Context):
    """Add or replace fields in order; later ones see earlier ones."""
    df = frames[target]
    for a in p["assignments"]:
        df = df.withColumn(a["as"], ctx.column(a["expr"], df))
    return {target: df}


@action("rename_fields")
def rename_fields(frames, target, p, ctx: Context):
    """Rename one after another; absent names are ignored and a name that is taken is overwritten."""
    df = frames[target]
    held = {c: c for c in df.columns}
    for old, new in p["mapping"].items():
        if old in held and old != new:
            source = held.pop(old)
            held.pop(new, None)
            held[new] = source
    return {target: df.select(*[df[source].alias(name) for name, source in held.items()])}


@action("drop_fields")
def drop_fields(frames, target, p, ctx: Context):
    df = frames[target]
    gone = [f for f in p["fields"] if f not in df.columns]
    if gone and p.get("missingPolicy", "error") == "error":
        raise ActionError(f"no field {gone[0]!r} to drop")
    return {target: df.drop(*p["fields"])}


@action("partition")
def partition(frames, target, p, ctx: Context):
    df = frames[target]
    return {target: df.withColumn("_partition", df[p["field"]] if p["field"] in df.columns else F.lit(None).cast("string"))}


def sort_key(df: DataFrame, key, ctx: Context) -> Column:
    """Nulls last by default; descending reverses their placement too, even a declared one."""
    if isinstance(key, str):
        key = {"field": key}
    col, down, nulls = item_column(key, df, ctx)[1], key.get("descending", False), key.get("nulls", "last")
    last = (nulls == "last") != bool(down)
    if down:
        return col.desc_nulls_last() if last else col.desc_nulls_first()
    return col.asc_nulls_last() if last else col.asc_nulls_first()


@action("sort")
def sort(frames, target, p, ctx: Context):
    df = frames[target]
    keys = p.get("keys") or [{"field": p["field"], "descending": p.get("descending", False)}]
    tie = [F.col(ctx.row_id)] if ctx.row_id in df.columns else []
    return {target: df.orderBy(*[sort_key(df, k, ctx) for k in keys], *tie)}


@action("limit")
def limit(frames, target, p, ctx: Context):
    """A slice; after a sort Spark keeps only the top rows of each task."""
    df = frames[target]
    return {target: (df.offset(int(p["offset"])) if p.get("offset") else df).limit(int(p["count"]))}


def first_rows(df: DataFrame, keys: list[str], ctx: Context, last: bool = False) -> DataFrame:
    order = ctx.order(df)
    ranked = df.withColumn("__order", order[0])
    by = Window.partitionBy(*keys).orderBy(F.desc("__order") if last else F.asc("__order"))
    return ranked.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n", "__order")


@action("distinct")
def distinct(frames, target, p, ctx: Context):
    """Whole rows, or the first row of each key."""
    df = frames[target]
    return {target: first_rows(df, p["fields"], ctx) if p.get("fields") else df.distinct()}


@action("deduplicate")
def deduplicate(frames, target, p, ctx: Context):
    df = frames[target]
    return {target: first_rows(df, p["keys"], ctx, p.get("retain", "first") == "last")}


@action("union")
def union(frames, target, p, ctx: Context):
    """byName fills absent fields with null (or refuses); positional takes fields by place where the names differ."""
    df, other = frames[target], frames[p["other"]]
    same = set(df.columns) == set(other.columns)
    if p.get("mode", "positional") == "positional" and not same and len(df.columns) == len(other.columns):
        out = df.union(other)
    else:
        if not same and p.get("missingColumnPolicy", "nullFill") == "error":
            raise ActionError("union: the datasets have different fields")
        out = df.unionByName(other, allowMissingColumns=True)
    return {target: out.distinct() if p.get("duplicatePolicy", "keep") == "distinct" else out}


def matched(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.select(*[F.col(c).alias(f"__r_{c}") for c in df.columns])
    same = F.lit(True)
    for c in df.columns:
        same = same & df[c].eqNullSafe(other[f"__r_{c}"])
    return df.join(other, same, how)


@action("intersect")
def intersect(frames, target, p, ctx: Context):
    """`all` keeps every left row that has a match."""
    df, other = frames[target], frames[p["other"]]
    return {target: matched(df, other, "left_semi") if p.get("mode") == "all" else df.intersect(other.select(*df.columns))}


@action("except")
def except_(frames, target, p, ctx: Context):
    """`all` keeps every left row that has no match."""
    df, other = frames[target], frames[p["other"]]
    return {target: matched(df, other, "left_anti") if p.get("mode") == "all" else df.subtract(other.select(*df.columns))}


@action("repartition")
def repartition(frames, target, p, ctx: Context):
    return {target: frames[target].repartition(*p["keys"])}


@action("coalesce_partitions")
def coalesce_partitions(frames, target, p, ctx: Context):
    return {target: frames[target].coalesce(int(p["count"]))}
