"""Error modes of actions: invalid values kept beside their rows, and rows routed to a quarantine.

Route: a frame carries a column __error (action, field, code, and the row as JSON as it came to the action), null for good rows. Actions that work
row by row add to it and let bad rows pass untouched, so a chain of them stays one pass over the input; `write_split`
writes both outcomes in that pass. Any other action first settles its frames: good rows go on, bad rows join the frame
__quarantine. Values that fail are null in bad rows, since nothing is evaluated that could raise, so Spark may move filters as it
likes.

Invalid: a column __invalid maps the names of a row's invalid fields to their codes. It follows fields through with_fields,
project, rename_fields, drop_fields and whatever keeps whole rows; grouping and reshaping end it, and a join keeps the left side's.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions import value_of
from ..expressions.build import INVALID
from .registry import ACTIONS, QUARANTINE, Context, Frames, item_column

ERROR = "__error"
ERROR_TYPE = "struct<action: string, field: string, code: string, row: string>"
#: Actions that let bad rows pass; all others see good rows only.
CARRYING = frozenset("project filter select with_fields rename_fields drop_fields partition".split())
#: Actions whose result still has the rows' own fields.
KEEPING = frozenset("filter select sort limit distinct deduplicate repartition coalesce_partitions sample random_split window partition".split())


def failure(name: str, field: str, error: Column, df: DataFrame) -> Column:
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != ERROR]))
    return F.when(error.isNotNull(), F.struct(F.lit(name).alias("action"), F.lit(field).alias("field"), error.alias("code"), row.alias("row"))).cast(ERROR_TYPE)


def with_failures(df: DataFrame, name: str, found: list[tuple[str, Column]]) -> DataFrame:
    """df with its rows' first failure; earlier ones stay."""
    if not found:
        return df
    own = [failure(name, field, error, df) for field, error in found]
    return df.withColumn(ERROR, F.coalesce(*([F.col(ERROR)] if ERROR in df.columns else []), *own, barrier(ERROR_TYPE)))


def barrier(kind: str) -> Column:
    """A null that the optimiser takes for one that changes, so that later filters are not rewritten in terms of whole chains of checks.
    It folds `rand() < 0` and a choice among nulls alone."""
    value = F.struct(*[F.lit("").alias(f) for f in ("action", "field", "code", "row")]) if kind.startswith("struct") else F.lit("")
    return F.when(F.spark_partition_id() < 0, value).cast(kind)


def settle(frames: Frames, name: str) -> Frames:
    """Move the bad rows of a frame to the quarantine."""
    df = frames[name]
    if ERROR not in df.columns:
        return frames
    bad = df.filter(F.col(ERROR).isNotNull()).select(F.lit(name).alias("frame"), f"{ERROR}.*")
    return {**frames, name: df.filter(F.col(ERROR).isNull()).drop(ERROR), QUARANTINE: frames[QUARANTINE].unionByName(bad) if QUARANTINE in frames else bad}


def settled(frames: Frames) -> Frames:
    for name in [n for n in frames if n != QUARANTINE]:
        frames = settle(frames, name)
    if QUARANTINE not in frames and frames:
        spark = next(iter(frames.values())).sparkSession
        frames = {**frames, QUARANTINE: spark.createDataFrame([], "frame string, action string, field string, code string, row string")}
    return frames


def write_split(df: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) of a frame that carries errors, written by one job that computes each row once."""
    path = f"{folder.rstrip('/')}/split-{uuid.uuid4().hex}"
    if ERROR not in df.columns:
        df = df.withColumn(ERROR, F.lit(None).cast(ERROR_TYPE))
    df.withColumn("__good", F.col(ERROR).isNull()).write.partitionBy("__good").parquet(path)
    both = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("__good", T.BooleanType())])).parquet(path)
    return both.filter("__good").drop("__good", ERROR), both.filter("not __good").select(f"{ERROR}.*")


def expressions(parameters) -> list[tuple[str, object]]:
    """(field, expression) of every expression among an action's parameters, but for a join's, which sees two frames."""
    if isinstance(parameters, Mapping):
        own = [(str(parameters.get("as") or k), v) for k, v in parameters.items() if k in ("expr", "predicate", "filter") and isinstance(v, (str, Mapping))]
        return own + [x for k, v in parameters.items() if k not in ("expr", "predicate", "filter", "on") for x in expressions(v)]
    return [x for v in parameters for x in expressions(v)] if isinstance(parameters, list) else []


def tolerant(name: str, target: str, p: dict, frames: Frames, ctx: Context) -> Frames:
    base = target.partition(".")[0]
    if name in OWN:
        return {**frames, base: OWN[name](frames[base], name, p, ctx)}
    if ctx.mode == "invalid":
        out = ACTIONS[name](unmarked(frames, base, p) if name not in KEEPING else frames, target, p, ctx)
        return {**frames, **out}
    if name not in CARRYING:
        df = frames[base]
        if name != "join" and name != "explode":
            values = [(field, value_of(e, df, ctx.strict).error) for field, e in expressions(p)]
            passes = value_of(p["filter"], df, ctx.strict).col if p.get("filter") is not None else None
            found = [(f, e if passes is None or f == "filter" else F.when(passes, e)) for f, e in values if e is not None]
            frames = {**frames, base: with_failures(df, name, found)}
        for other in {base, *[x for x in [p.get("right"), p.get("other"), *(p.get("others") or []), *(p.get("inputs") or [])] if isinstance(x, str)]} & set(frames):
            frames = settle(frames, other)
    return {**frames, **ACTIONS[name](frames, target, p, ctx)}


def unmarked(frames: Frames, base: str, p: dict) -> Frames:
    """Frames as an action sees them that does not keep rows' fields; a join keeps the left side's marks."""
    right = p.get("right")
    drop = [right] if right is not None else [base]
    return {n: df.drop(INVALID) if n in drop and INVALID in df.columns else df for n, df in frames.items()}


def marks(df: DataFrame) -> Column:
    return F.col(INVALID) if INVALID in df.columns else F.create_map().cast("map<string,string>")


def from_pairs(pairs: list[tuple[str, Column]]) -> Column:
    """A map of the names whose code is not null."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def code_of(value) -> Column | None:
    known = [c for c in (value.error, value.state) if c is not None]
    return F.coalesce(*known) if known else None


def with_fields(df: DataFrame, name: str, p: dict, ctx: Context) -> DataFrame:
    for a in p["assignments"]:
        value = value_of(a["expr"], df, ctx.strict)
        if ctx.mode == "route":
            df = with_failures(df, name, [(a["as"], value.error)] if value.error is not None else []).withColumn(a["as"], value.col)
            continue
        code, col = code_of(value), value.col
        if code is not None or INVALID in df.columns:
            rest = F.map_filter(marks(df), lambda k, _: k != a["as"])  # noqa: B023
            added = rest if code is None else F.map_concat(rest, from_pairs([(a["as"], F.coalesce(code, barrier("string")))]))
            df = df.withColumns({a["as"]: col, INVALID: added})
        else:
            df = df.withColumn(a["as"], col)
    return df


def project(df: DataFrame, name: str, p: dict, ctx: Context) -> DataFrame:
    out, pairs, found = [], [], []
    for item in p["fields"]:
        if isinstance(item, str) or "field" in item:
            field = item if isinstance(item, str) else item["field"]
            if isinstance(item, str) and field not in df.columns:
                continue
            label, col = item_column(item, df, ctx)
            if INVALID in df.columns:
                pairs.append((label, F.try_element_at(F.col(INVALID), F.lit(field))))
        else:
            label, value = item.get("as") or str(item["expr"]), value_of(item["expr"], df, ctx.strict)
            col, code = value.col, value.error if ctx.mode == "route" else code_of(value)
            if code is not None:
                pairs.append((label, code))
                found.append((label, code))
        out.append(col.alias(label))
    if ctx.mode == "route":
        df = with_failures(df, name, found)
        return df.select(*out, *([ERROR] if ERROR in df.columns else []))
    return df.select(*out, *([from_pairs(pairs).alias(INVALID)] if pairs else []))


def filtered(df: DataFrame, name: str, p: dict, ctx: Context) -> DataFrame:
    if "predicate" not in p:
        field = df[p["field"]]
        keeps = field.eqNullSafe(F.lit(p["equals"])) if "equals" in p else field.isNotNull()
    else:
        value = value_of(p["predicate"], df, ctx.strict)
        keeps = value.col
        if ctx.mode == "route":
            df = with_failures(df, name, [("predicate", value.error)] if value.error is not None else [])
    return df.filter(F.coalesce(keeps, F.lit(False)) | F.col(ERROR).isNotNull() if ERROR in df.columns else keeps)


def renamed(df: DataFrame, name: str, p: dict, ctx: Context) -> DataFrame:
    out = ACTIONS[name]({"x": df}, "x", p, ctx)["x"]
    if INVALID not in df.columns or INVALID not in out.columns:
        return out
    code = lambda c: F.try_element_at(F.col(INVALID), F.lit(c))
    if name == "drop_fields":
        return out.withColumn(INVALID, F.map_filter(F.col(INVALID), lambda k, _: ~k.isin(*p["fields"])))
    held = {c: c for c in df.columns if c != INVALID}
    for old, new in p["mapping"].items():
        if old in held and old != new:
            source = held.pop(old)
            held.pop(new, None)
            held[new] = source
    return out.withColumn(INVALID, from_pairs([(new, code(old)) for new, old in held.items()]))


OWN = {"with_fields": with_fields, "project": project, "filter": filtered, "select": filtered, "rename_fields": renamed, "drop_fields": renamed}
