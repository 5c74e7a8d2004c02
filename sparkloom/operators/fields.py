"""Field actions and edits of nested fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import ActionError, Context, action

SIMPLE = {
    "lowercase": F.lower, "uppercase": F.upper,
    "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1))),
    "trim": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""),
    "normalize_whitespace": lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", ""),
    "hash_sha256": lambda c: F.sha2(c, 256),
}


def simple(name: str, fn) -> None:
    @action(name)
    def run(frames, target, p, ctx: Context):
        base, _, field = target.partition(".")
        df = frames[base]
        if field not in df.columns:
            raise ActionError(f"{name}: no field {field!r}")
        out = fn(df[field])
        if name in ("lowercase", "uppercase") and ctx.strict:
            out = F.when(df[field].isNull(), F.raise_error(F.lit(f"{name}: null"))).otherwise(out)
        return {base: df.withColumn(field, out)}


for _name, _fn in SIMPLE.items():
    simple(_name, _fn)


def path_of(path) -> list:
    """Names and places of a structural path; dotted text is not a path."""
    if isinstance(path, str):
        raise ActionError("a nested path is a list of segments, not dotted text")
    out = [s["name"] if s["kind"] == "field" else int(s["index"]) for s in path]
    if not out or isinstance(out[0], int):
        raise ActionError("a nested path begins with a field")
    return out


def put(col: Column | None, kind: T.DataType | None, path: list, value: Column, create: bool) -> Column:
    """col with value at path; absent objects on the way are made if create is set."""
    if not path:
        return value
    head, rest = path[0], path[1:]
    if isinstance(head, int):
        if not isinstance(kind, T.ArrayType):
            raise ActionError("an index needs a list")
        return F.transform(col, lambda x, i: F.when(i == head, put(x, kind.elementType, rest, value, create)).otherwise(x))
    if not isinstance(kind, T.StructType):
        if kind is not None and not isinstance(kind, T.NullType) or not create:
            raise ActionError(f"no object to hold {head!r}")
        return F.struct(put(None, None, rest, value, create).alias(head))
    known = head in kind.names
    if rest and not known and not create:
        raise ActionError(f"no object {head!r}")
    inner = put(col.getField(head) if known else None, kind[head].dataType if known else None, rest, value, create)
    return col.withField(f"`{head}`", inner)


def cut(col: Column, kind: T.DataType, path: list) -> Column:
    """col without what is at path; absent paths change nothing, and an object that loses its last field is null."""
    head, rest = path[0], path[1:]
    if isinstance(head, int):
        if not isinstance(kind, T.ArrayType):
            return col
        return F.transform(col, lambda x, i: F.when(i == head, cut(x, kind.elementType, rest)).otherwise(x)) if rest else F.filter(col, lambda _, i: i != head)
    if not isinstance(kind, T.StructType) or head not in kind.names:
        return col
    return col.withField(f"`{head}`", cut(col.getField(head), kind[head].dataType, rest)) if rest else col.dropFields(f"`{head}`") if len(kind.names) > 1 else F.lit(None)


def taken(col: Column, kind: T.DataType, path: list) -> Column | None:
    for head in path:
        if isinstance(head, int) and isinstance(kind, T.ArrayType):
            col, kind = F.get(col, head), kind.elementType
        elif isinstance(kind, T.StructType) and head in kind.names:
            col, kind = col.getField(head), kind[head].dataType
        else:
            return None
    return col


def put_in(df, path: list, value: Column, create: bool):
    head = path[0]
    known = head in df.columns
    return df.withColumn(head, put(df[head] if known else None, df.schema[head].dataType if known else None, path[1:], value, create))


@action("with_nested_fields")
def with_nested_fields(frames, target, p, ctx: Context):
    df = frames[target]
    for a in p["assignments"]:
        value = ctx.column(a["expr"], df) if a.get("expr") is not None else F.lit(None if isinstance(a.get("value"), (list, dict)) else a.get("value"))
        df = put_in(df, path_of(a["path"]), value, bool(p.get("createParents", a.get("createParents", False))))
    return {target: df}


@action("drop_nested_fields")
def drop_nested_fields(frames, target, p, ctx: Context):
    df = frames[target]
    for path in map(path_of, p["paths"]):
        if path[0] in df.columns:
            df = df.withColumn(path[0], cut(df[path[0]], df.schema[path[0]].dataType, path[1:])) if path[1:] else df.drop(path[0])
    return {target: df}


@action("rename_nested_fields")
def rename_nested_fields(frames, target, p, ctx: Context):
    df = frames[target]
    for m in p["mapping"]:
        old, new = path_of(m["from"]), path_of(m["to"])
        value = taken(df[old[0]], df.schema[old[0]].dataType, old[1:]) if old[0] in df.columns else None
        if value is None:
            continue
        df = df.withColumn("__taken", value)
        df = df.withColumn(old[0], cut(df[old[0]], df.schema[old[0]].dataType, old[1:])) if old[1:] else df.drop(old[0])
        df = put_in(df, new, F.col("__taken"), True).drop("__taken")
    return {target: df}
