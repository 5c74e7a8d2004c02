"""JSON rows to typed columns with states, by Spark's variants.

A row's text is parsed once into a variant; each declared field is then taken out by its logical type. Objects with a `$` key are tokens:
{"$missing": true}, {"$invalid": "reason"}, {"$date": "2024-01-31"}, {"$datetime": "2024-01-31T10:00:00"}, and markers such as
{"$marker": "missing"} or {"$marker": "invalid", "reason": "..."}, whatever the marker's name. A field that a row lacks is missing, JSON
null is null. Missing fields are listed in the column __missing, which is_missing reads, and invalid ones in __invalid with their reasons.

What does not fit its type, and rows that are no JSON object or name a key twice, follow the error mode: fail raises, null gives null, invalid marks
the field (all fields of a corrupt row), route sends the row to the quarantine.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import INVALID, MISSING
from . import logical_type

TOKENS = ("$missing", "$invalid", "$date", "$datetime")
CORRUPT = "corrupt_row"


def ddl(kind: T.DataType) -> str:
    return kind.simpleString()


def typed(x: Column, kind: Column, inner: Column, name, wanted: T.DataType) -> Column:
    """The value of a variant by its logical type, null where it does not fit. inner: the text in a date's or moment's wrapper."""
    text = F.coalesce(inner, F.when(kind == "STRING", F.try_variant_get(x, "$", "string")))
    if name == "boolean":
        return F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
    if name == "integer":
        return F.when(kind == "BIGINT", F.try_variant_get(x, "$", "bigint"))
    if name == "decimal":
        return F.when(F.rlike(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.try_variant_get(x, "$", "double"))
    if name == "date":
        return F.try_to_timestamp(F.when(F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\d$")), text), F.lit("yyyy-MM-dd")).cast("date")
    if name == "datetime":
        return F.try_to_timestamp(F.when(F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\d[T ]")), text))
    if name == "binary":
        return F.try_to_binary(F.when(kind == "STRING", text), F.lit("base64"))
    if isinstance(wanted, T.StringType):
        return F.when(kind == "STRING", text)
    return F.when(fits(x, wanted), F.try_variant_get(x, "$", ddl(wanted)))


#: Logical names of the types of elements.
NAMES = {T.BooleanType: "boolean", T.LongType: "integer", T.DoubleType: "decimal", T.DateType: "date", T.TimestampType: "datetime", T.BinaryType: "binary", T.StringType: "string"}


def fits(x: Column, wanted: T.DataType) -> Column:
    """Whether a variant and all that it holds have the declared types; JSON null fits every type inside a list, map or object."""
    inner = lambda e, kind: F.is_variant_null(e) | fits(e, kind)
    if isinstance(wanted, T.ArrayType):
        return F.coalesce(F.forall(F.try_variant_get(x, "$", "array<variant>"), lambda e: inner(e, wanted.elementType)), F.lit(False))
    if isinstance(wanted, T.MapType):
        return F.coalesce(F.forall(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), lambda e: inner(e, wanted.valueType)), F.lit(False))
    if isinstance(wanted, T.StructType):
        whole = F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False))
        for f in wanted.fields:
            whole = whole & (member(x, f.name).isNull() | inner(member(x, f.name), f.dataType))
        return whole
    return typed(x, F.schema_of_variant(x), F.lit(None).cast("string"), NAMES[type(wanted)], wanted).isNotNull()


def member(whole: Column, name: str) -> Column:
    """The variant of a field; names that a path cannot quote are looked up in the whole object."""
    if '"' in name or "\\" in name:
        return F.try_element_at(F.try_variant_get(whole, "$", "map<string,variant>"), F.lit(name))
    return F.try_variant_get(whole, f'$["{name}"]', "variant")


def decoded(df: DataFrame, text: str, fields: list[Mapping], mode: str = "fail", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` of df, the declared fields of the JSON rows in column `text`, and the columns of states (in mode route, __error instead of invalid marks for what does not fit)."""
    from ..operators.errors import ERROR, barrier, failure

    work = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).withColumn("__v", F.try_parse_json("__text"))
    work = work.withColumn("__whole", F.coalesce(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), F.lit(False)))
    work = work.withColumns({f"__x{i}": member(F.when(F.col("__whole"), F.col("__v")), f["name"]) for i, f in enumerate(fields)})
    staged = {}
    for i in range(len(fields)):
        x = F.col(f"__x{i}")
        staged[f"__kind{i}"] = F.schema_of_variant(x)
        staged[f"__map{i}"] = F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT<`$")), F.try_variant_get(x, "$", "map<string,variant>"))
    work = work.withColumns(staged)
    tokens = {}
    for i in range(len(fields)):
        held = F.col(f"__map{i}")
        name = F.get(F.filter(F.map_keys(held), lambda k: F.startswith(k, F.lit("$"))), F.lit(0))
        said = F.try_variant_get(F.try_element_at(held, name), "$", "string")
        marker = ~name.isin(*TOKENS)
        tokens[f"__token{i}"] = F.when(name == "$missing", "missing").when(name == "$invalid", "invalid").when(name == "$date", "date").when(name == "$datetime", "datetime").when(
            marker & said.isin("missing", "invalid"), said).when(name.isNotNull(), "unknown")
        reason = F.try_variant_get(F.try_element_at(held, F.lit("reason")), "$", "string")
        tokens[f"__said{i}"] = F.when(marker, F.coalesce(reason, F.lit("invalid"))).otherwise(said)
    work = work.withColumns(tokens)
    values, wrong, missing, invalid = {}, {}, [], []
    for i, f in enumerate(fields):
        x, kind, token = F.col(f"__x{i}"), F.col(f"__kind{i}"), F.col(f"__token{i}")
        inner = F.when(token == f["type"], F.col(f"__said{i}")) if f["type"] in ("date", "datetime") else F.lit(None).cast("string")
        plain = token.isNull() | (token == f["type"]) if f["type"] in ("date", "datetime") else token.isNull()
        value = F.when(plain & ~F.is_variant_null(x), typed(x, kind, inner, f["type"], logical_type(f["type"])))
        values[f"__value{i}"] = value
        is_missing = (x.isNull() & F.col("__whole")) | F.coalesce(token == "missing", F.lit(False))
        is_invalid = F.coalesce(token == "invalid", F.lit(False))
        null = F.coalesce(F.is_variant_null(x), F.lit(False))
        wrong[f"__wrong{i}"] = F.when(~F.col("__whole"), CORRUPT).when(token == "unknown", "unknown_token").when(~is_missing & ~is_invalid & ~null & F.col(f"__value{i}").isNull(), "wrong_type")
        missing.append(F.when(is_missing, F.lit(f["name"])))
        invalid.append((f["name"], F.when(is_invalid, F.coalesce(F.col(f"__said{i}"), F.lit("invalid")))))
    work = work.withColumns(values).withColumns(wrong)
    codes = [F.col(f"__wrong{i}") for i in range(len(fields))]
    out = []
    for i, f in enumerate(fields):
        value = F.col(f"__value{i}")
        if mode == "fail":
            kind = work.schema[f"__value{i}"].dataType
            value = F.when(codes[i].isNotNull(), F.raise_error(F.concat(F.lit(f"field {f['name']}: "), codes[i])).cast(kind)).otherwise(value)
        out.append(value.alias(f["name"]))
    marks = [(n, F.coalesce(c, codes[i]) if mode == "invalid" else c) for i, (n, c) in enumerate(invalid)]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in marks])
    out += [F.filter(F.array(*missing), lambda m: m.isNotNull()).alias(MISSING), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias(INVALID)]
    if mode == "route":
        own = [failure("decode", f["name"], codes[i], work.select(F.col("__text").alias("text"))) for i, f in enumerate(fields)]
        work = work.withColumn("text", F.col("__text")).withColumn(ERROR, F.coalesce(*own, barrier("struct<action: string, field: string, code: string, row: string>")))
        out.append(F.col(ERROR))
    return work.select(*[F.col(f"`{c}`") for c in keep], *out)
