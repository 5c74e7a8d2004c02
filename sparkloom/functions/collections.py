"""Lists, maps, objects and functions that take lambdas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import Scope, Value, build, first_error, map_value
from ..expressions.parse import ExpressionError, parse
from .registry import columns, nodes, values

columns("list collect_list", 0, None)(lambda *v: F.array(*v))
columns("tuple", 1, None)(lambda *v: F.struct(*[x.alias(f"_{i + 1}") for i, x in enumerate(v)]))
columns("map", 0, None)(lambda *kv: F.create_map(*kv))
columns("list_contains", 2)(lambda xs, v: F.exists(xs, lambda x: x.eqNullSafe(v)))
columns("list_position", 2)(lambda xs, v: F.coalesce(F.call_function("array_position", xs, v), F.lit(0)).cast("bigint") - 1)
columns("list_concat", 1, None)(F.concat)
columns("list_sort", 1)(F.array_sort)
columns("map_keys", 1)(F.map_keys)
columns("map_values", 1)(F.map_values)
columns("map_entries", 1)(F.map_entries)
columns("map_from_entries", 1)(F.map_from_entries)


@values("object", 2, None)
def object_(scope: Scope, *kv: Value) -> Value:
    names = [scope.constant(k, "object: name") for k in kv[::2]]
    return map_value(lambda *v: F.struct(*[x.alias(n) for n, x in zip(names, v)]), *kv[1::2])


@values("size", 1)
def size(scope: Scope, v: Value) -> Value:
    text = isinstance(scope.type_of(v), T.StringType)
    return map_value(lambda x: F.when(x.isNotNull(), (F.char_length(x) if text else F.size(x)).cast("bigint")), v)


@values("field", 2)
def field(scope: Scope, v: Value, name: Value) -> Value:
    key, kind = scope.constant(name, "field: name"), scope.type_of(v)
    if isinstance(kind, T.StructType) and key not in kind.names:
        return map_value(lambda x: F.lit(None))
    return map_value(lambda x: F.try_element_at(x, F.lit(key)) if isinstance(kind, T.MapType) else x.getField(key), v)


@values("index element_at", 2)
def index(scope: Scope, v: Value, i: Value) -> Value:
    """0-based, negative from the end; null where there is no such element."""
    if isinstance(scope.type_of(v), T.MapType):
        return map_value(F.try_element_at, v, i)
    return map_value(lambda x, k: F.try_element_at(x, F.when(k < 0, k).otherwise(k + 1).cast("int")), v, i)


@columns("list_slice", 2, 3)
def list_slice(xs, start, end=None):
    first = F.greatest(start, F.lit(0))
    last = F.size(xs) if end is None else F.greatest(end, F.lit(0))
    return F.slice(xs, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))


@values("map_concat", 2, None)
def map_concat(scope: Scope, *args: Value) -> Value:
    """The last argument is the policy for keys in several maps: error, left or right."""
    *maps, policy = args
    how = policy.literal if policy.is_literal else None
    if how not in ("error", "left", "right"):
        raise ExpressionError("map_concat needs a policy: error, left or right")
    if how == "error":
        return map_value(F.map_concat, *maps)

    def two(a, b):
        keep, more = (a, b) if how == "left" else (b, a)
        return F.map_concat(keep, F.map_filter(more, lambda k, _: ~F.coalesce(F.map_contains_key(keep, k), F.lit(False))))

    out = maps[0]
    for m in maps[1:]:
        out = map_value(two, out, m)
    return out


def parts_of(scope: Scope, v: Value, what: str) -> Value:
    kind = scope.type_of(v)
    if isinstance(kind, T.StructType):
        if what == "names":
            return map_value(lambda x: F.array(*[F.lit(n) for n in kind.names]), v)
        return map_value(lambda x: F.array(*[x.getField(n) for n in kind.names]), v)
    return map_value(F.map_keys if what == "names" else F.map_values, v)


values("object_names", 1)(lambda scope, v: parts_of(scope, v, "names"))
values("object_values", 1)(lambda scope, v: parts_of(scope, v, "values"))


def applied(scope: Scope, node, types: list[T.DataType]):
    """(a Python function of columns for Spark's higher-order functions, the probe of its result, the same function for its error code or None)."""
    node = parse(node) if isinstance(node, str) else node
    if "lambda" not in node:
        raise ExpressionError("a lambda is needed here")
    names, body = list(node["lambda"]), node["body"]
    probes = [F.lit(None).cast(t) for t in types]

    def inner(cols) -> Value:
        bound = dict(scope.variables) | {n: Value(c, p) for n, c, p in zip(names, cols, probes)}
        return build(body, Scope(scope.df, bound, scope.strict, scope.errors))

    arity = len(names)
    if arity > len(types):
        raise ExpressionError("the lambda takes too many arguments")
    pick = {1: lambda of: lambda a: of(inner([a])), 2: lambda of: lambda a, b: of(inner([a, b]))}[arity]
    sample = inner(probes)
    return pick(lambda v: v.col), sample.probe, None if sample.error is None else pick(lambda v: v.error)


def first_of(errors):
    """The first code in a list of codes."""
    return F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))


def over_list(name: str, make) -> None:
    @nodes(name, 2)
    def built(scope: Scope, items, fn) -> Value:
        xs = build(items, scope)
        kind = scope.type_of(xs)
        call, probe, wrong = applied(scope, fn, [kind.elementType, T.LongType()])
        return Value(make(xs.col, call), result_probe(name, xs.probe, probe), error=first_error(xs.error, wrong and first_of(F.transform(xs.col, wrong))))


def result_probe(name: str, xs, item):
    return {"transform": F.array(item), "filter_values": xs}.get(name, F.lit(None).cast("boolean"))


over_list("transform", lambda xs, fn: F.transform(xs, fn))
over_list("filter_values", lambda xs, fn: F.filter(xs, fn))
over_list("exists", lambda xs, fn: F.coalesce(F.exists(xs, fn), F.lit(False)))
over_list("forall", lambda xs, fn: F.forall(xs, lambda x: F.coalesce(fn(x), F.lit(False))))


@nodes("reduce", 3)
def reduce(scope: Scope, items, start, fn) -> Value:
    xs, first = build(items, scope), build(start, scope)
    kind = scope.type_of(first)
    call, _, wrong = applied(scope, fn, [kind, scope.type_of(xs).elementType])
    if wrong is None:
        return Value(F.aggregate(xs.col, first.col, lambda acc, x: call(acc, x).cast(kind)), first.probe, error=first_error(xs.error, first.error))
    both = lambda v, e: F.struct(v.cast(kind).alias("v"), e.cast("string").alias("e"))
    out = F.aggregate(xs.col, both(first.col, F.lit(None)), lambda acc, x: F.when(acc["e"].isNotNull(), acc).otherwise(both(call(acc["v"], x), wrong(acc["v"], x))))
    return Value(out["v"], first.probe, error=first_error(xs.error, first.error, out["e"]))


@nodes("zip_with", 3)
def zip_with(scope: Scope, left, right, fn) -> Value:
    """As long as the shorter list."""
    a, b = build(left, scope), build(right, scope)
    call, probe, wrong = applied(scope, fn, [scope.type_of(a).elementType, scope.type_of(b).elementType])
    n = F.least(F.size(a.col), F.size(b.col))
    zipped = lambda f: F.zip_with(F.slice(a.col, F.lit(1), n), F.slice(b.col, F.lit(1), n), f)
    return Value(zipped(call), F.array(probe), error=first_error(a.error, b.error, wrong and first_of(zipped(wrong))))


def over_map(name: str, make, probe_of) -> None:
    @nodes(name, 2)
    def built(scope: Scope, of, fn) -> Value:
        m = build(of, scope)
        kind = scope.type_of(m)
        call, probe, wrong = applied(scope, fn, [kind.keyType, kind.valueType])
        codes = wrong and first_of(F.transform(F.map_entries(m.col), lambda e: wrong(*(e["key"], e["value"])[:wrong.__code__.co_argcount])))
        return Value(make(m.col, call), probe_of(m.probe, probe, kind), error=first_error(m.error, codes))


def last_wins(m, fn):
    """New keys; of entries that get the same key the last stays."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(fn(e["key"], e["value"]).alias("key"), e["value"].alias("value")))
    kept = F.aggregate(entries, F.slice(entries, 1, 0), lambda acc, e: F.concat(F.filter(acc, lambda a: a["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(kept)


over_map("map_filter", lambda m, fn: F.map_filter(m, lambda k, v: F.coalesce(fn(k, v), F.lit(False))), lambda m, p, k: m)
over_map("transform_keys", last_wins, lambda m, p, k: F.create_map(p, F.lit(None).cast(k.valueType)))
over_map("transform_values", lambda m, fn: F.transform_values(m, fn), lambda m, p, k: F.create_map(F.lit(None).cast(k.keyType), p))
