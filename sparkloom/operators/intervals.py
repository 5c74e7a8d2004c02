"""Joins on ranges by bins of many sizes, in place of a nested loop.

A predicate such as `low <= time && time < high` bounds an expression of one side by expressions of the other. Both sides then have an
interval in each row (a point is one of length nought), and rows can only match if these meet. An interval lies in at most two bins of the
least power of two that is as long as it: its home. The longer of two meeting intervals is at home in a bin that the shorter one visits, so
each row is one or two rows at home and one or two for each longer size that the other side has; an equality join on (size, bin) finds
all pairs, and of several bins that a pair shares, the one with the first common point counts. The predicate itself decides in the end,
so rounding in the bins costs nothing but candidates.

Rows of a bin are joined by blocks: arrays of neighbouring rows, unfolded after the join. Blocks that do not meet are never unfolded, and pairs
come as runs of one row against the same short list of others, made as they are read. Files encode such runs and repeats in a small part of
the bytes that the same pairs take in any order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expressions.build import Scope, build

#: Comparisons and what they say of their first argument.
LESS, MORE = frozenset(("lt", "lte")), frozenset(("gt", "gte"))
FARTHEST = float(1 << 62)
#: Candidates of one bin that one slice takes; bins with more are cut into slices.
CANDIDATES = 5_000_000
#: Bins that both sides have; if they are no more, rows of other bins are left out before the shuffle.
BINS = 50_000
#: What rows that meet have in common.
SHARED = ("__level", "__bin", "__slice")
#: Rows of a block on the side with more rows and on the other, whose list is repeated.
OUTER, INNER = 1024, 128
#: Bytes of strings and nested values after which a block ends, so that long rows make no long arrays.
BLOCK_BYTES = 1 << 20
#: Rows of both sides that one partition takes, so that its values fit the dictionaries of a file.
PARTITION_ROWS = 50_000
BINNED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def conjuncts(node: Mapping) -> list[Mapping]:
    if isinstance(node, Mapping) and node.get("call", "").rpartition(":")[2] == "and":
        return [x for a in node["args"] for x in conjuncts(a)]
    if isinstance(node, Mapping) and node.get("call", "").rpartition(":")[2] == "between":
        value, low, high = node["args"]
        return [{"call": "gte", "args": [value, low]}, {"call": "lte", "args": [value, high]}]
    return [node]


def fields_of(node) -> set[str]:
    if isinstance(node, Mapping):
        own = {node["field"].rpartition(".")[2]} if "field" in node else set()
        return own.union(*[fields_of(v) for v in node.values()])
    return set().union(*[fields_of(v) for v in node]) if isinstance(node, list) else set()


def bounds(node: Mapping, side_of: Mapping[str, str]) -> dict[str, list]:
    """upper: (left, right) where the predicate says left <= right; lower: where it says left >= right; equal: whether it equates the sides."""
    found: dict[str, list] = {"upper": [], "lower": [], "equal": []}
    for c in conjuncts(node):
        name = c.get("call", "").rpartition(":")[2] if isinstance(c, Mapping) else ""
        if name not in {*LESS, *MORE, "eq", "null_safe_eq"}:
            continue
        a, b = c["args"]
        sides = [{side_of.get(f) for f in fields_of(x)} for x in (a, b)]
        if sides == [{"l"}, {"r"}]:
            left, right, less = a, b, name in LESS
        elif sides == [{"r"}, {"l"}]:
            left, right, less = b, a, name in MORE
        else:
            continue
        found["equal" if name not in LESS | MORE else "upper" if less else "lower"].append((left, right))
    return found


def span(df: DataFrame, one, other, strict: bool) -> tuple[Column, Column, Column] | None:
    """Whether both of two expressions of a frame are there, and the interval between them, as doubles in a bounded range; None if they have no order of numbers or moments."""
    scope, there, ends = Scope(df, strict=strict), [], []
    for node in (one, other):
        value = build(node, scope)
        kind = scope.type_of(value)
        if not isinstance(kind, BINNED):
            return None
        there.append(value.col.isNotNull())
        if isinstance(kind, T.NumericType):
            number = value.col.cast("double")
            number = F.nanvl(number, F.lit(FARTHEST)) if isinstance(kind, T.FractionalType) else number  # NaN stands above all numbers
            ends.append(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), number)))
        else:
            ends.append(value.col.cast("timestamp").cast("double"))
    return there[0] & there[1], F.least(*ends), F.greatest(*ends)


def level(length: Column, least: int) -> Column:
    return F.when(length <= 2.0**least, F.lit(least)).otherwise(F.ceil(F.log2(length)).cast("int"))


def binned(df: DataFrame, levels: Column) -> DataFrame:
    """A row for each bin of each of the given sizes that a row's interval meets."""
    df = df.withColumn("__level", F.explode(levels))
    size = F.pow(F.lit(2.0), F.col("__level").cast("double"))
    first, last = F.floor(F.col("__low") / size), F.floor(F.col("__high") / size)
    return df.withColumn("__bin", F.explode(F.sequence(first, last)))


def sliced(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without rows of bins that the other side lacks, if the shared bins are few, and with a column __slice if there are bins with many candidates:
    there the side with more rows is dealt out and the other goes to every slice."""
    n, m = (df.groupBy("__level", "__bin").agg(F.count(F.lit(1)).cast("double").alias(c)) for df, c in ((left, "__n"), (right, "__m")))
    load = n.join(m, ["__level", "__bin"]).withColumn("__load", F.col("__n") * F.col("__m"))
    # Copies of the smaller side stay about as many as the rows of the larger one.
    slices = F.when(F.col("__load") <= CANDIDATES, 1).otherwise(F.least(F.ceil(F.col("__load") / CANDIDATES), F.ceil(F.greatest("__n", "__m") / F.least("__n", "__m")) + 3)).cast("int")
    load = load.select("__level", "__bin", slices.alias("__slices"), (F.col("__n") >= F.col("__m")).alias("__by_left"))
    shared = load.orderBy(F.desc("__slices")).limit(BINS + 1).collect()
    few, full = len(shared) <= BINS, bool(shared) and shared[0]["__slices"] > 1
    if not few:
        shared = load.filter("__slices > 1").collect() if shared[-1]["__slices"] > 1 else [r for r in shared if r["__slices"] > 1]
    bins = F.broadcast(left.sparkSession.createDataFrame(shared, "__level int, __bin bigint, __slices int, __by_left boolean"))
    if not full:
        return (left.join(bins, ["__level", "__bin"], "left_semi"), right.join(bins, ["__level", "__bin"], "left_semi")) if few else (left, right)

    def dealt(df: DataFrame, is_left: bool) -> DataFrame:
        own = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        df = df.withColumn("__hash", F.xxhash64(*own)).join(bins, ["__level", "__bin"], "inner" if few else "left")
        one, every = F.array(F.pmod("__hash", F.col("__slices")).cast("int")), F.sequence(F.lit(0), F.col("__slices") - 1)
        slices = F.when(F.col("__slices").isNull(), F.array(F.lit(0))).when(F.col("__by_left") == is_left, one).otherwise(every)
        return df.withColumn("__slice", F.explode(slices)).drop("__hash", "__slices", "__by_left")

    return dealt(left, True), dealt(right, False)


def sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind)
    return sortable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def blocks(df: DataFrame, columns: list[str], size: int, partitions: int) -> DataFrame:
    """Arrays of at most so many rows that are neighbours in a bin's slice, with the interval that they lie in."""
    keys = [k for k in SHARED if k in df.columns]
    order = Window.partitionBy(*keys).orderBy("__low", "__high")
    df = df.repartition(partitions, *keys).withColumn("__place", F.row_number().over(order))
    block = [F.floor((F.col("__place") - 1) / size).alias("__block")]
    long = [c for c in columns if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    if long:
        taken = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in long), F.lit(0))
        df = df.withColumn("__taken", F.sum(taken).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        block.append(F.floor(F.col("__taken") / BLOCK_BYTES).alias("__part"))
    rows = F.collect_list(F.struct("__place", "__low", "__high", *[F.col(f"`{c}`") for c in columns]))
    rows = F.sort_array(rows) if all(sortable(df.schema[c].dataType) for c in columns) else rows
    return df.groupBy(*keys, *block).agg(F.min("__low").alias("__from"), F.max("__high").alias("__to"), rows.alias("__rows"))


def unfolded(outer: DataFrame, inner: DataFrame, names: str) -> DataFrame:
    """Pairs of the rows of blocks that meet, as two structs.

    The outer block gives its rows near the other block one at a time: Spark keeps no generated code for a generator over a lambda, so each row
    moves on before the next one comes. Only then come the pairs, one short list at a time. In one piece, generated code would hold
    all pairs of a block with all blocks that it meets before the first pair moves on.
    """
    keys = [k for k in SHARED if k in outer.columns]
    inner = inner.select(*keys, F.col("__from").alias("__since"), F.col("__to").alias("__until"), F.col("__rows").alias("__list"))
    joined = outer.join(inner, keys).filter((F.col("__from") <= F.col("__until")) & (F.col("__since") <= F.col("__to")))
    near = F.filter("__rows", lambda row: (row["__low"] <= F.col("__until")) & (F.col("__since") <= row["__high"]))
    joined = joined.select("__level", "__bin", "__list", F.explode(near).alias(names[0]))
    return joined.select("__level", "__bin", names[0], F.explode("__list").alias(names[1]))


def range_join(left: DataFrame, right: DataFrame, predicate: Mapping, side_of: Mapping[str, str], condition, strict: bool) -> DataFrame | None:
    """Pairs of left (alias l) and right (alias r) that satisfy the predicate, or None if it bounds nothing on both sides or equates something."""
    found = bounds(predicate, side_of)
    if found["equal"] or not found["upper"] or not found["lower"]:
        return None
    (a, b), (c, d) = pair_of(found)
    pointed = a == c or b == d
    spans = span(left, a, c, strict), span(right, d, b, strict)
    if None in spans:
        return None
    sides = [df.filter(there).withColumns({"__low": low, "__high": high}) for df, (there, low, high) in zip((left, right), spans)]
    # Two rows of bounds: the sizes of intervals, where they lie and how far from nought.
    extents = [df.agg(F.min("__low").alias("from"), F.max("__high").alias("to"), F.max(F.greatest(F.abs("__low"), F.abs("__high"))).alias("far"), F.max(F.col("__high") - F.col("__low")).alias("longest"),
                      F.min(F.when(F.col("__high") > F.col("__low"), F.col("__high") - F.col("__low"))).alias("shortest")).first() for df in sides]
    far = max([e["far"] or 0.0 for e in extents])
    shortest, longest = [e["shortest"] for e in extents if e["shortest"]], [e["longest"] for e in extents if e["longest"]]
    if not longest:  # two points meet where they are equal
        least = most = max(-60, math.ceil(math.log2(max(far, 1.0))) - 40)
    else:
        least = max(math.ceil(math.log2(min(shortest))), math.ceil(math.log2(max(far, 1e-300))) - 50, -1000)
        most = max(least, math.ceil(math.log2(max(longest))))
    sides = [df.withColumn("__home", F.least(F.lit(most), level(F.col("__high") - F.col("__low"), least))) for df in sides]
    sides = [df.filter((F.col("__low") <= F.lit(e["to"])) & (F.col("__high") >= F.lit(e["from"]))) for df, e in zip(sides, reversed(extents))]
    counts = [{r["__home"]: r["count"] for r in df.groupBy("__home").count().collect()} for df in sides]
    present, rows = [sorted(c) for c in counts], [sum(c.values()) for c in counts]

    def guests(df: DataFrame, levels: list[int], strictly: bool) -> DataFrame:
        every = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
        return binned(df, F.filter(every, lambda k: k > F.col("__home") if strictly else k >= F.col("__home")))

    at_home = [binned(df, F.array("__home")) for df in sides]
    pairs = [(at_home[0], guests(sides[1], present[0], False))]
    if present[0] and present[1] and present[1][-1] > present[0][0]:
        pairs.append((guests(sides[0], present[1], True), at_home[1]))
    partitions = max(1, math.ceil((rows[0] * max(1, len(present[1])) + rows[1] * max(1, len(present[0]))) / PARTITION_ROWS))
    by_left = rows[0] > rows[1]
    sizes, columns = (OUTER, INNER) if by_left else (INNER, OUTER), (left.columns, right.columns)
    once = F.floor(F.greatest(F.col("l.__low"), F.col("r.__low")) / F.pow(F.lit(2.0), F.col("__level").cast("double"))) == F.col("__bin")
    test = condition if pointed else once & condition  # a point has one bin of a size, so its pairs are found once
    out = None
    for pair in pairs:
        l, r = (blocks(df, names, size, partitions) for df, names, size in zip(sliced(*pair), columns, sizes))  # noqa: E741
        outer, inner = (l, r) if by_left else (r, l)
        joined = unfolded(outer, inner, "lr" if by_left else "rl").filter(test)
        joined = joined.select(*[F.col(f"l.`{c}`").alias(f"__l_{i}") for i, c in enumerate(left.columns)], *[F.col(f"r.`{c}`").alias(f"__r_{i}") for i, c in enumerate(right.columns)])
        out = joined if out is None else out.unionByName(joined)
    return out


def pair_of(found: Mapping[str, list]) -> tuple:
    """An upper and a lower bound, if possible of one expression, so that one side is a point."""
    for up in found["upper"]:
        for low in found["lower"]:
            if up[0] == low[0] or up[1] == low[1]:
                return up, low
    return found["upper"][0], found["lower"][0]
