"""Window functions over one order of all rows, by ranges of the order key instead of in one task.

Two small jobs find up to BUCKETS - 1 edges of the leading order key (a sketch) and what each range holds: rows, distinct keys, sums. Equal
keys never part, so peers stay together. Windows then run inside ranges, and what comes before a range is added from the ranges' totals,
which are a handful of numbers in the plan. lag and lead look up the row at the other place by an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .aggregate import as_number

BUCKETS = 128
#: Functions of a row's place among the rows of its partition, peers alike; and from how many rows on a partition is cut into ranges for them.
RANKS, LARGE = frozenset("rank dense_rank percent_rank cume_dist".split()), 1_000_000
PLACED = frozenset("row_number rank dense_rank percent_rank cume_dist ntile lag lead".split())
#: Aggregates of all rows so far, and how what came before a range joins what its own rows give.
RUNNING = {"sum": lambda before, own: F.when(before.isNull() & own.isNull(), None).otherwise(F.coalesce(before, F.lit(0.0)) + F.coalesce(own, F.lit(0.0))), "count": lambda before, own: before + own,
           "min": F.least, "max": F.greatest}


def leading(kind: T.DataType, key: Column) -> Column | None:
    """A number that never falls where the key rises; None for types without one."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return key.cast("double") if not isinstance(kind, T.BooleanType) else key.cast("int").cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return key.cast("timestamp").cast("double")
    if isinstance(kind, T.StringType):  # the first six bytes
        return F.conv(F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return None


def is_running(frame: dict | None) -> bool:
    frame = frame or {}
    start, end = frame.get("start", frame.get("lower", "unboundedPreceding")), frame.get("end", frame.get("upper", "currentRow"))
    return (frame.get("type") or frame.get("unit") or "rows").lower() == "rows" and start in ("unboundedPreceding", "unbounded_preceding") and end in ("currentRow", "current_row")


def covered(functions: list[dict], frame: dict | None) -> bool:
    """Whether every function can be put together from ranges."""
    for f in functions:
        name = f["function"].rpartition(":")[2]
        if name not in PLACED and not (name in RUNNING and is_running(f.get("frame") or frame)):
            return False
    return True


def searched(value: Column, edges: list[float]) -> Column:
    """How many edges lie below a value, by halving."""
    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= edges[middle], among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(edges))


def of_range(values: list, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("__range"))


def over_order(df: DataFrame, keys: list[tuple[Column, bool, bool]], tie: list[Column], functions: list[dict], columns: dict[str, Column | None]) -> DataFrame | None:
    """df with the functions' columns. keys: (column, whether it falls, whether nulls come last) by importance; columns: what each function reads, by its name."""
    key, falls, last = keys[0]
    kind = df.select(key.alias("x")).schema[0].dataType
    number = leading(kind, key)
    if number is None:
        return None
    names = df.columns
    helpers = {f"__arg_{i}": columns[f["as"]] for i, f in enumerate(functions) if columns[f["as"]] is not None}
    work = df.withColumns({"__lead": number} | {f"__key_{i}": k for i, (k, *_) in enumerate(keys)} | {f"__tie_{i}": t for i, t in enumerate(tie)} | helpers)
    marks = work.agg(F.percentile_approx("__lead", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("m")).first()["m"] or []
    edges = sorted({m for m in marks if m == m})
    inside = searched(F.col("__lead"), edges)
    inside = F.lit(len(edges)) - inside if falls else inside
    work = work.withColumn("__range", F.when(F.col("__lead").isNull(), F.lit(len(edges) + 2 if last else 0)).otherwise(inside + 1))
    n_ranges = len(edges) + 3

    def sorts(i: int, down: bool, nulls_last: bool) -> Column:
        col = F.col(f"__key_{i}")
        return (col.desc_nulls_last() if nulls_last else col.desc_nulls_first()) if down else (col.asc_nulls_last() if nulls_last else col.asc_nulls_first())

    by = [sorts(i, down, nulls_last) for i, (_, down, nulls_last) in enumerate(keys)]
    peers = Window.partitionBy("__range").orderBy(*by)
    rows = Window.partitionBy("__range").orderBy(*by, *[F.col(f"__tie_{i}") for i in range(len(tie))])
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    named = [(f, f["function"].rpartition(":")[2], f"__arg_{i}") for i, f in enumerate(functions)]
    totals = [F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*[F.col(f"__key_{i}") for i in range(len(keys))])).alias("keys")]
    for i, (f, name, arg) in enumerate(named):
        if name in RUNNING:
            value = F.col(arg) if name == "count" else as_number(F.col(arg), work.schema[arg].dataType)
            totals.append(getattr(F, name)(value).alias(f"t{i}"))
    held = {r["__range"]: r for r in work.groupBy("__range").agg(*totals).collect()}

    def before(column: str, start, join):
        """What the ranges before each range add up to."""
        out, now = [], start
        for k in range(n_ranges):
            out.append(now)
            now = join(now, held[k][column]) if k in held else now
        return out

    n = sum(r["rows"] for r in held.values())
    first_row = of_range(before("rows", 0, lambda a, b: a + b), "bigint")
    place = F.row_number().over(rows).cast("bigint") + first_row
    work = work.withColumn("__place", place)
    outs, looked = {}, []
    for i, (f, name, arg) in enumerate(named):
        rank = F.rank().over(peers).cast("bigint") + first_row
        if name == "row_number":
            outs[f["as"]] = F.col("__place")
        elif name == "rank":
            outs[f["as"]] = rank
        elif name == "dense_rank":
            outs[f["as"]] = F.dense_rank().over(peers).cast("bigint") + of_range(before("keys", 0, lambda a, b: a + b), "bigint")
        elif name == "percent_rank":
            outs[f["as"]] = (rank - 1) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
        elif name == "cume_dist":
            upto = F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, 0))
            outs[f["as"]] = (upto + first_row) / F.lit(float(max(n, 1)))
        elif name == "ntile":
            outs[f["as"]] = F.call_function("div", ((F.col("__place") - 1) * int(f.get("n") or f.get("buckets"))).cast("bigint"), F.lit(max(n, 1)).cast("bigint")) + 1
        elif name in ("lag", "lead"):
            looked.append((i, f, arg, abs(int(f.get("offset", 1))) * (1 if name == "lag" else -1)))
        else:
            value = F.col(arg) if name == "count" else as_number(F.col(arg), work.schema[arg].dataType)
            kind_of = "bigint" if name == "count" else "double"
            plain = {"sum": lambda a, b: b if a is None else a if b is None else a + b, "count": lambda a, b: a + b, "min": lambda a, b: b if a is None else a if b is None else min(a, b),
                     "max": lambda a, b: b if a is None else a if b is None else max(a, b)}[name]
            earlier = of_range(before(f"t{i}", 0 if name == "count" else None, plain), kind_of)
            outs[f["as"]] = RUNNING[name](earlier, getattr(F, name)(value).over(so_far))
    out = work.select(*[F.col(f"`{c}`") for c in names], "__place", *[c for c in helpers], *[c.alias(f"__out_{k}") for k, c in enumerate(outs.values())])
    place_of = {name: f"__out_{k}" for k, name in enumerate(outs)}
    for i, f, arg, by_rows in looked:
        other = out.select((F.col("__place") + by_rows).alias("__at"), F.struct(F.col(arg).alias("v")).alias(f"__found_{i}"))
        out = out.join(other, out["__place"] == other["__at"], "left").drop("__at")
        default = F.lit(f.get("default"))
        place_of[f["as"]] = f"__out_x{i}"
        out = out.withColumn(f"__out_x{i}", F.when(F.col(f"__found_{i}").isNull(), default).otherwise(F.col(f"__found_{i}")["v"])).drop(f"__found_{i}")
    return out.select(*[F.col(f"`{c}`") for c in names], *[F.col(place_of[f["as"]]).alias(f["as"]) for f in functions])


def ranks_in_parts(df: DataFrame, part: list[str], keys: list[tuple[Column, bool, bool]], functions: list[dict]) -> DataFrame | None:
    """df with RANKS within partitions of which one at least is large: each partition by ranges of its leading key. None where there is no large one."""
    key, falls, last = keys[0]
    number = leading(df.select(key.alias("x")).schema[0].dataType, key)
    own = [F.col(f"`{c}`") for c in part]
    if number is None or (df.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0) <= LARGE:
        return None
    work = df.withColumns({"__lead": number} | {f"__key_{i}": k for i, (k, *_) in enumerate(keys)})
    marks = work.agg(F.percentile_approx("__lead", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("m")).first()["m"] or []
    edges = sorted({m for m in marks if m == m})
    inside = searched(F.col("__lead"), edges)
    inside = F.lit(len(edges)) - inside if falls else inside
    work = work.withColumn("__range", F.when(F.col("__lead").isNull(), F.lit(len(edges) + 2 if last else 0)).otherwise(inside + 1))
    # A row for each partition and range, with what comes before it.
    held = work.groupBy(*[c.alias(f"__part_{i}") for i, c in enumerate(own)], F.col("__range").alias("__held")).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_distinct(F.struct(*[F.col(f"__key_{i}") for i in range(len(keys))])).alias("__keys"))
    whole = Window.partitionBy(*[f"__part_{i}" for i in range(len(part))])
    before = whole.orderBy("__held").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("*", F.sum("__rows").over(whole).alias("__n"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__rows", "__keys")])
    same = work["__range"] == held["__held"]
    for i, c in enumerate(part):
        same = same & work[f"`{c}`"].eqNullSafe(held[f"__part_{i}"])
    work = work.join(held, same)
    by = [(c.desc_nulls_last() if low else c.desc_nulls_first()) if down else (c.asc_nulls_last() if low else c.asc_nulls_first())
          for c, down, low in ((F.col(f"__key_{i}"), down, low) for i, (_, down, low) in enumerate(keys))]
    peers = Window.partitionBy(*own, "__range").orderBy(*by)
    rank, n = F.rank().over(peers).cast("bigint") + F.col("__rows_before"), F.col("__n")
    found = {"rank": rank, "dense_rank": F.dense_rank().over(peers).cast("bigint") + F.col("__keys_before"), "percent_rank": F.when(n > 1, (rank - 1) / F.when(n > 1, n - 1)).otherwise(0.0),
             "cume_dist": (F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, 0)) + F.col("__rows_before")) / n}
    return work.select(*[F.col(f"`{c}`") for c in df.columns], *[found[f["function"].rpartition(":")[2]].alias(f["as"]) for f in functions])
