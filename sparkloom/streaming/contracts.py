"""Contracts with unbounded inputs as streaming queries.

An input is unbounded if it says `streaming: {mode: unbounded}`; its extension key `watermark: {field, delay}` sets how late its rows may be. Each
output is one query with its own checkpoint. A micro-batch writes its rows, the counts of its rules and the rows it took out below its own
number, in place of what an earlier try may have left, so after a restart each row and each violation counts once.

Beside row-wise actions, streams take joins with bounded frames, inner joins of two streams by a key and a predicate that bounds the time of each by that of
the other (so state can be dropped), `deduplicate` that retains the first (the first to arrive; of rows in one batch the least by `orderBy`, else by all
fields), and `aggregate` with a `window` over the watermarked field. All else needs all rows and is refused before a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..expressions import parse
from ..operators import ActionError, Context, apply
from ..operators.errors import ERROR
from ..operators.intervals import bounds
from ..plans.contract import ContractError, materialized, validate
from ..plans.graph import graph_of, plain, sources_of, written
from ..plans.rules import Outcome, counts_of, outcomes_of
from ..sources import schema_of
from . import ALLOWED, window_of


def is_unbounded(interface: Mapping) -> bool:
    return (interface.get("streaming") or {}).get("mode") == "unbounded"


def source(spark: SparkSession, interface: Mapping, spec: Mapping) -> DataFrame:
    """A stream of files with the declared schema."""
    schema = schema_of(interface)
    if schema is None:
        raise ContractError([f"input {interface['id']}: an unbounded input needs a schema"])
    return spark.readStream.format(spec.get("format", "parquet")).schema(schema).options(**spec.get("options", {})).load(spec["path"])


def bounded_in_time(left: DataFrame, right: DataFrame, p: Mapping, times: Mapping[str, str]) -> bool:
    """Whether a predicate bounds each stream's watermarked field by the other's, from both sides."""
    on = p.get("on") or p.get("predicate")
    if on is None:
        return False
    side = {c: "l" for c in left.columns} | {c: "r" for c in right.columns if c not in left.columns}
    found = bounds(parse(on) if isinstance(on, str) else on, side)
    within = lambda pairs: any(times["l"] in str(a) and times["r"] in str(b) for a, b in pairs)
    return within(found["upper"]) and within(found["lower"])


def first_row(part, by: list[str]):
    """The least row by some columns, nulls last; a column is read only where those before it leave several rows."""
    for c in by:
        if len(part) == 1:
            break
        held = part[c].dropna()
        if len(held):
            part = part[(part[c] == held.min()).to_numpy()]
    return part.head(1)


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key to arrive. A key's state is one flag, kept for good."""
    names = df.columns
    by = [*order, *[c for c in names if c not in order]]

    def run(key, parts: Iterator, state) -> Iterator:
        import pandas as pd

        known, least = state.exists, None
        for part in parts:
            if not known and len(part):
                some = first_row(part, by)
                least = some if least is None else first_row(pd.concat([least, some]), by)
        if not known and least is not None:
            state.update((True,))
            yield least

    return df.groupBy(*keys).applyInPandasWithState(run, df.schema, T.StructType([T.StructField("seen", T.BooleanType())]), "append", "NoTimeout")


def step(action: Mapping, frames: dict[str, DataFrame], times: dict[str, tuple[str, str]], ctx: Context) -> dict[str, DataFrame]:
    name, target, p = plain(action), action["target"].partition(".")[0], action.get("parameters") or {}
    df = frames[target]
    if not df.isStreaming:
        return apply(action["action"], action["target"], p, frames, ctx)
    if name == "deduplicate" and p.get("retain", "first") == "first":
        return {**frames, target: first_of_key(df, p["keys"], [k["field"] if isinstance(k, Mapping) else k for k in p.get("orderBy", [])])}
    if name in ("aggregate", "group") and p.get("window"):
        if target not in times:
            raise ActionError(f"{action['id']}: windows over the unbounded {target!r} need its watermark")
        inner = df.withColumn("__window", window_of({"field": times[target][0], **p["window"]}))
        ends = [{"as": "window_start", "expr": 'field(__window, "start")'}, {"as": "window_end", "expr": 'field(__window, "end")'}]
        grouped = apply("aggregate", target, {**p, "groupBy": ["__window", *p.get("groupBy", [])]}, {target: inner}, ctx)
        return {**frames, **apply("drop_fields", target, {"fields": ["__window"]}, apply("with_fields", target, {"assignments": ends}, grouped, ctx), ctx)}
    if name == "join" and frames[p["right"]].isStreaming:
        if p.get("type", "inner") != "inner" or not p.get("leftKey") or target not in times or p["right"] not in times or not bounded_in_time(df, frames[p["right"]], p, {"l": times[target][0], "r": times[p["right"]][0]}):
            raise ActionError(f"{action['id']}: two streams join by an inner join on a key that bounds their watermarked fields by each other")
        return apply(action["action"], action["target"], p, frames, ctx)
    if name == "join" and p.get("type", "inner") not in ("inner", "left", "semi", "left_semi"):
        raise ActionError(f"{action['id']}: a stream on the left joins a bounded frame by inner, left or semi joins")
    if name not in ALLOWED or name in ("distinct", "deduplicate"):
        raise ActionError(f"{action['id']}: {name} is not defined on an unbounded input")
    return apply(action["action"], action["target"], p, frames, ctx)


@dataclass(frozen=True)
class Streams:
    """The queries of a contract's outputs and where they write."""

    spark: SparkSession
    folder: str
    contract: Mapping
    queries: dict[str, StreamingQuery]

    def done(self) -> None:
        for q in self.queries.values():
            q.awaitTermination()

    def output(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}").drop("__batch")

    def quarantine(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}-quarantine").drop("__batch")

    def outcomes(self, name: str) -> list[Outcome]:
        """What became of an output's rules so far, over all batches."""
        rules = rules_of(self.contract, name)
        if not rules:
            return []
        counts = self.spark.read.parquet(f"{self.folder}/{name}-rules").drop("__batch")
        return outcomes_of(name, rules, counts.agg(*[F.sum(c).alias(c) for c in counts.columns]).first())


def rules_of(contract: Mapping, frame: str) -> list[Mapping]:
    return [r for r in contract.get("rules", []) if r["target"].partition(".")[0] == frame]


def writer(contract: Mapping, name: str, folder: str):
    """Write a batch, what it took out, and its counts below the batch's number."""
    rules = rules_of(contract, name)

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        put = lambda df, to: df.write.mode("overwrite").parquet(f"{folder}/{to}/__batch={number}")
        good = batch.filter(F.col(ERROR).isNull()).drop(ERROR) if ERROR in batch.columns else batch
        put(good, name)
        if ERROR in batch.columns:
            put(batch.filter(F.col(ERROR).isNotNull()).select(f"{ERROR}.*"), f"{name}-quarantine")
        if rules:
            put(good.agg(*counts_of(good, rules)), f"{name}-rules")
        batch.unpersist()

    return run


def execute_stream(contract: Mapping, spark: SparkSession, sources: Mapping[str, Mapping | DataFrame], folder: str, strict: bool = False, mode: str = "fail", trigger: Mapping | None = None) -> Streams:
    """Start the queries of a contract. sources: a spec of files ({path, format, options}) for each unbounded input, a frame for each other. trigger: of writeStream, all that is there by default."""
    found = validate(contract) + [f"rule {r['id']}: rules of unbounded contracts are checked on outputs" for r in contract.get("rules", []) if r["target"].partition(".")[0] not in {o["id"] for o in contract["outputs"]}]
    found += [f"input {i['id']} is missing" for i in contract["inputs"] if i["id"] not in sources]
    if found:
        raise ContractError(found)
    frames, times = {}, {}
    for i in contract["inputs"]:
        given = sources[i["id"]]
        frames[i["id"]] = source(spark, i, given) if is_unbounded(i) else given
        if is_unbounded(i) and i.get("watermark"):
            times[i["id"]] = (i["watermark"]["field"], i["watermark"]["delay"])
            frames[i["id"]] = frames[i["id"]].withWatermark(*times[i["id"]])
    outputs, ctx = {o["id"]: o for o in contract["outputs"]}, Context(strict, mode=mode)
    for node in graph_of(contract).order:
        if isinstance(node, str):
            if len(sources_of(contract, node)) > 1:
                raise ActionError(f"output {node}: rows of several unbounded inputs have no common places")
            frames[node] = materialized(contract, outputs[node], frames, ctx)
        else:
            if written(node) & set(outputs) and plain(node) not in ALLOWED:
                raise ActionError(f"{node['id']}: {plain(node)} is not defined on an unbounded output")
            frames = step(node, frames, times, ctx)
    queries = {}
    for name in outputs:
        queries[name] = frames[name].writeStream.foreachBatch(writer(contract, name, folder)).option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    return Streams(spark, folder, contract, queries)
