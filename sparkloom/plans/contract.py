"""Contract documents: load, check, and run as one DataFrame graph."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..expressions import ExpressionError, parse
from ..functions import NAMES
from ..operators import ACTIONS, Context, apply
from ..operators.errors import ERROR, settle, settled, with_failures
from ..operators.ordered import over_order
from ..sources import schema_of
from .graph import Graph, graph_of, sources_of
from .rules import check_rules

MOST_BYTES = 16 * 1024 * 1024


class ContractError(ValueError):
    """The contract or its inputs are not valid; .findings lists what is wrong."""

    def __init__(self, findings: list[str]):
        super().__init__("; ".join(findings))
        self.findings = findings


def load(source: str | Path) -> dict:
    """A contract from a YAML or JSON file, or from text."""
    text = str(source)
    if isinstance(source, Path) or ("\n" not in text and not text.lstrip().startswith("{")):
        text = Path(source).read_text()
    if len(text.encode()) > MOST_BYTES:
        raise ContractError(["the document is too large"])
    if text.lstrip().startswith("{"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def fingerprint(contract: Mapping) -> str:
    """SHA-256 of the contract's canonical JSON."""
    return hashlib.sha256(json.dumps(contract, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def calls_in(node) -> set[str]:
    if isinstance(node, Mapping):
        own = {node["call"].rpartition(":")[2]} if "call" in node else set()
        return own.union(*[calls_in(v) for v in node.values()])
    return set().union(*[calls_in(v) for v in node]) if isinstance(node, list) else set()


def expressions_in(parameters) -> list:
    if isinstance(parameters, Mapping):
        own = [v for k, v in parameters.items() if k in ("expr", "predicate", "on", "filter") and isinstance(v, (str, Mapping))]
        return own + [e for k, v in parameters.items() if k not in ("expr", "predicate", "on", "filter") for e in expressions_in(v)]
    return [e for v in parameters for e in expressions_in(v)] if isinstance(parameters, list) else []


def validate(contract: Mapping) -> list[str]:
    """What is wrong with the document, its references, actions and expressions."""
    found = [f"missing {k!r}" for k in ("id", "name", "version", "inputs", "outputs") if not contract.get(k)]
    inputs, outputs = ([i.get("id") for i in contract.get(k) or []] for k in ("inputs", "outputs"))
    ids = [x for x in [*inputs, *outputs, *[a.get("id") for a in contract.get("semanticActions", [])], *[r.get("id") for r in contract.get("rules", [])]] if x]
    found += [f"duplicate id {x!r}" for x in sorted({x for x in ids if ids.count(x) > 1})]
    for a in contract.get("semanticActions", []):
        name = a.get("action", "").rpartition(":")[2]
        if name not in ACTIONS:
            found.append(f"action {a.get('id')}: unknown action {a.get('action')!r}")
        if a.get("target", "").partition(".")[0] not in {*inputs, *outputs}:
            found.append(f"action {a.get('id')}: unknown target {a.get('target')!r}")
        for e in expressions_in(a.get("parameters") or {}):
            if name == "explode" or isinstance(e, str) and a.get("parameters", {}).get("on") is e and "leftKey" not in a["parameters"] and not e:
                continue
            try:
                found += [f"action {a.get('id')}: unknown function {c!r}" for c in sorted(calls_in(parse(e) if isinstance(e, str) else e) - set(NAMES))]
            except ExpressionError as error:
                found.append(f"action {a.get('id')}: {error}")
    by_target: dict[str, int] = {}
    for a in contract.get("semanticActions", []):
        by_target[a.get("target", "").partition(".")[0]] = by_target.get(a.get("target", "").partition(".")[0], 0) + 1
    order = ((contract.get("semantics") or {}).get("ordering") or {}).get("order")
    found += [f"several actions on {t!r} need an order" for t, n in by_target.items() if n > 1 and not order]
    if not found:
        found += graph_of(contract).findings
    for r in contract.get("rules", []):
        if r.get("target", "").partition(".")[0] not in {*inputs, *outputs}:
            found.append(f"rule {r.get('id')}: unknown target {r.get('target')!r}")
    return found


def check_input(name: str, interface: Mapping, df: DataFrame) -> list[str]:
    """Declared fields must be present; fields that may not be null are counted in one pass with the rows."""
    fields = (interface.get("schema") or {}).get("fields") or []
    absent = [f"input {name}: no field {f['name']!r}" for f in fields if f["name"] not in df.columns]
    if absent:
        return absent
    firm = [f["name"] for f in fields if not f.get("nullable", True)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c{k}") for k, c in enumerate(firm)]).first()
    found = [f"input {name}: {row[f'c{k}']} nulls in {c!r}" for k, c in enumerate(firm) if row[f"c{k}"]]
    return found + ([f"input {name}: no rows"] if not is_optional(interface) and fields and not row["n"] else [])


def is_optional(interface: Mapping) -> bool:
    return bool(interface.get("optional")) or interface.get("required") is False


def with_absent(contract: Mapping, inputs: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], list[str]]:
    """(inputs with an empty frame of the declared schema for each optional one that is absent, what is missing)."""
    frames, found = dict(inputs), []
    for i in contract.get("inputs", []):
        if i["id"] in frames:
            continue
        if not is_optional(i) or not frames:
            found.append(f"input {i['id']} is missing")
        else:
            spark = next(iter(inputs.values())).sparkSession
            frames[i["id"]] = spark.createDataFrame([], schema_of(i) or T.StructType([]))
    return frames, found


def with_place(df: DataFrame, ctx: Context) -> DataFrame:
    """Number rows from 0 in the order of their row ids, or else as they come: by partition, with the partitions' sizes (one row each) before them.

    Without a row id df is evaluated twice and must give its rows in the same partitions both times, as a scan does.
    """
    if ctx.row_id in df.columns:
        first = [{"as": "__place", "function": "row_number"}]
        return over_order(df, [(F.col(ctx.row_id).cast("bigint"), False, True)], [], first, {"__place": None}).withColumn("__place", F.col("__place") - 1)
    df = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return df.join(starts, "__part").withColumn("__place", F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__start")


#: Whole numbers up to which every one is a double of its own.
SAFE_WHOLE = 1 << 53


def refusal(col: Column, kind: T.DataType, wanted: T.DataType) -> Column | None:
    """A code where a value has no exact counterpart in the declared type; None if every value has one or the types are left to a cast."""
    if isinstance(wanted, T.LongType) and isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        wide = (col < -float(1 << 63)) | (col >= float(1 << 63)) | F.isnan(col.cast("double"))
        return F.when(wide, "out_of_range").when(col != F.floor(col), "fraction")
    if isinstance(wanted, T.DoubleType) and isinstance(kind, T.LongType):
        return F.when((col > SAFE_WHOLE) | (col < -SAFE_WHOLE), "unsafe_integer")
    return None


def materialized(contract: Mapping, output: Mapping, frames: Mapping[str, DataFrame], ctx: Context | None = None) -> DataFrame:
    """Project the lineage's inputs to the output's schema. A value that its declared type cannot hold exactly raises, is null, or sends its row to the quarantine, by the mode."""
    ctx = ctx or Context()
    names = sources_of(contract, output["id"])
    schema = schema_of(output)
    base = frames[names[0]]
    if len(names) > 1:  # rows of several inputs meet by place, so each needs a numbering
        base = with_place(base, Context())
        for other in names[1:]:
            more = frames[other]
            more = with_place(more, Context())
            base = base.join(more.select("__place", *[c for c in more.columns if c not in base.columns]), "__place", "left")
    if schema is None:
        return base.drop("__place")
    out, failures = [], []
    for f in schema.fields:
        if f.name not in base.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        col = F.col(f"`{f.name}`")
        code = refusal(col, base.schema[f.name].dataType, f.dataType)
        if code is None:
            out.append(col.cast(f.dataType).alias(f.name))
            continue
        if ctx.mode == "route":
            failures.append((f.name, code))
        instead = F.raise_error(F.concat(F.lit(f"output {output['id']}: field {f.name}: "), code)).cast(f.dataType) if ctx.mode == "fail" else F.lit(None).cast(f.dataType)
        out.append(F.when(code.isNotNull(), instead).otherwise(col.cast(f.dataType)).alias(f.name))
    if failures or ERROR in base.columns:
        return with_failures(base, "materialize", failures).select(*out, ERROR)
    return base.select(*out)


def before_output(contract: Mapping, output: str, frames: dict[str, DataFrame], graph: Graph) -> dict[str, DataFrame]:
    """Frames as an output is made of them: bad rows of a frame that several read go to the quarantine first, so each is there once."""
    for name in sources_of(contract, output):
        if graph.readers.get(name, 0) > 1:
            frames = settle(frames, name)
    return frames


def run(contract: Mapping, inputs: Mapping[str, DataFrame], strict: bool = False, check: bool = True, mode: str = "fail") -> dict[str, DataFrame]:
    """Outputs of a contract as frames: preconditions, actions and outputs in the graph's order, postconditions.

    Checks run before the frames are returned, in passes of their own; execution.execute() checks within the jobs that write. In mode
    route the result also holds the quarantine, as __quarantine.
    """
    frames, missing = with_absent(contract, inputs)
    found = validate(contract) + missing
    for i in contract.get("inputs", []):
        if i["id"] in inputs and check:
            found += check_input(i["id"], i, inputs[i["id"]])
    if found:
        raise ContractError(found)
    context = Context(strict, mode=mode)
    rules, outputs = contract.get("rules", []), {o["id"]: o for o in contract["outputs"]}
    if check:
        check_rules(frames, rules, ("precondition",))
    graph = graph_of(contract)
    for node in graph.order:
        if isinstance(node, str):
            frames = before_output(contract, node, frames, graph)
            frames[node] = materialized(contract, outputs[node], frames, context)
        else:
            frames = apply(node["action"], node["target"], node.get("parameters"), frames, context)
    if mode == "route":  # bad rows of a frame that one output is made of are in that output
        frames |= settled({n: f for n, f in frames.items() if not graph.readers.get(n)})
    if check:
        check_rules(frames, rules, ("runtime", "execution", "postcondition"))
    return {name: frames[name] for name in [*outputs, *(["__quarantine"] if mode == "route" else [])]}
