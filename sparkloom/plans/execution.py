"""Running a contract as the jobs that write its outputs, with every check inside them.

Counts for input checks and rules are observed on the rows as they flow to the outputs, so an input is read once however many rules it has.
A frame that several outputs or other frames read is computed once, if computing it takes a shuffle or a sort: it is kept (in memory or on
local disk; a lost part is computed again) until the outputs are written. Where rows may not all flow (below a limit), or a branch was
optimised away, a frame is checked by a pass of its own.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import Context, apply
from ..operators.errors import ERROR, QUARANTINE, settle, write_split
from .contract import ContractError, before_output, is_optional, materialized, validate, with_absent
from .graph import graph_of, plain, written
from .rules import Outcome, RuleViolation, counts_of, outcomes_of

#: Seconds to wait for the counts of a job that has ended.
PATIENCE = 10.0


@dataclass
class Watch:
    """Counts of one frame, observed as it is computed."""

    frame: str
    df: DataFrame
    columns: list[Column]
    rules: list[Mapping]
    firm: list[str] = field(default_factory=list)
    needs_rows: bool = False
    observation: Observation | None = None

    def attached(self) -> DataFrame:
        self.observation = Observation(f"{self.frame}-{uuid.uuid4().hex}")
        return self.df.observe(self.observation, *self.columns)

    def ask(self, found: list) -> None:
        with contextlib.suppress(Py4JJavaError):  # no counts: the branch was optimised away
            found.append(self.observation.get)

    def counts(self) -> Mapping:
        found: list[Mapping] = []
        if self.observation is not None:
            waiting = threading.Thread(target=self.ask, args=(found,), daemon=True)
            waiting.start()
            waiting.join(PATIENCE)
        return found[0] if found and found[0] else self.df.agg(*self.columns).first().asDict()


@dataclass(frozen=True)
class Execution:
    """The written outputs, what became of each rule, and (in mode route) the rows taken out."""

    outputs: dict[str, DataFrame]
    outcomes: list[Outcome]
    quarantine: DataFrame | None = None


def watch_input(name: str, interface: Mapping, df: DataFrame, rules: list[Mapping], given: bool) -> Watch | None:
    fields = (interface.get("schema") or {}).get("fields") or []
    firm = [f["name"] for f in fields if not f.get("nullable", True)]
    needs_rows = given and bool(fields) and not is_optional(interface)
    if not rules and not firm and not needs_rows:
        return None
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(firm)]
    return Watch(name, df, counts_of(df, rules) + nulls, rules, firm, needs_rows)


def execute(contract: Mapping, inputs: Mapping[str, DataFrame], folder: str, strict: bool = False, mode: str = "fail", on_violation: str = "raise") -> Execution:
    """Write each output below folder. A violated rule, or an indeterminate one that is not allowed to be, raises RuleViolation once all is counted (on_violation="report": it is reported only)."""
    frames, missing = with_absent(contract, inputs)
    found = validate(contract) + missing
    interfaces = {i["id"]: i for i in contract.get("inputs", [])}
    for name, i in interfaces.items():
        if name in frames:
            found += [f"input {name}: no field {f['name']!r}" for f in (i.get("schema") or {}).get("fields") or [] if f["name"] not in frames[name].columns]
    if found:
        raise ContractError(found)
    rules, outputs, graph, ctx = contract.get("rules", []), {o["id"]: o for o in contract["outputs"]}, graph_of(contract), Context(strict, mode=mode)
    whole = not any(plain(a) == "limit" for a in contract.get("semanticActions", []))
    watches: list[Watch] = []
    of = lambda frame, early: [r for r in rules if r["target"].partition(".")[0] == frame and (r.get("phase", "runtime") == "precondition") == early]

    def watched(name: str, watch: Watch | None, flows: bool) -> DataFrame:
        if watch is None:
            return frames[name]
        watches.append(watch)
        return watch.attached() if flows else watch.df

    for name, i in interfaces.items():
        frames[name] = watched(name, watch_input(name, i, frames[name], of(name, True), name in inputs), whole)
    last = {}
    for node in graph.order:
        for name in {node} if isinstance(node, str) else written(node):
            last[name] = node
    kept: list[DataFrame] = []

    def finished(name: str, current: dict[str, DataFrame]) -> DataFrame:
        """A frame in its last state: checked, and kept if it is read more than once."""
        frames.update(current)
        if name in frames and of(name, False):
            df = frames[name].filter(F.col(ERROR).isNull()) if ERROR in frames[name].columns else frames[name]
            watch = Watch(name, df, counts_of(df, of(name, False)), of(name, False))
            if (whole or name in outputs) and ERROR not in frames[name].columns:
                frames[name] = watched(name, watch, True)
            else:
                watches.append(watch)
        if name not in outputs and graph.readers.get(name, 0) > 1 and name in graph.costly:
            frames[name] = frames[name].persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(frames[name])
        return frames[name]

    for name in interfaces:
        if name not in last:
            frames[name] = finished(name, frames)
    for node in graph.order:
        if isinstance(node, str):
            frames = before_output(contract, node, frames, graph)
            frames[node] = materialized(contract, outputs[node], frames, ctx)
            names = {node}
        else:
            frames = apply(node["action"], node["target"], node.get("parameters"), frames, ctx)
            names = written(node)
        for name in names:
            if last[name] is node and name in frames:
                frames[name] = finished(name, frames)
    done, bad = {}, []
    for name in outputs:
        if ERROR in frames[name].columns:
            good, rejected = write_split(frames[name], f"{folder}/{name}")
            done[name] = good
            bad.append(rejected.select(F.lit(name).alias("frame"), "action", "field", "code", "row"))
        else:
            frames[name].write.parquet(f"{folder}/{name}")
            done[name] = frames[name].sparkSession.read.parquet(f"{folder}/{name}")
    if mode == "route":
        for name in [n for n in frames if n not in outputs and n != QUARANTINE]:
            frames = settle(frames, name) if graph.readers.get(name) is None else frames
        if QUARANTINE in frames:
            frames[QUARANTINE].write.parquet(f"{folder}/{QUARANTINE}")
            bad.append(frames[QUARANTINE].sparkSession.read.parquet(f"{folder}/{QUARANTINE}"))
    outcomes, wrong = [], []
    for w in watches:
        counts = w.counts()
        outcomes += outcomes_of(w.frame, w.rules, counts)
        wrong += [f"input {w.frame}: {counts[f'n{k}']} nulls in {c!r}" for k, c in enumerate(w.firm) if counts[f"n{k}"]]
        wrong += [f"input {w.frame}: no rows"] if w.needs_rows and not counts["rows"] else []
    for df in kept:
        df.unpersist()
    if wrong:
        raise ContractError(wrong)
    allowed = {r["id"] for r in rules if r.get("allowIndeterminate")}
    failed = [o for o in outcomes if o.outcome == "violated" or (o.outcome == "indeterminate" and o.id not in allowed)]
    if failed and on_violation == "raise":
        raise RuleViolation("; ".join(f"{o.phase} {o.id} ({o.rule} on {o.frame}.{o.field}): {o.outcome}, {o.violations} of {o.rows} rows" for o in failed), outcomes)
    quarantine = None
    for df in bad:
        quarantine = df if quarantine is None else quarantine.unionByName(df)
    return Execution(done, outcomes, quarantine)
