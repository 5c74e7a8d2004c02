"""Data-quality rules: conditions on values, counted for all rules of a frame at once, and their outcomes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHASES = ("precondition", "runtime", "execution", "postcondition")


@dataclass(frozen=True)
class Outcome:
    """What became of a rule: satisfied, violated or indeterminate, with the rows that say so."""

    id: str
    rule: str
    phase: str
    frame: str
    field: str
    outcome: str
    violations: int
    indeterminate: int
    rows: int


class RuleViolation(ValueError):
    """Rows violate a rule; .outcomes has what became of each rule, where all were evaluated."""

    def __init__(self, message: str, outcomes: list[Outcome] = ()):
        super().__init__(message)
        self.outcomes = list(outcomes)


def violates(rule: str, col: Column, kind: T.DataType, p: Mapping) -> Column:
    """Whether a value breaks a rule; null breaks every rule (for `equals` see unsure())."""
    absent = col.isNull()
    if rule == "not_null":
        return absent
    if rule == "min_length":
        return absent | (F.char_length(col) < int(p["min"]))
    if rule == "max_length":
        return absent | (F.char_length(col) > int(p["max"]))
    if rule == "regex_match":
        return absent | ~F.rlike(col, F.lit(p["pattern"]))
    if rule == "one_of":
        return absent | ~col.isin(list(p["values"]))
    if rule == "equals":
        return absent | (col != F.lit(p["value"]))
    if rule == "range":
        out = absent
        if p.get("min") is not None:
            out = out | (col < p["min"])
        if p.get("max") is not None:
            out = out | (col > p["max"])
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out = out | (col != F.floor(col))
        return out
    raise ValueError(f"unknown rule {rule!r}")


def unsure(rule: Mapping, col: Column) -> Column:
    """Whether a rule says nothing about a value: `equals` about null, where the rule allows indeterminate outcomes."""
    return col.isNull() if rule["rule"].rpartition(":")[2] == "equals" and rule.get("allowIndeterminate") else F.lit(False)


def counts_of(df: DataFrame, rules: list[Mapping]) -> list[Column]:
    """Aggregates v0, u0, v1, ...: the rows that violate each rule, and those about which it says nothing; and `rows`."""
    out = [F.count(F.lit(1)).alias("rows")]
    for k, r in enumerate(rules):
        field = r["target"].partition(".")[2] or r["target"]
        if field not in df.columns:
            raise RuleViolation(f"rule {r['id']}: no field {field!r}")
        col, open_ = F.col(f"`{field}`"), unsure(r, F.col(f"`{field}`"))
        test = F.coalesce(violates(r["rule"].rpartition(":")[2], col, df.schema[field].dataType, r.get("parameters") or {}), F.lit(False)) & ~open_
        out += [F.count_if(test).alias(f"v{k}"), F.count_if(open_).alias(f"u{k}")]
    return out


def outcomes_of(frame: str, rules: list[Mapping], counts: Mapping) -> list[Outcome]:
    out = []
    for k, r in enumerate(rules):
        bad, open_ = counts[f"v{k}"], counts[f"u{k}"]
        out.append(Outcome(r["id"], r["rule"].rpartition(":")[2], r.get("phase", "runtime"), frame, r["target"].partition(".")[2] or r["target"],
                           "violated" if bad else "indeterminate" if open_ else "satisfied", bad, open_, counts["rows"]))
    return out


def report(df: DataFrame, rules: list[Mapping]) -> DataFrame:
    """One row per rule: id, rule, field, violations, rows; a single pass over df."""
    named = [(r["id"], r["rule"].rpartition(":")[2], r["target"].partition(".")[2] or r["target"]) for r in rules]
    sums = df.agg(*counts_of(df, rules))
    rows = [F.struct(F.lit(i).alias("id"), F.lit(r).alias("rule"), F.lit(f).alias("field"), F.col(f"v{k}").alias("violations"), F.col("rows").alias("rows"))
            for k, (i, r, f) in enumerate(named)]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def check_rules(frames: Mapping[str, DataFrame], rules: list[Mapping], phases: tuple[str, ...]) -> None:
    """Raise at the first rule of the phases that some row breaks; equal rules are checked once, all of a frame in one pass."""
    by_frame: dict[str, dict] = {}
    for r in sorted((r for r in rules if r.get("phase", "runtime") in phases), key=lambda r: phases.index(r.get("phase", "runtime"))):
        key = (r["rule"], r["target"], str(sorted((r.get("parameters") or {}).items())))
        by_frame.setdefault(r["target"].partition(".")[0], {}).setdefault(key, r)
    for name, some in by_frame.items():
        asked = list(some.values())
        for r, row in zip(asked, report(frames[name], asked).collect()):
            if row["violations"]:
                raise RuleViolation(f"{r.get('phase', 'runtime')} {row['id']} ({row['rule']} on {name}.{row['field']}): {row['violations']} of {row['rows']} rows")
