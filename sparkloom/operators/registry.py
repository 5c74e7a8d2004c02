"""Registry of actions and the entry points that apply them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions import column_of, value_of

ACTIONS: dict[str, Callable] = {}
Frames = dict[str, DataFrame]


class ActionError(ValueError):
    """An action's parameters do not fit its input."""


MODES = ("fail", "invalid", "null", "route")
#: The frame of the rows that mode route takes out.
QUARANTINE = "__quarantine"


@dataclass(frozen=True)
class Context:
    """strict: null arguments of functions raise. row_id: a column that fixes the order of rows, where a frame has it.

    mode: what becomes of a value that cannot be computed. fail: the run ends. null: it is null. invalid: it is null, and the frame's
    column __invalid keeps its field and code, which is_invalid reads. route: its row leaves the frame for the quarantine (errors.py).
    """

    strict: bool = False
    row_id: str = "__row_id"
    mode: str = "fail"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown error mode {self.mode!r}; expected one of {', '.join(MODES)}")

    def column(self, expression, df: DataFrame) -> Column:
        if self.mode == "fail" or isinstance(expression, Column):
            return column_of(expression, df, self.strict)
        return value_of(expression, df, self.strict).col

    def order(self, df: DataFrame) -> list[Column]:
        """What orders rows as they came: the row id, or else the rows' own place in the plan."""
        return [F.col(self.row_id)] if self.row_id in df.columns else [F.monotonically_increasing_id()]


def action(*names: str):
    def keep(fn):
        for n in names:
            ACTIONS[n] = fn
        return fn

    return keep


def item_column(item, df: DataFrame, ctx: Context) -> tuple[str, Column]:
    """(name, column) of a list item: a field name, or {field or expr, as}."""
    if isinstance(item, str):
        return item, df[item]
    source = df[item["field"]] if "field" in item else ctx.column(item["expr"], df)
    return item.get("as") or item.get("field") or str(item["expr"]), source


def apply(name: str, target: str, parameters: Mapping | None, frames: Frames, context: Context | None = None) -> Frames:
    """frames after one action. target is a frame, or frame.field for field actions; other frames stay as they are."""
    plain = name.rpartition(":")[2]
    if plain not in ACTIONS:
        raise ActionError(f"unknown action {name!r}")
    base = target.partition(".")[0]
    if base not in frames:
        raise ActionError(f"unknown dataset {base!r}")
    context, parameters = context or Context(), dict(parameters or {})
    if context.mode in ("invalid", "route") and base != QUARANTINE:
        from . import errors

        return errors.tolerant(plain, target, parameters, frames, context)
    return {**frames, **ACTIONS[plain](frames, target, parameters, context)}


def apply_all(actions: list[Mapping], frames: Frames, context: Context | None = None) -> Frames:
    """All actions in turn. In mode route the result also holds the quarantine, as frame __quarantine."""
    for a in actions:
        frames = apply(a["action"], a["target"], a.get("parameters"), frames, context)
    if context is not None and context.mode == "route":
        from . import errors

        return errors.settled(frames)
    return frames
