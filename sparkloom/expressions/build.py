"""Nodes to Spark columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parse import ExpressionError, parse


@dataclass(frozen=True)
class Value:
    """A column and, for typing inside lambdas, the same column over typed nulls in place of lambda variables.

    error: in scopes that keep errors, a code where the value could not be computed, else null; None if it always can.
    state: the code of an invalid field; None if the frame has no invalid fields. missing: whether the row lacks the field, where a frame knows.
    """

    col: Column
    probe: Column
    literal: object = None
    is_literal: bool = False
    error: Column | None = None
    state: Column | None = None
    missing: Column | None = None


@dataclass
class Scope:
    """What names mean: the columns of df, and lambda variables. errors: nothing raises; values carry error codes instead."""

    df: DataFrame
    variables: Mapping[str, Value] = field(default_factory=dict)
    strict: bool = False
    errors: bool = False

    def type_of(self, value: Value) -> T.DataType:
        return self.df.select(value.probe.alias("x")).schema[0].dataType

    def constant(self, value: Value, what: str):
        if not value.is_literal:
            raise ExpressionError(f"{what} must be a literal")
        return value.literal


#: The map of a frame's invalid fields to their codes, where a frame has one.
INVALID = "__invalid"
#: The list of the fields that a row lacks.
MISSING = "__missing"


def first_error(*errors: Column | None) -> Column | None:
    known = [e for e in errors if e is not None]
    return F.coalesce(*known) if len(known) > 1 else known[0] if known else None


def map_value(fn: Callable[..., Column], *args: Value) -> Value:
    return Value(fn(*(a.col for a in args)), fn(*(a.probe for a in args)), error=first_error(*(a.error for a in args)))


def literal(value) -> Value:
    col = F.lit(value).cast("bigint") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)
    return Value(col, col, value, True)


def field_of(name: str, scope: Scope) -> Value:
    """A lambda variable or column; a column that the frame lacks is missing, which is null here."""
    last = name.rpartition(".")[2]
    if last in scope.variables:
        return scope.variables[last]
    if last in scope.df.columns:
        col = scope.df[last]
        state = F.try_element_at(scope.df[INVALID], F.lit(last)) if INVALID in scope.df.columns else None
        return Value(col, col, state=state, missing=F.array_contains(scope.df[MISSING], last) if MISSING in scope.df.columns else None)
    return Value(F.lit(None), F.lit(None))


def build(node, scope: Scope) -> Value:
    from ..functions import call

    if isinstance(node, str):
        node = parse(node)
    if not isinstance(node, Mapping):
        return literal(node)
    if "literal" in node:
        return literal(node["literal"])
    if "field" in node:
        return field_of(node["field"], scope)
    if "expr" in node:
        return build(node["expr"], scope)
    if "call" in node:
        return call(node["call"].rpartition(":")[2], node.get("args", []), scope)
    raise ExpressionError(f"unknown expression node {sorted(node)}")


def value_of(expression, df: DataFrame, strict: bool = False) -> Value:
    """The value of an expression that never raises: null with an error code where it cannot be computed."""
    value = build(expression, Scope(df, strict=strict, errors=True))
    return value if value.error is None else Value(F.when(value.error.isNull(), value.col), value.probe, error=value.error, state=value.state)


def column_of(expression, df: DataFrame, strict: bool = False) -> Column:
    """The column of an expression (text, node, or a Column as it is) over df."""
    return expression if isinstance(expression, Column) else build(expression, Scope(df, strict=strict)).col
