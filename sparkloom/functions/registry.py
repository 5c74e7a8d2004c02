"""Registry of functions. A builder gets Values (or, if it takes lambdas, nodes) and returns a Value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expressions.build import Scope, Value, build, map_value
from ..expressions.parse import ExpressionError, parse

NAMES: dict[str, tuple[Callable, int, int | None, str]] = {}


def register(name: str, least: int, most: int | None, builder: Callable, kind: str) -> None:
    NAMES[name] = (builder, least, most, kind)


def columns(name: str, least: int, most: int | None = -1):
    """Register a function of columns only; most -1 means as many as least, None any number."""

    def keep(fn: Callable[..., Column]):
        for n in name.split():
            register(n, least, least if most == -1 else most, fn, "columns")
        return fn

    return keep


def values(name: str, least: int, most: int | None = -1):
    """Register a function (scope, *values) -> Value that looks at types or literals."""

    def keep(fn):
        for n in name.split():
            register(n, least, least if most == -1 else most, fn, "values")
        return fn

    return keep


def nodes(name: str, least: int, most: int | None = -1):
    """Register a function (scope, *nodes) -> Value that takes lambdas."""

    def keep(fn):
        for n in name.split():
            register(n, least, least if most == -1 else most, fn, "nodes")
        return fn

    return keep


def names() -> list[str]:
    return sorted(NAMES)


def call(name: str, args: list, scope: Scope) -> Value:
    if name not in NAMES:
        raise ExpressionError(f"unknown function {name!r}")
    fn, least, most, kind = NAMES[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise ExpressionError(f"{name} takes {least} to {most if most is not None else 'any number of'} arguments, not {len(args)}")
    if scope.errors:
        from .errors import kept

        return kept(name, args, scope)
    if kind == "nodes":
        out, built = fn(scope, *args), [build(a, scope) for a in args if not is_lambda(a)] if scope.strict else []
    else:
        built = [build(a, scope) for a in args]
        out = fn(scope, *built) if kind == "values" else map_value(fn, *built)
    if scope.strict and built and name not in NULL_AWARE:
        out = map_value(lambda value, *cols: guarded(name, value, cols), out, *built)
    return out


#: Functions that have a result for null arguments; with strict nulls the others raise.
NULL_AWARE = frozenset("coalesce if_null null_if is_null is_missing is_invalid eq not_eq null_safe_eq concat_ws list collect_list collect_set tuple object map case_when first last "
                       "variance stddev median quantile covariance correlation try_cast random random_normal".split())


def is_lambda(node) -> bool:
    node = parse(node) if isinstance(node, str) else node
    return isinstance(node, dict) and "lambda" in node


def any_absent(name: str, args: tuple[Column, ...]) -> Column:
    """Whether an argument that counts is null: the right side of `and` and `or` does not where the left decides."""
    absent = args[0].isNull()
    for a in args[1:]:
        absent = absent | (a.isNull() if name not in ("and", "or") else a.isNull() & (args[0] if name == "and" else ~args[0]))
    return F.coalesce(absent, F.lit(False))


def guarded(name: str, value: Column, args: tuple[Column, ...]) -> Column:
    absent = any_absent(name, args)
    return F.when(absent, F.raise_error(F.lit(f"{name}: null argument"))).otherwise(value)
