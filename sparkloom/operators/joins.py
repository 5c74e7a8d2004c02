"""Joins: seven types, equality keys or predicates, four policies for fields of one name."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..expressions import parse
from ..expressions.build import Scope, Value, build
from .intervals import conjuncts, range_join
from .registry import ActionError, Context, action

TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "left_semi": "left_semi",
         "anti": "left_anti", "left_anti": "left_anti", "cross": "cross", "outer": "full"}


@action("join")
def join(frames, target, p, ctx: Context):
    """Null keys never match unless nullSafe. Spark picks the strategy; keys are equality conditions, and inner joins on ranges go by bins
    (intervals.py), so nothing is nested-looped but other predicates without a key."""
    kind = TYPES.get(p.get("type", "inner"))
    if kind is None:
        raise ActionError(f"unknown join type {p['type']!r}")
    left, right = frames[target].alias("l"), frames[p["right"]].alias("r")
    names, other = frames[target].columns, frames[p["right"]].columns
    both = [c for c in names if c in other]
    policy = p.get("collisionPolicy", "preferLeft")
    if policy == "error" and both and kind not in ("left_semi", "left_anti"):
        raise ActionError(f"join: both datasets have a field {both[0]!r}")
    l = lambda c: F.col(f"l.`{c}`")  # noqa: E731, E741
    r = lambda c: F.col(f"r.`{c}`")
    seen = {c: (r if policy == "preferRight" and c in other else l if c in names else r)(c) for c in [*names, *other]}
    if policy == "suffix":
        seen |= {f"{c}_left": l(c) for c in both} | {f"{c}_right": r(c) for c in both}
    condition = None
    if kind != "cross" and p.get("leftKey"):
        a, b = l(p["leftKey"]), r(p.get("rightKey", p["leftKey"]))
        condition = a.eqNullSafe(b) if p.get("nullSafe") else a == b
    predicate, ranged = p.get("on") or p.get("predicate"), None
    if predicate is not None:
        scope = Scope(left.join(right), {n: Value(c, c) for n, c in seen.items()}, ctx.strict, ctx.mode != "fail")
        node = parse(predicate) if isinstance(predicate, str) else predicate
        live = left.isStreaming and right.isStreaming
        test = build(node, scope).col if not live else functools.reduce(lambda a, b: a & b, [build(c, scope).col for c in conjuncts(node)])  # Spark reads bounds in time from plain conjunctions
        if condition is None and kind in ("inner", "cross") and ctx.mode == "fail" and not (left.isStreaming or right.isStreaming):
            side_of = {c: "r" if c in other and (policy == "preferRight" or c not in names) else "l" for c in [*names, *other]}
            ranged = range_join(frames[target], frames[p["right"]], node, side_of, test, ctx.strict)
        condition = test if condition is None else condition & test
    if ranged is not None:
        joined = ranged
        l, r = (lambda c: F.col(f"__l_{names.index(c)}")), (lambda c: F.col(f"__r_{other.index(c)}"))
    elif condition is None:
        joined = left.crossJoin(right)
    else:
        joined = left.join(right, condition, "inner" if kind == "cross" else kind)
    if kind in ("left_semi", "left_anti"):
        return {target: joined.select(*[l(c).alias(c) for c in names])}
    if policy == "suffix":
        out = [l(c).alias(f"{c}_left" if c in both else c) for c in names] + [r(c).alias(f"{c}_right" if c in both else c) for c in other]
    elif policy == "preferRight":
        out = [l(c).alias(c) for c in names if c not in both] + [r(c).alias(c) for c in other]
    else:
        out = [l(c).alias(c) for c in names] + [r(c).alias(c) for c in other if c not in both]
    return {target: joined.select(*out)}
