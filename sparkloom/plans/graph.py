"""The action graph of a contract: what each action reads and writes, an order that respects it, and frames that several readers share."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

#: Parameters that name other frames.
OTHERS = ("right", "other", "others", "inputs", "datasets")
#: Actions after which computing a frame twice costs a shuffle or a sort twice.
COSTLY = frozenset("join aggregate group window sort distinct deduplicate intersect except pivot sample random_split repartition".split())


def plain(action: Mapping) -> str:
    return action.get("action", "").rpartition(":")[2]


def base(target: str) -> str:
    return target.partition(".")[0]


def others(action: Mapping) -> list[str]:
    p, found = action.get("parameters") or {}, []
    for key in OTHERS:
        value = p.get(key)
        found += [value] if isinstance(value, str) else [x for x in value if isinstance(x, str)] if isinstance(value, list) else []
    return found


def written(action: Mapping) -> set[str]:
    more = (action.get("parameters") or {}).get("outputs")
    return {base(action.get("target", "")), *(more if isinstance(more, list) and plain(action) == "random_split" else [])}


def sources_of(contract: Mapping, output: str) -> list[str]:
    """The frames an output is made of, in the order of its lineage."""
    found = [base(i) for m in (contract.get("lineage") or {}).get("mappings", []) if m.get("output") == output for i in m.get("inputs", [])]
    return list(dict.fromkeys(found)) or [contract["inputs"][0]["id"]]


def declared_order(contract: Mapping) -> list[str] | None:
    return ((contract.get("semantics") or {}).get("ordering") or {}).get("order") or None


@dataclass(frozen=True)
class Graph:
    """order: actions (mappings) and outputs (names) as they run. readers: how many outputs and other frames' actions read each frame's last state. findings: why there is no order."""

    order: list
    readers: dict[str, int]
    costly: frozenset
    findings: list[str]


def edges_of(contract: Mapping, actions: list[Mapping]) -> dict[str, set[str]]:
    """For each node the nodes that come before it. Nodes are ids of actions and, as `output NAME`, the making of outputs."""
    outputs, order = [o["id"] for o in contract.get("outputs") or []], declared_order(contract)
    place = {name: k for k, name in enumerate(order or [a["id"] for a in actions])}
    before: dict[str, set[str]] = {a["id"]: set() for a in actions} | {f"output {o}": set() for o in outputs}
    for a in actions:
        for b in actions:
            if a is b:
                continue
            shares = written(a) & written(b) or (order and (written(a) & {*others(b), *written(b)} or written(b) & set(others(a))))
            if shares:
                first, second = (a, b) if place.get(a["id"], len(place)) < place.get(b["id"], len(place)) else (b, a)
                before[second["id"]].add(first["id"])
            elif written(a) & set(others(b)):
                before[b["id"]].add(a["id"])
        for o in outputs:
            if o in written(a):
                before[a["id"]].add(f"output {o}")
            elif written(a) & set(sources_of(contract, o)):
                before[f"output {o}"].add(a["id"])
            if o in others(a) and o not in written(a):
                before[a["id"]].add(f"output {o}")
    return before


def graph_of(contract: Mapping) -> Graph:
    """Actions and outputs in topological order; ties keep the document's order."""
    actions, outputs = list(contract.get("semanticActions") or []), [o["id"] for o in contract.get("outputs") or []]
    found, order = [], declared_order(contract)
    if order:
        ids = [a["id"] for a in actions]
        found += [f"the order names {x!r}, which is no action" for x in order if x not in ids] + [f"the order names {x!r} twice" for x in sorted({x for x in order if order.count(x) > 1})]
        found += [f"the order lacks action {x!r}" for x in ids if x not in order]
    before = edges_of(contract, actions)
    by_id = {a["id"]: a for a in actions} | {f"output {o}": o for o in outputs}
    place, done, out = {n: k for k, n in enumerate(before)}, set(), []
    while len(done) < len(before):
        ready = [n for n in before if n not in done and before[n] <= done]
        if not ready:
            found.append("a cycle among " + ", ".join(sorted(n for n in before if n not in done)))
            break
        node = min(ready, key=place.get)
        done.add(node)
        out.append(by_id[node])
    readers: dict[str, int] = {}
    for o in outputs:
        for s in sources_of(contract, o):
            readers[s] = readers.get(s, 0) + 1
    for a in actions:
        for x in set(others(a)) - written(a):
            readers[x] = readers.get(x, 0) + 1
    costly = {f for a in actions if plain(a) in COSTLY for f in written(a)}
    return Graph(out, readers, frozenset(costly), found)
