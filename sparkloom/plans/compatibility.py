"""What a new version of a contract changes for its readers and writers, and what depends on what."""

from __future__ import annotations

from collections.abc import Mapping

LEVELS = ("identical", "compatible", "conditionally compatible", "breaking")


def fields_of(interface: Mapping) -> dict[str, Mapping]:
    return {f["name"]: f for f in (interface.get("schema") or {}).get("fields") or []}


def changes(old: Mapping, new: Mapping) -> list[tuple[str, str]]:
    """(level, what) for each change of interfaces, actions and rules."""
    out: list[tuple[str, str]] = []
    for side in ("inputs", "outputs"):
        before, after = ({i["id"]: i for i in c.get(side) or []} for c in (old, new))
        out += [("breaking", f"{side}: {i} removed") for i in before if i not in after]
        out += [("breaking" if side == "inputs" and after[i].get("required", True) else "compatible", f"{side}: {i} added") for i in after if i not in before]
        for i in before.keys() & after.keys():
            if before[i].get("mode", "bounded") != after[i].get("mode", "bounded"):
                out.append(("breaking", f"{i}: mode changed"))
            a, b = fields_of(before[i]), fields_of(after[i])
            out += [("breaking" if side == "outputs" else "compatible", f"{i}.{f} removed") for f in a if f not in b]
            for f in b:
                if f not in a:
                    out.append(("breaking" if side == "inputs" and not b[f].get("nullable", True) else "compatible", f"{i}.{f} added"))
                elif a[f]["type"] != b[f]["type"]:
                    widened = (a[f]["type"], b[f]["type"]) == ("integer", "decimal")
                    out.append(("conditionally compatible" if widened else "breaking", f"{i}.{f}: type changed"))
                elif a[f].get("nullable", True) != b[f].get("nullable", True):
                    looser = b[f].get("nullable", True)
                    out.append(("compatible" if looser == (side == "inputs") else "breaking", f"{i}.{f}: nullability changed"))
    for part in ("semanticActions", "rules"):
        a, b = ({x["id"]: x for x in c.get(part) or []} for c in (old, new))
        out += [("conditionally compatible", f"{part}: {x} changed") for x in sorted(a.keys() | b.keys()) if a.get(x) != b.get(x)]
    return out


def compare(old: Mapping, new: Mapping) -> tuple[str, list[tuple[str, str]]]:
    """(the worst level, all changes)."""
    found = changes(old, new)
    return max((level for level, _ in found), key=LEVELS.index, default="identical"), found


def impact(contract: Mapping, start: str) -> set[str]:
    """Everything that lineage says depends on an interface or field."""
    after: dict[str, set[str]] = {}
    for m in (contract.get("lineage") or {}).get("mappings", []):
        for i in m.get("inputs", []):
            after.setdefault(i, set()).add(m["output"])
    seen, todo = set(), [start]
    while todo:
        for n in after.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen
