"""Step graphs of jobs: out-trees, checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass


class GraphError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    id: str
    after: tuple[str, ...] | None = None  # None: the step declared before


def build(nodes: list[Node]) -> dict[str, list[str]]:
    """Successors of each step. Rejects repeated ids, joins, unknown predecessors, cycles and unreachable steps."""
    ids = [n.id for n in nodes]
    if not nodes:
        raise GraphError("a job needs a step")
    if repeated := {i for i in ids if ids.count(i) > 1}:
        raise GraphError(f"step ids repeat: {sorted(repeated)}")
    before: dict[str, str | None] = {}
    for i, n in enumerate(nodes):
        after = n.after if n.after is not None else (() if i == 0 else (nodes[i - 1].id,))
        if len(after) > 1:
            raise GraphError(f"step {n.id!r} joins {list(after)}; a step has one predecessor")
        if after and after[0] not in ids:
            raise GraphError(f"step {n.id!r} comes after unknown step {after[0]!r}")
        before[n.id] = after[0] if after else None
    roots = [i for i, b in before.items() if b is None]
    if roots != [ids[0]]:
        raise GraphError(f"only the first step may have no predecessor, not {roots}")
    for start in ids:
        seen, at = set(), start
        while at is not None:
            if at in seen:
                raise GraphError(f"steps form a cycle at {at!r}")
            seen.add(at)
            at = before[at]
    out: dict[str, list[str]] = {i: [] for i in ids}
    for i, b in before.items():
        if b is not None:
            out[b].append(i)
    return out


def leaves(successors: dict[str, list[str]]) -> list[str]:
    return [s for s, out in successors.items() if not out]
