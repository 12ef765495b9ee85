"""The item state machine as a stateful stream, keyed by item.

Operations come as rows (id, ord, op, worker, at); each key keeps its item's
state, owner, attempt and lease between batches. The same function serves a
batch of operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPERATIONS = ("enqueue", "claim", "complete", "retry", "dead_letter", "release", "expire")
OUT = "id bigint, ord bigint, op string, accepted boolean, state string, attempt int, owner string"
STATE = "state string, attempt int, owner string, lease_until double"
LEASE = 30.0
MAX_ATTEMPTS = 5


def step(held: tuple, op: str, worker: str | None, at: float, lease: float = LEASE, most: int = MAX_ATTEMPTS) -> tuple[tuple, bool]:
    """The state (state, attempt, owner, lease_until) after an operation, and whether it took effect.

    An item is made once, claimed when ready, and left by its owner (an empty
    worker is any); a lapsed lease still belongs to its owner until it is
    reclaimed, which needs a time strictly after it.
    """
    state, attempt, owner, until = held
    if op == "enqueue":
        return (("ready", 0, None, 0.0), True) if state is None else (held, False)
    if op == "claim":
        return (("running", attempt + 1, worker, at + lease), True) if state == "ready" else (held, False)
    if op == "expire":
        if state != "running" or not until < at:
            return held, False
        return (("dlq" if attempt >= most else "ready", attempt, None, 0.0), True)
    if state != "running" or (worker and worker != owner):
        return held, False
    if op == "complete":
        return ("done", attempt, None, 0.0), True
    if op == "dead_letter":
        return ("dlq", attempt, None, 0.0), True
    if op == "retry":
        return ("ready", attempt, None, 0.0), True
    if op == "release":
        return ("ready", max(0, attempt - 1), None, 0.0), True
    return held, False


def _advance(key: int, held: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    out = []
    for r in rows.sort_values("ord").itertuples(index=False):
        worker = None if r.worker is None or r.worker != r.worker else r.worker
        held, took = step(held, r.op, worker, float(r.at))
        out.append((key, r.ord, r.op, took, held[0], held[1], held[2]))
    return held, out


_NAMES = [c.split()[0] for c in OUT.split(", ")]
_NONE = (None, 0, None, 0.0)


def run_stream(operations: DataFrame) -> DataFrame:
    """OUT rows of a stream of operations, in each item's order of ``ord`` within a batch."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else _NONE
        # One item has few operations in a batch; they must be put in order.
        rows = pd.concat(list(frames))
        held, out = _advance(key[0], held, rows)
        state.update(held)
        yield pd.DataFrame(out, columns=_NAMES)

    return operations.groupBy("id").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_batch(operations: DataFrame) -> DataFrame:
    """OUT rows of a table of operations."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_advance(key[0], _NONE, rows)[1], columns=_NAMES)

    return operations.groupBy("id").applyInPandas(work, OUT)
