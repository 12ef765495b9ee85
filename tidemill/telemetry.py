"""What happened, for observers; queue names only, never ids of items or runs."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener

# Outcomes an observer can hear of (fixed values).
OUTCOMES = ("success", "filtered", "retried", "dead_lettered", "released")


class Observer:
    """Hears what a runtime does; all methods do nothing here. They are called between batches and must not block."""

    def items_claimed(self, queue: str, n: int, seconds: float) -> None:
        """A claim that found work; empty polls are silent."""

    def item_started(self, queue: str, step: str) -> None:
        """A step's handlers begin on a batch."""

    def item_finished(self, queue: str, step: str, outcome: str, n: int, seconds: float) -> None:
        """So many attempts of a batch ended with one of OUTCOMES."""

    def item_stuck(self, queue: str, step: str, n: int, after: float) -> None:
        """Handlers that overran their time and were interrupted."""

    def leases_renewed(self, worker: str, n: int) -> None: ...

    def leases_expired(self, reclaimed: int, dead_lettered: int) -> None: ...

    def queue_depth(self, queue: str, ready: int, running: int, dlq: int) -> None: ...

    def items_swept(self, n: int) -> None: ...

    def sweep_backlog(self, behind) -> None:
        """How long before the cutoff the oldest item finished that a pass left for want of budget; zero if none."""


@dataclass
class Tally(Observer):
    """An observer that counts."""

    counts: Counter = field(default_factory=Counter)
    depths: dict[str, int] = field(default_factory=dict)

    def items_claimed(self, queue: str, n: int, seconds: float) -> None:
        self.counts[queue, "claimed"] += n

    def item_started(self, queue: str, step: str) -> None:
        self.counts[queue, "started"] += 1

    def item_finished(self, queue: str, step: str, outcome: str, n: int, seconds: float) -> None:
        self.counts[queue, outcome] += n
        if outcome in ("success", "filtered"):
            self.counts[queue, "completed"] += n

    def item_stuck(self, queue: str, step: str, n: int, after: float) -> None:
        self.counts[queue, "stuck"] += n

    def leases_renewed(self, worker: str, n: int) -> None:
        self.counts[worker, "renewed"] += n

    def leases_expired(self, reclaimed: int, dead_lettered: int) -> None:
        self.counts["leases", "reclaimed"] += reclaimed
        self.counts["leases", "dead_lettered"] += dead_lettered

    def queue_depth(self, queue: str, ready: int, running: int, dlq: int) -> None:
        self.depths[queue] = ready

    def items_swept(self, n: int) -> None:
        self.counts["sweep", "swept"] += n

    def sweep_backlog(self, behind) -> None:
        self.counts["sweep", "backlog"] = behind.total_seconds()


def sample_depth(ledger, now, observer: Observer) -> None:
    """Tells the depth of each queue; the queues of a ledger are few."""
    from tidemill.plans.readers import stats

    for row in stats(ledger, now).toLocalIterator():
        observer.queue_depth(row["queue"], row["ready"], row["running"], row["dlq"])


class Progress(StreamingQueryListener):
    """Rows and batches of streaming queries, by query name."""

    def __init__(self):
        self.rows: Counter = Counter()
        self.batches: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[p.name] += p.numInputRows
        self.batches[p.name] += 1

    def onQueryTerminated(self, event) -> None:
        pass
