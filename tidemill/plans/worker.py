"""A running worker over a stored ledger: loops that poll, keep leases alive, reclaim, sweep and sample.

Claims are committed before handlers run, so other workers see them, and the
leases of what is in hand are extended on a timer until the outcomes are
committed. A worker that dies leaves claims that lapse. All loops share one
store; a commit that another worker beats is made again on the newer version.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidemill.operators import fold as fold_ops
from tidemill.operators import transitions as X
from tidemill.operators.ledger import Ledger
from tidemill.plans import pipeline, readers
from tidemill.sources.store import Conflict, LedgerStore, checkpoint
from tidemill.telemetry import Observer


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class Worker:
    """``config`` is an ``app.Config``; ``clock`` gives the moment that transitions see."""

    store: LedgerStore
    jobs: list[pipeline.Job]
    config: object
    name: str = "worker"
    observer: Observer = field(default_factory=Observer)
    clock: Callable[[], datetime] = utc_now
    sample_every: timedelta | None = None
    threads: list[threading.Thread] = field(default_factory=list)

    def __post_init__(self):
        self._stop = threading.Event()
        self._commits = threading.RLock()
        self._swept_to: datetime | None = None
        self.failures: list[BaseException] = []

    def apply(self, change: Callable[[Ledger], object], tries: int = 5) -> object:
        """A transition on the newest version; made again if another worker commits first."""
        for left in range(tries - 1, -1, -1):
            try:
                with self._commits:
                    return self.store.apply(change)
            except Conflict:
                if not left:
                    raise
                time.sleep(0.05)

    def _held(self, ledger: Ledger):
        return ledger.items.where((F.col("state") == "running") & (F.col("leased_by") == self.name))

    def poll(self) -> int:
        """One round over all steps: claims up to the free capacity, runs handlers, commits outcomes; returns how many items it took."""
        total = 0
        for job in self.jobs:
            wired = job.wired()
            for step in job.steps:
                if self._stop.is_set():
                    return total
                total += self._work(job, step, wired)
        return total

    def _work(self, job: pipeline.Job, step: pipeline.Step, wired: dict[str, list[str]]) -> int:
        queue, now, began = job.queue(step.id), self.clock(), time.monotonic()

        def claim(g: Ledger):
            busy = self._held(g).where(F.col("queue") == queue).count()
            g, taken = X.claim(g, now, self.name, self.config.batch - busy, queue, self.config.lease)
            return g, checkpoint(taken)

        taken = self.apply(claim)
        n = taken.count()
        if not n:
            return 0
        self.observer.items_claimed(queue, n, time.monotonic() - began)
        self.observer.item_started(queue, step.id)
        done = threading.Event()
        beat = threading.Thread(target=self._beats, args=(done,), daemon=True)
        beat.start()
        try:
            made = pipeline.ran(job, step, wired, taken)
        finally:
            done.set()
            beat.join()
        ended = self.clock()
        releasing = self._stop.is_set()
        got = self.apply(lambda g: pipeline.settled(g, job, step, wired, made, taken, self.name, ended, releasing))
        took = time.monotonic() - began
        for outcome, count in got.by_outcome().items():
            if count:
                self.observer.item_finished(queue, step.id, outcome, count, took)
        if got.stuck:
            self.observer.item_stuck(queue, step.id, got.stuck, step.timeout)
        return n

    def _beats(self, done: threading.Event) -> None:
        while not done.wait(self.config.beat().total_seconds()):
            self.renew()

    def renew(self) -> int:
        """Extends the leases of what the worker holds."""
        now = self.clock()

        def change(g: Ledger):
            held = checkpoint(self._held(g).select(F.col("id").alias("ord"), "id", F.lit(self.name).alias("worker")))
            return X.extend_lease(g, held, now + self.config.lease, now)[0], held.count()

        n = self.apply(change)
        if n:
            self.observer.leases_renewed(self.name, n)
        return n

    def reclaim(self) -> tuple[int, int]:
        """Lapsed leases, a batch at a time until a batch is short."""
        back = dead = 0
        while True:
            row = self.apply(lambda g: X.reclaim_expired(g, self.clock(), self.config.reclaim_batch)).first()
            back, dead = back + row["reclaimed"], dead + row["dead_lettered"]
            if row["reclaimed"] + row["dead_lettered"] < self.config.reclaim_batch:
                break
        if back or dead:
            self.observer.leases_expired(back, dead)
        return back, dead

    def sweep(self) -> int:
        """One retention pass; tells how far behind it is if the budget ended it."""
        now, c = self.clock(), self.config
        labels = {j.name: list(j.labels) for j in self.jobs if j.labels}
        options = fold_ops.SweepOptions(c.retention, labels=labels, history=c.history)
        n = self.apply(lambda g: fold_ops.sweep_pass(g, options, now, c.folding, c.sweep_batch, c.sweep_budget))
        if n:
            self.observer.items_swept(n)
        behind = timedelta(0)
        if c.sweep_budget and n >= c.sweep_budget:
            oldest = fold_ops.due(self.store.load()[0], options, now).agg(F.min("finalized_at")).first()[0]
            behind = max(behind, fold_ops.cutoff(options, now) - oldest) if oldest else behind
        self.observer.sweep_backlog(behind)
        return n

    def sample(self) -> None:
        for row in readers.stats(self.store.load()[0], self.clock()).toLocalIterator():
            self.observer.queue_depth(row["queue"], row["ready"], row["running"], row["dlq"])

    def _loop(self, work: Callable[[], object], wait: Callable[[], timedelta], hurry: bool = False) -> None:
        while not self._stop.is_set():
            try:
                found = work()
            except Exception as e:  # a loop outlives a failed round
                self.failures.append(e)
                found = 0
            if not (hurry and found):
                self._stop.wait(wait().total_seconds())

    def start(self) -> None:
        """Launches the loops, each in a thread of its own."""
        c = self.config
        loops = [(self.poll, c.wait, True), (self.reclaim, lambda: c.reclaim_every, False), (self.sweep, lambda: c.sweep_every, False)]
        if self.sample_every:
            loops.append((self.sample, lambda: self.sample_every, False))
        self._stop.clear()
        self.threads = [threading.Thread(target=self._loop, args=loop, daemon=True) for loop in loops]
        for t in self.threads:
            t.start()

    def stop(self) -> int:
        """Claims no more, waits for what is in hand as long as ``config.drain``, and releases the rest; returns how many."""
        self._stop.set()
        until = time.monotonic() + self.config.drain.total_seconds()
        for t in self.threads:
            t.join(max(0.0, until - time.monotonic()))
        self.threads = []
        now = self.clock()

        def change(g: Ledger):
            held = checkpoint(self._held(g).select(F.col("id").alias("ord"), "id", F.lit(self.name).alias("worker")))
            return X.release(g, held, now)[0], held.count()

        return self.apply(change)
