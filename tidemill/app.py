"""One object over a stored ledger: queues with handlers, jobs, maintenance and readers."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import payload as P
from tidemill.functions.policy import DEFAULT, Policy
from tidemill.operators import fold as fold_ops
from tidemill.operators import transitions as X
from tidemill.operators.ledger import Ledger
from tidemill.plans import pipeline, projection, readers
from tidemill.plans.worker import Worker, utc_now
from tidemill.sources.store import LedgerStore


@dataclass(frozen=True)
class Config:
    """Defaults of the loops (fixed values, apart from ``batch``)."""

    poll: timedelta = timedelta(milliseconds=200)
    poll_jitter: float = 0.2
    lease: timedelta = timedelta(seconds=30)
    heartbeat: timedelta | None = None  # a third of the lease
    handler_timeout: timedelta = timedelta(minutes=5)
    drain: timedelta = timedelta(seconds=30)
    reclaim_every: timedelta = timedelta(seconds=5)
    reclaim_batch: int = 100
    retention: timedelta = timedelta(days=7)
    history: timedelta = timedelta(days=7)
    sweep_every: timedelta = timedelta(minutes=1)
    sweep_batch: int = 0  # 0: all that is due in one set operation
    sweep_budget: int = 0
    folding: bool = False
    flush_size: int = pipeline.FLUSH_SIZE
    flush_seconds: float = pipeline.FLUSH_SECONDS
    batch: int = 100_000

    def beat(self) -> timedelta:
        return self.heartbeat or self.lease / 3

    def wait(self, rng: random.Random | None = None) -> timedelta:
        """The poll interval with its jitter, a tenth of it at least."""
        spread = (rng or random).uniform(-self.poll_jitter, self.poll_jitter)
        return max(self.poll / 10, self.poll * (1 + spread))


@dataclass
class QueueJob(pipeline.Job):
    """A queue of its own with one terminal handler."""

    def queue(self, step: str) -> str:
        return self.name


@dataclass
class App:
    store: LedgerStore
    config: Config = field(default_factory=Config)
    worker: str = "app"
    observer: object = None
    jobs: dict[str, pipeline.Job] = field(default_factory=dict)
    policies: dict[str, Policy] = field(default_factory=dict)
    swept_at: datetime | None = None
    running: Worker | None = None

    def queue(self, name: str, handler: Callable, policy: Policy = DEFAULT, argument: str = "value") -> None:
        """Registers the handler of a queue; it takes a payload (see ``Step.argument``) and returns nothing."""
        job = QueueJob(name)
        job.step("handle", handler, policy=policy, timeout=self.config.handler_timeout.total_seconds(), argument=argument)
        self.jobs[name] = job
        self.policies[name] = policy

    def job(self, job: pipeline.Job) -> pipeline.Job:
        job.wired()
        self.jobs[job.name] = job
        return job

    def enqueue(self, queue: str, payloads: DataFrame, now: datetime, at: datetime | None = None, after: timedelta | None = None, policy: Policy | None = None) -> int:
        """Adds one item for each row of ``payloads`` (column ``payload``, and ``ord`` if their order matters); returns how many."""
        wrong = payloads.where(F.col("payload").isNotNull() & ~P.valid(F.col("payload"))).select("payload").first()
        if wrong is not None:
            raise ValueError(f"a payload is no JSON: {wrong['payload'][:80]!r}")
        due = at or (now + after if after else None)
        rows = payloads if "ord" in payloads.columns else payloads.withColumn("ord", F.monotonically_increasing_id())
        new = rows.select("ord", "payload", F.lit(queue).alias("queue"), (policy or self.policies.get(queue, DEFAULT)).column().alias("policy"))
        if due is not None:
            new = new.withColumn("available_at", F.lit(due.isoformat(sep=" ")).cast("timestamp_ntz"))
        return self.store.apply(lambda g: X.enqueue(g, new, now)).count()

    def run(self, job: str, payload, now: datetime) -> str:
        return self.store.apply(lambda g: self.jobs[job].run(g, payload, now))

    def tick(self, now: datetime) -> int:
        """One round: lapsed leases, every step of every job, and a sweep when it is time. One commit."""
        runner = pipeline.Runner(list(self.jobs.values()), self.worker, self.config.batch, self.config.lease, self.observer)
        sweeping = self.swept_at is None or now - self.swept_at >= self.config.sweep_every

        def change(g: Ledger):
            g, n = runner.tick(g, now)
            if sweeping:
                labels = {j.name: list(j.labels) for j in self.jobs.values() if j.labels}
                options = fold_ops.SweepOptions(self.config.retention, labels=labels, history=self.config.history)
                g, _ = fold_ops.sweep_pass(g, options, now, self.config.folding, self.config.sweep_batch, self.config.sweep_budget)
            return g, n

        n = self.store.apply(change)
        if sweeping:
            self.swept_at = now
        return n

    def start(self, **options) -> Worker:
        """Runs the loops in the background until ``stop``; options go to the worker."""
        if self.running is not None:
            raise RuntimeError("the app runs already")
        observer = {"observer": self.observer} if self.observer is not None else {}
        self.running = Worker(self.store, list(self.jobs.values()), self.config, self.worker, **observer, **options)
        self.running.start()
        return self.running

    def stop(self, now: datetime | None = None) -> None:
        """Ends the loops, if they run, and gives back what this worker still holds."""
        if self.running is not None:
            self.running.stop()
            self.running = None
        else:
            self.store.apply(lambda g: pipeline.Runner([], self.worker).drain(g, now or utc_now()))

    def ledger(self) -> Ledger:
        return self.store.load()[0]

    def stats(self, now: datetime, *queues: str) -> DataFrame:
        return readers.stats(self.ledger(), now, *queues)

    def execution(self, id: str) -> DataFrame:
        return readers.get_execution(self.ledger(), id)

    def executions(self, limit: int = 50) -> DataFrame:
        return readers.list_executions(self.ledger(), limit)

    def execution_steps(self, id: str) -> DataFrame:
        return readers.execution_steps(self.ledger(), id)

    def lineage(self, id: str, item: str) -> DataFrame:
        return readers.lineage(self.ledger(), id, item)

    def projection(self, id: str | None = None) -> projection.Projection:
        """Status and leaks of one run, or of all; counts and edges come from one version of the ledger."""
        g = self.ledger()
        edges = g.step_edges if id is None else g.step_edges.where(F.col("execution_id") == id)
        return projection.project(readers.step_counts(g, id), edges)
