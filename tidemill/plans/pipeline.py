"""Jobs: named pipelines of handlers over the ledger.

A handler takes a decoded payload and returns None (terminal step), one output
(map), or a list of outputs (flatMap, empty to filter). A stream handler takes
an ``Out`` as well and emits in chunks. Handlers run in Python workers on the
executors, where their results are materialised once before any transition
reads them.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import signal
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.policy import DEFAULT, Policy
from tidemill.operators import transitions as X
from tidemill.operators.ledger import Ledger
from tidemill.plans import graph
from tidemill.sources.store import checkpoint

FLUSH_SIZE = 500
FLUSH_SECONDS = 1.0
TIMED_OUT = "handler timeout"
HANDLED = "id bigint, attempt int, outcome string, outputs array<array<string>>, error string"


class Discard(Exception):
    """Raised by a handler whose item should not be tried again."""


class OutClosed(RuntimeError):
    """The stream's handler has returned."""


class Overrun(BaseException):
    """Raised inside a handler whose time is up; not an Exception, so that handlers do not swallow it."""


class Out:
    """Outputs of a stream handler, in chunks of ``size`` or as old as ``seconds``; ages are checked as items come."""

    def __init__(self, size: int = FLUSH_SIZE, seconds: float = FLUSH_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.chunks: list[list[str]] = []
        self.buffer: list[str] = []
        self.since = clock()
        self.closed = False

    def add(self, value) -> None:
        if self.closed:
            raise OutClosed
        self.buffer.append(_json(value))
        if len(self.buffer) >= self.size or self.clock() - self.since >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.closed:
            raise OutClosed
        if self.buffer:
            self.chunks.append(self.buffer)
        self.buffer, self.since = [], self.clock()


def _json(value) -> str:
    if isinstance(value, bytes):
        value = value.decode()
        json.loads(value)
        return value
    return json.dumps(value, default=lambda o: o.__dict__)


@dataclass(frozen=True)
class Step:
    id: str
    handler: Callable
    after: tuple[str, ...] | None = None
    policy: Policy = DEFAULT
    concurrency: int = 1
    stream: bool = False
    flush_size: int = FLUSH_SIZE
    timeout: float = 300.0
    argument: str = "value"  # what the handler gets: the decoded value, the payload's "raw" bytes, or the "item" as a dict


ITEM = ("id", "queue", "attempt", "max_attempts", "execution_id", "step_id", "item_id", "parent_item_id")


@contextmanager
def limited(seconds: float):
    """Interrupts the block by Overrun once its time is up; where signals cannot reach it, it is found out at its end."""
    began = time.monotonic()
    timed = seconds > 0 and threading.current_thread() is threading.main_thread()

    def ring(*_):
        raise Overrun

    if timed:
        before = signal.signal(signal.SIGALRM, ring)
        signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
        if seconds > 0 and time.monotonic() - began > seconds:
            raise Overrun
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)


@dataclass
class Job:
    name: str
    labels: tuple[str, ...] = ()
    steps: list[Step] = field(default_factory=list)

    def step(self, id: str, handler: Callable, after: str | tuple[str, ...] | None = None, **options) -> Job:
        """Adds a step behind the last one, or behind ``after``; several steps behind one all get its output."""
        takes = len([p for p in inspect.signature(handler).parameters.values() if p.default is p.empty])
        if takes != (2 if options.get("stream") else 1):
            raise graph.GraphError(f"the handler of step {id!r} takes {takes} arguments")
        if options.get("argument", "value") not in ("value", "raw", "item"):
            raise graph.GraphError(f"step {id!r} asks for {options['argument']!r}; a handler gets a value, raw bytes or an item")
        self.steps.append(Step(id, handler, (after,) if isinstance(after, str) else after, **options))
        return self

    def wired(self) -> dict[str, list[str]]:
        return graph.build([graph.Node(s.id, s.after) for s in self.steps])

    def queue(self, step: str) -> str:
        return f"{self.name}.{step}"

    def run(self, ledger: Ledger, payload, now: datetime, execution_id: str | None = None) -> tuple[Ledger, str]:
        """Records an execution and its seed item in one change."""
        wired = self.wired()
        body = _json(payload)
        execution_id = execution_id or "exec_" + hashlib.sha256(f"{self.name}:{now.isoformat()}:{body}:{ledger.next_item}".encode()).hexdigest()[:24]
        ledger = X.create_execution(ledger, execution_id, self.name, [(s.id, self.queue(s.id), sorted(wired[s.id])) for s in self.steps], body, now)
        first = self.steps[0]
        item = new_id(execution_id, first.id, "0")
        seed = ledger.spark.createDataFrame([(0, self.queue(first.id), body, execution_id, first.id, item)], "ord bigint, queue string, payload string, execution_id string, step_id string, item_id string")
        ledger, _ = X.enqueue(ledger, seed.withColumn("policy", first.policy.column()), now)
        return ledger, execution_id


def new_id(*parts: str) -> str:
    """An item id that a recomputed task makes again."""
    return "item_" + hashlib.sha256("\0".join(parts).encode()).hexdigest()[:24]


def handle(items: DataFrame, step: Step) -> DataFrame:
    """HANDLED rows: what the step's handler made of each item.

    A payload that is no JSON, an exception and an overrun are errors of that
    item alone; a handler that overruns its time is interrupted, so the next
    item gets its turn.
    """
    fn, stream, size, timeout, argument = step.handler, step.stream, step.flush_size, step.timeout, step.argument

    def one(item: dict) -> tuple[str, list[list[str]], str | None]:
        out = Out(size)
        payload = item["payload"]
        try:
            value = payload.encode() if argument == "raw" else json.loads(payload)
            if argument == "item":
                value = {c: item.get(c) for c in ITEM} | {"payload": value}
            with limited(timeout):
                made = fn(value, out) if stream else fn(value)
            if stream:
                rest = out.buffer
                out.closed = True
                return "success" if out.chunks or rest else "filtered", [*out.chunks, rest], None
            if made is None:
                return "success", [[]], None
            many = made if isinstance(made, list) else [made]
            return ("success" if many else "filtered"), [[_json(m) for m in many]], None
        except Overrun:
            out.closed = True
            return "error", out.chunks if stream else [], TIMED_OUT
        except Discard as e:
            return "discard", out.chunks if stream else [], str(e)
        except Exception as e:  # the item's own failure
            return "error", out.chunks if stream else [], f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [one(item) for item in f.to_dict("records")]
            yield pd.DataFrame({"id": f["id"], "attempt": f["attempt"], "outcome": [r[0] for r in found], "outputs": [r[1] for r in found], "error": [r[2] for r in found]})

    names = dict.fromkeys(["id", "attempt", "payload", *(c for c in ITEM if argument == "item" and c in items.columns)])
    source = items.select(*names)
    return (source.repartition(step.concurrency) if step.concurrency > 1 else source).mapInPandas(run, HANDLED)


def routed(job: Job, step: Step, wired: dict[str, list[str]], handled: DataFrame, items: DataFrame) -> DataFrame:
    """handled with ``produced``: outputs of all chunks for each successor, with its policy and a shared item id.

    A map step's single output keeps its item's id; all others get ids of
    their own, made of the item, its attempt and the output's place.
    """
    by_id = {s.id: s for s in job.steps}
    lineage = items.select("id", "execution_id", "item_id")
    rows = handled.join(lineage, "id")
    flat = rows.withColumn("flat", F.flatten("outputs"))
    keeps = F.lit(not step.stream) & (F.size("flat") == 1)
    fresh = lambda i: F.concat(F.lit("item_"), F.substring(F.sha2(F.concat_ws(":", "item_id", "id", "attempt", i.cast("string")), 256), 1, 24))

    def made_for(to: str):
        s = by_id[to]
        return lambda value, i: F.struct(
            F.lit(job.queue(to)).alias("queue"), value.alias("payload"), F.lit(None).cast("timestamp_ntz").alias("available_at"), s.policy.column().alias("policy"), F.col("execution_id"),
            F.lit(to).alias("step_id"), F.when(keeps, F.col("item_id")).otherwise(fresh(i)).alias("item_id"), F.col("item_id").alias("parent_item_id"),
        )

    to = sorted(wired[step.id])
    if not to:
        return flat.withColumn("produced", F.array().cast(X.PRODUCED))
    lists = [F.transform("flat", made_for(t)) for t in to]
    return flat.withColumn("produced", F.concat(*lists).cast(X.PRODUCED))


@dataclass(frozen=True)
class Settled:
    success: int = 0
    filtered: int = 0
    retried: int = 0
    dead: int = 0
    released: int = 0
    stuck: int = 0

    @property
    def completed(self) -> int:
        return self.success + self.filtered

    def by_outcome(self) -> dict[str, int]:
        return {"success": self.success, "filtered": self.filtered, "retried": self.retried, "dead_lettered": self.dead, "released": self.released}


def ran(job: Job, step: Step, wired: dict[str, list[str]], taken: DataFrame) -> DataFrame:
    """What handlers made of claimed items, computed once, although several transitions read it."""
    made = checkpoint(routed(job, step, wired, handle(taken, step), taken))
    if not wired[step.id] and not made.where(F.size("flat") > 0).isEmpty():
        raise graph.GraphError(f"step {step.id!r} made output, but no step comes after it")
    return made


def settled(ledger: Ledger, job: Job, step: Step, wired: dict[str, list[str]], made: DataFrame, taken: DataFrame, worker: str, now: datetime, releasing: bool = False) -> tuple[Ledger, Settled]:
    """Puts the outcomes of ``ran`` into the ledger: done, dead after a discard or the last attempt, else tried again.

    ``releasing``: the worker is stopping, so items whose handler failed are given back with their attempt.
    """
    asked = made.select(F.col("id").alias("ord"), "*").withColumn("worker", F.lit(worker))
    n = {r["outcome"]: r["n"] for r in asked.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    done = asked.where(F.col("outcome").isin("success", "filtered"))
    if n.get("success") or n.get("filtered"):
        ledger, _ = X.complete(ledger, done.select("ord", "id", "worker", "produced", (F.col("outcome") == "filtered").alias("filtered")), now)
    failed = asked.where(F.col("outcome").isin("error", "discard"))
    dead = retried = released = stuck = 0
    if n.get("error") or n.get("discard"):
        if step.stream:  # what was flushed before the failure stays
            ledger, _ = X.emit(ledger, failed.select("ord", "id", "worker", "attempt", "produced"), now)
        budget = taken.select("id", (F.col("attempt") >= F.col("max_attempts")).alias("spent"))
        failed = checkpoint(failed.join(budget, "id"))
        stuck = failed.where(F.col("error") == TIMED_OUT).count()
        over = F.col("outcome") == "discard" if releasing else (F.col("outcome") == "discard") | F.col("spent")
        dead = failed.where(over).count()
        rest = failed.count() - dead
        if dead:
            ledger, _ = X.dead_letter(ledger, failed.where(over).select("ord", "id", "worker", "error"), now)
        if rest and releasing:
            ledger, released = X.release(ledger, failed.where(~over).select("ord", "id", "worker"), now)[0], rest
        elif rest:
            ledger, retried = X.retry(ledger, failed.where(~over).select("ord", "id", "worker", "error"), now)[0], rest
    return ledger.settled(), Settled(n.get("success", 0), n.get("filtered", 0), retried, dead, released, stuck)


def settle(ledger: Ledger, job: Job, step: Step, wired: dict[str, list[str]], taken: DataFrame, worker: str, now: datetime) -> tuple[Ledger, Settled]:
    """Runs a step on claimed items and puts the outcomes into the ledger."""
    return settled(ledger, job, step, wired, ran(job, step, wired, taken), taken, worker, now)


@dataclass
class Runner:
    """Drives jobs in micro-batches: claim, run, settle, one step after the other."""

    jobs: list[Job]
    worker: str = "runner"
    batch: int = 100_000
    lease: timedelta = timedelta(seconds=30)
    observer: object = None

    def tick(self, ledger: Ledger, now: datetime) -> tuple[Ledger, int]:
        """One round over all steps; returns how many items it settled."""
        total = 0
        ledger, lapsed = X.reclaim_expired(ledger, now)
        ledger = ledger.settled()
        for job in self.jobs:
            wired = job.wired()
            for step in job.steps:
                ledger, taken = X.claim(ledger, now, self.worker, self.batch, job.queue(step.id), self.lease)
                ledger = ledger.settled()
                mine = (F.col("leased_by") == self.worker) & (F.col("queue") == job.queue(step.id)) & (F.col("state") == "running")
                taken = ledger.items.where(mine & (F.col("updated_at") == F.lit(now.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")))
                if taken.isEmpty():
                    continue
                ledger, got = settle(ledger, job, step, wired, taken, self.worker, now)
                total += got.completed + got.retried + got.dead
                if self.observer is not None:
                    for outcome, count in got.by_outcome().items():
                        if count:
                            self.observer.item_finished(job.queue(step.id), step.id, outcome, count, 0.0)
        return ledger, total

    def run(self, ledger: Ledger, now: datetime, rounds: int = 100) -> Ledger:
        """Rounds until one finds nothing that is due at ``now``."""
        for _ in range(rounds):
            ledger, n = self.tick(ledger, now)
            if not n:
                return ledger
        return ledger

    def drain(self, ledger: Ledger, now: datetime) -> Ledger:
        """Gives back what the worker still holds."""
        held = ledger.items.where((F.col("state") == "running") & (F.col("leased_by") == self.worker)).select(F.col("id").alias("ord"), "id", F.lit(self.worker).alias("worker"))
        return X.release(ledger, checkpoint(held), now)[0].settled()

    def heartbeat(self, ledger: Ledger, now: datetime) -> Ledger:
        """Extends the leases of what the worker holds."""
        held = ledger.items.where((F.col("state") == "running") & (F.col("leased_by") == self.worker)).select(F.col("id").alias("ord"), "id", F.lit(self.worker).alias("worker"))
        return X.extend_lease(ledger, checkpoint(held), now + self.lease, now)[0]
