"""Retention: deleting finished items, or folding them into saved counts.

After a fold every reader answers as before; only payload, policy and due time
of the folded items are gone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.payload import flags
from tidemill.operators.ledger import Ledger, at
from tidemill.plans.readers import DONE_WINDOW, KEY, done_since
from tidemill.schema import RETENTION_ZERO
from tidemill.sources.store import checkpoint

HISTORY = timedelta(days=7)
MAP = "map<string,bigint>"
MARKS = 8192  # pages of marked ids that every task holds, 32 MB


@dataclass(frozen=True)
class SweepOptions:
    """retention: a timedelta, or RETENTION_NEVER or RETENTION_ZERO. limit 0 sweeps all that is due at once."""

    retention: timedelta | int = timedelta(days=7)
    queue: str | None = None
    after: datetime | None = None
    limit: int = 0
    labels: dict[str, list[str]] = field(default_factory=dict)
    history: timedelta = HISTORY


@dataclass(frozen=True)
class Swept:
    count: int
    newest: datetime | None


def clean_labels(labels: dict[str, list[str]]) -> dict[str, list[str]]:
    """Flags by job without empty and repeated ones."""
    return {job: kept for job, names in labels.items() if (kept := list(dict.fromkeys(n for n in names if n)))}


def cutoff(options: SweepOptions, now: datetime) -> datetime | None:
    """Items finished before it are due; None if none ever are."""
    r = options.retention
    if isinstance(r, int) and not isinstance(r, timedelta):
        return now if r == RETENTION_ZERO else None if r < 0 else now - timedelta(days=7)
    if r < timedelta(0):
        return None
    return now - (r or timedelta(days=7))


def _is_due(options: SweepOptions, now: datetime) -> Column:
    """Whether an item is done with after <= finalized_at < cutoff; may be null for one that is not."""
    end = cutoff(options, now)
    if end is None:
        return F.lit(False)
    when = (F.col("state") == "done") & (F.col("finalized_at") < at(end))
    if options.after is not None:
        when &= F.col("finalized_at") >= at(options.after)
    return when & (F.col("queue") == options.queue) if options.queue else when


def due(ledger: Ledger, options: SweepOptions, now: datetime) -> DataFrame:
    """Done items with after <= finalized_at < cutoff, the oldest first if limited."""
    items = ledger.items.where(_is_due(options, now))
    return items.orderBy("finalized_at", "id").limit(options.limit) if options.limit > 0 else items


# What a fold reads of the items it takes; a sweep reads the first two.
TAKEN = ["id", "finalized_at", "queue", "outcome", "attempt", "max_attempts", *KEY, "item_id", "parent_item_id", "last_error", "produced", "dropped", "produced_capped", "created_at", "updated_at"]


def _take(ledger: Ledger, options: SweepOptions, now: datetime, *read) -> tuple[DataFrame, Swept]:
    """``read`` of what is due, computed once, and how much it is."""
    gone = checkpoint(due(ledger, options, now).select(*read))
    row = gone.agg(F.count("*").alias("n"), F.max("finalized_at").alias("newest")).first()
    return gone, Swept(row["n"], row["newest"])


def _split(attempts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts of the items ``gone``, and all others.

    The ids gone are a bit each, in pages of 4 KB that every task holds, so
    attempts stay where they are. Where ids lie so far apart that pages are
    more than MARKS, attempts and ids are joined by an exchange.
    """
    ids = gone.select("id").where("id IS NOT NULL")
    marks = checkpoint(ids.groupBy(F.bitmap_bucket_number("id").alias("__page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("__bits")))
    if marks.count() > MARKS:
        pk = ids.select(F.col("id").alias("item_pk"))
        return attempts.join(pk, "item_pk", "left_semi"), attempts.join(pk, "item_pk", "left_anti")
    met = attempts.withColumn("__at", F.bitmap_bucket_number("item_pk")).join(F.broadcast(marks), F.col("__at") == F.col("__page"), "left")
    place = F.bitmap_bit_position("item_pk")
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return met.where(hit).select(*attempts.columns), met.where(~hit).select(*attempts.columns)


def _without(ledger: Ledger, options: SweepOptions, now: datetime, gone: DataFrame, told: Swept) -> Ledger:
    """The ledger without the items ``gone``, which are all that is due, or the oldest if limited, and their attempts."""
    mine = _is_due(options, now)
    if options.limit > 0:
        end = F.col("finalized_at") == at(told.newest)
        last = gone.where(end).agg(F.max("id")).first()[0]
        mine &= (F.col("finalized_at") < at(told.newest)) | (end & (F.col("id") <= last))
    return ledger.having(items=ledger.items.where(~F.coalesce(mine, F.lit(False))), attempts=_split(ledger.attempts, gone)[1])


def sweep(ledger: Ledger, options: SweepOptions, now: datetime) -> tuple[Ledger, Swept]:
    """Deletes what is due, attempts with it."""
    gone, told = _take(ledger, options, now, "id", "finalized_at")
    return (_without(ledger, options, now, gone, told) if told.count else ledger), told


def history_from(now: datetime, keep: timedelta = HISTORY):
    return F.date_trunc("DAY", at(now - keep)).cast("timestamp_ntz")


def prepare(ledger: Ledger, now: datetime, keep: timedelta = HISTORY, window: timedelta = DONE_WINDOW) -> Ledger:
    """Drops history days that are past keeping, a day after they stop being written, and tallies that no reader counts."""
    first = F.date_sub(history_from(now, keep).cast("date"), 1)
    live = {"item_history": F.col("day") >= first, "done_hourly": F.col("hour") >= done_since(now, window)}
    changed = {t: ledger.frames[t].where(c) for t, c in live.items() if not ledger.frames[t].where(~c).isEmpty()}
    return ledger.having(**changed) if changed else ledger


def history_days(now: datetime, keep: timedelta = HISTORY) -> list:
    """Days that history is written for: from the oldest kept to two days ahead."""
    first, last = (now - keep).date(), now.date() + timedelta(days=2)
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def folded_counts(ledger: Ledger, gone: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """Saved counts with those of ``gone`` added."""
    items = gone.where("execution_id IS NOT NULL AND step_id IS NOT NULL")
    counts = items.groupBy(*KEY).agg(
        F.count_if(F.col("outcome") == "success").alias("succeeded"), F.count_if(F.col("outcome") == "filtered").alias("filtered"), F.sum("produced").alias("produced"),
        F.sum("dropped").alias("dropped"), F.count_if("produced_capped").alias("capped"), F.max(F.greatest("updated_at", "finalized_at")).alias("last_activity"),
    )
    sums = ["succeeded", "filtered", "produced", "dropped", "capped"]
    before = ledger.step_counts
    merged = before.select(*KEY, *sums, "last_activity").unionByName(counts).groupBy(*KEY).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums], F.max("last_activity").alias("last_activity"))
    tallies = before.select(*KEY, F.explode("filtered_by").alias("flag", "n"))
    if clean := clean_labels(labels):
        wanted = F.create_map(*[x for job, names in clean.items() for x in (F.lit(job), F.array(*map(F.lit, names)))])
        jobs = ledger.executions.select(F.col("id").alias("execution_id"), F.try_element_at(wanted, F.col("job")).alias("wanted"))
        filtered = items.where(F.col("outcome") == "filtered").select(*KEY, flags(F.col("payload")).alias("on")).join(jobs, "execution_id")
        found = filtered.select(*KEY, F.explode(F.filter("wanted", lambda name: F.try_element_at("on", name) == "true")).alias("flag"))
        tallies = tallies.unionByName(found.groupBy(*KEY, "flag").agg(F.count("*").alias("n")))
    # One entry for each flag of the step's job.
    by_flag = tallies.groupBy(*KEY, "flag").agg(F.sum("n").cast("bigint").alias("n"))
    maps = by_flag.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("filtered_by"))
    return merged.join(maps, KEY, "left").withColumn("filtered_by", F.coalesce("filtered_by", F.create_map().cast(MAP)))


def folded_hours(ledger: Ledger, gone: DataFrame) -> DataFrame:
    hours = gone.groupBy("queue", F.date_trunc("HOUR", "finalized_at").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("done"))
    return ledger.done_hourly.unionByName(hours).groupBy("queue", "hour").agg(F.sum("done").cast("bigint").alias("done"))


def folded_history(ledger: Ledger, gone: DataFrame, since) -> DataFrame:
    """History rows of items finished at ``since`` or later, with their attempts in order."""
    kept = gone.where(F.col("finalized_at") >= since)
    tries = _split(ledger.attempts, kept)[0].groupBy(F.col("item_pk").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "attempt", "worker", "started_at", "ended_at", "outcome", "error"))), lambda a: a.dropFields("id")).alias("attempts")
    )
    none = F.array().cast(dict(ledger.item_history.dtypes)["attempts"])
    return kept.join(tries, "id", "left").select(
        "id", "queue", "outcome", "attempt", "max_attempts", *KEY, "item_id", "parent_item_id", "last_error", "produced", "dropped", "produced_capped",
        "created_at", "finalized_at", F.coalesce("attempts", none).alias("attempts"), F.col("finalized_at").cast("date").alias("day"),
    )


def fold(ledger: Ledger, options: SweepOptions, now: datetime) -> tuple[Ledger, Swept]:
    """Deletes what is due and saves its counts, hourly tally and history in the same change."""
    # Payloads only tell the flags of filtered items.
    payload = F.when(F.col("outcome") == "filtered", F.col("payload")) if clean_labels(options.labels) else F.lit(None).cast("string")
    gone, told = _take(ledger, options, now, *TAKEN, payload.alias("payload"))
    if not told.count:
        return ledger, told
    history = folded_history(ledger, gone, history_from(now, options.history))
    after = _without(ledger, options, now, gone, told).having(
        step_counts=folded_counts(ledger, gone, options.labels), done_hourly=folded_hours(ledger, gone), item_history=ledger.item_history.unionByName(history)
    )
    return after, told


class Breaker:
    """Halves a batch after a failure and restores it after a success."""

    def __init__(self, size: int, least: int = 1):
        self.full, self.size, self.least = size, size, least

    def failed(self) -> int:
        self.size = max(self.least, self.size // 2)
        return self.size

    def succeeded(self) -> int:
        self.size = self.full
        return self.size


def sweep_pass(ledger: Ledger, options: SweepOptions, now: datetime, folding: bool = True, batch: int = 0, budget: int = 0) -> tuple[Ledger, int]:
    """One maintenance pass with a fixed cutoff: all that is due, or with a ``batch`` the oldest ``budget`` items.

    A change writes the ledger's tables anew, so pages of a fixed size would
    write them once for each page. All pages go in one change; only after a
    failure the pass goes on in pages of ``batch`` items, fewer after further
    failures, each from the last one's newest.
    """
    from dataclasses import replace

    step = fold if folding else sweep
    if folding:
        ledger = prepare(ledger, now, options.history)
    if batch <= 0:
        ledger, done = step(ledger, options, now)
        return ledger, done.count
    if budget < 0:
        return ledger, 0
    total, size, breaker = 0, budget, None
    while True:
        try:
            after, done = step(ledger, replace(options, limit=size), now)
            after = after.settled()
        except Exception:
            if breaker is None:
                breaker = Breaker(batch)
            elif breaker.size <= breaker.least:
                raise
            else:
                breaker.failed()
        else:
            ledger, total = after, total + done.count
            if breaker is None or done.count < size or total == budget:
                return ledger, total
            breaker.succeeded()
            options = replace(options, after=done.newest)
        size = min(breaker.size, budget - total) if budget else breaker.size
