"""Queries over a ledger. All answer for every execution or queue at once; arguments narrow them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.payload import flags
from tidemill.operators.ledger import Ledger, at
from tidemill.schema import columns

DONE_WINDOW = timedelta(days=7)
KEY = ["execution_id", "step_id"]


def _of(df: DataFrame, execution_id: str | None, column: str = "execution_id") -> DataFrame:
    return df if execution_id is None else df.where(F.col(column) == execution_id)


def done_since(now: datetime, window: timedelta = DONE_WINDOW):
    """The first hour that the done tally still counts."""
    return F.date_trunc("HOUR", at(now - window)).cast("timestamp_ntz")


def stats(ledger: Ledger, now: datetime, *queues: str, window: timedelta = DONE_WINDOW) -> DataFrame:
    """Per known queue: ready, running, done (live and folded within the window), dlq, paused."""
    names = ledger.queues.where(F.col("name").isin(*queues)) if queues else ledger.queues
    # Items shrink to a row for each queue before they meet anything.
    live = ledger.items.groupBy("queue").agg(*[F.count_if(F.col("state") == s).alias(f"live_{s}") for s in ("ready", "running", "done", "dlq")])
    tally = ledger.done_hourly.where(F.col("hour") >= done_since(now, window)).groupBy("queue").agg(F.sum("done").alias("folded"))
    joined = names.join(live, names["name"] == live["queue"], "left").drop("queue").join(tally, names["name"] == tally["queue"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return joined.select(
        F.col("name").alias("queue"), zero("live_ready").alias("ready"), zero("live_running").alias("running"),
        (zero("live_done") + zero("folded")).alias("done"), zero("live_dlq").alias("dlq"), F.col("paused_at").isNotNull().alias("paused"),
    ).orderBy("queue")


def step_counts(ledger: Ledger, execution_id: str | None = None) -> DataFrame:
    """Per step: received, succeeded, filtered, dlq, active, produced, dropped, capped; live items plus folded counts."""
    done = F.col("state") == "done"
    live = _of(ledger.items, execution_id).where("execution_id IS NOT NULL AND step_id IS NOT NULL").groupBy(*KEY).agg(
        F.count("*").alias("received"), F.count_if(done & (F.col("outcome") == "success")).alias("succeeded"), F.count_if(done & (F.col("outcome") == "filtered")).alias("filtered"),
        F.count_if(F.col("state") == "dlq").alias("dlq"), F.count_if(F.col("state").isin("ready", "running")).alias("active"),
        F.sum("produced").alias("produced"), F.sum("dropped").alias("dropped"), F.count_if("produced_capped").alias("capped"),
    )
    saved = ledger.step_counts.select(*KEY, *[F.col(c).alias(f"saved_{c}") for c in ("succeeded", "filtered", "produced", "dropped", "capped")])
    joined = _of(ledger.steps, execution_id).join(live, KEY, "left").join(saved, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    both = lambda c: (zero(c) + zero(f"saved_{c}")).alias(c)
    return joined.select(
        "execution_id", "step_id", "idx", "queue", (zero("received") + zero("saved_succeeded") + zero("saved_filtered")).alias("received"),
        both("succeeded"), both("filtered"), zero("dlq").alias("dlq"), zero("active").alias("active"), both("produced"), both("dropped"), both("capped"),
    ).orderBy("execution_id", "idx")


LINEAGE = ["execution_id", "step_id", "item_id", "id", "state", "outcome", "attempt", "last_error", "produced"]


def lineage(ledger: Ledger, execution_id: str, item_id: str) -> DataFrame:
    """Every step of an execution in order with what happened there to an item; state is null where it never came."""
    past = ledger.item_history.withColumn("state", F.lit("done"))
    found = [_of(f, execution_id).where(F.col("item_id") == item_id).select(*LINEAGE) for f in (ledger.items, past)]
    there = found[0].unionByName(found[1]).drop("execution_id", "item_id")
    return _of(ledger.steps, execution_id).select("step_id", "idx").join(there, "step_id", "left").orderBy("idx", "id")


def filtered_by_label(ledger: Ledger, execution_id: str | None, *labels: str) -> DataFrame:
    """(execution_id, step_id, label, n): filtered items whose payload has the flag, for every step and label."""
    names = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    asked = _of(ledger.steps, execution_id).select(*KEY, F.explode(names).alias("label"))
    items = _of(ledger.items, execution_id).where((F.col("state") == "done") & (F.col("outcome") == "filtered"))
    on = F.filter(names, lambda name: F.element_at(F.col("__flags"), name) == "true")
    live = items.select(*KEY, flags(F.col("payload")).alias("__flags")).select(*KEY, F.explode(on).alias("label")).groupBy(*KEY, "label").agg(F.count("*").alias("live"))
    saved = _of(ledger.step_counts, execution_id).select(*KEY, F.explode("filtered_by").alias("label", "saved"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return asked.join(live, [*KEY, "label"], "left").join(saved, [*KEY, "label"], "left").select(*KEY, "label", (zero("live") + zero("saved")).alias("n"))


def folded_items(ledger: Ledger) -> DataFrame:
    """History in the columns of items: done, without payload, policy and due time, and last touched when finished."""
    have = {
        "state": F.lit("done"), "payload": F.lit(None).cast("string"), "available_at": F.lit(None).cast("timestamp_ntz"), "leased_by": F.lit(None).cast("string"),
        "lease_until": F.lit(None).cast("timestamp_ntz"), "policy": F.lit(None), "updated_at": F.col("finalized_at"), "last_worker": F.try_element_at("attempts", F.lit(-1))["worker"],
    }
    types = dict(ledger.items.dtypes)
    return ledger.item_history.select(*[(have[c] if c in have else F.col(c)).cast(types[c]).alias(c) for c in columns("items")])


def get_item(ledger: Ledger, item: int) -> DataFrame:
    """An item by id, live or folded."""
    mine = F.col("id") == item
    return ledger.items.where(mine).unionByName(folded_items(ledger).where(mine))


ATTEMPTS = ["item_pk", "attempt", "seq", "worker", "started_at", "ended_at", "outcome", "error"]


def attempts(ledger: Ledger, item: int | None = None) -> DataFrame:
    """Attempts by (attempt, seq), of live items and of folded ones."""
    live = ledger.attempts.withColumnRenamed("id", "seq")
    past = ledger.item_history.select(F.col("id").alias("item_pk"), F.posexplode("attempts").alias("pos", "a")).select("item_pk", (F.col("pos") + 1).cast("bigint").alias("seq"), "a.*")
    both = live.select(*ATTEMPTS).unionByName(past.select(*ATTEMPTS))
    return (both if item is None else both.where(F.col("item_pk") == item)).orderBy("item_pk", "attempt", "seq")


def list_items(ledger: Ledger, queue: str | None = None, state: str | None = None, execution_id: str | None = None, step_id: str | None = None, item_id: str | None = None, error_contains: str | None = None, limit: int = 100) -> DataFrame:
    """Live items that meet all given conditions, the newest first."""
    df = ledger.items
    for column, value in (("queue", queue), ("state", state), ("execution_id", execution_id), ("step_id", step_id), ("item_id", item_id)):
        if value:
            df = df.where(F.col(column) == value)
    if error_contains:
        df = df.where(F.ilike("last_error", F.lit(f"%{error_contains}%")))
    return df.orderBy(F.desc("id")).limit(limit if limit > 0 else 100)


def get_execution(ledger: Ledger, execution_id: str) -> DataFrame:
    return ledger.executions.where(F.col("id") == execution_id)


def list_executions(ledger: Ledger, limit: int = 50) -> DataFrame:
    """The newest first."""
    return ledger.executions.orderBy(F.desc("created_at"), F.desc("id")).limit(limit if limit > 0 else 50)


def execution_steps(ledger: Ledger, execution_id: str | None = None) -> DataFrame:
    """Steps in order with their successors, sorted by id."""
    out = _of(ledger.step_edges, execution_id).groupBy("execution_id", F.col("from_step_id").alias("step_id")).agg(F.sort_array(F.collect_list("to_step_id")).alias("successors"))
    none = F.array().cast("array<string>")
    return _of(ledger.steps, execution_id).join(out, KEY, "left").select(*KEY, "idx", "queue", F.coalesce("successors", none).alias("successors")).orderBy("execution_id", "idx")


def queue_stats(ledger: Ledger, queue: str, now: datetime) -> dict:
    """One queue's row of ``stats`` as a dict; zeros when it is unknown."""
    row = stats(ledger, now, queue).first()
    return row.asDict() if row else {"queue": queue, "ready": 0, "running": 0, "done": 0, "dlq": 0, "paused": False}
