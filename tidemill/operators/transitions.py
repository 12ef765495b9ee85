"""State changes of items as functions (ledger, requests, now) -> (ledger, results).

Guards are checked for each row; a request that fails its guard changes
nothing and fails no other. Of several requests for one item the first whose
guard holds wins. Results come with the requests' ``ord``; ``error_kind`` is
null for requests that took effect.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import payload as P
from tidemill.functions import policy as R
from tidemill.operators.ledger import Ledger, at, numbered
from tidemill.sources.store import checkpoint
from tidemill.schema import LAPSED, LEASE_LOST, NOT_FOUND, WRONG_STATE, base_of, columns, dlq_of

DEFAULT_BATCH = 100
WORKER_LENGTH = 128
LEASE = timedelta(minutes=1)


def _blank(c: Column) -> Column:
    return F.when(c != "", c)


def _set(items: DataFrame, hit: DataFrame, on: Column, **values: Column) -> DataFrame:
    """Items with columns replaced where ``hit`` (by id, with its columns at hand as __*) and ``on`` hold."""
    joined = items.join(hit, "id", "left")
    return joined.select(*[F.when(on, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in columns("items")])


def ensure_queues(ledger: Ledger, names: DataFrame, now) -> Ledger:
    """Adds the queues (column ``name``) that the ledger does not know."""
    fresh = checkpoint(names.where("name IS NOT NULL").select("name").distinct().join(ledger.queues, "name", "left_anti"))
    if fresh.isEmpty():
        return ledger
    fresh = fresh.select("name", F.lit(None).cast("timestamp_ntz").alias("paused_at"), at(now).alias("created_at"), at(now).alias("updated_at"))
    return ledger.having(queues=ledger.queues.unionByName(fresh))


def enqueue(ledger: Ledger, new_items: DataFrame, now, *order: str) -> tuple[Ledger, DataFrame]:
    """Adds items (columns of NEW_ITEM, missing ones as null) in the order of ``ord``, or of other columns; returns their rows."""
    for f in ("payload", "execution_id", "step_id", "item_id", "parent_item_id"):
        if f not in new_items.columns:
            new_items = new_items.withColumn(f, F.lit(None).cast("string"))
    if "available_at" not in new_items.columns:
        new_items = new_items.withColumn("available_at", F.lit(None).cast("timestamp_ntz"))
    if "policy" not in new_items.columns:
        new_items = new_items.withColumn("policy", R.DEFAULT.column())
    policy = F.coalesce("policy", R.DEFAULT.column())
    allowed = R.attempts_allowed(policy["max_attempts"])
    placed = numbered(new_items, ledger.next_item, *order)
    n = placed.count()
    made = placed.select(
        "id", "queue", P.or_empty(F.col("payload")).alias("payload"), F.lit("ready").alias("state"), F.lit(None).cast("string").alias("outcome"),
        F.lit(0).alias("attempt"), allowed.cast("int").alias("max_attempts"), F.coalesce("available_at", at(now)).alias("available_at"),
        F.lit(None).cast("string").alias("leased_by"), F.lit(None).cast("timestamp_ntz").alias("lease_until"),
        F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("last_worker"),
        *[_blank(F.col(c)).alias(c) for c in ("execution_id", "step_id", "item_id", "parent_item_id")],
        F.lit(0).alias("produced"), F.lit(0).alias("dropped"), F.lit(False).alias("produced_capped"),
        policy.withField("max_attempts", allowed.cast("int")).alias("policy"), at(now).alias("created_at"), at(now).alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("finalized_at"),
    )
    if not n:
        return ledger, made
    ledger = ensure_queues(ledger, made.select(F.col("queue").alias("name")), now)
    return ledger.having(items=ledger.items.unionByName(made), next_item=ledger.next_item + n), made


def claimable(ledger: Ledger, now) -> DataFrame:
    """Ready items whose time has come, of queues that are not paused."""
    paused = ledger.queues.where("paused_at IS NOT NULL").select(F.col("name").alias("queue"))
    return ledger.items.where((F.col("state") == "ready") & (F.col("available_at") <= at(now))).join(paused, "queue", "left_anti")


def claim(ledger: Ledger, now: datetime, worker: str, limit: int, queue: str | None = None, lease: timedelta = LEASE) -> tuple[Ledger, DataFrame]:
    """Takes up to ``limit`` items of a queue, or of each queue, by (available_at, id); returns their new rows in that order."""
    lease = lease if lease > timedelta(0) else LEASE
    worker = worker.encode()[:WORKER_LENGTH].decode(errors="ignore")
    ready = claimable(ledger, now)
    if limit <= 0:
        picked = ready.limit(0)
    elif queue is not None:
        picked = ready.where(F.col("queue") == queue).orderBy("available_at", "id").limit(limit)
    else:
        rank = F.row_number().over(Window.partitionBy("queue").orderBy("available_at", "id"))
        picked = ready.withColumn("__rank", rank).where(F.col("__rank") <= limit)
    # Both the items and the attempts need the same pick, and its size.
    picked = checkpoint(picked.select("id", F.lit(True).alias("__hit"), (F.col("attempt") + 1).alias("__attempt")))
    n = picked.count()
    if not n:
        return ledger, ledger.items.limit(0)
    hit = F.col("__hit").isNotNull()
    items = _set(
        ledger.items, picked, hit, state=F.lit("running"), attempt=F.col("attempt") + 1, leased_by=F.lit(worker), last_worker=F.lit(worker),
        lease_until=at(now) + F.expr(f"make_dt_interval(0, 0, 0, {lease.total_seconds():.6f})"), updated_at=at(now),
    )
    taken = items.join(picked.select("id"), "id", "left_semi")
    opened = numbered(picked.select(F.col("id").alias("item_pk"), F.col("__attempt").alias("attempt")), ledger.next_attempt, "item_pk").select(
        "id", "item_pk", "attempt", F.lit(worker).alias("worker"), at(now).alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("ended_at"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("error"),
    )
    ledger = ledger.having(items=items, attempts=ledger.attempts.unionByName(opened), next_attempt=ledger.next_attempt + n)
    return ledger, taken.orderBy("available_at", "id")


def _guarded(ledger: Ledger, requests: DataFrame, every: bool = False) -> DataFrame:
    """Requests that take effect: item running and owned (an empty worker owns all), the first for each item unless ``every``."""
    live = ledger.items.where(F.col("state") == "running").select("id", F.col("leased_by").alias("__owner"))
    owned = _blank(F.col("worker")).isNull() | (F.col("worker") == F.col("__owner"))
    held = requests.join(live, "id").where(owned).drop("__owner")
    if every:
        return held
    return held.withColumn("__turn", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("__turn = 1").drop("__turn")


def results(ledger: Ledger, requests: DataFrame, won: DataFrame) -> DataFrame:
    """RESULT for each request, in request order; refused ones tell the item's state after the batch."""
    known = ledger.items.select("id", "state", "leased_by").unionByName(ledger.item_history.select("id", F.lit("done").alias("state"), F.lit(None).cast("string").alias("leased_by")))
    told = requests.select("ord", "id").join(won.select("ord", F.lit(True).alias("__won")), "ord", "left").join(known, "id", "left")
    kind = F.when(F.col("__won"), F.lit(None)).when(F.col("state").isNull(), F.lit(NOT_FOUND)).otherwise(F.lit(WRONG_STATE))
    owner = F.coalesce("leased_by", F.lit("<none>"))
    text = F.when(F.col("__won"), F.lit(None)).when(F.col("state").isNull(), F.format_string("item not found: id %d", "id")).otherwise(F.format_string("item not in the expected state: id %d is %s (leased_by %s)", "id", "state", owner))
    return told.select("ord", "id", kind.cast("string").alias("error_kind"), text.cast("string").alias("error")).orderBy("ord")


def _closed(ledger: Ledger, ended: DataFrame, now) -> DataFrame:
    """Attempts with the open ones of items (id, __outcome, __error) closed."""
    joined = ledger.attempts.join(ended.select(F.col("id").alias("item_pk"), "__outcome", "__error"), "item_pk", "left")
    on = F.col("ended_at").isNull() & F.col("__outcome").isNotNull()
    return joined.select(
        "id", "item_pk", "attempt", "worker", "started_at", F.when(on, at(now)).otherwise(F.col("ended_at")).alias("ended_at"),
        F.when(on, F.col("__outcome")).otherwise(F.col("outcome")).alias("outcome"), F.when(on, F.col("__error")).otherwise(F.col("error")).alias("error"),
    )


def _with(requests: DataFrame, **defaults: str) -> DataFrame:
    for name, kind in defaults.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests


PRODUCED = "array<struct<queue:string,payload:string,available_at:timestamp_ntz,policy:struct<max_attempts:int,schedule_ns:array<bigint>,jitter:double>,execution_id:string,step_id:string,item_id:string,parent_item_id:string>>"


def _outputs(won: DataFrame) -> DataFrame:
    """New items of requests, to be numbered by request (``ord``) and then place in its list (``pos``)."""
    return won.select("ord", F.posexplode("produced").alias("pos", "new")).select("ord", "pos", "new.*")


def complete(ledger: Ledger, requests: DataFrame, now) -> tuple[Ledger, DataFrame]:
    """running -> done with outputs enqueued. Columns: ord, id, worker, produced (array of new items), filtered, dropped, capped."""
    requests = _with(requests, worker="string", produced=PRODUCED, filtered="boolean", dropped="int", capped="boolean")
    requests = requests.withColumn("produced", F.coalesce(F.col("produced").cast(PRODUCED), F.array().cast(PRODUCED)))
    won = checkpoint(_guarded(ledger, requests))
    if won.isEmpty():
        return ledger, results(ledger, requests, won)
    made = F.size("__produced")
    hits = won.select("id", F.col("produced").alias("__produced"), F.coalesce("filtered", F.lit(False)).alias("__filtered"), F.coalesce("dropped", F.lit(0)).alias("__dropped"), F.coalesce("capped", F.lit(False)).alias("__capped"))
    total = F.col("produced") + made
    items = _set(
        ledger.items, hits, F.col("__produced").isNotNull(), state=F.lit("done"), outcome=F.when(F.col("__filtered") & (total == 0), "filtered").otherwise("success"),
        produced=total.cast("int"), dropped=F.col("__dropped"), produced_capped=F.col("__capped"), leased_by=F.lit(None).cast("string"),
        lease_until=F.lit(None).cast("timestamp_ntz"), updated_at=at(now), finalized_at=at(now),
    )
    ended = items.join(won.select("id"), "id", "left_semi").select("id", F.col("outcome").alias("__outcome"), F.lit(None).cast("string").alias("__error"))
    after = ledger.having(items=items, attempts=_closed(ledger, ended, now))
    after, _ = enqueue(after, _outputs(won), now, "ord", "pos")
    return after, results(after, requests, won)


def emit(ledger: Ledger, requests: DataFrame, now) -> tuple[Ledger, DataFrame]:
    """Adds outputs of running items. Columns: ord, id, worker, attempt (0 or null: any), produced. A worker is needed."""
    requests = _with(requests, attempt="int", produced=PRODUCED)
    requests = requests.withColumn("produced", F.coalesce(F.col("produced").cast(PRODUCED), F.array().cast(PRODUCED)))
    live = ledger.items.where(F.col("state") == "running").select("id", F.col("leased_by").alias("__owner"), F.col("attempt").alias("__attempt"))
    asked = requests.where(F.size("produced") > 0)
    fits = (F.col("worker") == F.col("__owner")) & ((F.coalesce("attempt", F.lit(0)) <= 0) | (F.col("attempt") == F.col("__attempt")))
    won = checkpoint(asked.join(live, "id").where(fits).drop("__owner", "__attempt"))
    after = ledger
    if not won.isEmpty():
        added = won.groupBy("id").agg(F.sum(F.size("produced")).alias("__more"))
        items = _set(ledger.items, added, F.col("__more").isNotNull(), produced=(F.col("produced") + F.col("__more")).cast("int"), updated_at=at(now))
        after, _ = enqueue(ledger.having(items=items), _outputs(won), now, "ord", "pos")
    told = requests.select("ord", "id", (F.size("produced") == 0).alias("__idle")).join(won.select("ord", F.lit(True).alias("__won")), "ord", "left")
    fine = F.col("__idle") | F.col("__won").isNotNull()
    return after, told.select("ord", "id", F.when(~fine, F.lit(LEASE_LOST)).alias("error_kind"), F.when(~fine, F.format_string("lease lost: id %d", "id")).alias("error")).orderBy("ord")


def retry(ledger: Ledger, requests: DataFrame, now) -> tuple[Ledger, DataFrame]:
    """running -> ready after the policy's backoff, or at ``at``. Columns: ord, id, worker, error, at. Never dead-letters."""
    requests = _with(requests, worker="string", error="string", at="timestamp_ntz")
    won = checkpoint(_guarded(ledger, requests))
    if won.isEmpty():
        return ledger, results(ledger, requests, won)
    hits = won.select("id", F.lit(True).alias("__hit"), F.col("error").alias("__error"), F.col("at").alias("__at"))
    wait = R.jittered(R.backoff(F.col("attempt"), F.col("policy.schedule_ns")), F.col("policy.jitter"), R.spread(F.col("id"), F.col("attempt")))
    items = _set(
        ledger.items, hits, F.col("__hit").isNotNull(), state=F.lit("ready"), available_at=F.coalesce("__at", R.later(at(now), wait)), last_error=F.col("__error"),
        leased_by=F.lit(None).cast("string"), lease_until=F.lit(None).cast("timestamp_ntz"), updated_at=at(now),
    )
    ended = hits.select("id", F.lit("error").alias("__outcome"), "__error")
    after = ledger.having(items=items, attempts=_closed(ledger, ended, now))
    return after, results(after, requests, won)


def _buried(ledger: Ledger, hits: DataFrame, now) -> Ledger:
    """Items (id, __error) moved to their dead-letter queues."""
    marked = hits.withColumn("__hit", F.lit(True))
    items = _set(
        ledger.items, marked, F.col("__hit").isNotNull(), state=F.lit("dlq"), outcome=F.lit("dlq"), queue=dlq_of(F.col("queue")), last_error=F.col("__error"),
        leased_by=F.lit(None).cast("string"), lease_until=F.lit(None).cast("timestamp_ntz"), updated_at=at(now), finalized_at=at(now),
    )
    ended = hits.select("id", F.lit("dlq").alias("__outcome"), "__error")
    names = items.join(hits.select("id"), "id", "left_semi").select(F.col("queue").alias("name"))
    return ensure_queues(ledger.having(items=items, attempts=_closed(ledger, ended, now)), names, now)


def dead_letter(ledger: Ledger, requests: DataFrame, now) -> tuple[Ledger, DataFrame]:
    """running -> dlq in the queue's dead-letter queue. Columns: ord, id, worker, error."""
    requests = _with(requests, worker="string", error="string")
    won = checkpoint(_guarded(ledger, requests))
    if won.isEmpty():
        return ledger, results(ledger, requests, won)
    after = _buried(ledger, won.select("id", F.col("error").alias("__error")), now)
    return after, results(after, requests, won)


def release(ledger: Ledger, requests: DataFrame, now) -> tuple[Ledger, DataFrame]:
    """running -> ready at once, with the attempt given back and its open row dropped. Columns: ord, id, worker."""
    requests = _with(requests, worker="string")
    won = checkpoint(_guarded(ledger, requests))
    if won.isEmpty():
        return ledger, results(ledger, requests, won)
    items = _set(
        ledger.items, won.select("id", F.lit(True).alias("__hit")), F.col("__hit").isNotNull(), state=F.lit("ready"), attempt=F.greatest(F.col("attempt") - 1, F.lit(0)),
        available_at=at(now), leased_by=F.lit(None).cast("string"), lease_until=F.lit(None).cast("timestamp_ntz"), updated_at=at(now),
    )
    kept = ledger.attempts.join(won.select(F.col("id").alias("item_pk"), F.lit(True).alias("__hit")), "item_pk", "left").where("__hit IS NULL OR ended_at IS NOT NULL")
    after = ledger.having(items=items, attempts=kept)
    return after, results(after, requests, won)


def extend_lease(ledger: Ledger, requests: DataFrame, until: datetime, now) -> tuple[Ledger, DataFrame]:
    """Leases of owned running items last until ``until``; every request for an item succeeds. Columns: ord, id, worker."""
    requests = _with(requests, worker="string")
    won = checkpoint(_guarded(ledger, requests, every=True))
    if won.isEmpty():
        return ledger, results(ledger, requests, won)
    items = _set(ledger.items, won.select("id", F.lit(True).alias("__hit")).distinct(), F.col("__hit").isNotNull(), lease_until=at(until), updated_at=at(now))
    after = ledger.having(items=items)
    return after, results(after, requests, won)


def expired(ledger: Ledger, now, limit: int = DEFAULT_BATCH) -> DataFrame:
    """(id, dead) of items whose lease has run out, the oldest first."""
    late = ledger.items.where((F.col("state") == "running") & (F.col("lease_until") < at(now)))
    return late.orderBy("lease_until", "id").limit(limit if limit > 0 else DEFAULT_BATCH).select("id", (F.col("attempt") >= F.col("max_attempts")).alias("dead"))


def reclaim_expired(ledger: Ledger, now, limit: int = DEFAULT_BATCH) -> tuple[Ledger, DataFrame]:
    """Items of lapsed leases go back to ready, or to the dead letters after their last attempt; returns (reclaimed, dead_lettered)."""
    late = checkpoint(expired(ledger, now, limit))
    told = late.agg(F.count_if(~F.col("dead")).alias("reclaimed"), F.count_if("dead").alias("dead_lettered"))
    if late.isEmpty():
        return ledger, told
    back = late.where(~F.col("dead")).select("id", F.lit(True).alias("__hit"))
    items = _set(
        ledger.items, back, F.col("__hit").isNotNull(), state=F.lit("ready"), available_at=at(now), updated_at=at(now), last_error=F.lit(LAPSED),
        leased_by=F.lit(None).cast("string"), lease_until=F.lit(None).cast("timestamp_ntz"),
    )
    ended = back.select("id", F.lit("reclaimed").alias("__outcome"), F.lit(LAPSED).alias("__error"))
    after = ledger.having(items=items, attempts=_closed(ledger, ended, now))
    after = _buried(after, late.where("dead").select("id", F.lit(LAPSED).alias("__error")), now)
    return after, told


def _replayed(ledger: Ledger, queue: str, now, error_contains: str | None, limit: int | None) -> tuple[Ledger, int]:
    dead = ledger.items.where((F.col("queue") == queue) & (F.col("state") == "dlq"))
    if error_contains:
        dead = dead.where(F.ilike("last_error", F.lit(f"%{error_contains}%")))
    picked = checkpoint((dead if limit is None else dead.orderBy("id").limit(limit)).select("id", F.lit(True).alias("__hit")))
    n = picked.count()
    if n:
        items = _set(
            ledger.items, picked, F.col("__hit").isNotNull(), queue=base_of(F.col("queue")), state=F.lit("ready"), outcome=F.lit(None).cast("string"), attempt=F.lit(0),
            available_at=at(now), updated_at=at(now), finalized_at=F.lit(None).cast("timestamp_ntz"), leased_by=F.lit(None).cast("string"), lease_until=F.lit(None).cast("timestamp_ntz"),
        )
        ledger = ledger.having(items=items)
    target = ledger.spark.createDataFrame([(queue,)], "name string").select(base_of(F.col("name")).alias("name"))
    return ensure_queues(ledger, target, now), n


def replay(ledger: Ledger, queue: str, now, error_contains: str | None = None, limit: int = DEFAULT_BATCH) -> tuple[Ledger, int]:
    """Dead letters of a queue go back to work with a fresh budget, by id; ``%`` and ``_`` in the error text are wildcards."""
    return _replayed(ledger, queue, now, error_contains, limit if limit > 0 else DEFAULT_BATCH) if queue else (ledger, 0)


def drain(ledger: Ledger, queue: str, now, error_contains: str | None = None, most: int = 0) -> tuple[Ledger, int]:
    """Replays all dead letters of a queue, or ``most`` of them, in one change."""
    return _replayed(ledger, queue, now, error_contains, most if most > 0 else None) if queue else (ledger, 0)


def _pause_set(ledger: Ledger, queue: str, paused: bool, now) -> Ledger:
    named = ledger.spark.createDataFrame([(queue,)], "name string")
    ledger = ensure_queues(ledger, named, now)
    mine = F.col("name") == queue
    return ledger.having(
        queues=ledger.queues.select("name", F.when(mine, at(now) if paused else F.lit(None).cast("timestamp_ntz")).otherwise(F.col("paused_at")).alias("paused_at"), "created_at", F.when(mine, at(now)).otherwise(F.col("updated_at")).alias("updated_at"))
    )


def pause_queue(ledger: Ledger, queue: str, now) -> Ledger:
    """Stops claims on a queue, which is created if unknown."""
    return _pause_set(ledger, queue, True, now)


def resume_queue(ledger: Ledger, queue: str, now) -> Ledger:
    return _pause_set(ledger, queue, False, now)


def create_execution(ledger: Ledger, execution_id: str, job: str, steps: list[tuple[str, str, list[str]]], input_json: str, now, state: str = "running") -> Ledger:
    """Adds an execution with its steps, (id, queue, successors) each, and their edges."""
    spark = ledger.spark
    run = spark.createDataFrame([(execution_id, job, state, input_json)], "id string, job string, state string, input string")
    run = run.select("*", at(now).alias("created_at"), at(now).alias("updated_at"))
    rows = spark.createDataFrame([(execution_id, s, i, q) for i, (s, q, _) in enumerate(steps)], "execution_id string, step_id string, idx int, queue string")
    edges = spark.createDataFrame([(execution_id, s, t) for s, _, out in steps for t in out], "execution_id string, from_step_id string, to_step_id string")
    return ledger.having(executions=ledger.executions.unionByName(run), steps=ledger.steps.unionByName(rows), step_edges=ledger.step_edges.unionByName(edges))


def delete_item(ledger: Ledger, item: int) -> Ledger:
    """Loses an item and its attempts; for tests of leak detection."""
    return ledger.having(items=ledger.items.where(F.col("id") != item), attempts=ledger.attempts.where(F.col("item_pk") != item))

