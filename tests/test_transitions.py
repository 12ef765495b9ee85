"""State changes: guards, results, order and fan-out."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions.policy import Policy
from tidemill.operators import transitions as X
from tidemill.operators.ledger import new_ledger
from tidemill.plans import readers
from tidemill.schema import LEASE_LOST, NOT_FOUND, WRONG_STATE, violations

T0 = datetime(2026, 10, 1, 9)
ASK = "ord bigint, id bigint, worker string, error string"


def later(**kw):
    return T0 + timedelta(**kw)


@pytest.fixture
def three(spark):
    """Three ready items of queue q."""
    new = spark.createDataFrame([(i, "q", f'{{"n":{i}}}') for i in range(3)], "ord bigint, queue string, payload string")
    g, made = X.enqueue(new_ledger(spark), new, T0)
    assert [r.id for r in made.orderBy("id").collect()] == [1, 2, 3]
    return g.settled()


def claimed(g, n=3, worker="w1", now=T0, **kw):
    g, taken = X.claim(g, now, worker, n, "q", **kw)
    ids = [r.id for r in taken.collect()]
    return g.settled(), ids


def ask(spark, *rows):
    return spark.createDataFrame([(i, id, w, e) for i, (id, w, e) in enumerate(rows)], ASK)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(columns[0]).collect()]


def test_enqueue_defaults_and_queues(three):
    item = three.items.where("id = 1").first()
    assert (item.state, item.attempt, item.max_attempts, item.available_at, item.policy.jitter) == ("ready", 0, 5, T0, 0.1)
    assert [r.name for r in three.queues.collect()] == ["q"]


def test_claim_takes_due_items_in_order(spark, three):
    g = three.having(items=three.items.withColumn("available_at", F.when(F.col("id") == 1, F.lit("2026-10-01 10:00:00").cast("timestamp_ntz")).otherwise(F.col("available_at"))))
    g, ids = claimed(g, 5)
    assert ids == [2, 3]
    assert rows(g.items, "id", "state", "attempt", "leased_by") == [(1, "ready", 0, None), (2, "running", 1, "w1"), (3, "running", 1, "w1")]
    assert g.attempts.count() == 2 and violations(g.items).isEmpty()
    assert claimed(g, 5, now=later(hours=1))[1] == [1]
    assert claimed(g, 0, now=later(hours=2))[1] == []


def test_paused_queue_gives_nothing(three):
    paused = X.pause_queue(three, "q", T0)
    assert claimed(paused)[1] == []
    assert claimed(X.resume_queue(paused, "q", T0))[1] == [1, 2, 3]
    assert readers.queue_stats(X.pause_queue(three, "new", T0), "new", T0)["paused"]


def test_worker_names_are_cut_at_128_bytes(three):
    g, _ = claimed(three, 1, worker="é" * 100)
    assert len(g.items.where("id = 1").first().leased_by.encode()) == 128


def test_mixed_batch_reports_each_request(spark, three):
    g, _ = claimed(three, 2)
    requests = ask(spark, (1, "w1", None), (1, "w1", None), (2, "other", None), (3, "w1", None), (99, "w1", None), (2, "", None))
    g, result = X.complete(g, requests.drop("error"), later(seconds=1))
    got = [(r.ord, r.error_kind, r.error) for r in result.collect()]
    assert [k for _, k, _ in got] == [None, WRONG_STATE, WRONG_STATE, WRONG_STATE, NOT_FOUND, None]
    assert got[1][2].endswith("id 1 is done (leased_by <none>)") and got[2][2].endswith("id 2 is done (leased_by <none>)") and got[4][2].endswith("id 99")
    assert rows(g.items, "id", "state", "outcome") == [(1, "done", "success"), (2, "done", "success"), (3, "ready", None)]
    assert [r.outcome for r in g.attempts.collect()] == ["success", "success"]


def outputs(spark, request, *payloads, worker="w1", **more):
    new = F.array(*[F.struct(F.lit("next").alias("queue"), F.lit(p).alias("payload"), *[F.lit(None).alias(c) for c in ("available_at", "policy", "execution_id", "step_id")], F.lit("i").alias("item_id"), F.lit("p").alias("parent_item_id")) for p in payloads]) if payloads else F.array()
    return spark.createDataFrame([(0, request, worker)], "ord bigint, id bigint, worker string").select("*", new.cast(X.PRODUCED).alias("produced"), *[F.lit(v).alias(k) for k, v in more.items()])


def test_complete_fans_out_only_if_it_wins(spark, three):
    g, _ = claimed(three)
    g, _ = X.complete(g, outputs(spark, 1, "{}", "[]"), T0)
    g, refused = X.complete(g, outputs(spark, 1, "{}"), T0)
    assert refused.first().error_kind == WRONG_STATE
    assert rows(g.items.where("queue = 'next'"), "id", "payload", "item_id") == [(4, "{}", "i"), (5, "[]", "i")]
    assert g.items.where("id = 1").first().produced == 2


def test_filtered_is_success_once_something_was_produced(spark, three):
    g, _ = claimed(three)
    g, _ = X.complete(g, outputs(spark, 1, filtered=True, dropped=4, capped=True), T0)
    g, _ = X.emit(g, outputs(spark, 2, "{}"), T0)
    g, _ = X.complete(g, outputs(spark, 2, filtered=True), T0)
    assert rows(g.items.where("id < 3"), "id", "outcome", "produced", "dropped", "produced_capped") == [(1, "filtered", 0, 4, True), (2, "success", 1, 0, False)]


def test_emit_is_fenced_by_worker_and_attempt(spark, three):
    g, _ = claimed(three, 1)
    for request, kind in ((outputs(spark, 1, "{}", attempt=1), None), (outputs(spark, 1, "{}", attempt=2), LEASE_LOST), (outputs(spark, 1, "{}", worker="x"), LEASE_LOST), (outputs(spark, 1, "{}", worker=""), LEASE_LOST), (outputs(spark, 1), None), (outputs(spark, 2, "{}"), LEASE_LOST)):
        g, result = X.emit(g, request, T0)
        assert result.first().error_kind == kind
    assert g.items.where("queue = 'next'").count() == 1


def test_retry_waits_by_the_schedule_of_the_item(spark):
    policy = Policy(9, (5 * 10**9, 30 * 10**9), 0.0)
    new = spark.createDataFrame([(0, "q")], "ord bigint, queue string").withColumn("policy", policy.column())
    g, _ = X.enqueue(new_ledger(spark), new, T0)
    now = T0
    for wait in (5, 30, 30):
        g, ids = claimed(g, 1, now=now)
        g, _ = X.retry(g, ask(spark, (1, "w1", "boom")), now)
        g = g.settled()
        item = g.items.first()
        assert ids == [1] and item.available_at == now + timedelta(seconds=wait) and item.last_error == "boom" and item.outcome is None
        now = item.available_at
    assert [r.outcome for r in g.attempts.collect()] == ["error"] * 3


def test_release_gives_the_attempt_back(spark, three):
    g, _ = claimed(three, 1)
    g, _ = X.release(g, ask(spark, (1, "w1", None)), T0)
    assert (g.items.where("id = 1").first().attempt, g.attempts.count()) == (0, 0)


def test_dead_letter_and_replay(spark, three):
    g, _ = claimed(three)
    g, _ = X.dead_letter(g, ask(spark, (1, "w1", "bad_one"), (2, "w1", "other")), T0)
    g = g.settled()
    assert rows(g.items.where("state = 'dlq'"), "id", "queue", "outcome", "attempt") == [(1, "q.dlq", "dlq", 1), (2, "q.dlq", "dlq", 1)]
    assert {r.queue: r.dlq for r in readers.stats(g, T0).collect()} == {"q": 0, "q.dlq": 2}
    g, n = X.replay(g, "q.dlq", T0, "BAD%one")
    assert n == 1 and rows(g.items.where("id = 1"), "id", "queue", "state", "attempt", "outcome") == [(1, "q", "ready", 0, None)]
    assert X.drain(g, "q.dlq", T0)[1] == 1
    assert X.replay(g, "", T0)[1] == 0


def test_leases_lapse_strictly_and_late_acks_still_count(spark, three):
    g, _ = claimed(three, 2, lease=timedelta(seconds=10))
    g, n = X.reclaim_expired(g, later(seconds=10))
    assert tuple(n.first()) == (0, 0)
    g, _ = X.complete(g, ask(spark, (1, "w1", None)).drop("error"), later(seconds=20))
    g, n = X.reclaim_expired(g.settled(), later(seconds=20))
    assert tuple(n.first()) == (1, 0)
    assert rows(g.items, "id", "state", "attempt") == [(1, "done", 1), (2, "ready", 1), (3, "ready", 0)]
    assert {r.outcome for r in g.attempts.collect()} == {"success", "reclaimed"}


def test_last_attempt_of_a_lapsed_lease_is_dead(spark):
    new = spark.createDataFrame([(0, "q")], "ord bigint, queue string").withColumn("policy", Policy(1, (), 0.0).column())
    g, _ = X.enqueue(new_ledger(spark), new, T0)
    g, _ = claimed(g, 1)
    g, n = X.reclaim_expired(g, later(hours=1))
    assert tuple(n.first()) == (0, 1) and g.items.first().queue == "q.dlq" and violations(g.items).isEmpty()


def test_extend_lease_lets_every_request_win(spark, three):
    g, _ = claimed(three, 1)
    g, result = X.extend_lease(g, ask(spark, (1, "w1", None), (1, "w1", None), (1, "x", None)), later(hours=2), T0)
    assert [r.error_kind for r in result.collect()] == [None, None, WRONG_STATE]
    assert g.items.where("id = 1").first().lease_until == later(hours=2)
