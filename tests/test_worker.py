"""The running worker, its loops and what observers hear."""

import io
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill import cli
from tidemill.app import App, Config
from tidemill.functions.policy import Policy, no_retry
from tidemill.operators import transitions as X
from tidemill.operators.ledger import new_ledger
from tidemill.plans import graph, pipeline
from tidemill.plans.worker import Worker
from tidemill.sources.store import LedgerStore, import_jdbc, migrate
from tidemill.telemetry import Tally

NOW = datetime(2026, 10, 1)


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_loops_run_until_stopped(spark, tmp_path):
    tally = Tally()
    app = App(LedgerStore(spark, f"file://{tmp_path}/l"), Config(poll=timedelta(milliseconds=20), reclaim_every=timedelta(seconds=1), sweep_every=timedelta(seconds=60)), observer=tally)
    app.queue("mail", lambda mail: None)
    app.job(pipeline.Job("doc").step("split", lambda d: [{"i": i} for i in range(d["n"])]).step("sink", lambda d: None))
    app.enqueue("mail", payloads(spark, "1", "2"), datetime(2020, 1, 1))
    run = app.run("doc", {"n": 3}, datetime(2020, 1, 1))
    worker = app.start(sample_every=timedelta(seconds=1))
    with pytest.raises(RuntimeError):
        app.start()
    until = time.monotonic() + 120
    while time.monotonic() < until and app.projection(run).summary.first().status != "COMPLETE" or tally.counts["mail", "success"] < 2:
        time.sleep(0.5)
    app.stop()
    assert worker.failures == [] and app.running is None
    assert app.projection(run).summary.first().terminal_success == 3
    assert tally.counts["mail", "claimed"] == tally.counts["mail", "success"] == 2 and tally.counts["doc.sink", "success"] == 3


def test_claims_are_visible_and_leases_are_renewed(spark, tmp_path):
    store, tally, moment = LedgerStore(spark, f"file://{tmp_path}/l"), Tally(), [NOW]
    job = pipeline.Job("slow").step("one", lambda x: time.sleep(2.5))
    worker = Worker(store, [job], Config(lease=timedelta(seconds=3), batch=1), "me", tally, lambda: moment[0])
    store.apply(lambda g: X.enqueue(g, payloads(spark, "1", "2").selectExpr("monotonically_increasing_id() AS ord", "payload", "'slow.one' AS queue"), NOW))
    assert worker.poll() == 1 and tally.counts["me", "renewed"] >= 1  # a beat is a third of the lease
    store.apply(lambda g: X.claim(g, NOW, "gone", 1, "slow.one"))
    moment[0] = NOW + timedelta(minutes=10)
    assert worker.reclaim() == (1, 0) and tally.counts["leases", "reclaimed"] == 1
    store.apply(lambda g: X.claim(g, moment[0], "me", 1, "slow.one"))
    assert worker.poll() == 0  # it holds as much as it may
    assert worker.stop() == 1 and store.load()[0].items.where("state = 'ready' AND attempt = 1").count() == 1


def test_overruns_are_interrupted(spark):
    job = pipeline.Job("j").step("hang", lambda x: time.sleep(60) if x == 1 else None, timeout=0.5, policy=no_retry())
    items = spark.createDataFrame([(i, 1, str(i)) for i in (1, 2)], "id bigint, attempt int, payload string")
    began = time.monotonic()
    got = {r.id: (r.outcome, r.error) for r in pipeline.handle(items.coalesce(1), job.steps[0]).collect()}
    assert got == {1: ("error", "handler timeout"), 2: ("success", None)} and time.monotonic() - began < 30


def test_handlers_get_values_bytes_or_items(spark):
    items = spark.createDataFrame([(7, 2, '{"a": 1}', "q", "i1")], "id bigint, attempt int, payload string, queue string, item_id string")
    out = {}
    for argument in ("value", "raw", "item"):
        step = pipeline.Step("s", lambda x: {"got": x.decode() if isinstance(x, bytes) else x}, argument=argument)
        out[argument] = pipeline.handle(items, step).first().outputs[0][0]
    assert out["value"] == '{"got": {"a": 1}}' and out["raw"] == '{"got": "{\\"a\\": 1}"}'
    assert '"id": 7' in out["item"] and '"item_id": "i1"' in out["item"] and '"payload": {"a": 1}' in out["item"]
    with pytest.raises(graph.GraphError):
        pipeline.Job("j").step("s", lambda x: x, argument="all")


def test_bad_payloads_are_refused(spark, tmp_path):
    app = App(LedgerStore(spark, f"file://{tmp_path}/l"))
    app.queue("mail", lambda mail: None)
    with pytest.raises(ValueError, match="no JSON"):
        app.enqueue("mail", payloads(spark, "{}", "{oops"), NOW)
    assert app.enqueue("mail", payloads(spark, None, "[1]"), NOW) == 2 and app.stats(NOW, "mail").first().ready == 2


def test_sweeps_tell_their_backlog(spark, tmp_path):
    store, tally = LedgerStore(spark, f"file://{tmp_path}/l"), Tally()
    g, _ = X.enqueue(new_ledger(spark), payloads(spark, *"123").selectExpr("monotonically_increasing_id() AS ord", "payload", "'q' AS queue"), NOW)
    done = g.items.withColumns({"state": F.lit("done"), "outcome": F.lit("success"), "finalized_at": F.expr("timestamp_ntz '2026-10-01 00:00:00' + make_dt_interval(0, cast(id AS int))")})
    store.apply(lambda empty: empty.having(items=done, next_item=g.next_item))
    c = Config(retention=timedelta(days=1), sweep_batch=1, sweep_budget=2)
    worker = Worker(store, [], c, "me", tally, lambda: datetime(2026, 10, 2, 12))
    assert worker.sweep() == 2 and tally.counts["sweep", "backlog"] == 9 * 3600
    assert worker.sweep() == 1 and tally.counts["sweep", "backlog"] == 0 and tally.counts["sweep", "swept"] == 3


def test_migrations_go_both_ways(spark, tmp_path):
    root = f"file://{tmp_path}/l"
    store = LedgerStore(spark, root)
    store.apply(lambda g: X.enqueue(g, payloads(spark, "1").selectExpr("0 AS ord", "payload", "'q' AS queue"), NOW))

    def run(*argv):
        out = io.StringIO()
        code = cli.main(["--root", root, *argv], spark, NOW, out)
        return code, out.getvalue()

    assert run("migrate", "down") == (0, "schema 3 -> 2\n1  ledger tables  applied\n2  step edges  applied\n3  folded counts, hourly tally and history  pending\n")
    with pytest.raises(ValueError, match="migrate it first"):
        store.load()
    assert run("migrate", "up", "--to", "1")[0] == 1 and run("migrate", "up")[0] == 0 and migrate(store) == (3, 3)
    assert store.load()[0].items.count() == 1 and run("migrate", "down", "--to", "9")[0] == 1


def test_import_reads_tables_in_ranges(spark, tmp_path):
    """Any JDBC driver will do; the session's own has none, so the reader is checked up to its options."""
    with pytest.raises(Exception, match="(?i)driver"):
        import_jdbc(spark, "jdbc:nosuch://host/db", {"items": "items"}, bounds=(1, 100), partitions=2)


def test_releases_what_fails_while_stopping(spark):
    def fail(x):
        raise ValueError("no")

    job = pipeline.Job("j").step("one", fail, policy=Policy(1, (), 0.0))
    g, run = job.run(new_ledger(spark), 1, NOW)
    g, taken = X.claim(g, NOW, "me", 5, "j.one")
    g = g.settled()
    made = pipeline.ran(job, job.steps[0], job.wired(), taken)
    after, got = pipeline.settled(g, job, job.steps[0], job.wired(), made, taken, "me", NOW, releasing=True)
    assert got.released == 1 and after.items.select("state", "attempt").first() == ("ready", 0)
