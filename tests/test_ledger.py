"""Policies, graphs, projections, folds, the store, jobs, streams and the command line."""

import io

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill import cli
from tidemill.functions import payload as P
from tidemill.functions import policy as R
from tidemill.operators import fold as fold_ops
from tidemill.operators import transitions as X
from tidemill.operators.ledger import Ledger, new_ledger, numbered
from tidemill.plans import graph, pipeline, projection, readers
from tidemill.schema import RETENTION_NEVER, RETENTION_ZERO, violations
from tidemill.sources.store import Conflict, LedgerStore
from tidemill.streaming import machine
from tidemill.telemetry import Tally, sample_depth

NOW = datetime(2026, 10, 29, 9)


def test_backoff_and_jitter(spark):
    df = spark.range(1, 9).select(F.col("id").cast("int").alias("a"))
    waits = [r.w for r in df.select(R.backoff(F.col("a"), R.DEFAULT.column()["schedule_ns"]).alias("w"), "a").orderBy("a").collect()]
    assert [w // R.SECOND for w in waits] == [5, 30, 120, 600, 600, 600, 600, 600]
    base = F.lit(10 * R.SECOND).cast("bigint")
    low, high = R.bounds(base, F.lit(0.1))
    row = df.select(F.min(R.jittered(base, F.lit(0.1), R.spread(F.col("a"), F.lit(1)))).alias("x"), F.max(R.jittered(base, F.lit(0.1), R.spread(F.col("a"), F.lit(1)))).alias("y"), F.first(low).alias("l"), F.first(high).alias("h")).first()
    assert row.l <= row.x < row.y <= row.h
    empty = R.retry(3).column()["schedule_ns"]
    assert spark.range(1).select(R.backoff(F.lit(1), empty)).first()[0] == 5 * R.SECOND
    assert spark.range(1).select(R.exhausted(F.lit(5), F.lit(0))).first()[0]


def test_payload_flags_read_true_and_text_alike(spark):
    df = spark.createDataFrame([('{"a.b":true}',), ('{"a.b":"true"}',), ('{"a":{"b":true}}',), ("{",)], "p string")
    got = [r[0] for r in df.select(F.try_element_at(P.flags(F.col("p")), F.lit("a.b"))).collect()]
    assert got == ["true", "true", None, None]
    assert [r[0] for r in df.select(P.valid(F.col("p"))).collect()] == [True, True, True, False]


def test_idle_ticks_write_nothing(spark, tmp_path):
    from tidemill.app import App, Config

    app = App(LedgerStore(spark, f"file://{tmp_path}/l"), Config(folding=True))
    app.queue("mail", lambda mail: None)
    app.job(pipeline.Job("doc").step("one", lambda d: None))
    app.enqueue("mail", spark.createDataFrame([("{}",)], "payload string"), NOW)
    assert app.tick(NOW) == 1
    have = app.store.versions()
    for minutes in (1, 2, 3):
        assert app.tick(NOW + timedelta(minutes=minutes)) == 0
    assert app.store.versions() == have
    before = app.store._read(have[-1])["tables"]
    app.enqueue("mail", spark.createDataFrame([("{}",)], "payload string"), NOW)
    after = app.store._read(app.store.versions()[-1])["tables"]
    assert {t for t in after if after[t] != before[t]} == {"items"}


def test_numbering_gathers_no_rows_in_one_task(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("ord"), F.col("id").alias("pos"))
    out = numbered(df, 5, "ord", "pos")
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    rows = out.orderBy("id").toPandas()
    assert rows["id"].tolist() == list(range(5, 20_005)) and rows["ord"].is_monotonic_increasing
    g, made = X.enqueue(new_ledger(spark), df.withColumn("queue", F.lit("q")), NOW)
    assert "SinglePartition" not in g.items._jdf.queryExecution().toString() and g.next_item == 20_001
    assert numbered(df.limit(0), 1).isEmpty()


def test_numbers_follow_the_order_over_buckets(spark):
    df = spark.range(0, 200_001, 7).select((F.lit(200_001) - F.col("id")).alias("ord"))
    out = numbered(df, 10).orderBy("ord").select("id").toPandas()["id"].tolist()
    assert out == list(range(10, 10 + len(out)))


@pytest.mark.parametrize(
    "nodes, text",
    [
        ([("a", None), ("a", None)], "repeat"),
        ([("a", None), ("b", ("x",))], "unknown"),
        ([("a", None), ("b", None), ("c", ("a", "b"))], "joins"),
        ([("a", None), ("b", ("c",)), ("c", ("b",))], "cycle"),
        ([("a", None), ("b", ())], "predecessor"),
        ([], "needs"),
    ],
)
def test_bad_graphs(nodes, text):
    with pytest.raises(graph.GraphError, match=text):
        graph.build([graph.Node(i, a) for i, a in nodes])


def test_out_trees():
    out = graph.build([graph.Node("d"), graph.Node("f"), graph.Node("i", ("f",)), graph.Node("a", ("f",))])
    assert out == {"d": ["f"], "f": ["i", "a"], "i": [], "a": []} and graph.leaves(out) == ["i", "a"]


COUNTS = "execution_id string, step_id string, idx int, queue string, received bigint, succeeded bigint, filtered bigint, dlq bigint, active bigint, produced bigint, dropped bigint, capped bigint"
CASES = {
    # name: steps (id, received, succeeded, filtered, dlq, active, produced, dropped, capped), expected status, terminal success, leaks (kind, missing)
    "all success": ([("discover", 1, 1, 0, 0, 0, 100, 0, 0), ("crawl", 100, 100, 0, 0, 0, 100, 0, 0), ("index", 100, 100, 0, 0, 0, 0, 0, 0)], "COMPLETE", 100, []),
    "dead letters": ([("crawl", 10000, 9990, 0, 10, 0, 9990, 0, 0), ("process", 9990, 9985, 0, 5, 0, 9985, 0, 0), ("index", 9985, 9983, 0, 2, 0, 0, 0, 0)], "COMPLETE", 9983, []),
    "mid-run": ([("discover", 1, 1, 0, 0, 0, 50, 0, 0), ("crawl", 50, 20, 0, 0, 30, 20, 0, 0), ("index", 18, 15, 0, 0, 3, 0, 0, 0)], "RUNNING", 15, []),
    "deleted": ([("discover", 1, 1, 0, 0, 0, 100, 0, 0), ("crawl", 100, 88, 0, 2, 0, 88, 0, 0), ("index", 88, 88, 0, 0, 0, 0, 0, 0)], "COMPLETE", 88, [("edge-imbalance", 10)]),
    "gap": ([("crawl", 10, 10, 0, 0, 0, 10, 0, 0), ("index", 7, 7, 0, 0, 0, 0, 0, 0)], "COMPLETE", 7, [("continuity", 3)]),
    "twice": ([("crawl", 10, 10, 0, 0, 0, 10, 0, 0), ("index", 13, 13, 0, 0, 0, 0, 0, 0)], "COMPLETE", 13, [("duplication", -3)]),
    "capped": ([("discover", 1, 1, 0, 0, 0, 200, 4800, 1), ("crawl", 200, 200, 0, 0, 0, 0, 0, 0)], "COMPLETE", 200, [("capped-output", 4800)]),
    "filtered": ([("filter", 10, 6, 4, 0, 0, 6, 0, 0), ("sink", 6, 6, 0, 0, 0, 0, 0, 0)], "COMPLETE", 6, []),
}


def test_projection_cases(spark):
    rows, edges = [], []
    for name, (steps, *_) in CASES.items():
        rows += [(name, s[0], i, s[0], *s[1:]) for i, s in enumerate(steps)]
        edges += [(name, a[0], b[0]) for a, b in zip(steps, steps[1:])]
    p = projection.project(spark.createDataFrame(rows, COUNTS), spark.createDataFrame(edges, "execution_id string, from_step_id string, to_step_id string"))
    got = {r.execution_id: (r.status, r.terminal_success) for r in p.summary.collect()}
    leaks = {}
    for r in projection.leak_text(p.leaks).collect():
        leaks.setdefault(r.execution_id, []).append((r.kind, r.missing))
        assert r.text.startswith(r.kind)
    for name, (_, status, success, want) in CASES.items():
        assert got[name] == (status, success), name
        assert leaks.get(name, []) == want, name


def test_divergence_names_the_odd_branch_and_comes_before_the_group(spark):
    rows = [("r", "split", 0, "q", 1, 1, 0, 0, 0, 12, 0, 0), ("r", "document", 1, "q", 5, 5, 0, 0, 0, 0, 0, 0), ("r", "metadata", 2, "q", 4, 4, 0, 0, 0, 0, 0, 0), ("r", "acl", 3, "q", 4, 4, 0, 0, 0, 0, 0, 0)]
    edges = [("r", "split", t) for t in ("document", "metadata", "acl")]
    leaks = projection.leak_text(projection.run_leaks(spark.createDataFrame(rows, COUNTS), spark.createDataFrame(edges, "execution_id string, from_step_id string, to_step_id string"))).collect()
    assert [(r.kind, r.edge, r.missing) for r in leaks] == [("branch-divergence", "split->document", -1), ("duplication", "split->{acl,document,metadata}", -1)]


def finished(spark, n=24):
    """A run of discover -> fetch with filtered and plain items, finished hour by hour, and a queue of its own."""
    g = X.create_execution(new_ledger(spark), "e1", "crawl", [("discover", "crawl.discover", ["fetch"]), ("fetch", "crawl.fetch", [])], "{}", NOW - timedelta(days=9))
    rows = [(i, "crawl.fetch" if i % 4 else "mail", '{"gone":true}' if i % 3 == 0 else '{"excluded":"true"}', "e1" if i % 4 else None, "fetch" if i % 4 else None, f"i{i}") for i in range(n)]
    g, _ = X.enqueue(g, spark.createDataFrame(rows, "ord bigint, queue string, payload string, execution_id string, step_id string, item_id string"), NOW - timedelta(days=9))
    for q in ("crawl.fetch", "mail"):
        g, _ = X.claim(g, NOW - timedelta(days=8), "w", 1000, q)
    asks = g.items.where("id % 6 != 0").select(F.col("id").alias("ord"), "id", F.lit("w").alias("worker"), (F.col("id") % 2 == 0).alias("filtered"))
    g, _ = X.complete(g, asks, NOW - timedelta(days=8))
    days = F.make_dt_interval(F.col("id").cast("int") % 9, F.col("id").cast("int") % 24)
    moved = F.when(F.col("finalized_at").isNotNull(), F.lit(str(NOW)).cast("timestamp_ntz") - days)
    return g.having(items=g.items.withColumn("finalized_at", moved).withColumn("updated_at", F.coalesce(moved, "updated_at"))).settled()


def views(g):
    out = {
        "stats": readers.stats(g, NOW, window=timedelta(days=30)), "steps": readers.step_counts(g), "labels": readers.filtered_by_label(g, "e1", "gone", "excluded", "none"),
        "attempts": readers.attempts(g).drop("seq"), "lineage": readers.lineage(g, "e1", "i5"), "summary": projection.run_summary(readers.step_counts(g), g.step_edges),
    }
    out["item"] = readers.get_item(g, 2).drop("payload", "policy", "available_at")
    return {k: sorted(map(str, v.collect())) for k, v in out.items()}


def test_fold_changes_no_reader(spark):
    g = finished(spark)
    before = views(g)
    labels = {"crawl": ["gone", "excluded", "gone", ""]}
    for days in (6, 3, 0):
        options = fold_ops.SweepOptions(timedelta(days=days) if days else RETENTION_ZERO, labels=labels, history=timedelta(days=30))
        g, done = fold_ops.fold(g, options, NOW)
        g = g.settled()
        assert views(g) == before, days
    assert g.items.where("state = 'done'").count() == 0
    assert violations(g.items).isEmpty()


def test_sweep_bounds_batches_and_history(spark):
    g = finished(spark)
    n = g.items.where("state = 'done'").count()
    assert fold_ops.sweep(g, fold_ops.SweepOptions(RETENTION_NEVER), NOW)[1].count == 0
    after, total = fold_ops.sweep_pass(g, fold_ops.SweepOptions(RETENTION_ZERO), NOW + timedelta(days=1), folding=False, batch=5)
    assert total == n and after.items.where("state = 'done'").isEmpty() and after.items.where("state = 'running'").count() == g.items.where("state = 'running'").count()
    folded, done = fold_ops.fold(g, fold_ops.SweepOptions(RETENTION_ZERO, history=timedelta(days=2)), NOW + timedelta(days=1))
    since = datetime(2026, 10, 28)
    assert done.count == n and folded.item_history.where(F.col("finalized_at") < F.lit(str(since)).cast("timestamp_ntz")).isEmpty() and not folded.item_history.isEmpty()
    assert folded.step_counts.agg(F.sum(F.col("succeeded") + F.col("filtered"))).first()[0] == g.items.where("state = 'done' AND step_id IS NOT NULL").count()
    late = fold_ops.prepare(folded, NOW + timedelta(days=20), timedelta(days=2))
    assert late.item_history.isEmpty() and late.done_hourly.isEmpty()
    assert [str(d) for d in fold_ops.history_days(NOW, timedelta(hours=72))] == ["2026-10-26", "2026-10-27", "2026-10-28", "2026-10-29", "2026-10-30", "2026-10-31"]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_pass_writes_the_tables_once_whatever_its_pages(spark, monkeypatch):
    g = finished(spark)
    options, late = fold_ops.SweepOptions(RETENTION_ZERO), NOW + timedelta(days=1)
    want, n = fold_ops.sweep_pass(g, options, late, folding=False)
    writes, settled = [], Ledger.settled
    monkeypatch.setattr(Ledger, "settled", lambda self: writes.append(1) or settled(self))
    after, total = fold_ops.sweep_pass(g, options, late, folding=False, batch=2)
    assert total == n > 4 and len(writes) == 1
    assert rows_of(after.items) == rows_of(want.items) and rows_of(after.attempts) == rows_of(want.attempts)
    assert fold_ops.sweep_pass(g, options, late, folding=False, batch=2, budget=-1) == (g, 0)


def test_a_pass_that_failed_goes_on_in_pages(spark, monkeypatch):
    g = finished(spark)
    options, late = fold_ops.SweepOptions(RETENTION_ZERO), NOW + timedelta(days=1)
    limits, sweep = [], fold_ops.sweep

    def failing(ledger, options, now):
        limits.append(options.limit)
        if len(limits) < 3:
            raise OSError("full")
        return sweep(ledger, options, now)

    monkeypatch.setattr(fold_ops, "sweep", failing)
    after, total = fold_ops.sweep_pass(g, options, late, folding=False, batch=8, budget=14)
    assert limits == [14, 8, 4, 8, 2] and total == 14
    first = [r.id for r in fold_ops.due(g, fold_ops.SweepOptions(RETENTION_ZERO, limit=14), late).select("id").collect()]
    assert rows_of(after.items) == rows_of(g.items.where(~F.col("id").isin(first)))
    assert rows_of(after.attempts) == rows_of(g.attempts.where(~F.col("item_pk").isin(first)))


def test_attempts_are_told_apart_by_marked_ids(spark, monkeypatch):
    ids = [-40000, -32768, -1, 0, 1, 7, 8, 32767, 32768, 32769, 70000, 1 << 40]
    attempts = spark.createDataFrame([(i,) for i in (*ids, *(i + 2 for i in ids), None)], "item_pk bigint")
    gone = spark.createDataFrame([(i,) for i in (*ids, None)], "id bigint")
    for marks in (fold_ops.MARKS, 0):
        monkeypatch.setattr(fold_ops, "MARKS", marks)
        mine, rest = ([r.item_pk for r in f.collect()] for f in fold_ops._split(attempts, gone))
        assert sorted(mine) == sorted([*ids, *(i + 2 for i in ids if i + 2 in ids)])
        assert sorted(rest, key=str) == sorted([*(i + 2 for i in ids if i + 2 not in ids), None], key=str)


def test_a_fold_leaves_items_and_attempts_where_they_are(spark):
    g = finished(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for options in (fold_ops.SweepOptions(timedelta(days=3)), fold_ops.SweepOptions(timedelta(days=3), limit=4)):
            after, done = fold_ops.fold(g, options, NOW)
            assert done.count and after.items.count() == g.items.count() - done.count
            for f in (after.items, after.attempts):
                assert "hashpartitioning" not in f._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_breaker():
    b = fold_ops.Breaker(8)
    assert [b.failed(), b.failed(), b.failed(), b.failed(), b.succeeded()] == [4, 2, 1, 1, 8]


def test_store_commits_whole_or_not_at_all(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    new = spark.createDataFrame([(0, "q"), (1, "q")], "ord bigint, queue string")
    store.apply(lambda g: X.enqueue(g, new, NOW))
    base, version = store.load()
    assert version == 1 and base.items.count() == 2 and base.next_item == 3
    changed, _ = X.claim(base, NOW, "w", 1, "q")

    def crash():
        raise OSError("killed")

    with pytest.raises(OSError):
        store.commit(base, version, changed, crash)
    assert store.load()[1] == 1 and store.load()[0].items.where("state = 'running'").isEmpty()
    assert store.commit(base, version, changed) == 2
    with pytest.raises(Conflict):
        store.commit(base, version, changed)
    assert store.load()[0].items.where("state = 'running'").count() == 1 and store.load(1)[0].items.where("state = 'running'").isEmpty()
    assert store.vacuum() >= 1 and store.load()[0].attempts.count() == 1


def crawl_job():
    def process(d):
        n = int(d["url"].rsplit("/", 1)[1])
        if n % 10 == 7:
            raise ValueError("broken page")
        return [] if n % 10 == 3 else [{"url": d["url"], "text": "t"}]

    one_try = R.no_retry()
    job = pipeline.Job("site", labels=("gone",))
    job.step("discover", lambda s: [{"url": f"{s['root']}/{i}"} for i in range(1, s["pages"] + 1)])
    job.step("crawl", lambda p: {"url": p["url"], "body": "b"}).step("process", process, policy=one_try).step("index", lambda r: None)
    return job


def test_job_runs_to_completion(spark):
    job, tally = crawl_job(), Tally()
    g, run = job.run(new_ledger(spark), {"root": "http://x", "pages": 25}, NOW)
    g = pipeline.Runner([job], observer=tally).run(g.settled(), NOW)
    got = {r.step_id: (r.received, r.succeeded, r.filtered, r.dlq, r.produced) for r in readers.step_counts(g, run).collect()}
    assert got == {"discover": (1, 1, 0, 0, 25), "crawl": (25, 25, 0, 0, 25), "process": (25, 20, 3, 2, 20), "index": (20, 20, 0, 0, 0)}
    p = projection.project(readers.step_counts(g, run), g.step_edges)
    assert p.summary.first().status == "COMPLETE" and p.leaks.isEmpty() and violations(g.items).isEmpty()
    assert tally.counts["site.process", "dead_lettered"] == 2
    crawl = g.items.where("step_id = 'crawl'").first()
    assert g.items.where((F.col("step_id") == "index") | (F.col("step_id") == "process")).where(F.col("item_id") == crawl.item_id).count() in (1, 2)
    sample_depth(g, NOW, tally)
    assert tally.depths["site.crawl"] == 0
    lost = X.delete_item(g, g.items.where("step_id = 'index'").first().id)
    leak = projection.run_leaks(readers.step_counts(lost, run), lost.step_edges).collect()
    assert [(x.kind, x.missing) for x in leak] == [("continuity", 1)]


def test_broadcast_streams_and_retries(spark):
    def split(d, out):
        for i in range(5):
            out.add({"i": i})
        if d.get("fail"):
            raise RuntimeError("after two chunks")

    job = pipeline.Job("doc").step("split", split, stream=True, flush_size=2, policy=R.retry(2, R.SECOND))
    job.step("text", lambda d: None).step("acl", lambda d: None, after="split")
    with pytest.raises(graph.GraphError):
        pipeline.Job("x").step("a", lambda: None)
    g, run = job.run(new_ledger(spark), {"fail": True}, NOW)
    runner = pipeline.Runner([job])
    g = runner.run(g, NOW)
    counts = {r.step_id: (r.received, r.active) for r in readers.step_counts(g, run).collect()}
    assert counts == {"split": (1, 1), "text": (4, 0), "acl": (4, 0)}  # two full chunks stay, the buffer is lost
    g = runner.run(g, NOW + timedelta(minutes=5))
    assert {r.step_id: r.received for r in readers.step_counts(g, run).collect()} == {"split": 1, "text": 8, "acl": 8}  # at least once
    assert g.items.where("step_id = 'split'").first().state == "dlq"
    pairs = g.items.where("step_id IN ('text', 'acl')").groupBy("item_id").count().select("count").distinct().collect()
    assert [r[0] for r in pairs] == [2]


def test_undecodable_payload_and_discard(spark):
    def refuse(d):
        raise pipeline.Discard("never again")

    items = spark.createDataFrame([(1, 1, "{"), (2, 1, "{}")], "id bigint, attempt int, payload string")
    got = {r.id: (r.outcome, r.error) for r in pipeline.handle(items, pipeline.Step("s", refuse)).collect()}
    assert got[1][0] == "error" and got[2] == ("discard", "never again")


def test_runner_gives_back_and_keeps_alive(spark):
    g, _ = X.enqueue(new_ledger(spark), spark.createDataFrame([(0, "q")], "ord bigint, queue string"), NOW)
    g, _ = X.claim(g, NOW, "runner", 1, "q")
    r = pipeline.Runner([])
    assert r.heartbeat(g, NOW + timedelta(minutes=1)).items.first().lease_until == NOW + timedelta(seconds=90)
    assert r.drain(g, NOW).items.first().state == "ready"


operation = st.tuples(st.sampled_from(machine.OPERATIONS), st.sampled_from(["a", "b", None]), st.integers(0, 200))


@settings(max_examples=200, deadline=None)
@given(st.lists(operation, max_size=30))
def test_machine_keeps_its_constraints(ops):
    held = machine._NONE
    for op, worker, at in ops:
        before = held
        held, took = machine.step(held, op, worker, float(at))
        state, attempt, owner, _ = held
        assert took or held == before
        assert (state == "running") or owner is None
        assert attempt >= 0 and state in (None, "ready", "running", "done", "dlq")
        assert before[0] not in ("done",) or held == before


def test_command_line(spark, tmp_path):
    root = f"file://{tmp_path}/l"
    store = LedgerStore(spark, root)
    job = crawl_job()

    def fill(g):
        g, run = job.run(g, {"root": "u", "pages": 7}, NOW, "exec_1")
        return pipeline.Runner([job]).run(g.settled(), NOW), run

    store.apply(fill)

    def call(*args):
        out = io.StringIO()
        code = cli.main(["--root", root, *args], spark, NOW + timedelta(days=30), out)
        return code, out.getvalue()

    assert "site.process.dlq" in call("queues")[1]
    assert "broken page" in call("dlq", "ls", "site.process")[1]
    assert "COMPLETE" in call("runs")[1] and "COMPLETE" in call("run", "exec_1")[1] and call("run", "nope")[0] == 1
    item = store.load()[0].items.where("step_id = 'index'").first()
    assert "index" in call("trace", "exec_1", item.item_id)[1] and "success" in call("item", str(item.id))[1] and call("item", "9999")[0] == 1
    before = readers.step_counts(store.load()[0]).collect()
    assert "swept 19" in call("gc", "--fold")[1]
    assert readers.step_counts(store.load()[0]).collect() == before
    assert "replayed 1" in call("dlq", "replay", "site.process")[1]
    assert "paused" in call("pause", "q")[1] and "resumed" in call("resume", "q")[1] and "applied" in call("migrate", "status")[1]

