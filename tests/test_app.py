"""The application object over a stored ledger."""

import random
from datetime import datetime, timedelta

from tidemill.app import App, Config
from tidemill.functions.policy import no_retry
from tidemill.plans import pipeline
from tidemill.sources.store import LedgerStore

NOW = datetime(2026, 10, 1)


def test_queue_and_job_in_one_app(spark, tmp_path):
    app = App(LedgerStore(spark, f"file://{tmp_path}/l"), Config(folding=True))

    def send(mail):
        if mail["to"] == "bad":
            raise ValueError("no such box")

    app.queue("mail", send, no_retry())
    app.job(pipeline.Job("doc").step("split", lambda d: [{"i": i} for i in range(d["n"])]).step("sink", lambda d: None))
    assert app.enqueue("mail", spark.createDataFrame([('{"to":"a"}',), ('{"to":"bad"}',)], "payload string"), NOW) == 2
    app.enqueue("mail", spark.createDataFrame([('{"to":"later"}',)], "payload string"), NOW, after=timedelta(hours=1))
    run = app.run("doc", {"n": 3}, NOW)
    assert app.tick(NOW) == 6
    stats = {r.queue: (r.ready, r.done, r.dlq) for r in app.stats(NOW).collect()}
    assert stats == {"mail": (1, 1, 0), "mail.dlq": (0, 0, 1), "doc.split": (0, 1, 0), "doc.sink": (0, 3, 0)}
    p = app.projection(run)
    assert p.summary.first().terminal_success == 3 and p.leaks.isEmpty()
    assert [r.step_id for r in app.execution_steps(run).collect()] == ["split", "sink"] and app.executions().count() == app.execution(run).count() == 1
    assert app.tick(NOW + timedelta(days=8)) == 1  # the late mail, and a fold of the rest
    assert app.ledger().items.where("state = 'done'").count() == 1
    assert app.projection(run).summary.first().terminal_success == 3
    app.stop(NOW + timedelta(days=8))


def test_poll_jitter_and_heartbeat():
    c = Config()
    waits = [c.wait(random.Random(i)) for i in range(50)]
    assert min(waits) >= timedelta(milliseconds=160) and max(waits) <= timedelta(milliseconds=240) and len(set(waits)) > 10
    assert c.beat() == timedelta(seconds=10) and Config(poll_jitter=5).wait(random.Random(1)) >= timedelta(milliseconds=20)
