"""Command line over a stored ledger: ``python -m tidemill.cli --root DIR COMMAND``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import fold as fold_ops
from tidemill.operators import transitions as X
from tidemill.plans import projection, readers
from tidemill.schema import RETENTION_ZERO, SCHEMA_VERSION
from tidemill.sources.store import LedgerStore, migrate, migrations

LIMIT = 20


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(df: DataFrame, limit: int = 1000) -> str:
    """A text table of the first rows."""
    rows = [df.columns, *[["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemill")
    p.add_argument("--root", required=True, help="folder of the ledger")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("migrate")
    m.add_argument("what", choices=["status", "up", "down"])
    m.add_argument("--to", type=int, default=None)
    sub.add_parser("queues")
    dlq = sub.add_parser("dlq")
    dlq.add_argument("what", choices=["ls", "replay"])
    dlq.add_argument("queue")
    dlq.add_argument("--error", default=None)
    dlq.add_argument("--limit", type=int, default=LIMIT)
    sub.add_parser("item").add_argument("id", type=int)
    sub.add_parser("runs").add_argument("--limit", type=int, default=LIMIT)
    sub.add_parser("run").add_argument("id")
    trace = sub.add_parser("trace")
    trace.add_argument("id")
    trace.add_argument("item")
    gc = sub.add_parser("gc")
    gc.add_argument("--queue", default=None)
    gc.add_argument("--retention-days", type=float, default=7.0)
    gc.add_argument("--fold", action="store_true")
    for name in ("pause", "resume"):
        sub.add_parser(name).add_argument("queue")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, now: datetime | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    store = LedgerStore(spark or session(), a.root)
    show = lambda text: print(text, file=out)
    if a.command == "migrate":
        have = store.versions()
        at = store._read(have[-1])["schema"] if have else SCHEMA_VERSION
        if a.what != "status":
            to = a.to or (SCHEMA_VERSION if a.what == "up" else at - 1)
            if (to > at) == (a.what == "down") and to != at or to < 1:
                show(f"cannot go {a.what} from version {at} to {to}")
                return 1
            before, at = migrate(store, to)
            show(f"schema {before} -> {at}")
        for version, what in migrations():
            show(f"{version}  {what}  {'applied' if version <= at else 'pending'}")
        return 0
    ledger, _ = store.load()
    if a.command == "queues":
        show(table(readers.stats(ledger, now)))
    elif a.command == "dlq" and a.what == "ls":
        queue = a.queue if a.queue.endswith(".dlq") else a.queue + ".dlq"
        show(table(readers.list_items(ledger, queue=queue, state="dlq", error_contains=a.error, limit=a.limit).select("id", "attempt", "last_error", "finalized_at")))
    elif a.command == "dlq":
        queue = a.queue if a.queue.endswith(".dlq") else a.queue + ".dlq"
        show(f"replayed {store.apply(lambda g: X.drain(g, queue, now, a.error, a.limit))}")
    elif a.command == "item":
        found = readers.get_item(ledger, a.id)
        if found.isEmpty():
            show(f"no item {a.id}")
            return 1
        show(table(found.select("id", "queue", "state", "outcome", "attempt", "max_attempts", "last_error", "execution_id", "step_id", "item_id")))
        show(table(readers.attempts(ledger, a.id).drop("item_pk")))
    elif a.command == "runs":
        summary = projection.run_summary(readers.step_counts(ledger), ledger.step_edges)
        recent = readers.list_executions(ledger, a.limit).select("id", "job", "created_at")
        show(table(recent.join(summary, recent["id"] == summary["execution_id"], "left").drop("execution_id").orderBy(F.desc("created_at"), F.desc("id"))))
    elif a.command == "run":
        if readers.get_execution(ledger, a.id).isEmpty():
            show(f"no run {a.id}")
            return 1
        edges = ledger.step_edges.where(F.col("execution_id") == a.id)
        run = projection.project(readers.step_counts(ledger, a.id), edges)
        show(table(run.summary))
        show(table(run.steps.drop("execution_id").orderBy("idx")))
        for row in projection.leak_text(run.leaks).select("text").toLocalIterator():
            show(f"leak: {row['text']}")
    elif a.command == "trace":
        show(table(readers.lineage(ledger, a.id, a.item)))
    elif a.command == "gc":
        days = a.retention_days
        options = fold_ops.SweepOptions(timedelta(days=days) if days > 0 else RETENTION_ZERO, a.queue)
        show(f"swept {store.apply(lambda g: fold_ops.sweep_pass(g, options, now, folding=a.fold))}")
    elif a.command == "pause":
        store.apply(lambda g: X.pause_queue(g, a.queue, now))
        show(f"paused {a.queue}")
    else:
        store.apply(lambda g: X.resume_queue(g, a.queue, now))
        show(f"resumed {a.queue}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
