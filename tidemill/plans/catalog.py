"""Registered queries over the ledger of the ``events`` table, and the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import policy as R
from tidemill.operators import fold as fold_ops
from tidemill.operators import transitions as X
from tidemill.operators.ledger import Ledger, new_ledger
from tidemill.plans import pipeline, projection, readers
from tidemill.schema import LAPSED, violations
from tidemill.sources import events as source

NOW = datetime(2024, 1, 15, 12)
STAMP = f"timestamp '{NOW}'"
RUN, ITEM = "exec_7", "item_3"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ITEMS = f"items as ({source.items_sql(source.K_DUCKDB)})"
STEPS = "runs as (select distinct execution_id from items), steps as (select execution_id, step_id, idx, 'ingest.' || step_id as queue from runs, (values " + ", ".join(f"('{s}', {i})" for s, i in source.STEPS) + ") s(step_id, idx))"
EDGES = "edges as (select execution_id, a as from_step_id, b as to_step_id from runs, (values " + ", ".join(f"('{a}', '{b}')" for a, b in source.EDGES) + ") e(a, b))"


def _counts_sql(items: str = "items") -> str:
    return f"""counts as (select st.execution_id, st.step_id, st.idx, st.queue, count(i.id) as received,
  count(*) filter (where i.state = 'done' and i.outcome = 'success') as succeeded, count(*) filter (where i.state = 'done' and i.outcome = 'filtered') as filtered,
  count(*) filter (where i.state = 'dlq') as dlq, count(*) filter (where i.state in ('ready', 'running')) as active,
  cast(coalesce(sum(i.produced), 0) as bigint) as produced, cast(coalesce(sum(i.dropped), 0) as bigint) as dropped, count(*) filter (where i.produced_capped) as capped
  from steps st left join {items} i on i.execution_id = st.execution_id and i.step_id = st.step_id group by all)"""


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return source.ledger(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))


def query(sql: str | None = None):
    """Registers a function of the ledger under its name, with its SQL (after the ITEMS definition)."""

    def add(fn: Callable[[Ledger], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ledger(spark, sf_dir))
        if sql is not None:
            SQL[fn.__name__] = f"with {ITEMS}{sql}" if sql.lstrip().startswith(",") else f"with {ITEMS} {sql}"
        return fn

    return add


@query(f", {STEPS}, {_counts_sql()} select * from counts")
def step_counts(g: Ledger) -> DataFrame:
    return readers.step_counts(g)


QUEUE_LIVE = "select queue, count(*) filter (where state = 'ready') as ready, count(*) filter (where state = 'running') as running, count(*) filter (where state = 'done') as done, count(*) filter (where state = 'dlq') as dlq, queue = 'ingest.acl' as paused from items group by queue"


@query(QUEUE_LIVE)
def queue_stats(g: Ledger) -> DataFrame:
    return readers.stats(g, NOW)


@query(f", live as ({QUEUE_LIVE.replace('from items', 'from items where not (state = {q}done{q} and finalized_at < {s} - interval 3 day)'.format(q=chr(39), s=STAMP))}), tally as (select queue, count(*) as n from items where state = 'done' and finalized_at < {STAMP} - interval 3 day and date_trunc('hour', finalized_at) >= {STAMP} - interval 7 day group by queue), names as (select distinct queue from items) select q.queue, coalesce(ready, 0) as ready, coalesce(running, 0) as running, coalesce(done, 0) + coalesce(n, 0) as done, coalesce(dlq, 0) as dlq, q.queue = 'ingest.acl' as paused from names q left join live using (queue) left join tally using (queue)")
def queue_stats_with_tally(g: Ledger) -> DataFrame:
    return readers.stats(fold_ops.fold(g, fold_ops.SweepOptions(timedelta(days=3)), NOW)[0], NOW)


def _lineage_sql(run: str, item: str) -> str:
    return f", {STEPS} select st.step_id, st.idx, i.id, i.state, i.outcome, i.attempt, i.last_error, i.produced from steps st left join (select * from items where execution_id = '{run}' and item_id = '{item}') i on i.step_id = st.step_id where st.execution_id = '{run}'"


@query(_lineage_sql(RUN, ITEM))
def lineage(g: Ledger) -> DataFrame:
    return readers.lineage(g, RUN, ITEM)


@query(_lineage_sql(RUN, "item_none"))
def lineage_never_entered(g: Ledger) -> DataFrame:
    return readers.lineage(g, RUN, "item_none")


@query("select id as item_pk, cast(n as int) as attempt, id * 8 + n as seq, coalesce(last_worker, 'w0') as worker, created_at as started_at, case when n < attempt or state <> 'running' then created_at end as ended_at, case when n < attempt then 'error' when state = 'running' then null else coalesce(outcome, 'error') end as outcome, case when n = attempt then last_error else 'try again' end as error from (select *, unnest(generate_series(1, attempt)) as n from items) x")
def attempts_history(g: Ledger) -> DataFrame:
    return readers.attempts(g)


SHOWN = ["id", "queue", "state", "outcome", "attempt", "execution_id", "step_id", "produced", "finalized_at"]


@query(f"select {', '.join(SHOWN)} from items where id in (11, 12, 13, 14, 15)")
def get_item_union(g: Ledger) -> DataFrame:
    folded = fold_ops.fold(g, fold_ops.SweepOptions(fold_ops.RETENTION_ZERO, history=timedelta(days=400)), datetime(2024, 3, 1))[0]
    out = [readers.get_item(folded, i).select(*SHOWN) for i in (11, 12, 13, 14, 15)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("select id, queue, state, last_error from items where state = 'dlq' and last_error ilike '%refused%' order by id desc limit 100")
def list_items_filtered(g: Ledger) -> DataFrame:
    return readers.list_items(g, state="dlq", error_contains="refused").select("id", "queue", "state", "last_error")


@query("select execution_id as id, 'ingest' as job, min(created_at) as created_at from items group by 1 order by 3 desc, 1 desc limit 50")
def list_executions(g: Ledger) -> DataFrame:
    return readers.list_executions(g).select("id", "job", "created_at")


@query(f", {STEPS}, {EDGES} select st.execution_id, st.step_id, st.idx, st.queue, coalesce(string_agg(e.to_step_id, ',' order by e.to_step_id), '') as successors from steps st left join edges e on e.execution_id = st.execution_id and e.from_step_id = st.step_id group by all")
def execution_steps(g: Ledger) -> DataFrame:
    return readers.execution_steps(g).withColumn("successors", F.concat_ws(",", "successors"))


@query(f", {STEPS}, hits as (select execution_id, step_id, label, count(*) as n from items, (values ('gone'), ('excluded')) l(label) where state = 'done' and outcome = 'filtered' and payload::json->>label = 'true' group by all) select st.execution_id, st.step_id, l.label, coalesce(n, 0) as n from steps st cross join (values ('gone'), ('excluded')) l(label) left join hits h on h.execution_id = st.execution_id and h.step_id = st.step_id and h.label = l.label")
def filtered_by_label(g: Ledger) -> DataFrame:
    return readers.filtered_by_label(g, None, "gone", "excluded")


@query(f", {STEPS}, {_counts_sql()} select execution_id, case when sum(active) > 0 then 'RUNNING' else 'COMPLETE' end as status, cast(sum(case when step_id in ('index', 'acl') then succeeded else 0 end) as bigint) as terminal_success, cast(sum(dlq) as bigint) as terminal_dlq, cast(sum(active) as bigint) as active from counts group by 1")
def run_summary(g: Ledger) -> DataFrame:
    return projection.run_summary(readers.step_counts(g), g.step_edges)


def _damaged(g: Ledger) -> Ledger:
    """Some items lost, some with an outcome that no item should have, and quiet runs."""
    lost = g.items.where("id % 7 != 0").withColumn("outcome", F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("outcome")))
    quiet = F.col("id") % 2 == 0
    lost = lost.withColumn("state", F.when(quiet & F.col("state").isin("ready", "running"), "done").otherwise(F.col("state")))
    return g.having(items=lost)


DAMAGED = f"bad as (select id, execution_id, step_id, produced, dropped, produced_capped, case when id % 13 = 0 then null else outcome end as outcome, case when id % 2 = 0 and state in ('ready', 'running') then 'done' else state end as state from items where id % 7 <> 0), {STEPS}, {EDGES}, {_counts_sql('bad')}"
GROUPS = "pairs as (select e.execution_id, e.from_step_id as step_id, e.to_step_id, u.produced as up, u.active as busy, d.received as got from edges e join counts u on u.execution_id = e.execution_id and u.step_id = e.from_step_id join counts d on d.execution_id = e.execution_id and d.step_id = e.to_step_id), grp as (select execution_id, step_id, any_value(up) as up, any_value(busy) as busy, sum(got) as reached, count(*) as fan, step_id || '->' || case when count(*) > 1 then '{' || string_agg(to_step_id, ',' order by to_step_id) || '}' else min(to_step_id) end as edge from pairs group by 1, 2)"
LEAKS = {
    projection.EDGE_IMBALANCE: "select execution_id, step_id, cast(null as varchar) as edge, received - succeeded - filtered - dlq - active as missing from counts where received <> succeeded + filtered + dlq + active",
    projection.CAPPED_OUTPUT: "select execution_id, step_id, cast(null as varchar) as edge, dropped as missing from counts where capped > 0",
    projection.BRANCH_DIVERGENCE: f"{GROUPS} select p.execution_id, p.step_id, p.step_id || '->' || to_step_id as edge, cast(p.up // fan - got as bigint) as missing from pairs p join grp g on g.execution_id = p.execution_id and g.step_id = p.step_id where fan > 1 and got <> p.up // fan",
    projection.DUPLICATION: f"{GROUPS} select execution_id, step_id, edge, cast(up - reached as bigint) as missing from grp where reached > up",
    projection.CONTINUITY: f"{GROUPS} select execution_id, step_id, edge, cast(up - reached as bigint) as missing from grp where busy = 0 and reached < up",
}


def _leak_query(kind: str) -> None:
    name = "leak_" + kind.removesuffix("-output").replace("-", "_")

    def fn(g: Ledger) -> DataFrame:
        d = _damaged(g)
        return projection.run_leaks(readers.step_counts(d), d.step_edges).where(F.col("kind") == kind).select("execution_id", "step_id", "edge", "missing")

    fn.__name__ = name
    sql = LEAKS[kind]
    query(f", {DAMAGED}{', ' if sql.startswith('pairs') else ' '}{sql}")(fn)


for _kind in LEAKS:
    _leak_query(_kind)

LEAK_TEXTS = f"""{GROUPS},
one as (select execution_id, '{projection.EDGE_IMBALANCE}' as kind, step_id, cast(null as varchar) as edge, 1 as a, idx as b, 0 as c,
  received || ' items entered, ' || (succeeded + filtered + dlq + active) || ' accounted for: ' || succeeded || ' succeeded, ' || filtered || ' filtered, ' || dlq || ' dead-lettered, ' || active || ' active' as detail from counts where received <> succeeded + filtered + dlq + active),
two as (select execution_id, '{projection.CAPPED_OUTPUT}', step_id, null, 1, idx, 1, capped || ' items capped their output and dropped ' || dropped from counts where capped > 0),
three as (select p.execution_id, '{projection.BRANCH_DIVERGENCE}', p.step_id, p.step_id || '->' || p.to_step_id, 2, s.idx, row_number() over (partition by p.execution_id, p.step_id order by p.to_step_id), p.to_step_id || ' received ' || p.got || ' of ' || (p.up // g.fan) || ' under ' || p.step_id, p.got <> p.up // g.fan as odd
  from pairs p join grp g on g.execution_id = p.execution_id and g.step_id = p.step_id join steps s on s.execution_id = p.execution_id and s.step_id = p.step_id where g.fan > 1),
four as (select g.execution_id, '{projection.DUPLICATION}', g.step_id, g.edge, 2, s.idx, 1000, 'successors of ' || g.step_id || ' received ' || reached || ' of ' || up || ' produced' from grp g join steps s using (execution_id, step_id) where reached > up),
five as (select g.execution_id, '{projection.CONTINUITY}', g.step_id, g.edge, 2, s.idx, 1000, g.step_id || ' produced ' || up || ', ' || reached || ' reached its successors' from grp g join steps s using (execution_id, step_id) where busy = 0 and reached < up),
leaks as (select * from one union all select * from two union all select * exclude (odd) from three where odd union all select * from four union all select * from five)
select execution_id, cast(row_number() over (partition by execution_id order by a, b, c) as int) as place, kind, kind || case when edge is null then ' at step "' || step_id || '": ' else ' on edge ' || edge || ': ' end || detail as text from leaks"""


@query(f", {DAMAGED}, {LEAK_TEXTS}")
def leak_texts(g: Ledger) -> DataFrame:
    """All leaks of every run, in their order and in words."""
    d = _damaged(g)
    told = projection.leak_text(projection.run_leaks(readers.step_counts(d), d.step_edges))
    place = F.row_number().over(Window.partitionBy("execution_id").orderBy("ord1", "ord2", "ord3"))
    return told.select("execution_id", place.alias("place"), "kind", "text")


READY = f"state = 'ready' and available_at <= {STAMP}"
CLAIMED = ["id", "queue", "attempt", "leased_by", "lease_until"]


def _claimed_sql(rows: str) -> str:
    return f"select id, queue, attempt + 1 as attempt, 'me' as leased_by, {STAMP} + interval 1 minute as lease_until from ({rows}) c"


@query(_claimed_sql(f"select * from items where queue = 'ingest.crawl' and {READY} order by available_at, id limit 40"))
def claim_topk(g: Ledger) -> DataFrame:
    return X.claim(g, NOW, "me", 40, "ingest.crawl")[1].select(*CLAIMED)


@query(_claimed_sql(f"select * from (select *, row_number() over (partition by queue order by available_at, id) as r from items where queue <> 'ingest.acl' and {READY}) x where r <= 5"))
def claim_per_queue(g: Ledger) -> DataFrame:
    return X.claim(g, NOW, "me", 5)[1].select(*CLAIMED)


@query(_claimed_sql(f"select * from (select *, row_number() over (partition by queue order by available_at, id) as r from items where queue not in ('ingest.crawl', 'ingest.index') and {READY}) x where r <= 5"))
def claim_skips_paused(g: Ledger) -> DataFrame:
    """Two queues paused, one of them new to it, and one resumed."""
    paused = X.resume_queue(X.pause_queue(X.pause_queue(g, "ingest.crawl", NOW), "ingest.index", NOW), "ingest.acl", NOW)
    return X.claim(paused, NOW, "me", 5)[1].select(*CLAIMED)


@query(f"select queue as name, case when queue in ('ingest.crawl', 'ingest.new') then {STAMP} end as paused_at from (select distinct queue from items union select 'ingest.new') q")
def pause_and_resume(g: Ledger) -> DataFrame:
    """Pausing makes unknown queues known; resuming clears the mark."""
    changed = X.resume_queue(X.pause_queue(X.pause_queue(g, "ingest.crawl", NOW), "ingest.new", NOW), "ingest.acl", NOW)
    return changed.queues.select("name", "paused_at")


LONG = "w" * 127 + "é tail"


@query(f"select id, '{'w' * 127}' as leased_by, '{'w' * 127}' as worker from (select * from items where queue = 'ingest.crawl' and {READY} order by available_at, id limit 7) c")
def claim_cuts_worker(g: Ledger) -> DataFrame:
    """A worker's name keeps 128 bytes, and no half character."""
    after, taken = X.claim(g, NOW, LONG, 7, "ingest.crawl")
    opened = after.attempts.where("started_at = timestamp_ntz '" + str(NOW) + "'").select(F.col("item_pk").alias("id"), "worker")
    return taken.join(opened, "id").select("id", "leased_by", "worker")


@query(f"select queue, state, count(*) as n from items i where not (state = 'done' and finalized_at < {STAMP} - interval 3 day) group by all")
def sweep_deletes(g: Ledger) -> DataFrame:
    after, _ = fold_ops.sweep(g, fold_ops.SweepOptions(timedelta(days=3)), NOW)
    return after.items.groupBy("queue", "state").agg(F.count("*").alias("n"))


@query(f"select i.id as item_pk, cast(i.attempt as bigint) as n from items i where attempt > 0 and not (state = 'done' and finalized_at < {STAMP} - interval 3 day)")
def sweep_deletes_attempts(g: Ledger) -> DataFrame:
    after, _ = fold_ops.sweep(g, fold_ops.SweepOptions(timedelta(days=3)), NOW)
    return after.attempts.groupBy("item_pk").agg(F.count("*").alias("n"))


@query(f"select 'paged' as way, count(*) as swept, cast(0 as bigint) as left_over from items where state = 'done' and finalized_at < {STAMP} - interval 3 day")
def sweep_pages(g: Ledger) -> DataFrame:
    """A pass in pages, each from the newest of the one before."""
    after, n = fold_ops.sweep_pass(g, fold_ops.SweepOptions(timedelta(days=3)), NOW, folding=False, batch=2000)
    return fold_ops.due(after, fold_ops.SweepOptions(timedelta(days=3)), NOW).agg(F.lit("paged").alias("way"), F.lit(n).cast("bigint").alias("swept"), F.count("*").alias("left_over"))


@query("select id, queue, state, attempt from items where queue in ('ingest.crawl', 'ingest.index.dlq') and id <> 11")
def delete_item(g: Ledger) -> DataFrame:
    return X.delete_item(g, 11).items.where(F.col("queue").isin("ingest.crawl", "ingest.index.dlq")).select("id", "queue", "state", "attempt")


@query("select * from (values ('run_1', 'a', 0, 'j.a', 'b,c'), ('run_1', 'b', 1, 'j.b', ''), ('run_1', 'c', 2, 'j.c', 'd'), ('run_1', 'd', 3, 'j.d', '')) v(execution_id, step_id, idx, queue, successors)")
def create_execution(g: Ledger) -> DataFrame:
    made = X.create_execution(g, "run_1", "j", [("a", "j.a", ["b", "c"]), ("b", "j.b", []), ("c", "j.c", ["d"]), ("d", "j.d", [])], "{}", NOW)
    return readers.execution_steps(made, "run_1").withColumn("successors", F.concat_ws(",", "successors"))


@query(f"select '{RUN}' as id, 'ingest' as job, 'running' as state, '{{}}' as input, min(created_at) as created_at, max(created_at) as updated_at from items where execution_id = '{RUN}'")
def get_execution(g: Ledger) -> DataFrame:
    return readers.get_execution(g, RUN)


@query("select queue, count(*) filter (where state = 'ready') as ready, count(*) filter (where state = 'running') as running, count(*) filter (where state = 'done') as done, count(*) filter (where state = 'dlq') as dlq, queue = 'ingest.acl' as paused from items where queue in ('ingest.crawl', 'ingest.acl') group by queue union all select 'ingest.none', 0, 0, 0, 0, false")
def queue_stats_of_some(g: Ledger) -> DataFrame:
    """Named queues, and one queue's row, which is of zeros where it is unknown."""
    some = readers.stats(g, NOW, "ingest.crawl", "ingest.acl")
    return some.unionByName(g.spark.createDataFrame([tuple(readers.queue_stats(g, "ingest.none", NOW)[c] for c in some.columns)], some.schema))


def _asks(g: Ledger, *extra) -> DataFrame:
    """Requests of worker w0 for all items, in id order; ownership and state decide which take effect."""
    return g.items.select(F.col("id").alias("ord"), "id", F.lit("w0").alias("worker"), *extra)


def _new(queue: str):
    """An output as a struct of a new item's columns."""
    text = lambda c, n: c.cast("string").alias(n)
    return F.struct(
        F.lit(queue).alias("queue"), F.lit('{"x":1}').alias("payload"), F.lit(None).cast("timestamp_ntz").alias("available_at"), R.DEFAULT.column().alias("policy"), text(F.col("execution_id"), "execution_id"),
        F.lit("next").alias("step_id"), F.concat(F.lit("n_"), F.col("id").cast("string")).alias("item_id"), text(F.col("item_id"), "parent_item_id"),
    )


def _outputs():
    """id % 4 outputs, as _new items."""
    return F.slice(F.array(*[_new("ingest.next")] * 3), 1, (F.col("id") % 4).cast("int")).alias("produced")


OWNED = "state = 'running' and leased_by = 'w0'"


@query(f"select id, 'done' as state, case when id % 2 = 0 and id % 4 = 0 and produced = 0 then 'filtered' else 'success' end as outcome, cast(produced + id % 4 as int) as produced, {STAMP} as finalized_at from items where {OWNED}")
def complete_outcome(g: Ledger) -> DataFrame:
    after, _ = X.complete(g, _asks(g, _outputs(), (F.col("id") % 2 == 0).alias("filtered")), NOW)
    moved = after.items.where(F.col("finalized_at") == F.lit(str(NOW)).cast("timestamp_ntz"))
    return moved.select("id", "state", "outcome", "produced", "finalized_at")


@query(f"select 10000000 + row_number() over (order by id, n) - 1 as id, 'ingest.next' as queue, 'n_' || id as item_id, item_id as parent_item_id, execution_id, 5 as max_attempts from (select *, unnest(generate_series(1, id % 4)) as n from items where {OWNED}) x")
def complete_fanout(g: Ledger) -> DataFrame:
    after, _ = X.complete(g, _asks(g, _outputs()), NOW)
    return after.items.where("queue = 'ingest.next'").select("id", "queue", "item_id", "parent_item_id", "execution_id", "max_attempts")


NEWCOMERS = "(select *, row_number() over (order by id) as n from items where state = 'dlq') x"


@query(f"select 10000000 + n - 1 as id, case when id % 2 = 0 then 'ingest.fresh' else queue end as queue, case when id % 3 = 1 then '{{}}' else payload end as payload, 'ready' as state, 0 as attempt, case when id % 5 = 0 then created_at else {STAMP} end as available_at, case id % 4 when 0 then 5 when 1 then 1 else 9 end as max_attempts, nullif(case when id % 7 = 0 then '' else item_id end, '') as item_id from {NEWCOMERS}")
def enqueue_many(g: Ledger) -> DataFrame:
    """New items with payloads, due times and policies of their own, and without."""
    four, none = F.col("id") % 4, F.lit(None)
    policy = F.when(four == 0, none).when(four == 1, R.no_retry().column()).otherwise(R.retry(9, R.SECOND).column())
    new = g.items.where("state = 'dlq'").select(
        F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "ingest.fresh").otherwise(F.col("queue")).alias("queue"), F.when(F.col("id") % 3 != 1, F.col("payload")).alias("payload"),
        F.when(F.col("id") % 5 == 0, F.col("created_at")).alias("available_at"), policy.alias("policy"), F.when(F.col("id") % 7 == 0, "").otherwise(F.col("item_id")).alias("item_id"),
    )
    return X.enqueue(g, new, NOW)[1].select("id", "queue", "payload", "state", "attempt", "available_at", "max_attempts", "item_id")


@query(f"select queue as name, cast(queue like 'fresh%' as boolean) as fresh from (select distinct queue from items union select 'fresh.' || execution_id from items) q")
def ensure_queues(g: Ledger) -> DataFrame:
    """Names that are new are added once; known ones and nulls are left alone."""
    names = g.items.select(F.concat(F.lit("fresh."), "execution_id").alias("name")).unionByName(g.queues.select("name")).unionByName(g.spark.createDataFrame([(None,)], "name string"))
    return X.ensure_queues(g, names, NOW).queues.select("name", (F.col("created_at") == F.lit(str(NOW)).cast("timestamp_ntz")).alias("fresh"))


@query(f"select id as ord, case when id % 4 = 0 or ({OWNED} and attempt = 2) then null else 'lease lost' end as error_kind from items")
def emit_fenced(g: Ledger) -> DataFrame:
    return X.emit(g, _asks(g, F.lit(2).alias("attempt"), _outputs()), NOW)[1].select("ord", "error_kind")


@query(f"select id as ord, id, case when {OWNED} then null else 'wrong state' end as error_kind, case when {OWNED} then null else 'item not in the expected state: id ' || id || ' is ' || state || ' (leased_by ' || coalesce(leased_by, '<none>') || ')' end as error from items union all select -n, -n, 'not found', 'item not found: id ' || -n from (values (1), (2)) v(n)")
def guarded_batch_results(g: Ledger) -> DataFrame:
    ghosts = g.spark.createDataFrame([(-1, -1, "w0"), (-2, -2, "w0")], "ord bigint, id bigint, worker string")
    return X.release(g, _asks(g).unionByName(ghosts), NOW)[1].join(g.items.select("id", F.col("state").alias("was")), "id", "left").select("ord", "id", "error_kind", "error")


WAIT = "list_extract([5, 30, 120, 600], cast(greatest(1, least(attempt, 4)) as int))"
UNIT = "(cast('0x' || substr(md5(id || ':' || attempt), 1, 8) as bigint) / 4294967295.0)"


@query(f"select id, attempt, cast({WAIT} as bigint) as wait_s from items")
def retry_backoff(g: Ledger) -> DataFrame:
    return g.items.select("id", "attempt", (R.backoff(F.col("attempt"), F.col("policy.schedule_ns")) / R.SECOND).cast("bigint").alias("wait_s"))


@query(f"select id, 'ready' as state, attempt, cast(floor(({WAIT} * 1000000000.0) * (1 + 0.1 * (2 * {UNIT} - 1))) as bigint) // 1000000 as wait_ms, 'boom' as last_error from items where {OWNED}")
def retry_jitter_md5(g: Ledger) -> DataFrame:
    after, _ = X.retry(g, _asks(g, F.lit("boom").alias("error")), NOW)
    now = F.lit(str(NOW)).cast("timestamp_ntz")
    wait = F.expr("unix_micros(cast(available_at as timestamp))") - F.unix_micros(now.cast("timestamp"))
    return after.items.where("last_error = 'boom'").select("id", "state", "attempt", F.floor(wait / 1000).cast("bigint").alias("wait_ms"), "last_error")


@query(f"select id, case when attempt >= 5 then queue || '.dlq' else queue end as queue, case when attempt >= 5 then 'dlq' else 'ready' end as state, attempt from items where {OWNED}")
def retry_exhausted_to_dlq(g: Ledger) -> DataFrame:
    held = g.items.where(OWNED).withColumn("spent", R.exhausted(F.col("attempt"), F.col("policy.max_attempts")))
    asks = held.select(F.col("id").alias("ord"), "id", F.lit("w0").alias("worker"), F.lit("boom").alias("error"), "spent")
    after, _ = X.dead_letter(g, asks.where("spent").drop("spent"), NOW)
    after, _ = X.retry(after, asks.where("NOT spent").drop("spent"), NOW)
    return after.items.where("last_error = 'boom'").select("id", "queue", "state", "attempt")


@query(f"select id, 'ready' as state, greatest(attempt - 1, 0) as attempt, attempt - 1 as tries from items where {OWNED}")
def release_attempt(g: Ledger) -> DataFrame:
    after, _ = X.release(g, _asks(g), NOW)
    hit = g.items.where(f"{OWNED}").select("id")
    tries = after.attempts.groupBy(F.col("item_pk").alias("id")).agg(F.count("*").cast("int").alias("tries"))
    return after.items.join(hit, "id", "left_semi").join(tries, "id", "left").select("id", "state", "attempt", F.coalesce("tries", F.lit(0)).alias("tries"))


@query(f"select id, leased_by, case when leased_by = 'w0' then {STAMP} + interval 1 hour else lease_until end as lease_until from items where state = 'running'")
def extend_lease(g: Ledger) -> DataFrame:
    return X.extend_lease(g, _asks(g), NOW + timedelta(hours=1), NOW)[0].items.where("state = 'running'").select("id", "leased_by", "lease_until")


@query(f"select id, case when attempt >= 5 then queue || '.dlq' else queue end as queue, case when attempt >= 5 then 'dlq' else 'ready' end as state from (select * from items where state = 'running' and lease_until < {STAMP} order by lease_until, id limit 100) x")
def reclaim_expired(g: Ledger) -> DataFrame:
    return X.reclaim_expired(g, NOW)[0].items.where(F.col("last_error") == LAPSED).select("id", "queue", "state")


@query(f"select id, queue || '.dlq' as queue, 'dlq' as state, 'dlq' as outcome, attempt, step_id, 'bad' as last_error from items where {OWNED}")
def dead_letter_rename(g: Ledger) -> DataFrame:
    after, _ = X.dead_letter(g, _asks(g, F.lit("bad").alias("error")), NOW)
    return after.items.where("last_error = 'bad'").select("id", "queue", "state", "outcome", "attempt", "step_id", "last_error")


@query("select id, 'ingest.crawl' as queue, 'ready' as state, 0 as attempt, last_error from (select * from items where queue = 'ingest.crawl.dlq' and last_error ilike '%http_4%' order by id limit 100) x")
def replay_ilike(g: Ledger) -> DataFrame:
    after, _ = X.replay(g, "ingest.crawl.dlq", NOW, "http_4")
    return after.items.where("queue = 'ingest.crawl' AND state = 'ready' AND last_error LIKE 'http%'").select("id", "queue", "state", "attempt", "last_error")


@query("select id, case when queue = 'ingest.index.dlq' then 'ingest.index' else queue end as queue, case when queue = 'ingest.index.dlq' then 'ready' else state end as state, case when queue = 'ingest.index.dlq' then 0 else attempt end as attempt, (select count(*) from items where queue = 'ingest.index.dlq') as moved from items where queue in ('ingest.index', 'ingest.index.dlq')")
def dlq_drain(g: Ledger) -> DataFrame:
    after, n = X.drain(g, "ingest.index.dlq", NOW)
    return after.items.where("queue LIKE 'ingest.index%'").select("id", "queue", "state", "attempt", F.lit(n).cast("bigint").alias("moved"))


OLD = f"state = 'done' and finalized_at < {STAMP} - interval 3 day"


@query(f"select id, finalized_at from items where {OLD} order by finalized_at, id limit 500")
def sweep_batch(g: Ledger) -> DataFrame:
    return fold_ops.due(g, fold_ops.SweepOptions(timedelta(days=3), limit=500), NOW).select("id", "finalized_at")


def _folded(g: Ledger) -> Ledger:
    options = fold_ops.SweepOptions(timedelta(days=3), labels={source.JOB: ["gone", "excluded", "gone", ""]})
    return fold_ops.fold(g, options, NOW)[0]


@query(f"select execution_id, step_id, count(*) filter (where outcome = 'success') as succeeded, count(*) filter (where outcome = 'filtered') as filtered, cast(sum(produced) as bigint) as produced, cast(sum(dropped) as bigint) as dropped, count(*) filter (where produced_capped) as capped, max(finalized_at) as last_activity from items where {OLD} group by 1, 2")
def fold_step_counts(g: Ledger) -> DataFrame:
    return _folded(g).step_counts.drop("filtered_by")


@query(f"select execution_id, step_id, label as flag, count(*) as n from items, (values ('gone'), ('excluded')) l(label) where {OLD} and outcome = 'filtered' and payload::json->>label = 'true' group by all")
def fold_label_map(g: Ledger) -> DataFrame:
    return _folded(g).step_counts.select("execution_id", "step_id", F.explode("filtered_by").alias("flag", "n"))


@query(f"select queue, date_trunc('hour', finalized_at) as hour, count(*) as done from items where {OLD} group by 1, 2")
def fold_done_hourly(g: Ledger) -> DataFrame:
    return _folded(g).done_hourly


@query(f"select id, queue, outcome, cast(n as int) as attempt, case when n < attempt then 'error' else outcome end as attempt_outcome from (select *, unnest(generate_series(1, attempt)) as n from items where {OLD} and finalized_at >= date_trunc('day', {STAMP} - interval 7 day)) x")
def fold_history_attempts(g: Ledger) -> DataFrame:
    return _folded(g).item_history.select("id", "queue", "outcome", F.explode("attempts").alias("a")).select("id", "queue", "outcome", "a.attempt", F.col("a.outcome").alias("attempt_outcome"))


@query(f"select execution_id, step_id, count(*) filter (where outcome = 'success') as succeeded, count(*) filter (where outcome = 'filtered') as filtered, cast(sum(produced) as bigint) as produced, cast(sum(dropped) as bigint) as dropped, count(*) filter (where produced_capped) as capped, max(finalized_at) as last_activity from items where {OLD} group by 1, 2")
def fold_adds_up(g: Ledger) -> DataFrame:
    """Three folds, each into what the ones before saved."""
    for days in (9, 5, 3):
        g = fold_ops.fold(g, fold_ops.SweepOptions(timedelta(days=days), labels={source.JOB: ["gone"]}), NOW)[0].settled()
    return g.step_counts.drop("filtered_by")


@query(f"select execution_id, step_id, label as flag, count(*) as n from items, (values ('gone'), ('excluded')) l(label) where {OLD} and outcome = 'filtered' and payload::json->>label = 'true' group by all")
def fold_labels_add_up(g: Ledger) -> DataFrame:
    for days in (9, 5, 3):
        g = fold_ops.fold(g, fold_ops.SweepOptions(timedelta(days=days), labels={source.JOB: ["gone", "excluded"]}), NOW)[0].settled()
    return g.step_counts.select("execution_id", "step_id", F.explode("filtered_by").alias("flag", "n"))


@query(f"select queue, date_trunc('hour', finalized_at) as hour, count(*) as done from items where {OLD} group by 1, 2")
def fold_hours_add_up(g: Ledger) -> DataFrame:
    for days in (9, 5, 3):
        g = fold_ops.fold(g, fold_ops.SweepOptions(timedelta(days=days)), NOW)[0].settled()
    return g.done_hourly


@query(f"select 'item_history' as kept, count(*) as n from items where {OLD} and cast(finalized_at as date) >= cast(date_trunc('day', {STAMP} - interval 5 day) as date) - 1 and finalized_at >= date_trunc('day', {STAMP} - interval 7 day) union all select 'done_hourly', count(*) from (select distinct queue, date_trunc('hour', finalized_at) as hour from items where {OLD}) h where hour >= date_trunc('hour', {STAMP} - interval 6 day)")
def prepare_fold(g: Ledger) -> DataFrame:
    """History days and hourly tallies that are past keeping go before a fold."""
    after = fold_ops.prepare(_folded(g), NOW, timedelta(days=5), timedelta(days=6))
    return after.item_history.agg(F.lit("item_history").alias("kept"), F.count("*").alias("n")).unionByName(after.done_hourly.agg(F.lit("done_hourly").alias("kept"), F.count("*").alias("n")))


def _kept_whole(g: Ledger) -> Ledger:
    """Everything done long ago folded, with its whole history."""
    labels = {source.JOB: ["gone", "excluded"]}
    return fold_ops.fold(g, fold_ops.SweepOptions(timedelta(days=3), labels=labels, history=timedelta(days=4000)), NOW)[0]


def _same_after_fold(name: str, read: Callable[[Ledger], DataFrame] | None = None) -> None:
    """Registers a reader on a folded ledger: its SQL is that of the ledger before the fold."""
    sql = SQL[name]
    base = QUERIES[name]
    fn = globals()[name] if read is None else read
    QUERIES[f"folded_{name}"] = lambda spark, sf_dir: fn(_kept_whole(ledger(spark, sf_dir)))
    SQL[f"folded_{name}"] = sql
    assert base is QUERIES[name]


for _reader in ("step_counts", "filtered_by_label", "run_summary", "lineage", "lineage_never_entered", "list_executions", "execution_steps", "get_execution", "list_items_filtered"):
    _same_after_fold(_reader)


@query("select item_pk, cast(attempt as int) as attempt, worker, started_at, ended_at, outcome, error from (select id as item_pk, n as attempt, coalesce(last_worker, 'w0') as worker, created_at as started_at, case when n < attempt or state <> 'running' then created_at end as ended_at, case when n < attempt then 'error' when state = 'running' then null else coalesce(outcome, 'error') end as outcome, case when n = attempt then last_error else 'try again' end as error from (select *, unnest(generate_series(1, attempt)) as n from items) x) y")
def folded_attempts(g: Ledger) -> DataFrame:
    """All attempts, live and folded, but for their sequence numbers, which a fold renumbers by item."""
    return readers.attempts(_kept_whole(g)).drop("seq")


@query(f"select id, queue, state, outcome, attempt, max_attempts, last_error, execution_id, step_id, item_id, parent_item_id, produced, dropped, produced_capped, created_at, finalized_at from items")
def folded_items_all(g: Ledger) -> DataFrame:
    """Every item by id, whether it is live or only in the history."""
    after = _kept_whole(g)
    names = ["id", "queue", "state", "outcome", "attempt", "max_attempts", "last_error", "execution_id", "step_id", "item_id", "parent_item_id", "produced", "dropped", "produced_capped", "created_at", "finalized_at"]
    return after.items.select(*names).unionByName(readers.folded_items(after).select(*names))


@query(f"select id, cast({WAIT} as bigint) * 900000000 as least_ns, cast({WAIT} as bigint) * 1100000000 as most_ns, cast(floor(({WAIT} * 1000000000.0) * (1 + 0.1 * (2 * {UNIT} - 1))) as bigint) // 1000000 as wait_ms, true as inside, attempt >= 1 as spent_without_retry, attempt >= 3 as spent_of_three from items where attempt > 0")
def retry_policies(g: Ledger) -> DataFrame:
    """Waits with the bounds that jitter keeps, and when other policies' attempts are spent."""
    base, jitter = R.backoff(F.col("attempt"), F.col("policy.schedule_ns")), F.col("policy.jitter")
    wait = R.jittered(base, jitter, R.spread(F.col("id"), F.col("attempt")))
    low, high = R.bounds(base, jitter)
    spent = lambda p: R.exhausted(F.col("attempt"), F.lit(p.max_attempts))
    return g.items.where("attempt > 0").select("id", low.alias("least_ns"), high.alias("most_ns"), F.floor(wait / 1_000_000).cast("bigint").alias("wait_ms"), wait.between(low, high).alias("inside"), spent(R.no_retry()).alias("spent_without_retry"), spent(R.retry(3, R.SECOND)).alias("spent_of_three"))


@query("select id, 'lease' as rule from items where id % 5 = 0 and state = 'running' union all select id, 'finalized' from items where id % 5 = 1 and state in ('done', 'dlq') union all select id, 'state' from items where id % 5 = 2 and state = 'ready' union all select id, 'outcome' from items where id % 5 = 3")
def constraint_violations(g: Ledger) -> DataFrame:
    five = F.col("id") % 5
    broken = g.items.withColumn("lease_until", F.when(five != 0, F.col("lease_until"))).withColumn("finalized_at", F.when(five != 1, F.col("finalized_at")))
    broken = broken.withColumn("state", F.when((five == 2) & (F.col("state") == "ready"), "lost").otherwise(F.col("state"))).withColumn("outcome", F.when(five == 3, "odd").otherwise(F.col("outcome")))
    return violations(broken)


def _words(page: dict) -> list:
    return [{"line": s} for s in page["text"].split("\n") if s.split()]


def _stream_words(page: dict, out) -> None:
    for s in page["text"].split("\n"):
        if s.split():
            out.add({"line": s})


def _lines_sql(op: str) -> str:
    return f"select doc_id as id, '{op}' as op, count(*) filter (where trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '') as lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) x group by 1"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    return docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("attempt"), F.to_json(F.struct("text")).alias("payload"))


def pipeline_flatmap_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipeline.handle(_documents(spark, sf_dir), pipeline.Step("split", _words))
    return made.select("id", F.lit("flatmap").alias("op"), F.size(F.flatten("outputs")).cast("bigint").alias("lines"))


def pipeline_stream_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipeline.handle(_documents(spark, sf_dir), pipeline.Step("split", _stream_words, stream=True, flush_size=10))
    return made.select("id", F.lit("stream").alias("op"), F.size(F.flatten("outputs")).cast("bigint").alias("lines"))


QUERIES |= {"pipeline_flatmap_udf": pipeline_flatmap_udf, "pipeline_stream_udtf": pipeline_stream_udtf}
SQL |= {"pipeline_flatmap_udf": _lines_sql("flatmap"), "pipeline_stream_udtf": _lines_sql("stream")}


def _pick(nation: dict) -> list | dict:
    if nation["k"] == 4:
        raise pipeline.Discard("not wanted")
    return [] if nation["k"] % 2 else nation


def job_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job from its seed to its end: fan-out, filter, discard, map, and two branches that both get the output."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    job = pipeline.Job("geo").step("list", lambda p: [{"k": i} for i in range(p["n"])]).step("pick", _pick)
    job.step("left", lambda p: None, after="pick").step("right", lambda p: None, after="pick")
    g, run = job.run(new_ledger(spark), {"n": n}, NOW)
    g = pipeline.Runner([job]).run(g.settled(), NOW)
    counts = readers.step_counts(g, run).select("step_id", "idx", "queue", "received", "succeeded", "filtered", "dlq", "active", "produced")
    kept = g.items.where("state = 'done' AND item_id IS NOT NULL").groupBy("step_id").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("parent_item_id").alias("parents"))
    return counts.join(kept, "step_id", "left")


QUERIES["job_run"] = job_run
SQL["job_run"] = """
with k as (select unnest(range((select count(*) from nation))) as k), f as (select count(*) as n, count(*) filter (where k % 2 = 1) as odd, count(*) filter (where k % 2 = 0 and k <> 4) as fine from k)
select 'list' as step_id, 0 as idx, 'geo.list' as queue, cast(1 as bigint) as received, cast(1 as bigint) as succeeded, cast(0 as bigint) as filtered, cast(0 as bigint) as dlq, cast(0 as bigint) as active, n as produced, cast(1 as bigint) as items, cast(0 as bigint) as parents from f
union all select 'pick', 1, 'geo.pick', n, fine, odd, n - fine - odd, 0, 2 * fine, fine + odd, 1 from f
union all select v.s, v.i, 'geo.' || v.s, fine, fine, 0, 0, 0, 0, fine, fine from f, (values ('left', 2), ('right', 3)) v(s, i)
"""


def stream_hourly_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The done tally from a stream over the event files."""
    from tidemill.streaming import tally

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    events.createOrReplaceTempView("__tidemill_stream")
    items = spark.sql(source.items_sql(source.K_SPARK, "__tidemill_stream")).select("queue", "state", "finalized_at")
    return tally.finished(tally.hourly(items, "60 days"), ["queue", "hour"], "hourly_tally")


OPS = ["enqueue", "claim", "complete", "retry", "claim", "release", "claim", "dead_letter", "expire"]


def stream_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations read from events (item = user, one operation for each event) through the keyed state machine, as a stream."""
    from tidemill.streaming import machine, tally

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    name = F.element_at(F.array(*map(F.lit, OPS)), (F.col("event_id") % len(OPS) + 1).cast("int"))
    ops = events.select(F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ord"), name.alias("op"), F.lit("w").alias("worker"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return tally.finished(machine.run_stream(ops), ["id", "ord"], "state_machine", "append")


QUERIES |= {"stream_hourly_tally": stream_hourly_tally, "stream_state_machine": stream_state_machine}
SQL |= {"stream_hourly_tally": f"with {ITEMS} select queue, date_trunc('hour', finalized_at) as hour, count(*) as done from items where state = 'done' group by 1, 2"}

MACHINE_NAME = "list_extract([" + ", ".join(f"'{o}'" for o in OPS) + f"], event_id % {len(OPS)} + 1)"
SQL["stream_state_machine"] = f"""
with recursive ops as (select user_id as id, epoch_us(ts) as ord, {MACHINE_NAME} as op, epoch_us(ts) / 1000000.0 as t, row_number() over (partition by user_id order by ts) as n from events),
walk as (
  select id, cast(0 as bigint) as n, cast(null as bigint) as ord, cast(null as varchar) as op, false as accepted, cast(null as varchar) as state, 0 as attempt, cast(null as varchar) as owner, cast(0 as double) as until from (select distinct id from ops) i
  union all
  select id, n, ord, op, ok, case when not ok then state when op = 'claim' then 'running' when op in ('enqueue', 'retry', 'release') then 'ready' when op = 'complete' then 'done' when op = 'dead_letter' then 'dlq' when attempt >= 5 then 'dlq' else 'ready' end,
    case when ok and op = 'claim' then attempt + 1 when ok and op = 'release' then greatest(0, attempt - 1) else attempt end, case when not ok then owner when op = 'claim' then 'w' end, case when not ok then until when op = 'claim' then t + 30 else 0 end
  from (select w.id, o.n, o.ord, o.op, o.t, w.state, w.attempt, w.owner, w.until,
      case o.op when 'enqueue' then w.state is null when 'claim' then coalesce(w.state = 'ready', false) when 'expire' then coalesce(w.state = 'running' and w.until < o.t, false) else coalesce(w.state = 'running', false) end as ok
    from walk w join ops o on o.id = w.id and o.n = w.n + 1) x)
select id, ord, op, accepted, state, cast(attempt as int) as attempt, owner from walk where n > 0
"""
