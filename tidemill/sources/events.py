"""A ledger seen in a table of events: each event is an item, each user an execution of one job.

The job is discover -> crawl -> {acl, process}, process -> index. The field k
of an event's JSON decides its state. The same text serves other SQL engines,
apart from how they read the field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.policy import DEFAULT
from tidemill.operators.ledger import Ledger
from tidemill.schema import TABLES, columns, empty

JOB = "ingest"
STEPS = [("discover", 0), ("crawl", 1), ("process", 2), ("index", 3), ("acl", 4)]
EDGES = [("discover", "crawl"), ("crawl", "acl"), ("crawl", "process"), ("process", "index")]
K_SPARK = "cast(get_json_object(props,'$.k') as int)"
K_DUCKDB = "cast(props->>'$.k' as int)"


def items_sql(k: str, events: str = "events") -> str:
    """Items of the events, without policy, as a SELECT."""
    return f"""
select event_id as id, concat('{JOB}.', step_id, case when k % 10 = 9 then '.dlq' else '' end) as queue,
  concat('{{"gone":', case when k % 10 = 4 then 'true' else 'false' end, ',"excluded":"', case when k % 20 = 5 then 'true' else 'no' end, '"}}') as payload,
  case when k % 10 <= 5 then 'done' when k % 10 = 6 then 'running' when k % 10 <= 8 then 'ready' else 'dlq' end as state,
  case when k % 10 <= 3 then 'success' when k % 10 <= 5 then 'filtered' when k % 10 = 9 then 'dlq' end as outcome,
  case when k % 10 in (7, 8) then k % 4 else 1 + k % 5 end as attempt, 5 as max_attempts,
  case when k % 10 = 7 then ts + interval 1 hour else ts end as available_at,
  case when k % 10 = 6 then concat('w', cast(k % 3 as varchar(2))) end as leased_by,
  case when k % 10 = 6 then ts + interval 30 second end as lease_until,
  case when k % 10 = 9 then case when k < 40 then 'unsupported_pdf_encoding' when k < 70 then 'connection_refused' else 'http 451' end end as last_error,
  case when k % 10 not in (7, 8) then concat('w', cast(k % 3 as varchar(2))) end as last_worker,
  concat('exec_', cast(user_id as varchar(20))) as execution_id, step_id,
  concat('item_', cast(event_id % 11 as varchar(20))) as item_id, case when step_id <> 'discover' then concat('item_', cast(event_id % 11 as varchar(20))) end as parent_item_id,
  case when k % 10 <= 3 and step_id not in ('index', 'acl') then k % 3 + 1 else 0 end as produced,
  case when k = 0 then 40 else 0 end as dropped, (k = 0) as produced_capped,
  ts as created_at, ts as updated_at, case when k % 10 <= 5 or k % 10 = 9 then ts end as finalized_at, k
from (select event_id, user_id, ts, {k} as k,
        case event_type when 'signup' then 'discover' when 'view' then 'crawl' when 'click' then 'process' when 'purchase' then 'index' else 'acl' end as step_id
      from {events}) e"""


def ledger(spark: SparkSession, events: DataFrame, next_item: int = 10_000_000, next_attempt: int = 100_000_000) -> Ledger:
    """The ledger of an events table; its attempts are one for each that an item has made."""
    name = "__tidemill_events"
    events.createOrReplaceTempView(name)
    raw = spark.sql(items_sql(K_SPARK, name))
    types = dict(empty(spark, "items").dtypes)
    items = raw.withColumn("policy", DEFAULT.column()).select(*[F.col(c).cast(types[c]).alias(c) for c in columns("items")])
    tries = raw.where("attempt > 0").select("id", "attempt", "state", "outcome", "last_worker", "created_at", "finalized_at", "last_error", F.explode(F.sequence(F.lit(1), F.col("attempt"))).alias("n"))
    last = F.col("n") == F.col("attempt")
    attempts = tries.select(
        (F.col("id") * 8 + F.col("n")).cast("bigint").alias("id"), F.col("id").alias("item_pk"), F.col("n").alias("attempt"), F.coalesce("last_worker", F.lit("w0")).alias("worker"),
        F.col("created_at").alias("started_at"), F.when(~last | (F.col("state") != "running"), F.col("created_at")).alias("ended_at"),
        F.when(~last, "error").when(F.col("state") == "running", F.lit(None)).otherwise(F.coalesce("outcome", F.lit("error"))).alias("outcome"), F.when(last, F.col("last_error")).otherwise("try again").alias("error"),
    )
    runs = events.groupBy(F.concat(F.lit("exec_"), F.col("user_id").cast("string")).alias("id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    executions = runs.select("id", F.lit(JOB).alias("job"), F.lit("running").alias("state"), F.lit("{}").alias("input"), "created_at", "updated_at")
    step_list = F.array(*[F.struct(F.lit(s).alias("step_id"), F.lit(i).alias("idx"), F.lit(f"{JOB}.{s}").alias("queue")) for s, i in STEPS])
    edge_list = F.array(*[F.struct(F.lit(a).alias("from_step_id"), F.lit(b).alias("to_step_id")) for a, b in EDGES])
    steps = runs.select(F.col("id").alias("execution_id"), F.explode(step_list).alias("s")).select("execution_id", "s.*")
    edges = runs.select(F.col("id").alias("execution_id"), F.explode(edge_list).alias("e")).select("execution_id", "e.*")
    none = F.lit(None).cast("timestamp_ntz")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    queues = items.select(F.col("queue").alias("name")).distinct().select("name", F.when(F.col("name") == f"{JOB}.acl", start).otherwise(none).alias("paused_at"), start.alias("created_at"), start.alias("updated_at"))
    frames = {t: empty(spark, t) for t in TABLES} | {"items": items, "attempts": attempts, "executions": executions, "steps": steps, "step_edges": edges, "queues": queues}
    return Ledger(frames, next_item, next_attempt)
