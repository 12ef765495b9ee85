"""Tables of a work ledger: their columns, fixed values and constraints.

Timestamps are ``timestamp_ntz`` holding UTC; durations are nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY = "struct<max_attempts:int,schedule_ns:array<bigint>,jitter:double>"
ATTEMPT = "struct<attempt:int,worker:string,started_at:timestamp_ntz,ended_at:timestamp_ntz,outcome:string,error:string>"

ITEMS = (
    "id bigint, queue string, payload string, state string, outcome string, attempt int, max_attempts int, "
    "available_at timestamp_ntz, leased_by string, lease_until timestamp_ntz, last_error string, last_worker string, "
    "execution_id string, step_id string, item_id string, parent_item_id string, produced int, dropped int, "
    f"produced_capped boolean, policy {POLICY}, created_at timestamp_ntz, updated_at timestamp_ntz, finalized_at timestamp_ntz"
)
TABLES = {
    "queues": "name string, paused_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "items": ITEMS,
    "executions": "id string, job string, state string, input string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "steps": "execution_id string, step_id string, idx int, queue string",
    "step_edges": "execution_id string, from_step_id string, to_step_id string",
    "attempts": "id bigint, item_pk bigint, attempt int, worker string, started_at timestamp_ntz, ended_at timestamp_ntz, outcome string, error string",
    "step_counts": "execution_id string, step_id string, succeeded bigint, filtered bigint, filtered_by map<string,bigint>, produced bigint, dropped bigint, capped bigint, last_activity timestamp_ntz",
    "done_hourly": "queue string, hour timestamp_ntz, done bigint",
    "item_history": (
        "id bigint, queue string, outcome string, attempt int, max_attempts int, execution_id string, step_id string, item_id string, "
        "parent_item_id string, last_error string, produced int, dropped int, produced_capped boolean, created_at timestamp_ntz, "
        f"finalized_at timestamp_ntz, attempts array<{ATTEMPT}>, day date"
    ),
}
NEW_ITEM = f"ord bigint, queue string, payload string, available_at timestamp_ntz, policy {POLICY}, execution_id string, step_id string, item_id string, parent_item_id string"
# What a result of a guarded request says.
RESULT = "ord bigint, id bigint, error_kind string, error string"

STATES = ("ready", "running", "done", "dlq")
OUTCOMES = ("success", "filtered", "dlq")
DLQ = ".dlq"
RETENTION_NEVER = -1
RETENTION_ZERO = -2
NOT_FOUND = "not found"
WRONG_STATE = "wrong state"
LEASE_LOST = "lease lost"
LAPSED = "lease expired; worker did not finish the attempt"
SCHEMA_VERSION = 3


def columns(table: str) -> list[str]:
    return [f.split()[0] for f in _split(TABLES[table])]


def _split(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def dlq_of(queue):
    """A queue's dead-letter queue."""
    return F.concat(queue, F.lit(DLQ))


def base_of(queue):
    """The working queue of a dead-letter queue; other queues are their own."""
    return F.regexp_replace(queue, r"\.dlq$", "")


def violations(items: DataFrame) -> DataFrame:
    """(id, rule) for each item that breaks a constraint of the ledger."""
    final = F.col("state").isin("done", "dlq")
    leased = F.col("leased_by").isNotNull() & F.col("lease_until").isNotNull()
    free = F.col("leased_by").isNull() & F.col("lease_until").isNull()
    rules = {
        "state": ~F.coalesce(F.col("state").isin(*STATES), F.lit(False)),
        "outcome": F.col("outcome").isNotNull() & ~F.col("outcome").isin(*OUTCOMES),
        "finalized": final != F.col("finalized_at").isNotNull(),
        "lease": F.when(F.col("state") == "running", ~leased).otherwise(~free),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return items.select("id", F.explode(broken).alias("rule"))


def check_session(spark: SparkSession) -> None:
    """Truncating timestamps is only right in UTC, which has no gaps."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"the session's time zone is {zone}; set spark.sql.session.timeZone to UTC")
