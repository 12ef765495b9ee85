"""Run status and leaks of all executions from step counts and step edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["execution_id", "step_id"]
# Kinds of leaks (fixed values).
EDGE_IMBALANCE, CAPPED_OUTPUT, BRANCH_DIVERGENCE, DUPLICATION, CONTINUITY = "edge-imbalance", "capped-output", "branch-divergence", "duplication", "continuity"


@dataclass(frozen=True)
class Projection:
    summary: DataFrame  # one row for each execution
    steps: DataFrame
    leaks: DataFrame


def run_steps(counts: DataFrame) -> DataFrame:
    return counts.withColumn("terminal", F.col("succeeded") + F.col("filtered") + F.col("dlq"))


def run_summary(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """status, terminal_success (over steps without successors), terminal_dlq and active of each execution."""
    inner = edges.select("execution_id", F.col("from_step_id").alias("step_id"), F.lit(True).alias("inner")).distinct()
    leaf = F.col("inner").isNull()
    return counts.join(inner, KEY, "left").groupBy("execution_id").agg(
        F.when(F.sum("active") > 0, "RUNNING").otherwise("COMPLETE").alias("status"), F.sum(F.when(leaf, F.col("succeeded")).otherwise(0)).cast("bigint").alias("terminal_success"),
        F.sum("dlq").cast("bigint").alias("terminal_dlq"), F.sum("active").cast("bigint").alias("active"),
    )


def run_leaks(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """(execution_id, kind, step_id, edge, missing, detail, ord1, ord2, ord3), the last three giving the order of leaks in a run."""
    n = lambda c: F.col(c).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shape = lambda df, kind, edge, missing, detail, *ords: df.select(
        "execution_id", F.lit(kind).alias("kind"), "step_id", edge.cast("string").alias("edge"), missing.cast("bigint").alias("missing"), detail.alias("detail"),
        *[o.cast("int").alias(f"ord{i + 1}") for i, o in enumerate(ords)],
    )
    steps = run_steps(counts)
    got = F.col("terminal") + F.col("active")
    one, two = F.lit(1), F.lit(2)
    imbalance = shape(
        steps.where(got != F.col("received")), EDGE_IMBALANCE, F.lit(None), F.col("received") - got,
        text(n("received"), " items entered, ", got.cast("string"), " accounted for: ", n("succeeded"), " succeeded, ", n("filtered"), " filtered, ", n("dlq"), " dead-lettered, ", n("active"), " active"),
        one, F.col("idx"), F.lit(0),
    )
    capped = shape(steps.where("capped > 0"), CAPPED_OUTPUT, F.lit(None), F.col("dropped"), text(n("capped"), " items capped their output and dropped ", n("dropped")), one, F.col("idx"), one)
    up = steps.select("execution_id", "step_id", "idx", F.col("produced").alias("up_produced"), F.col("active").alias("up_active"))
    down = steps.select("execution_id", F.col("step_id").alias("to_step_id"), F.col("received").alias("to_received"))
    pairs = edges.select("execution_id", F.col("from_step_id").alias("step_id"), "to_step_id").join(up, KEY).join(down, ["execution_id", "to_step_id"], "left")
    pairs = pairs.withColumn("to_received", F.coalesce("to_received", F.lit(0)))
    # A step has few successors; gathering their names is what the edge text is made of.
    groups = pairs.groupBy(*KEY, "idx", "up_produced", "up_active").agg(F.sum("to_received").alias("reached"), F.count("*").alias("fan"), F.sort_array(F.collect_list("to_step_id")).alias("names"))
    branches = pairs.join(groups.where("fan > 1").select(*KEY, "fan", "names"), KEY).withColumn("expected", F.expr("up_produced div fan"))
    diverged = shape(
        branches.where("to_received != expected"), BRANCH_DIVERGENCE, text(F.col("step_id"), "->", F.col("to_step_id")), F.col("expected") - F.col("to_received"),
        text(F.col("to_step_id"), " received ", n("to_received"), " of ", n("expected"), " under ", F.col("step_id")), two, F.col("idx"), F.array_position("names", F.col("to_step_id")),
    )
    listed = F.concat_ws(",", "names")
    edge = F.when(F.col("fan") > 1, text(F.col("step_id"), "->{", listed, "}")).otherwise(text(F.col("step_id"), "->", listed))
    last = F.lit(1 << 30)
    twice = shape(groups.where("reached > up_produced"), DUPLICATION, edge, F.col("up_produced") - F.col("reached"), text("successors of ", F.col("step_id"), " received ", n("reached"), " of ", n("up_produced"), " produced"), two, F.col("idx"), last)
    short = shape(groups.where("up_active = 0 AND reached < up_produced"), CONTINUITY, edge, F.col("up_produced") - F.col("reached"), text(F.col("step_id"), " produced ", n("up_produced"), ", ", n("reached"), " reached its successors"), two, F.col("idx"), last)
    return imbalance.unionByName(capped).unionByName(diverged).unionByName(twice).unionByName(short)


def leak_text(leaks: DataFrame) -> DataFrame:
    """Leaks with a ``text`` column, in order."""
    where = F.when(F.col("edge").isNotNull(), F.format_string("%s on edge %s: %s", "kind", "edge", "detail")).otherwise(F.format_string('%s at step "%s": %s', "kind", "step_id", "detail"))
    return leaks.withColumn("text", where).orderBy("execution_id", "ord1", "ord2", "ord3")


def project(counts: DataFrame, edges: DataFrame) -> Projection:
    return Projection(run_summary(counts, edges), run_steps(counts), run_leaks(counts, edges))
