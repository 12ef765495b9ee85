"""Mixing sources to target weights by entropy balancing.

Document rates are the exponential tilt closest to taking every document once
(in relative entropy, weighted by size) that meets each source's token target,
takes no document more than CAP times, and keeps the corpus's mean document
length as far as the targets allow. The convex dual has a multiplier for each
source and one for the length; its Newton steps add up gradient and Hessian
over the documents in Spark. Rates become whole copies by error diffusion from
large documents to small ones within shards of a source, so a source's total
ends within about one small document per shard of its target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.frames import cut, partitions

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SHARD_DOCS = 500
SALTS = 64
SLACK = 1.0  # smaller holds the mean length more strictly
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(spaced, " "), ""))).cast("long")


def _ranked(totals: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 in the order of code points, null last; sources are sorted in ranges, not in one task."""
    spark = totals.sparkSession
    placed = totals.repartitionByRange(partitions(spark), F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    # The lower 33 bits of the id count the rows of a partition.
    placed = cut(placed.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__place")))
    before, count = {}, 0
    for r in sorted(placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        before[r["__part"]], count = count, count + r["n"]
    if not before:
        return placed.withColumn("rank", F.col("__place")).drop("__part", "__place")
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__part"))
    return placed.withColumn("rank", offset + F.col("__place")).drop("__part", "__place")


def targets(totals: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources rank by code point, null last, and take the weights in turn. Excess
    over ``cap`` times a source's size goes to the others by weight: targets are
    min(most, w * level), and the level at which they add up to the total is
    found by Newton's method, which rises to it on a concave line of as many
    pieces as there are sources.
    """
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    ranked = cut(_ranked(totals).select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most")))
    level, left = 0.0, -1
    while True:
        free = F.col("w") * F.lit(level) < F.col("most")
        total, given, slope, n = ranked.agg(F.sum("source_size").cast("double"), F.sum(F.least(F.col("most"), F.col("w") * F.lit(level))), F.sum(F.when(free, F.col("w"))), F.count(F.when(free, 1))).first()
        if not total or not slope or n == left:  # the same sources are free: the level is theirs
            break
        level, left = level + (total - given) / slope, n
    return ranked.select("source", "source_size", F.least(F.col("most"), F.col("w") * F.lit(level)).alias("target"))


def tilt(hist: DataFrame, plan: DataFrame, cap: float = CAP, slack: float = SLACK, rounds: int = 40, close: float = 1e-9) -> tuple[DataFrame, float, float, float]:
    """(source, source_size, target, x) with each source's multiplier, the length multiplier, and the mean and spread of log sizes.

    ``hist`` holds (source, size, n): how many documents of a source have a
    size, which is all the dual needs of the documents, as a rate depends on
    nothing else. A document's rate is min(cap, exp(x[source] + y * z)), where
    z is its standardised log size. The dual adds up over documents; its
    gradient and its Hessian (an arrow: one row for each source and one for the
    lengths) are sums of size * rate, size * rate * z and size * rate * z^2 that
    Spark aggregates at every step, the Hessian's over documents below the cap.
    The source constraints are exact. The length constraint, that the mix keep
    the corpus's mean log size, may conflict with them: it costs SLACK times the
    squared gap. Steps have a length of at most 1 and are halved until the dual
    rises. Sources without words or with a target of 0 have a null multiplier.
    """
    words = F.col("n") * F.col("size")
    log = F.log("size")
    total, first, second = hist.where("size > 0").agg(F.sum(words), F.sum(words * log), F.sum(words * log * log)).first()
    if not total:
        return plan.withColumn("x", F.lit(None).cast("double")), 0.0, 0.0, 1.0
    mean = first / total
    spread = max(second / total - mean * mean, 1e-12) ** 0.5
    live = hist.where("size > 0").select("source", words.cast("double").alias("w"), ((log - F.lit(mean)) / F.lit(spread)).alias("z"))
    weight, top = slack * float(total), math.log(cap)

    def measured(state: DataFrame, y: float) -> tuple[DataFrame, tuple]:
        """Each source's sums over its documents, and the dual with what the Schur complement needs of all sources."""
        rated = live.join(state, F.col("source").eqNullSafe(F.col("s")))
        z, u = F.col("z"), F.col("x") + F.lit(y) * F.col("z")
        taken = F.col("w") * F.least(F.exp(u), F.lit(float(cap)))
        rated = rated.select("s", "target", "x", "z", taken.alias("t"), F.when(u < top, taken).otherwise(0.0).alias("free"), F.when(u < top, taken).otherwise(taken * (1 + u - top)).alias("area"))
        sums = rated.groupBy("s", "target", "x").agg(F.sum("t").alias("t"), F.sum("free").alias("h"), F.sum(F.col("free") * z).alias("hz"), F.sum(F.col("free") * z * z).alias("hzz"), F.sum(F.col("t") * z).alias("tz"), F.sum("area").alias("area"))
        # A source all of whose documents are at the cap has no curvature left.
        sums = cut(sums.withColumn("gap", F.col("target") - F.col("t")).withColumn("h", F.greatest("h", F.lit(1e-6) * F.col("target"))))
        hz = F.col("hz") / F.col("h")
        return sums, sums.agg(F.sum(F.col("target") * F.col("x") - F.col("area")) - weight * y * y / 2, F.max(F.abs(F.col("gap") / F.col("target"))), F.sum("tz"), F.sum("hzz"), F.sum(F.col("hz") * hz), F.sum(hz * F.col("gap"))).first()

    y = 0.0
    here, now = measured(cut(plan.where("source_size > 0 AND target > 0").select(F.col("source").alias("s"), "target", F.log(F.col("target") / F.col("source_size")).alias("x"))), y)
    for _ in range(rounds):
        value, worst, tz, hzz, bent, pull = now
        if worst is None:
            break
        dy = (-tz - weight * y - pull) / (hzz - bent + weight)
        if worst < close and abs(dy) < close:
            break
        dx = (F.col("gap") - F.col("hz") * F.lit(dy)) / F.col("h")
        step = min(1.0, 1.0 / max(abs(dy), here.agg(F.max(F.abs(dx))).first()[0]))
        while True:
            there, then = measured(here.select("s", "target", (F.col("x") + F.lit(step) * dx).alias("x")), y + step * dy)
            if then[0] >= value - 1e-12 * abs(value) or step < 1e-6:
                break
            step /= 2
        here, now, y = there, then, y + step * dy
    found = plan.join(here.select("s", "x"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "x")
    return cut(found), y, mean, spread


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Error diffusion over rows sorted by (shard, size descending)."""
    shard, owed = None, 0.0
    for batch in batches:
        key = batch.column("shard").to_pylist()
        size = batch.column("size").to_pylist()
        rate = batch.column("rate").to_pylist()
        most = batch.column("most").to_pylist()
        out = []
        for k, s, r, top in zip(key, size, rate, most):
            if k != shard:
                shard, owed = k, 0.0
            if not s:
                out.append(0)
                continue
            owed += s * r
            n = min(int(top), int(np.ceil(r)), max(int(np.floor(r)), int(np.floor(owed / s + 0.5))))
            owed -= s * n
            out.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pick"), pa.array(out, pa.int64())], names=["doc_id", "pick", "copies"])


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row.

    Reruns agree: ties in size are broken by doc_id, and rows equal in all of
    (doc_id, source, size) are interchangeable. A null text has size 0 and is
    never taken; null sources form one source; a null doc_id is an id like any
    other. ``copies`` never exceeds ``cap`` rounded down. An empty table gives
    no rows.
    """
    sized = cut(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size")))
    hist = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = cut(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n")))
    plan, y, mean, spread = tilt(hist, targets(totals.select("source", "source_size"), weights, cap), cap)
    counted = plan.withColumnRenamed("source", "s").join(totals.select(F.col("source").alias("t"), "n"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    # A source may hold a third of all rows: its rows meet copies of its plan in SALTS places.
    salted = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = sized.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    rows = dealt.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("dealt") == F.col("salt"))).drop("s", "salt", "dealt")
    z = (F.log(F.greatest("size", F.lit(1))) - F.lit(mean)) / F.lit(spread)
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.exp(F.col("x") + F.lit(y) * z)))
    rows = rows.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    shards = F.ceil(F.col("n") / F.lit(SHARD_DOCS))
    rows = rows.withColumn("shard", F.xxhash64(F.coalesce("source", F.lit("\0null")), F.pmod(F.xxhash64("doc_id"), shards)))
    picked = rows.select("doc_id", "size", "rate", "shard", F.lit(int(cap)).alias("most"), F.struct("source", "size", "source_size", "target", "rate").alias("pick"))
    dealt = picked.repartition("shard").sortWithinPartitions("shard", F.desc("size"), "doc_id")
    out = dealt.mapInArrow(_copies, f"doc_id {dict(dealt.dtypes)['doc_id']}, pick {dict(dealt.dtypes)['pick']}, copies long")
    return out.select("doc_id", "pick.*", "copies", (F.col("copies") * F.col("pick.size")).alias("taken"))


def apply(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it.

    Rows that share doc_id, source and size are numbered by their texts, so
    that each gets the copies of one of them. Documents without words go.
    """
    key = ["__id", "__source", "__size"]
    turn = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    taken = mix(docs, weights, cap, doc_id, text, source).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").cast("int").alias("__copies"))
    taken = taken.where("__size > 0").withColumn("__turn", turn(F.desc("__copies"))).where("__copies > 0")
    rows = docs.withColumns({"__id": F.col(f"`{doc_id}`"), "__source": F.col(f"`{source}`"), "__size": size_of(F.col(f"`{text}`"))}).where("__size > 0")
    rows = rows.withColumn("__turn", turn(F.col(f"`{text}`")))
    same = [rows[k].eqNullSafe(taken[k]) for k in (*key, "__turn")]
    chosen = rows.join(taken, reduce(lambda a, b: a & b, same))
    return chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[rows[f"`{c}`"] for c in docs.columns])
