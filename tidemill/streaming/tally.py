"""Hourly counts of finished items as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.store import checkpoint


def hourly(items: DataFrame, late: str = "2 hours") -> DataFrame:
    """(queue, hour, done) of done items; a stream drops what comes more than ``late`` behind."""
    done = items.where(F.col("state") == "done").select("queue", F.col("finalized_at").cast("timestamp").alias("finalized_at"))
    if items.isStreaming:
        done = done.withWatermark("finalized_at", late)
    counted = done.groupBy("queue", F.window("finalized_at", "1 hour")).agg(F.count("*").alias("done"))
    return counted.select("queue", F.col("window.start").cast("timestamp_ntz").alias("hour"), "done")


def finished(stream: DataFrame, key: list[str], name: str, mode: str = "update") -> DataFrame:
    """What a stream over the files now present ends with: for each key the row of the last batch that had one."""
    spark: SparkSession = stream.sparkSession
    checkpoint(spark.range(1))  # sets the shared folder up where the session has none
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/__part={number}")

    query = stream.writeStream.queryName(name).foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{root}/out").drop("__part")
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("__batch", *key)]), "__batch").alias("r")
    return rows.groupBy(*key).agg(last).select(*key, "r.*")
