"""An immutable ledger: one DataFrame for each table and the next free ids."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.schema import TABLES, check_session, columns, empty


@dataclass(frozen=True)
class Ledger:
    frames: dict[str, DataFrame]
    next_item: int = 1
    next_attempt: int = 1
    kept: dict[str, DataFrame] = field(default_factory=dict)  # frames whose plans are cut already

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.frames[name]
        raise AttributeError(name)

    @property
    def spark(self) -> SparkSession:
        return self.frames["items"].sparkSession

    def having(self, next_item: int | None = None, next_attempt: int | None = None, **frames: DataFrame) -> Ledger:
        shaped = {t: f.select(*columns(t)) for t, f in frames.items()}
        return replace(self, frames=self.frames | shaped, next_item=next_item or self.next_item, next_attempt=next_attempt or self.next_attempt)

    def settled(self) -> Ledger:
        """The same tables with the plans of changed ones cut, kept in the checkpoint folder; without this, plans grow with each transition."""
        from tidemill.sources.store import checkpoint

        frames = {t: f if f is self.kept.get(t) else checkpoint(f) for t, f in self.frames.items()}
        return replace(self, frames=frames, kept=frames)


def new_ledger(spark: SparkSession) -> Ledger:
    check_session(spark)
    frames = {t: empty(spark, t) for t in TABLES}
    return Ledger(frames, kept=frames)


def at(now: datetime | Column) -> Column:
    """A moment in UTC as a column."""
    if isinstance(now, Column):
        return now
    return F.lit(now.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def numbered(df: DataFrame, start: int, *order: str, name: str = "id") -> DataFrame:
    """Adds consecutive numbers from ``start`` in the order of columns (``ord`` by default).

    Rows are sorted in ranges and numbered within them; the driver adds up one
    count for each range, so no task sees more than its range.
    """
    from tidemill.sources.store import checkpoint

    order = order or ("ord",)
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The lower 33 bits of the id count the rows of a range.
    placed = checkpoint(placed.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__place")))
    before, count = {}, start
    for r in sorted(placed.groupBy("__range").agg(F.count("*").alias("n")).collect()):
        before[r["__range"]], count = count, count + r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") if i % 2 else F.lit(x) for pair in before.items() for i, x in enumerate(pair)]), F.col("__range")) if before else F.lit(start)
    return placed.withColumn(name, (offset + F.col("__place")).cast("bigint")).drop("__range", "__place")
