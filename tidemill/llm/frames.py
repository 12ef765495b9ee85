"""Small helpers between DataFrames and the Python-side text kernels."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 4 << 20
PAUSE = 0.7  # seconds between rounds of collecting garbage


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for; the cluster's owner sizes it by the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only where the session has none."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if at is None:
            import tempfile

            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="tidemill-checkpoints-")
        sc.setCheckpointDir(at)
    return at or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    Shuffle files that fed it are then garbage, if the caller holds no frame
    that needs them. With ``free`` the driver collects its garbage, so that
    Spark deletes them now and not half an hour later.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    for _ in range(3 if free else 0):  # listeners hold a finished query for a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(PAUSE)
    return out


def slices(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices holding about ``most`` bytes of text each; a longer text stands alone."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield batch.slice(start)


def add_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str | None]], Iterable[pa.Array]]],
    keep: list[str],
    most: int = CHUNK_BYTES,
) -> DataFrame:
    """``keep`` columns of each row plus columns computed from its whole text.

    ``make`` runs once in each task and returns a function from a list of texts
    to one array for each of ``fields``. New columns replace kept ones of the
    same name, so clashing names cannot collide.
    """
    names = {f.name for f in fields}
    carried = [c for c in dict.fromkeys(keep) if c not in names]
    read = text if text in carried else "__text"
    source = df.select(*[F.col(f"`{c}`") for c in carried], *([F.col(f"`{text}`").alias(read)] if read not in carried else []))
    schema = T.StructType([*source.schema.fields[: len(carried)], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for whole in batches:
            fn = fn or make()
            for part in slices(whole, read, most):
                columns = [part.column(c) for c in carried]
                columns += list(fn(part.column(read).to_pylist()))
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)

