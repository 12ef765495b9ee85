"""Questions and answers between documents and a hashed key space.

Operators that look for shared pieces ask about hashes in packed blobs, one
for each chunk of texts and bucket of hashes; a bucket's task answers in blobs
for groups of documents; then answers and texts of a group meet again. Hashes
travel as arrays, so a shuffle has few rows, and no task holds more than a
chunk of texts, one bucket's hashes or one group's answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.frames import CHUNK_BYTES, partitions, slices

LAST = (1 << 63) - 1  # stands for a null id, which is after all others
TEXTS = 100  # the kind of rows that hold texts; answers have smaller kinds

ASKED = "bucket int, kind int, payload binary"
ANSWERED = "grp int, kind int, payload binary"


def counts(spark) -> tuple[int, int]:
    """Buckets of hashes and groups of documents for this session, one for each task.

    Blobs number at most buckets times groups, or entries if these are fewer.
    """
    n = partitions(spark)
    return n, n


def pack(ids: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ids (as 32-bit offsets where they fit) and further arrays of the same length."""
    base = int(ids.min()) if len(ids) else 0
    narrow = len(ids) == 0 or int(ids.max()) - base < 1 << 32
    head = np.array([len(ids), base, int(narrow)], np.int64).tobytes()
    return b"".join([head, (ids - base).astype(np.uint32).tobytes() if narrow else ids.astype(np.int64).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    n, base, narrow = (int(x) for x in np.frombuffer(payload, np.int64, 3))
    at, out = 24, []
    for k in (np.dtype(np.uint32 if narrow else np.int64), *map(np.dtype, kinds)):
        out.append(np.frombuffer(payload, k, n, at))
        at += n * k.itemsize
    out[0] = out[0].astype(np.int64) + base if narrow else out[0]
    return out


def by_key(key: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) for each value of key that occurs."""
    order = np.argsort(key, kind="stable")
    edge = np.searchsorted(key[order], np.arange(count + 1))
    for v in np.flatnonzero(np.diff(edge)):
        yield int(v), order[edge[v] : edge[v + 1]]


def rows(names: str, found: list[tuple]) -> pa.RecordBatch:
    first = names.split()[0]
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=[first, "kind", "payload"])


def ask(docs: DataFrame, doc_id: str, text: str, questions: Callable[[np.ndarray, list[bytes]], list[tuple[int, int, bytes]]], most: int = CHUNK_BYTES) -> DataFrame:
    """ASKED rows of all texts: ``questions`` gets ids and texts of a chunk."""
    source = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", most):
                found = questions(part.column("id").to_numpy(), [t.encode() for t in part.column("text").to_pylist()])
                if found:
                    yield rows(ASKED, found)

    return source.mapInArrow(run, ASKED)


def settle(asked: DataFrame, answer: Callable[[Iterator[tuple[int, bytes]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """ANSWERED rows: ``answer`` gets the (kind, payload) rows of one bucket at a time."""
    dealt = asked.repartitionById(partitions(asked.sparkSession), F.col("bucket")).sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in per_group(batches, "bucket", lambda b, it: answer((k, p) for k, p in it), ("kind", "payload")):
            yield rows(ANSWERED, [found])

    return dealt.mapInArrow(run, ANSWERED)


def per_group(batches: Iterator[pa.RecordBatch], key: str, work: Callable, names: tuple[str, ...]) -> Iterator:
    """What ``work(value, rows)`` yields for each run of equal keys; rows are read as they come."""

    def each() -> Iterator[tuple]:
        for b in batches:
            for row in zip(b.column(key).to_pylist(), *(b.column(n) for n in names)):
                yield row[0], tuple(v.as_py() for v in row[1:])

    stream = each()
    pending = next(stream, None)
    while pending is not None:
        value = pending[0]

        def own() -> Iterator[tuple]:
            nonlocal pending
            while pending is not None and pending[0] == value:
                row = pending[1]
                pending = next(stream, None)
                yield row

        mine = own()
        yield from work(value, mine)
        for _ in mine:  # what it left unread
            pass


def meet(docs: DataFrame, doc_id: str, text: str, answers: DataFrame, groups: int) -> DataFrame:
    """(grp, kind, payload, id, doc_id, text): each group's answers and then, with kind TEXTS, its texts."""
    spark = docs.sparkSession
    known = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST))
    texts = docs.select(F.pmod(known, F.lit(groups)).cast("int").alias("grp"), F.lit(TEXTS).alias("kind"), F.lit(None).cast("binary").alias("payload"), known.alias("id"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    told = answers.select("grp", "kind", "payload", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return told.unionByName(texts).repartitionById(partitions(spark), F.col("grp")).sortWithinPartitions("grp", "kind")


def over_groups(batches: Iterator[pa.RecordBatch], load: Callable[[list[tuple[int, bytes]]], object], work: Callable, most: int = CHUNK_BYTES) -> Iterator:
    """Yields ``work(loaded answers, ids, doc_ids, texts)`` for chunks of texts of one group."""

    def group(_, stream) -> Iterator:
        told, loaded = [], None
        ids, docs, texts, size = [], [], [], 0
        for kind, payload, i, d, t in stream:
            if kind < TEXTS:
                told.append((kind, payload))
                continue
            if loaded is None:
                loaded, told = load(told), []
            data = (t or "").encode()
            if texts and size + len(data) > most:
                yield work(loaded, np.array(ids, np.int64), docs, texts)
                ids, docs, texts, size = [], [], [], 0
            ids.append(i)
            docs.append(d)
            texts.append(data)
            size += len(data)
        if texts:
            yield work(loaded, np.array(ids, np.int64), docs, texts)

    return per_group(batches, "grp", group, ("kind", "payload", "id", "doc_id", "text"))
