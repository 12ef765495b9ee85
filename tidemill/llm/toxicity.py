"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the characters of words, one of toxic
and one of ordinary labelled documents, tell how likely each class makes the
next character after the four before it. Both back off to the same lower
orders, four characters down to one and then to a uniform floor, whose counts
are continuation counts of the two classes together, so an expression that
neither class has seen speaks for neither and one seen rarely speaks softly. A
text's evidence is the length-normalised log-likelihood ratio over the whole
of it and over its most toxic stretch of a word or so; a logistic calibration
turns both into a score.

Counts cover all labelled training documents but the calibration's bounded
sample. They are exact: what they say about each expression is a row of a
written table that grows with the corpus. While that table is small (its size
is checked) every task holds it. Beyond that, texts are dealt into groups,
which ask it for their distinct expressions, bucket by bucket, so a task holds
one bucket of the table or a chunk of texts and the answers of its group.
Groups and buckets follow the session's partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import kernel as K
from tidemill.llm.exchange import TEXTS, by_key, pack, per_group, unpack
from tidemill.llm.frames import CHUNK_BYTES, add_columns, cut, partitions, slices

ORDER = 5  # characters (UTF-8 bytes) of an expression; they fit one long
DISCOUNT = 0.95
FLOOR = 1 / 256  # of each character, whatever was seen
HELD_BYTES = 64 << 20  # of a table that every task holds
STRETCH = 10  # characters
CALIBRATION_DOCS = 8_000
GRAMS, CONTEXTS, ASK = 0, 1, 2  # kinds of ROWS in a bucket, in the order they are read
ROWS = "bucket int, kind int, grp int, payload binary"
PACKED = 1 << 20  # expressions of the table that are packed together
AT_ONCE = 1 << 20  # bytes of text whose expressions a task holds while it scores

_INK = np.zeros(256, bool)  # ASCII letters and digits and all beyond ASCII; the rest separates
_INK[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _INK[_a:_b] = True


def held_out(doc_id) -> bool:
    """Rows that learning never sees; a null id is not one of them, and has no label."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ORDER characters, packed into a long, and the text it ends in.

    Letters are lower-cased (A-Z), separators become one blank, and each text
    begins after blanks, so no run reaches into the text before.
    """
    raw, at = K.joined([b"    " + (t or "").encode() for t in texts], 1)
    chars = np.where(_INK[raw], K.LOWER[raw], np.uint8(32))
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    real = np.ones(len(chars), bool)
    real[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
    lead = np.zeros(len(chars), bool)
    lead[(at[:-1, None] + np.arange(ORDER - 1)).ravel()] = True
    real |= lead
    chars, doc, lead = chars[real].astype(np.int64), doc[real], lead[real]
    if len(chars) < ORDER:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.zeros(len(chars) - ORDER + 1, np.int64)
    for k in range(ORDER):
        key = (key << 8) | chars[k : k + len(key)]
    own = ~lead[ORDER - 1 :]
    return key[own], doc[ORDER - 1 :][own]


def _buckets(context: np.ndarray, count: int) -> np.ndarray:
    return (K.mix(context.astype(np.uint64) + np.uint64(1)) % np.uint64(count)).astype(np.int64)


def _measures(ratio: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """For each text the mean log-likelihood ratio of its characters and the largest mean over a stretch."""
    out = np.zeros((texts, 2))
    n = np.bincount(doc, minlength=texts)
    out[:, 0] = np.bincount(doc, weights=ratio, minlength=texts) / np.maximum(n, 1)
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    end = np.minimum(np.arange(len(ratio)) + STRETCH, np.cumsum(n)[doc])
    best = np.full(texts, -np.inf)
    np.maximum.at(best, doc, (total[end] - total[:-1]) / STRETCH)
    out[:, 1] = np.where(n > 0, best, 0.0)
    return out


@dataclass(frozen=True)
class Fitted:
    """The written table of log-likelihood ratios, packed in buckets, its rows, and the calibration of evidence."""

    table: DataFrame
    buckets: int
    rows: int
    calibration: tuple[float, float, float]


def _labels(labels: DataFrame, doc_id: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(id, y) of training labels: those for counts and, apart from them, the calibration's sample, of a tenth and CALIBRATION_DOCS at most.

    Of a document labelled twice the larger label counts.
    """
    y = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    y = y.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    tenth = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(10)) == 0
    sample = cut(y.where(tenth).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(CALIBRATION_DOCS))
    # The sample is bounded, so it is broadcast.
    return y.join(F.broadcast(sample.select("id")), "id", "left_anti"), sample


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct expressions of each chunk with their counts by class."""
    for whole in batches:
        for part in slices(whole, "text", 4 * AT_ONCE):
            key, doc = _grams(part.column("text").to_pylist())
            y = np.array(part.column("y").to_pylist(), np.int64)[doc]
            key, at = np.unique(key, return_inverse=True)
            c1 = np.bincount(at, weights=y, minlength=len(key)).astype(np.int64)
            c = np.bincount(at, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c - c1), pa.array(c1)], names=["key", "c0", "c1"])


def shared_backoff(types: DataFrame) -> DataFrame:
    """(low, shared): how likely the last of ORDER - 1 characters follows the others, from continuation counts of distinct ``types`` (key).

    An expression of k characters counts once for each character before it that
    makes it a distinct expression of k + 1. Every order is interpolated with
    the one below, the lowest with FLOOR, so the characters after a context
    have probabilities that add up to 1.
    """
    orders = []
    for k in range(ORDER - 1, 0, -1):
        known = types if not orders else orders[-1]
        low = F.col("key").bitwiseAND((1 << 8 * k) - 1)
        orders.append(cut(known.select(low.alias("key")).groupBy("key").agg(F.count("*").alias("n"))))
    below = None
    for grams in reversed(orders):
        context = F.shiftright("key", 8)
        totals = grams.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        met = grams.join(totals.withColumnRenamed("context", "__context"), context == F.col("__context"))
        less = F.lit(FLOOR)
        if below is not None:
            k, lower = below
            met = met.join(lower, F.col("key").bitwiseAND((1 << 8 * k) - 1) == F.col("low"))
            less = F.col("shared")
        p = (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * less) / F.col("total")
        size = 1 if below is None else below[0] + 1
        below = size, cut(met.select(F.col("key").alias("low"), p.alias("shared")))
    return below[1]


def _ratios(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, ratio) of each expression and of each context, the latter for expressions not seen in it."""
    types = types.withColumns({"context": F.shiftright("key", 8), "low": F.col("key").bitwiseAND((1 << 8 * (ORDER - 1)) - 1)})
    kinds = lambda c: F.count(F.when(F.col(c) > 0, 1))
    contexts = types.groupBy("context").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), kinds("c0").alias("k0"), kinds("c1").alias("k1"))

    def ratio(count, backoff):
        p = lambda k: (F.greatest(count(k) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"k{k}") * backoff) / F.col(f"n{k}")
        log = lambda k: F.log(F.when(F.col(f"n{k}") > 0, p(k)).otherwise(backoff))
        return (log(1) - log(0)).alias("ratio")

    seen = types.join(contexts, "context").join(shared_backoff(types), "low").select("key", ratio(lambda k: F.col(f"c{k}"), F.col("shared")))
    # The backoff of an expression that was not seen is the same factor in both classes.
    return seen, contexts.select(F.col("context").alias("key"), ratio(lambda k: F.lit(0), F.lit(1.0)))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["bucket", "kind", "grp", "payload"])


def _packed(rated: DataFrame, kind: int, count: int) -> DataFrame:
    """ROWS of (key, ratio) rows."""

    def blobs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, ratio = (np.concatenate([b.column(n).to_numpy() for b in held]) for n in ("key", "ratio"))
        return _rows([(b, kind, 0, pack(key[at], ratio[at])) for b, at in by_key(_buckets(key >> 8 if kind == GRAMS else key, count), count)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= PACKED:
                yield blobs(held)
                held, size = [], 0
        if size:
            yield blobs(held)

    return rated.mapInArrow(run, ROWS)


def _counts(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, c0, c1): how often each expression occurs in ordinary and in toxic texts."""
    # Labels grow with the corpus, so they are shuffled at every size.
    known = texts.join(labels.hint("merge"), "id")
    return known.select("text", "y").mapInArrow(_count, "key long, c0 long, c1 long").groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _questions(count: int):
    """ROWS of (grp, text) rows: the distinct expressions each group asks about in each bucket; a group is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for part in slices(whole, "text"):
                key, doc = _grams(part.column("text").to_pylist())
                grp = part.column("grp").to_numpy()
                for g in np.unique(grp).tolist():
                    held[g] = np.union1d(held.get(g, key[:0]), key[grp[doc] == g])
        for g, key in held.items():
            yield _rows([(b, ASK, g, key[at].tobytes()) for b, at in by_key(_buckets(key >> 8, count), count)])

    return run


def _sorted(blobs: list[bytes], real=np.float64) -> list[np.ndarray]:
    """Keys and ratios of all blobs, in the order of keys."""
    parts = [unpack(p, real) for p in blobs]
    key, ratio = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind) for i, kind in enumerate((np.int64, real)))
    order = np.argsort(key)
    return [key[order], ratio[order]]


def _look_up(told: list[np.ndarray], key: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """``ratio``, replaced where the sorted table has the key."""
    known, value = told
    if not len(known):
        return ratio
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, value[at], ratio)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answer(bucket: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        told: tuple[list, list] = ([], [])
        grams = contexts = None
        for kind, grp, payload in rows:
            if kind != ASK:
                told[kind].append(payload)
                continue
            if grams is None:
                grams, contexts = map(_sorted, told)
            key = np.frombuffer(payload, np.int64)
            yield bucket, ASK, grp, pack(key, _look_up(grams, key, _look_up(contexts, key >> 8, np.zeros(len(key)))).astype(np.float32))

    held, size = [], 0
    for row in per_group(batches, "bucket", answer, ("kind", "grp", "payload")):
        held.append(row)
        size += len(row[3])
        if size >= CHUNK_BYTES:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _scored(keep: list[str], text: str):
    """Kept columns, mean and peak of (grp, kind, payload, text, row) rows, each group's answers before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, told, loaded = None, [], None
        for whole in batches:
            grp, kind = (whole.column(n).to_numpy() for n in ("grp", "kind"))
            edge = np.flatnonzero((grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(grp)]):
                if a == b:
                    continue
                if grp[a] != current:
                    current, told, loaded = grp[a], [], None
                if kind[a] != TEXTS:
                    told += whole.column("payload").slice(a, b - a).to_pylist()
                    continue
                if loaded is None:
                    loaded, told = _sorted(told, np.float32), []
                for part in slices(whole.slice(a, b - a), "text"):
                    key, doc = _grams(part.column("text").to_pylist())
                    key, at = np.unique(key, return_inverse=True)
                    ratio = _look_up(loaded, key, np.full(len(key), np.nan))
                    if np.isnan(ratio).any():
                        raise ValueError(f"group {current} lacks answers")
                    kept = part.column("row")
                    columns = [part.column("text") if c == text else kept.field(c) for c in keep] + [pa.array(c) for c in _measures(ratio[at], doc, part.num_rows).T]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__mean", "__peak"])

    return run


def _held(table: DataFrame) -> list[np.ndarray]:
    """Keys and ratios of expressions, then of contexts, in order."""
    blobs = table.select("kind", "payload").toArrow().to_pylist()
    return [c for kind in (GRAMS, CONTEXTS) for c in _sorted([r["payload"] for r in blobs if r["kind"] == kind])]


def _directly(docs: DataFrame, text: str, keep: list[str], table: DataFrame) -> DataFrame:
    """``_evidence`` by a table that every task holds."""
    known = docs.sparkSession.sparkContext.broadcast(_held(table))
    fields = [T.StructField("__mean", T.DoubleType()), T.StructField("__peak", T.DoubleType())]

    def make():
        def run(texts):
            key, doc = _grams(texts)
            key, at = np.unique(key, return_inverse=True)
            grams, gram_ratio, contexts, context_ratio = known.value
            ratio = _look_up([grams, gram_ratio], key, _look_up([contexts, context_ratio], key >> 8, np.zeros(len(key))))
            return [pa.array(c) for c in _measures(ratio[at], doc, len(texts)).T]

        return run

    return add_columns(docs, text, fields, make, keep, AT_ONCE)


def _evidence(docs: DataFrame, text: str, keep: list[str], table: DataFrame, count: int, size: int) -> DataFrame:
    """Kept columns of each row, ``__mean`` and ``__peak`` of its text; ``size``: rows of the table, of 16 bytes."""
    if 16 * size <= HELD_BYTES:
        return _directly(docs, text, keep, table)
    n = partitions(docs.sparkSession)
    kept = [docs.schema[c] for c in keep]
    # Groups follow from what a row holds, so that both passes deal alike.
    plain = (T.StringType, T.NumericType, T.DateType, T.TimestampType)
    hashed = [f"`{f.name}`" for f in kept if isinstance(f.dataType, plain) and f.name != text]
    grp = F.pmod(F.xxhash64(f"`{text}`", *hashed), F.lit(n)).cast("int").alias("grp")
    words = F.col(f"`{text}`").alias("text")
    asked = docs.select(grp, words).repartitionById(n, F.col("grp")).mapInArrow(_questions(count), ROWS)
    answers = cut(asked.unionByName(table).repartitionById(count, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(_answers, ROWS), free=True)
    row = F.struct(*[F.col(f"`{c}`") for c in keep if c != text], F.lit(0).alias("__some"))
    texts = docs.select(grp, F.lit(TEXTS).alias("kind"), F.lit(None).cast("binary").alias("payload"), words, row.alias("row"))
    told = answers.select("grp", "kind", "payload", F.lit(None).cast("string").alias("text"), F.lit(None).cast(texts.schema["row"].dataType).alias("row"))
    met = told.unionByName(texts).repartitionById(n, F.col("grp")).sortWithinPartitions("grp", "kind")
    schema = T.StructType([*kept, T.StructField("__mean", T.DoubleType()), T.StructField("__peak", T.DoubleType())])
    return met.mapInArrow(_scored(keep, text), schema)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Fitted:
    """Counts over the labelled training rows, then three calibration numbers on a bounded sample apart from them.

    Rows with a null id, text or label are left out; of a document labelled
    twice the larger label counts, and of several rows of a labelled id all do.
    Without labels of both kinds the score is one number for all texts.
    """
    counting, sample = _labels(labels, doc_id, label)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    count = partitions(docs.sparkSession)
    types = cut(_counts(texts, counting), free=True)
    seen, unseen = _ratios(types)
    table = cut(_packed(seen, GRAMS, count).unionByName(_packed(unseen, CONTEXTS, count)))
    size = types.agg(F.count("*") + F.count_distinct(F.shiftright("key", 8))).first()[0]
    # The sample is bounded, so it is broadcast.
    return Fitted(table, count, size, _calibrate(_evidence(texts.join(F.broadcast(sample), "id"), "text", ["id", "y"], table, count, size)))


def _calibrate(rows: DataFrame) -> tuple[float, float, float]:
    rows = rows.toPandas().sort_values(["id", "__mean", "__peak"])
    y = rows["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():  # one class only: its share, and no slope
        return (float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 2.5))), 0.0, 0.0)
    x = np.column_stack([np.ones(len(y)), rows["__mean"], rows["__peak"]])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * b)
    return tuple(map(float, b))


def score(docs: DataFrame, fitted: Fitted, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and ``score`` (0 to 1, higher: likelier toxic) of each row's whole text.

    Only the text enters the score. Null texts score as empty ones: what the
    calibration gives for no evidence. Repeated rows give repeated rows.
    """
    carried = [c for c in dict.fromkeys(keep) if c != "score"]
    a, b, c = fitted.calibration
    x = F.lit(a) + b * F.col("__mean") + c * F.col("__peak")
    found = _evidence(docs, text, carried, fitted.table, fitted.buckets, fitted.rows)
    return found.select(*[F.col(f"`{k}`") for k in carried], (1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))).alias("score"))
