"""Document fingerprints by randomised edit embedding.

A random walk reads a text: at step j it writes the character it stands on and
moves on if a shared random bit of (j, character) says so. Two texts a few
edits apart fall back into step soon after each edit, so the Hamming distance
of what their walks write reflects their edit distance. A fingerprint samples
one bit of the embedding at each of BITS places. The places for a length are
the last records below it of shared random sequences: uniform for each length,
and shared by two texts for as large a part as their lengths have in common.
Near copies are found by banding sampled bits and verified on whole
fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import connected_components
from tidemill.llm.exchange import ASKED, by_key, pack, per_group, unpack
from tidemill.llm.exchange import rows as rows_of
from tidemill.llm.frames import cut, partitions

BITS = 256
PERIOD = 4096  # of the shared random bits, in steps
STEPS = 2  # embedding steps for each character, as many as a walk needs on average
BANDS, BAND_BITS = 144, 20  # a pair at NEAR shares no band with probability under 1e-7
NEAR = 0.8
CHUNK = 1 << 15  # fingerprints that a task deals to bands at once, and about as many as a part of a band has
BLOCK = 2048  # larger buckets are searched breadth first, one fingerprint after another
LEADERS = 4  # fingerprints of a bucket that the others are compared with first


def _stays() -> list[list[int]]:
    """For each class of characters and step (modulo PERIOD) how many steps the walk stays from there."""
    moves = np.random.default_rng(7301).integers(0, 2, (256, PERIOD), dtype=np.int64)
    moves[:, -1] = 1  # every class moves on at least once a period
    out = np.empty_like(moves)
    wait = np.zeros(256, np.int64)
    for k in (0, 1):
        for j in range(PERIOD - 1, -1, -1):
            wait = np.where(moves[:, j] == 1, 1, wait + 1)
            out[:, j] = wait
    return out.tolist()


def _places() -> np.ndarray:
    """Record times of BITS random sequences: from record r the next lies beyond m with probability (r+1)/(m+1)."""
    rng = np.random.default_rng(7302)
    rows = [np.zeros(BITS)]
    while rows[-1].min() < 1e15:
        rows.append(np.maximum(rows[-1] + 1, np.floor((rows[-1] + 1) / rng.random(BITS))))
    return np.minimum(np.array(rows), 4e18).astype(np.int64).T.copy()


class Walker:
    def __init__(self):
        self.stays = _stays()
        self.places = _places()
        self.coins = np.random.default_rng(7303).integers(0, 2, (BITS, 257), dtype=np.uint8)
        self.each = np.arange(BITS)

    @staticmethod
    def classes(text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return ((code ^ (code >> np.uint32(8))) & np.uint32(255)).astype(np.uint8)

    def walk(self, classes: np.ndarray, at: int = 0) -> np.ndarray:
        """Step at which the walk comes to each character, and past the last; begins at step ``at``."""
        stays, mask = self.stays, PERIOD - 1
        return np.fromiter(accumulate(classes.tobytes(), lambda j, c: j + stays[c][j & mask], initial=at), np.int64, len(classes) + 1)

    def bits(self, classes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The sampled bits, packed; ``steps`` is what ``walk`` gave."""
        length = max(1, STEPS * len(classes))
        place = self.places[self.each, (self.places < length).sum(1) - 1]
        stand = np.searchsorted(steps, place, side="right") - 1
        symbol = np.full(BITS, 256, np.int64)  # past the end
        on = stand < len(classes)
        symbol[on] = classes[stand[on]]
        return np.packbits(self.coins[self.each, symbol])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the embedding two fingerprints have in common: equal bits beyond the half that chance gives."""
    equal = BITS - int(np.bitwise_count(a ^ b).sum())
    return max(0.0, 2.0 * equal / BITS - 1.0)


def _with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(bucket, tail, doc_id, text) sorted so that each row's successor by doc_id follows it.

    Buckets are ranges of doc_id with about equally many rows. The first row of
    each bucket is also the last, with tail 1, of the bucket before; the first
    of all closes the last. Driver and literals hold one number for each bucket.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ids = rows.select("doc_id").where("doc_id IS NOT NULL")
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.1 / count)}) if count > 1 else []
    bucket = F.lit(0)
    if cuts:
        # The cuts passed are counted in two steps: first whole stretches of them, then those of one stretch.
        width = max(1, int(len(cuts) ** 0.5))
        stretches = [cuts[i : i + width] for i in range(0, len(cuts), width)]
        passed = lambda edges: F.size(F.filter(edges, lambda c: c <= F.col("doc_id")))
        longs = lambda values: F.array(*[F.lit(c).cast("long") for c in values])
        whole = F.greatest(passed(longs([s[0] for s in stretches])), F.lit(1))
        bucket = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise((whole - 1) * width + passed(F.element_at(F.array(*map(longs, stretches)), whole)))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    # Null ids come last, so a bucket's first row has a null id only if all have.
    firsts = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()}
    used = sorted(firsts)
    if not used:
        return rows.select("bucket", F.lit(0).alias("tail"), "doc_id", "text")
    leads = F.create_map(*[x for i, b in enumerate(used) for x in (F.lit(b), F.lit(used[i - 1]))])
    begin = F.create_map(*[x for b in used for x in (F.lit(b), F.lit(firsts[b]).cast("long"))])
    is_first = F.col("doc_id").eqNullSafe(F.element_at(begin, F.col("bucket")))
    own = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    lead = F.struct(F.element_at(leads, F.col("bucket")).alias("bucket"), F.lit(1).alias("tail"))
    twice = rows.select(F.explode(F.when(is_first, F.array(own, lead)).otherwise(F.array(own))).alias("to"), "doc_id", "text")
    placed = twice.select("to.bucket", "to.tail", "doc_id", "text")
    return placed.repartitionById(count, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.asc_nulls_last("doc_id"), "text")


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    walker = Walker()
    held = None  # row still waiting for its successor
    shut = None  # bucket whose tail came

    def known(bucket, tail, doc_id, text):
        c = walker.classes(text)
        steps = walker.walk(c)
        return bucket, tail, doc_id, text, c, steps, walker.bits(c, steps)

    def settle(a, b):
        _, _, doc_id, text, c, steps, print_a = a
        half = len(text) // 2
        head = len(text) - half
        edited = text[:head] + b[3][:half]
        new = np.concatenate([c[:head], b[4][:half]])
        print_e = walker.bits(new, np.concatenate([steps[:head], walker.walk(b[4][:half], int(steps[head]))]))
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_a.tobytes().hex(), print_e.tobytes().hex(), likeness(print_a, print_e), likeness(print_a, b[6])

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    for batch in batches:
        out = []
        for bucket, tail, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("bucket", "tail", "doc_id", "text"))):
            if bucket == shut:  # a repeated row of the tail
                continue
            row = known(bucket, tail, doc_id, text)
            if held is not None:
                out.append(settle(held, row))
            held = None if tail else row
            if tail:
                shut = bucket
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=list(NAMES))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """NAMES for each row: its fingerprint and that of its text with the second half replaced from the next row.

    Rows follow each other by doc_id, null last, then text; the first follows
    the last. A null text counts as the empty one, whose fingerprint is that of
    a walk that ended at once. A table's only row follows itself.
    """
    return _with_next(docs, doc_id, text).mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _samples(n: int) -> list[np.ndarray]:
    """The bits of each band for ``n`` fingerprints.

    Bands have a bit more for each doubling beyond 4 million, so that chance
    fills their buckets no further, and are as many more as keep the odds.
    """
    bits = min(64, max(BAND_BITS, (max(1, n) - 1).bit_length() - 2))
    same = BITS - int((1 - NEAR) * BITS / 2)
    shared = lambda k: math.comb(same, k) / math.comb(BITS, k)
    pick = np.random.default_rng(7304)
    return [np.sort(pick.choice(BITS, bits, replace=False)) for _ in range(math.ceil(BANDS * shared(BAND_BITS) / shared(bits)))]


def _keys(words: np.ndarray, samples: list[np.ndarray]) -> Iterator[np.ndarray]:
    """What each band reads of fingerprints."""
    columns = np.ascontiguousarray(words.view(np.uint8).reshape(len(words), -1).T)
    for s in samples:
        bits = columns[s >> 3] >> (7 - (s & 7)).astype(np.uint8)[:, None] & np.uint8(1)
        yield (np.uint64(1) << np.arange(len(s), dtype=np.uint64)) @ bits.astype(np.uint64)


def _bands(samples: list[np.ndarray], parts: int):
    """ASKED rows: a blob of nodes and fingerprints for each chunk, band and part of its keys."""

    def deal(nodes: list[np.ndarray], prints: list[str]) -> Iterator[pa.RecordBatch]:
        ids, words = np.concatenate(nodes), np.frombuffer(bytes.fromhex("".join(prints)), np.uint64).reshape(len(prints), -1)
        for i, key in enumerate(_keys(words, samples)):
            part = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
            yield rows_of(ASKED, [(i * parts + v, 0, pack(ids[at], words[at])) for v, at in by_key(part.astype(np.int64), parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints = [], []
        for b in batches:
            nodes.append(b.column("node").to_numpy())
            prints += b.column("fingerprint").to_pylist()
            if len(prints) >= CHUNK:
                yield from deal(nodes, prints)
                nodes, prints = [], []
        if prints:
            yield from deal(nodes, prints)

    return run


def _forest(words: np.ndarray, near: float) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs, breadth first: what is found is compared with the rest only."""
    left = np.ones(len(words), bool)
    out = []
    for first in range(len(words)):
        queue = [first] if left[first] else []
        left[first] = False
        rest = np.flatnonzero(left) if queue else None
        while queue and len(rest):
            k = queue.pop()
            hit = _near(words[rest], words[k], near)
            found = rest[hit].tolist()
            if found:
                left[found] = False
                rest = rest[~hit]
                out += [(k, x) for x in found]
                queue += found
    return out


def _near(a: np.ndarray, b: np.ndarray, near: float) -> np.ndarray:
    return 1.0 - 2.0 * np.bitwise_count(a ^ b).sum(1, dtype=np.int64) / BITS >= near


def _linked(words: np.ndarray, key: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of near pairs with equal keys, which connect all that such pairs connect."""
    order = np.argsort(key)
    begin = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    size = np.diff(np.r_[begin, len(key)])
    out = []
    for g in np.flatnonzero(size > BLOCK):
        own = order[begin[g] : begin[g] + size[g]]
        out += [own[np.array(_forest(words[own], near), np.int64).reshape(-1, 2)]]
    # The other groups at once: rows of a group follow each other, and those of size 1 are left out.
    fits = np.repeat((size > 1) & (size <= BLOCK), size)
    order, group = order[fits], np.repeat(np.arange(len(size)), size)[fits]
    words = words[order]
    end = np.searchsorted(group, group, side="right")
    # Rows near a leader of their group need no comparison with each other.
    label, free = np.arange(len(order)), np.arange(len(order))
    for _ in range(LEADERS):
        first = np.r_[True, group[free][1:] != group[free][:-1]] if len(free) else np.zeros(0, bool)
        lead = free[np.flatnonzero(first)[np.cumsum(first) - 1]]
        hit = _near(words[free], words[lead], near)
        label[free[hit]] = lead[hit]
        out.append(np.stack([order[lead[hit & ~first]], order[free[hit & ~first]]], 1))
        free = free[~hit & ~first]
    at, k = np.arange(len(order)), 0
    while len(at):
        k += 1
        at = at[at + k < end[at]]
        pair = at[label[at] != label[at + k]]
        pair = pair[_near(words[pair], words[pair + k], near)]
        out.append(np.stack([order[pair], order[pair + k]], 1))
    both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def _links(samples: list[np.ndarray], parts: int, near: float):
    """Near pairs (a, b) of nodes in the buckets of each part of a band."""

    def work(bucket: int, payloads: Iterator[tuple[bytes]]) -> Iterator[pa.RecordBatch]:
        blobs = [unpack(p, np.dtype((np.void, BITS // 8))) for (p,) in payloads]
        nodes, words = np.concatenate([n for n, _ in blobs]), np.concatenate([w for _, w in blobs]).view(np.uint64).reshape(-1, BITS // 64)
        a, b = _linked(words, *_keys(words, [samples[bucket // parts]]), near)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a], pa.int64()), pa.array(nodes[b], pa.int64())], names=["a", "b"])

    return lambda batches: per_group(batches, "bucket", work, ("payload",))


def near_classes(prints: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint", near: float = NEAR) -> DataFrame:
    """(doc_id, class_id) with the least fingerprint of each class of near fingerprints as its id.

    Equal fingerprints are one candidate. Bands send fingerprints packed, in
    parts of their keys with about CHUNK of them each; a part compares the
    fingerprints of each bucket on all bits. Rows without a fingerprint are
    left out; an empty table has no classes.
    """
    rows = cut(prints.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{fingerprint}`").alias("fingerprint")).where("fingerprint IS NOT NULL"))
    known = cut(rows.select("fingerprint").distinct().withColumn("node", F.monotonically_increasing_id()))
    n = known.count()
    samples, parts = _samples(n), -(-max(1, n) // CHUNK)
    spread = known.repartition(partitions(prints.sparkSession), "node")
    sent = spread.mapInArrow(_bands(samples, parts), ASKED).select("bucket", "payload")
    dealt = sent.repartitionById(partitions(prints.sparkSession), F.col("bucket")).sortWithinPartitions("bucket")
    classes = connected_components(dealt.mapInArrow(_links(samples, parts, near), "a long, b long"))
    tied = known.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = tied.groupBy("component").agg(F.min("fingerprint").alias("class_id"))
    return rows.join(tied.join(least, "component").select("fingerprint", "class_id"), "fingerprint").select("doc_id", "class_id")


def digest_bits(text: str) -> bytes:
    """Fingerprint of one text, for tests and tools."""
    w = Walker()
    c = w.classes(text)
    return w.bits(c, w.walk(c)).tobytes()


