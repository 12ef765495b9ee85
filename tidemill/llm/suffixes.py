"""Substring deduplication by a logarithmic family of suffix arrays.

Every WIDTH-byte string of a text is looked after by its anchor, the GRAM-byte
string in it with the least hash (of equals the first). The strings of one
anchor begin within REACH bytes of each other, so they travel as one piece of
text. Hashes only route: a first exchange finds the anchors that several
documents have, and pieces around these go to buckets by what all their
strings surely hold.

In a bucket, pieces arrive in batches. A batch's strings are sorted by their
bytes, which gives its suffix array (suffixes cut to the WIDTH bytes that
matter); it is merge-scanned against the levels that the bucket holds, in
which equal strings are found by comparing bytes, and becomes a level of its
own. Levels of about equal size merge, so there are logarithmically many. A
level holds each string once for every piece of the least document that has
it; strings of larger documents are told to go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import kernel as K
from tidemill.llm.exchange import ASKED, ask, by_key, counts, meet, over_groups, pack, rows, settle, unpack
from tidemill.llm.frames import cut

WIDTH = 50
GRAM = 25
REACH = WIDTH - GRAM  # strings of an anchor begin up to so many bytes before it
SPAN = WIDTH + REACH  # bytes of a neighbourhood
HALF = REACH // 2 + 1  # strings that begin fewer bytes before their anchor hold so many after it, the others before it
BLOCK = 192 << 10  # bytes of text whose hashes are held at a time
BATCH = 1 << 20  # strings of a batch
SHARED, BEATEN = 1, 2


def _doubled(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of 1, 2, 4 .. 64 bytes from each place, before mixing."""
    h = {1: K.CODES[data]}
    for w in (1, 2, 4, 8, 16, 32):
        a = h[w]
        h[2 * w] = a[: len(a) - w] * np.uint64(pow(K._BASE, w, 1 << 64)) + a[w:]
    return h


def _pieced(h: dict[int, np.ndarray], width: int, n: int) -> np.ndarray:
    """Hash of ``width`` bytes from each of the first n - width + 1 places."""
    out, done = None, 0
    for w in (64, 32, 16, 8, 4, 2, 1):
        if width & w:
            part = h[w][done : done + n - width + 1]
            out = part.copy() if out is None else out * np.uint64(pow(K._BASE, w, 1 << 64)) + part
            done += w
    return K.mix(out)


class Anchors:
    """Anchors of some texts: number and size of the text, place in it, hash, and hash of the SPAN bytes around.

    Rivals are ranked once for a segment of text; ``strings`` tells more of
    those anchors that turn out to matter.
    """

    def __init__(self, texts: list[bytes], wanted: np.ndarray | None = None, strings: bool = False):
        """Of all texts; only anchors with hashes among the sorted ``wanted``; with ``strings`` also least, most and around."""
        found: list[list[np.ndarray]] = [[] for _ in range(8)]
        for segments in _segments(texts):
            for out, part in zip(found, _anchored(texts, segments, wanted, strings)):
                out.append(part)
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)
        self.doc, self.size, self.place, self.gram, self.near, self.least, self.most = (np.concatenate(f) if f else np.empty(0, k) for f, k in zip(found, kinds))
        self.around = np.concatenate(found[7]) if found[7] else np.empty((0, SPAN), np.uint8)

    def __len__(self) -> int:
        return len(self.doc)


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """(text, begin, end) of texts with a string, about BLOCK bytes at a time; a long text is several segments."""
    cuts = [(i, a, min(a + BLOCK, len(t))) for i, t in enumerate(texts) if len(t) >= WIDTH for a in range(0, len(t), BLOCK)]
    for a, b in K.batches([end - begin for _, begin, end in cuts], BLOCK):
        yield cuts[a:b]


def _anchored(texts: list[bytes], segments: list[tuple[int, int, int]], wanted: np.ndarray | None, strings: bool) -> list[np.ndarray]:
    # A segment is read with as much text around it as the strings of its anchors and their rivals reach.
    gap = b"\xff" * (2 * SPAN)
    lead = np.array([min(a, 2 * SPAN) for _, a, _ in segments])
    read = [texts[i][a - k : b + 2 * SPAN] for (i, a, b), k in zip(segments, lead.tolist())]
    data = np.frombuffer(gap + gap.join(read) + gap, np.uint8)
    begin = len(gap) + np.concatenate([[0], np.cumsum([len(r) + len(gap) for r in read])])[:-1]
    h = _doubled(data)
    gram, near = _pieced(h, GRAM, len(data)), _pieced(h, SPAN, len(data))
    rank = (gram >> np.uint64(32)).astype(np.uint32)
    low = K.sliding_min(rank, REACH + 1)
    ends = np.zeros(REACH, np.uint32)
    high = ~K.sliding_min(~np.concatenate([ends, low, ends]), REACH + 1)
    at = np.flatnonzero(rank == high)
    seg = np.searchsorted(begin, at, side="right") - 1
    at, seg = at[seg >= 0], seg[seg >= 0]
    text, first, last = (np.array(c) for c in zip(*segments))
    place = at - begin[seg] + first[seg] - lead[seg]
    size = np.array([len(texts[i]) for i, *_ in segments])[seg]
    mine = (place >= first[seg]) & (place < last[seg]) & (place + GRAM <= size)
    if wanted is not None:
        mine &= _within(gram[at], wanted)
    at, seg, place, size = at[mine], seg[mine], place[mine], size[mine]
    columns = [text[seg], size, place, gram[at], near[at - REACH]]
    if not strings:
        return columns
    # An anchor's strings begin from ``most`` to ``least`` bytes before it: to its left all rivals are worse, to its right none is better.
    left, right, own = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), rank[at]
    going, coming = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, REACH + 1):
        going &= rank[at - k] > own
        coming &= rank[np.minimum(at + k, len(rank) - 1)] >= own
        left += going
        right += coming
    most = np.minimum(left, place)
    least = np.maximum(np.maximum(REACH - right, WIDTH - (size - place)), 0)
    real = most >= least
    around = np.lib.stride_tricks.sliding_window_view(data, SPAN)[at[real] - REACH]
    return [c[real] for c in (*columns, least, most)] + [around]


def _answers(kind: int, groups: int, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    for g, at in by_key(np.mod(ids, groups), groups):
        yield g, kind, pack(ids[at], *(c[at] for c in columns))


def _grams(groups: int, ids: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(group, distinct hashes) of documents' anchors."""
    for g, at in by_key(np.mod(ids, groups), groups):
        yield g, np.unique(gram[at]).tobytes()


def _questions(buckets: int, groups: int):
    """Asks whether anchors are shared: each with its least document in the chunk."""

    def run(ids: np.ndarray, texts: list[bytes]) -> list[tuple[int, int, bytes]]:
        found = Anchors(texts)
        if not len(found):
            return []
        owner = ids[found.doc]
        order = np.lexsort((owner, found.gram))
        gram, owner = found.gram[order], owner[order]
        first = np.ones(len(gram), bool)
        first[1:] = gram[1:] != gram[:-1]
        start = np.flatnonzero(first)
        # Anchors that several documents of the chunk have are shared; the least asks all the same.
        spread = np.repeat(owner[start] != owner[np.append(start[1:], len(gram)) - 1], np.diff(np.append(start, len(gram))))
        fresh = np.ones(len(gram), bool)
        fresh[1:] = first[1:] | (owner[1:] != owner[:-1])
        known = spread & fresh
        out = [(int(g % buckets), -1 - g, p) for g, p in _grams(groups, owner[known], gram[known])]
        for b, at in by_key((gram[start] % np.uint64(buckets)).astype(np.int64), buckets):
            out.append((b, 0, pack(owner[start][at], gram[start][at])))
        return out

    return run


def _shared(groups: int):
    def run(asked: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        parts = []
        for kind, payload in asked:
            if kind < 0:  # found within its chunk
                yield -1 - kind, SHARED, payload
            else:
                parts.append(unpack(payload, np.uint64))
        if not parts:
            return
        ids, gram = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, gram))
        ids, gram = ids[order], gram[order]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        end = np.append(start[1:], len(gram))
        spread = np.repeat(ids[start] != ids[end - 1], end - start)
        for g, p in _grams(groups, ids[spread], gram[spread]):
            yield g, SHARED, p

    return run


def _known(told: list[tuple[int, bytes]]) -> np.ndarray:
    """Hashes of shared anchors that a group's documents have."""
    parts = [np.frombuffer(p, np.uint64) for k, p in told if k == SHARED]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _within(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, keys), max(0, len(among) - 1))
    return among[at] == keys if len(among) else np.zeros(len(keys), bool)


def _wrapped(head: bytes, plain: bytes, text: bytes) -> bytes:
    """``head`` and ``text`` compressed, and ``plain``, which hashes fill, as it is."""
    sizes = np.array([len(head), len(plain), len(text)], np.int64).tobytes()
    return sizes + plain + pa.compress(head + text, "zstd", asbytes=True)


def _unwrapped(payload: bytes) -> tuple[bytes, bytes, np.ndarray]:
    head, plain, text = (int(n) for n in np.frombuffer(payload, np.int64, 3))
    both = pa.decompress(payload[24 + plain :], head + text, "zstd", asbytes=True)
    return both[:head], payload[24 : 24 + plain], np.frombuffer(both, np.uint8, offset=head)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 .. for size[0] numbers, then from start[1] and so on."""
    if not len(size):
        return np.empty(0, np.int64)
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _pieces(buckets: int, groups: int):
    """Sends the piece of each shared anchor, without those a chunk holds twice.

    Strings that begin fewer than HALF bytes before their anchor go by the
    anchor and the bytes after it that all of them hold, the others by the
    bytes before it, so a frequent anchor spreads over many buckets.
    """

    def work(known, ids, _, texts) -> list[tuple[int, int, bytes]]:
        found = Anchors(texts, known, True) if len(known) else ()
        if not len(found):
            return []
        owner, near, around, least, most, gram = ids[found.doc], found.near, found.around, found.least, found.most, found.gram
        order = np.lexsort((owner, near))
        owner, near, around, least, most, gram = (c[order] for c in (owner, near, around, least, most, gram))
        # Equal neighbourhoods lie next to each other; their bytes decide.
        same = np.zeros(len(owner), bool)
        twin = np.flatnonzero((near[1:] == near[:-1]) & (least[1:] == least[:-1]) & (most[1:] == most[:-1])) + 1
        same[twin] = (around[twin] == around[twin - 1]).all(1)
        lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        later = same & (owner > owner[lead])
        mask = ((np.int64(1) << (most + 1)) - (np.int64(1) << least)).astype(np.uint32)
        out = [(int(g % buckets), -1 - g, p) for g, _, p in _answers(BEATEN, groups, owner[later], near[later], mask[later])]
        # By document: ids then differ little from one to the next, and so does a document's language.
        left = np.flatnonzero(~same)
        left = left[np.argsort(owner[left], kind="stable")]
        owner, near, around, least, most, gram = (c[left] for c in (owner, near, around, least, most, gram))
        for side, a, b in ((0, least, np.minimum(most, HALF - 1)), (1, np.maximum(least, HALF), most)):
            some = np.flatnonzero(a <= b)
            if not len(some):
                continue
            sure = around[some, REACH + GRAM : REACH + GRAM + REACH - HALF + 1] if side == 0 else around[some, REACH - HALF : REACH]
            route = K.mix(gram[some] + (K.CODES[sure] * K.mix(np.arange(1, sure.shape[1] + 1, dtype=np.uint64) + np.uint64(64 * side))).sum(1, dtype=np.uint64))
            low, high = a[some], b[some]
            flat = around.ravel()
            for bucket, at in by_key((route % np.uint64(buckets)).astype(np.int64), buckets):
                text = flat[_spans(some[at] * SPAN + REACH - high[at], high[at] - low[at] + WIDTH)]
                out.append((bucket, 0, _wrapped(pack(owner[some[at]], low[at].astype(np.uint8), high[at].astype(np.uint8)), near[some[at]].tobytes(), text.tobytes())))
        return out

    return work


class Level:
    """Strings sorted by their bytes, with their documents and the piece and the offset that each is of."""

    def __init__(self, text: np.ndarray, ids: np.ndarray, piece: np.ndarray, bit: np.ndarray):
        self.text, self.ids, self.piece, self.bit = text, ids, piece, bit

    def __len__(self) -> int:
        return len(self.text)

    def take(self, which: np.ndarray) -> Level:
        return Level(self.text[which], self.ids[which], self.piece[which], self.bit[which])

    @staticmethod
    def joined(levels: list[Level]) -> Level:
        """All their strings in order; each level is a run that the sort merges."""
        both = Level(*(np.concatenate([getattr(x, c) for x in levels]) for c in ("text", "ids", "piece", "bit")))
        return both.take(np.argsort(both.text, kind="stable"))


class Family:
    """Levels of strings that halve in size, and for each piece a mask of its strings that smaller documents have."""

    def __init__(self):
        self.levels: list[Level] = []
        self.ids: list[np.ndarray] = []
        self.near: list[np.ndarray] = []
        self.masks: list[np.ndarray] = []
        self.pieces = 0

    def add(self, ids: np.ndarray, near: np.ndarray, least: np.ndarray, most: np.ndarray, text: np.ndarray) -> None:
        """A batch of pieces: ``text`` holds one after the other, most - least + WIDTH bytes each."""
        count = (most - least + 1).astype(np.int64)
        size = count + WIDTH - 1
        start = np.cumsum(size) - size
        # Pieces that are equal as a whole need be looked at once.
        whole = np.zeros((len(ids), SPAN + 2), np.uint8)
        whole[np.repeat(np.arange(len(ids)), size), _spans(np.zeros(len(ids), np.int64), size)] = text
        whole[:, SPAN], whole[:, SPAN + 1] = least + 1, most + 1
        whole = whole.view(f"S{SPAN + 2}").ravel()
        order = np.lexsort((ids, whole))
        first = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        mask = np.zeros(len(ids), np.uint32)
        later = order[ids[order] > ids[order][lead]]
        mask[later] = ((np.int64(1) << (most[later].astype(np.int64) + 1)) - (np.int64(1) << least[later].astype(np.int64))).astype(np.uint32)
        self.ids.append(ids)
        self.near.append(near)
        self.masks.append(mask)
        # Those of the same document lie in different neighbourhoods and stay.
        on = np.sort(order[ids[order] == ids[order][lead]])
        begin = _spans(start[on], count[on])
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, WIDTH)[begin]).view(f"S{WIDTH}").ravel()
        piece = np.repeat(on, count[on])
        bit = most[piece] - (begin - start[piece])
        batch = Level(strings, ids[piece], piece + self.pieces, bit.astype(np.uint8))
        self.pieces += len(ids)
        batch = self._least(batch.take(np.argsort(batch.text, kind="stable")))
        for i, level in enumerate(self.levels):
            batch, self.levels[i] = self._scan(batch, level)
        self.levels = [x for x in [*self.levels, batch] if len(x)]
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self.levels[-2:] = [Level.joined(self.levels[-2:])]

    def _beat(self, level: Level, which: np.ndarray) -> None:
        """Marks strings as held by a smaller document."""
        starts = np.cumsum([0, *map(len, self.masks)])
        piece, bit = level.piece[which], np.uint32(1) << level.bit[which].astype(np.uint32)
        batch = np.searchsorted(starts, piece, side="right") - 1
        for b in np.unique(batch):
            on = batch == b
            np.bitwise_or.at(self.masks[b], piece[on] - starts[b], bit[on])

    def _least(self, level: Level) -> Level:
        """The strings without those that a smaller document of the same level has too."""
        if not len(level):
            return level
        start = np.flatnonzero(np.concatenate([[True], level.text[1:] != level.text[:-1]]))
        least = np.repeat(np.minimum.reduceat(level.ids, start), np.diff(np.append(start, len(level))))
        later = level.ids > least
        self._beat(level, later)
        return level.take(~later)

    def _scan(self, batch: Level, level: Level) -> tuple[Level, Level]:
        """Both without the strings that the other holds for a smaller document."""
        if not len(batch) or not len(level):
            return batch, level
        low = np.searchsorted(level.text, batch.text, side="left")
        met = level.text[np.minimum(low, len(level) - 1)] == batch.text
        if not met.any():
            return batch, level
        # A level's equal strings are all of one document, and so are a batch's.
        theirs = level.ids[np.minimum(low, len(level) - 1)]
        lost = met & (batch.ids > theirs)
        won = met & (batch.ids < theirs)
        self._beat(batch, lost)
        if won.any():
            first = np.unique(low[won])
            run = np.searchsorted(level.text, level.text[first], side="right") - first
            beaten = np.zeros(len(level), bool)
            beaten[_spans(first, run)] = True
            self._beat(level, beaten)
            level = level.take(~beaten)
        return batch.take(~lost), level

    def beaten(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, neighbourhoods and masks of pieces with a string that goes."""
        if not self.ids:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
        ids, near, masks = (np.concatenate(x) for x in (self.ids, self.near, self.masks))
        some = masks > 0
        return ids[some], near[some], masks[some]


def _compared(groups: int):
    def run(asked: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        family = Family()
        held, strings = [], 0

        def flush() -> None:
            family.add(*(np.concatenate(x) for x in zip(*held)))
            held.clear()

        for kind, payload in asked:
            if kind < 0:  # settled within its chunk
                yield -1 - kind, BEATEN, payload
                continue
            head, near, text = _unwrapped(payload)
            ids, least, most = unpack(head, np.uint8, np.uint8)
            held.append((ids, np.frombuffer(near, np.uint64), least, most, text))
            strings += int((most - least).sum()) + len(ids)
            if strings >= BATCH:
                flush()
                strings = 0
        if held:
            flush()
        yield from _answers(BEATEN, groups, *family.beaten())

    return run


def _masks(told: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, neighbourhoods and masks, in the order of both; either side of an anchor gives masks of its own."""
    parts = [unpack(p, np.uint64, np.uint32) for k, p in told if k == BEATEN]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
    ids, near, mask = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((near, ids))
    ids, near, mask = ids[order], near[order], mask[order]
    start = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (near[1:] != near[:-1])]))
    return ids[start], near[start], np.bitwise_or.reduceat(mask, start)


def _cover(told, ids: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """For each text which bytes go."""
    size = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(size + 1)])
    edge = np.zeros(base[-1] + 1, np.int64)
    owners, near, masks = told
    low, high = np.searchsorted(owners, ids), np.searchsorted(owners, ids, side="right")
    some = np.flatnonzero(low < high)
    if len(some):
        found = Anchors([texts[i] for i in some])
        edges = np.searchsorted(found.doc, np.arange(len(some) + 1))
        mask = np.zeros(len(found), np.uint32)
        for k, i in enumerate(some):
            own = found.near[edges[k] : edges[k + 1]]
            at = low[i] + np.minimum(np.searchsorted(near[low[i] : high[i]], own), high[i] - low[i] - 1)
            mask[edges[k] : edges[k + 1]] = np.where(near[at] == own, masks[at], 0)
        for k in range(REACH + 1):
            on = np.flatnonzero((mask >> np.uint32(k)) & np.uint32(1))
            begin = base[some[found.doc[on]]] + found.place[on] - k
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + WIDTH, -1)
    gone = np.cumsum(edge) > 0
    return [gone[base[i] : base[i] + size[i]] for i in range(len(texts))]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(told, ids, docs, texts):
        out = []
        for d, t, gone in zip(docs, texts, _cover(told, ids, texts)):
            n = int(gone.sum())
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if n else t
            out.append((d, len(t), n, spans, hashlib.sha256(kept).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[f.split()[0] for f in RESULT.split(", ")])

    yield from over_groups(batches, _masks, work)


def _kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(told, ids, docs, texts):
        kept = [np.frombuffer(t, np.uint8)[~g].tobytes() for t, g in zip(texts, _cover(told, ids, texts))]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    yield from over_groups(batches, _masks, work)


def _told(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    buckets, groups = counts(docs.sparkSession)
    shared = cut(settle(ask(docs, doc_id, text, _questions(buckets, groups)), _shared(groups)), free=True)
    send = _pieces(buckets, groups)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in over_groups(batches, _known, send):
            if found:
                yield rows(ASKED, found)

    pieces = meet(docs, doc_id, text, shared, groups).mapInArrow(sent, ASKED)
    return cut(settle(pieces, _compared(groups)), free=True), groups


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT for each row: what is left without the bytes of WIDTH-byte strings that a smaller document holds.

    Null and empty texts have no bytes; texts shorter than WIDTH lose none.
    Rows with the same doc_id, repeated rows among them, are never smaller than
    each other, and a null doc_id is larger than any other. An empty table
    gives no rows.
    """
    told, groups = _told(docs, doc_id, text)
    return meet(docs, doc_id, text, told, groups).mapInArrow(_removed, RESULT)


def remaining(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept): the remaining bytes themselves, under the same rules."""
    told, groups = _told(docs, doc_id, text)
    return meet(docs, doc_id, text, told, groups).mapInArrow(_kept_bytes, "doc_id long, kept binary")
