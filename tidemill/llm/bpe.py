"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A token is *stable* once no continuation of the input can change it. How far
to the left unseen input can reach is a property of the merge list alone: a
merge (u, v) can hand the influence from the boundary right of u to the one
left of it, and a later merge (u', v') can hand it on only if v' starts with
u. The longest such chain bounds the lookahead in bytes, so a run of any
length is encoded in a window of fixed size. A text is read in pieces that end
where no continuation can join what lies on either side, and the ids of a piece
are handed on before the next is read. Decoding feeds token bytes to an
incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.llm.frames import add_columns

# The byte-level pre-tokenizer's published pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 600_000  # of at most MEMO_LENGTH characters each
MEMO_LENGTH = 48
PIECE = 1 << 16  # characters that are read at a time, and ids that are handed on
_BITS = 24
_LOW = (1 << _BITS) - 1
_NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes right of a token that settle it, for merges in rank order."""
    reach: dict[bytes, int] = {}
    longest = 0
    for u, v in merges:
        chain = max((reach.get(v[:i], 0) for i in range(1, len(v) + 1)), default=0) + len(u)
        if chain > reach.get(u, 0):
            reach[u] = chain
        longest = max(longest, chain)
    return longest


class _Memo(dict):
    """Results by key; forgets all once full, so memory stays bounded."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[key] = value
        return value


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = lambda s: bytes(alphabet[c] for c in s)
        vocab = {plain(t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(plain(a), plain(b)) for a, b in pairs]
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.merge_of = {}  # left id, right id -> rank, id of both
        for r, (a, b) in enumerate(merges):
            self.merge_of.setdefault(vocab[a] << _BITS | vocab[b], r << _BITS | vocab[a + b])
        # Only tokens that encode to themselves can stand in an encoding.
        self.id_of = {t: i for t, i in vocab.items() if self._merge(t) == [i]}
        self.longest = [min(16, max(len(t) for t in self.id_of if t[0] == b)) for b in range(256)]
        self.settled = _Memo(self._settled)
        self.lookahead = sufficient_lookahead(merges)
        self.window = 4 * (self.lookahead + max(map(len, vocab)))
        self.specials = specials
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pattern = regex.compile(PATTERN)
        self.unsplit = regex.compile(r"\s ")
        self.seam = regex.compile(r"(?<=\S) (?=\S)")  # a space that begins a pre-token, whatever surrounds it
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in specials.items()}
        self.memo = _Memo(lambda segment: self._segment(" " + segment))
        if array("I").itemsize != 4 or array("I", [1]).tobytes() != b"\x01\0\0\0":
            raise RuntimeError("needs 32-bit little-endian unsigned ints")

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Merge the lowest rank first, leftmost among equals."""
        get = self.merge_of.get
        values = [get(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while values and (best := min(values)) != _NONE:
            i = values.index(best)
            new = ids[i] = best & _LOW
            del ids[i + 1], values[i]
            if i < len(values):
                values[i] = get(new << _BITS | ids[i + 1], _NONE)
            if i:
                values[i - 1] = get(ids[i - 1] << _BITS | new, _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges by a heap over a linked list: n log n for long windows."""
        n, get = len(ids), self.merge_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(v, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (v := get(a << _BITS | b, _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            v, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            new = ids[i] = v & _LOW
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (v := get(new << _BITS | ids[k], _NONE)) != _NONE:
                    heapq.heappush(heap, (v, i, new, ids[k]))
            if (h := before[i]) >= 0 and (v := get(ids[h] << _BITS | new, _NONE)) != _NONE:
                heapq.heappush(heap, (v, h, ids[h], new))
        return [i for i in ids if i >= 0]

    def _merge(self, data: bytes) -> list[int]:
        ids = list(map(self.byte_id.__getitem__, data))
        return self._merge_short(ids) if len(ids) <= 150 else self._merge_long(ids)

    def _settled(self, pair: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves."""
        a, b = pair >> _BITS, pair & _LOW
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _short(self, data: bytes) -> list[int]:
        """Ids of a short pre-token.

        A token sequence is the encoding exactly when every two neighbours
        encode to themselves, so longest matches are taken from the left and
        kept if all pairs are settled; if one is not, the merges decide.
        """
        n, at, last, out = len(data), 0, -1, []
        id_of, settled, longest = self.id_of.get, self.settled, self.longest
        while at < n:
            end = min(n, at + longest[data[at]])
            while (token := id_of(data[at:end])) is None:
                end -= 1
            if last >= 0 and not settled[last << _BITS | token]:
                return self._merge(data)
            out.append(token)
            last, at = token, end
        return out

    def stream(self, data: bytes) -> Iterator[int]:
        """Ids of one pre-token, each as soon as it is stable; holds one window at most."""
        start, n = 0, len(data)
        while n - start > self.window:
            stable = start + self.window - self.lookahead
            for token in self._merge(data[start : start + self.window]):
                if start + len(self.bytes_of[token]) > stable:
                    break
                yield token
                start += len(self.bytes_of[token])
        yield from self._merge(data[start:])

    def _segment(self, segment: str) -> bytes:
        out: list[int] = []
        for piece in self.pattern.findall(segment):
            data = piece.encode()
            out += self._short(data) if len(data) <= 40 else self.stream(data)
        return array("I", out).tobytes()

    def _ordinary(self, text: str) -> bytes:
        if self.unsplit.search(text):  # white space before a space joins its neighbours
            return b"".join([self.memo[p[1:]] if p[0] == " " and len(p) < MEMO_LENGTH else self._segment(p) for p in self._pieces(text)])
        memo, long = self.memo, MEMO_LENGTH
        first, *rest = text.split(" ")
        return self._segment(first) + b"".join([memo[s] if len(s) < long else self._segment(" " + s) for s in rest])

    def _pieces(self, text: str) -> Iterator[str]:
        """Pre-tokens, one at a time; each is a segment whose neighbours cannot change it."""
        for m in self.pattern.finditer(text):
            yield m[0]

    def _parts(self, text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
        """Begin and end of consecutive parts of text[at:end] whose ids do not depend on each other."""
        while end - at > PIECE and (m := self.seam.search(text, at + PIECE, end)):
            yield at, m.start()
            at = m.start()
        yield at, end

    def _settled_ids(self, text: str) -> Iterator[bytes]:
        """Ids of a part; of one much longer than a piece token by token, as they become stable."""
        if len(text) <= 4 * PIECE:
            yield self._ordinary(text)
            return
        out = array("I")
        for piece in self._pieces(text):
            data = piece.encode()
            for token in self._short(data) if len(data) <= 40 else self.stream(data):
                out.append(token)
                if len(out) >= PIECE:
                    yield out.tobytes()
                    out = array("I")
        yield out.tobytes()

    def encode_stream(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian uint32, a piece at a time; null encodes as the empty text."""
        text, at = text or "", 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            for a, b in self._parts(text, at, m.start()):
                yield from self._settled_ids(text[a:b])
            yield array("I", [self.specials[m[0]]]).tobytes()
            at = m.end()
        for a, b in self._parts(text, at, len(text)):
            yield from self._settled_ids(text[a:b])

    def encode(self, text: str | None) -> bytes:
        """All ids at once."""
        return b"".join(self.encode_stream(text))

    def decode_stream(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """Text of pieces of ids; bytes that are no UTF-8 become U+FFFD once they are known to be none."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for piece in pieces:
            numbers = array("I")
            numbers.frombytes(piece)
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, numbers)))
        yield machine.decode(b"", True)

    def decode(self, ids: bytes) -> str:
        return "".join(self.decode_stream(ids[i : i + 4 * PIECE] for i in range(0, len(ids), 4 * PIECE)))


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def _vocabulary(path: str) -> str:
    """A path on each machine; ``public:NAME`` is looked up in the installed tokenizer files there."""
    if path.startswith("public:"):
        import public_tokenizers

        return public_tokenizers.path(path.removeprefix("public:"))
    return path


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``n_tokens`` and ``ids`` (little-endian uint32 bytes) of each whole text.

    A null text encodes as the empty one: no ids. Repeated rows give repeated
    rows; an empty table gives none.
    """

    def make():
        t = transducer(_vocabulary(path))

        def run(texts):
            ids = [t.encode(x) for x in texts]
            return pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return add_columns(df, text, fields, make, list(keep))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and ``text``, decoded from ``ids``; null ids decode to the empty text."""

    def make():
        t = transducer(_vocabulary(path))
        return lambda values: (pa.array([t.decode(v or b"") for v in values], pa.string()),)

    return add_columns(df, ids, [T.StructField("text", T.StringType())], make, list(keep))


def digests(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``n_tokens`` and SHA-256 digests of the ids and of the text decoded from them.

    Ids are decoded and digested as they are emitted, so neither they nor the
    decoded text are held. Null texts count as empty ones; repeated rows give
    repeated rows; an empty table gives none.
    """

    def make():
        t = transducer(_vocabulary(path))

        def run(texts):
            n, a, b = [], [], []
            for x in texts:
                of_ids, of_text, size = hashlib.sha256(), hashlib.sha256(), 0

                def emitted():
                    nonlocal size
                    for piece in t.encode_stream(x):
                        of_ids.update(piece)
                        size += len(piece) // 4
                        yield piece

                for piece in t.decode_stream(emitted()):
                    of_text.update(piece.encode())
                n.append(size)
                a.append(of_ids.hexdigest())
                b.append(of_text.hexdigest())
            return pa.array(n, pa.int64()), pa.array(a), pa.array(b)

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return add_columns(df, text, fields, make, list(keep))
