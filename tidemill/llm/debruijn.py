"""Substring deduplication on a de Bruijn graph of words.

WINDOW consecutive words are an edge between the word sequences at its two
ends. Edges that start in several documents are repeated; the least document
with one is its source, and its place there its source coordinate. Degrees of
nodes are counted over the repeated edges. Edges that follow each other in
their source over nodes with one edge in and one out are compacted in place
into runs; runs that such nodes join across sources are compacted by pointer
jumping, a join that doubles the reach of every run each round. What comes out
are nonbranching paths, along which every edge has a coordinate.

Documents then get the coordinates of the repeated edges they hold. Edges with
consecutive coordinates and one source are a span, whose words the source must
hold at the source coordinates; spans so verified go.

Hashes stand for edges and nodes. A span whose words differ from its source's,
because two word sequences share a hash, is found and looked at edge by edge;
an edge that then differs stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel as K
from tidemill.llm.exchange import ANSWERED, ASKED, LAST, ask, by_key, counts, meet, over_groups, pack, per_group, rows, settle, unpack
from tidemill.llm.frames import cut, partitions

WINDOW = 13
SOURCE, MEMBER = 1, 2  # answers: edges that a document is the source of; repeated edges of a bucket and the groups that hold them
HEAD, CHAIN, REQUEST, PIECE = 1, 2, 3, 4  # what the groups of sources get, in this order
PATH, DENIED = 1, 2  # what the groups of documents get
EDGES = 0

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
FOUND = f"{ANSWERED}, {RESULT}"


class Edges:
    """Edges of some texts: hash, number of the first word in its text, text; and hashes of the nodes they leave and reach."""

    def __init__(self, texts: list[bytes]):
        data, at = K.joined(texts, 1)
        starts, ends = K.words_of(data)
        doc = np.searchsorted(at, starts, side="right") - 1
        first = np.searchsorted(starts, at)
        self.words = np.diff(first)
        h = K.span_hashes(data, starts, ends)
        edge, node = K.sequence_windows(h, WINDOW), K.sequence_windows(h, WINDOW - 1)
        whole = np.flatnonzero(doc[: len(edge)] == doc[WINDOW - 1 :]) if len(edge) else np.empty(0, np.int64)
        self.hash, self.doc, self.leaves, self.reaches = edge[whole], doc[whole], node[whole], node[whole + 1] if len(whole) else node[:0]
        self.word = whole - first[self.doc]
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def _sent(groups: int, kind: int, ids: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(g, kind, pack(ids[at], *(c[at] for c in columns))) for g, at in by_key(np.mod(ids, groups), groups)]


def _members(grp: np.ndarray, edge: np.ndarray) -> bytes:
    """Distinct pairs of a group and an edge that its documents hold."""
    order = np.lexsort((grp, edge))
    grp, edge = grp[order], edge[order]
    new = np.concatenate([[True], (edge[1:] != edge[:-1]) | (grp[1:] != grp[:-1])]) if len(edge) else np.empty(0, bool)
    return pack(grp[new], edge[new])


def _questions(buckets: int, groups: int):
    """Asks about the distinct edges of a chunk, each with its least document and whether another of the chunk has it."""

    def run(ids: np.ndarray, texts: list[bytes]) -> list[tuple[int, int, bytes]]:
        found = Edges(texts)
        if not len(found.hash):
            return []
        order = np.lexsort((ids[found.doc], found.hash))
        edge, owner = found.hash[order], ids[found.doc][order]
        start = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
        end = np.append(start[1:], len(edge))
        twice = owner[start] != owner[end - 1]
        later = owner > np.repeat(owner[start], end - start)
        out = []
        for b, at in by_key((edge[later] % np.uint64(buckets)).astype(np.int64), buckets):
            out.append((b, MEMBER, _members(np.mod(owner[later][at], groups), edge[later][at])))
        edge, owner = edge[start], owner[start]
        for b, at in by_key((edge % np.uint64(buckets)).astype(np.int64), buckets):
            out.append((b, EDGES, pack(owner[at], edge[at], twice[at])))
        return out

    return run


def _repeated(buckets: int, groups: int):
    """SOURCE answers, and one MEMBER row of a bucket, addressed to the bucket itself."""

    def run(asked: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        parts, members = [], []
        for kind, payload in asked:
            if kind == MEMBER:  # found within its chunk
                members.append(tuple(unpack(payload, np.uint64)))
            else:
                parts.append(unpack(payload, np.uint64, np.bool_))
        if not parts:
            return
        ids, edge, twice = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, edge))
        ids, edge, twice = ids[order], edge[order], twice[order]
        start = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
        end = np.append(start[1:], len(edge))
        again = (ids[start] != ids[end - 1]) | np.logical_or.reduceat(twice, start)
        yield from _sent(groups, SOURCE, ids[start][again], edge[start][again])
        later = ids > np.repeat(ids[start], end - start)
        members.append((np.mod(ids[later], groups), edge[later]))
        yield int(edge[0] % np.uint64(buckets)), MEMBER, _members(*(np.concatenate(c) for c in zip(*members)))

    return run


def _wrapped(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unwrapped(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(payload):
        n = int.from_bytes(payload[at : at + 8], "little")
        out.append(payload[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _pieces(groups: int):
    """PIECE rows: the edges that documents are sources of, with nodes and words, for each chunk of texts.

    Consecutive edges form a piece, whose words travel once. An edge counts
    where it first occurs, in the first row of its document that has it.
    """

    def load(told):
        parts = [unpack(p, np.uint64) for k, p in told if k == SOURCE]
        if not parts:
            return None
        ids, edge = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((edge, ids))
        return ids[order], edge[order], np.zeros(len(ids), bool)

    def work(told, ids, _, texts) -> list[tuple[int, int, bytes]]:
        if told is None:
            return []
        owners, known, used = told
        low, high = np.searchsorted(owners, ids), np.searchsorted(owners, ids, side="right")
        some = np.flatnonzero(low < high)
        if not len(some):
            return []
        found = Edges([texts[i] for i in some])
        columns, lengths, words = [], [], []
        for k, i in enumerate(some):
            a, b = found.bounds[k], found.bounds[k + 1]
            edge, first = np.unique(found.hash[a:b], return_index=True)
            at = low[i] + np.minimum(np.searchsorted(known[low[i] : high[i]], edge), high[i] - low[i] - 1)
            mine = (known[at] == edge) & ~used[at]
            used[at[mine]] = True
            at = a + np.sort(first[mine])
            if not len(at):
                continue
            columns.append((np.full(len(at), ids[i]), found.hash[at], found.leaves[at], found.reaches[at], found.word[at].astype(np.uint32)))
            split = texts[i].split()
            cuts = np.flatnonzero(np.diff(found.word[at]) != 1) + 1
            for x, y in zip(np.append(0, cuts), np.append(cuts, len(at))):
                piece = b" ".join(split[found.word[at[x]] : found.word[at[y - 1]] + WINDOW])
                lengths.append(len(piece))
                words.append(piece)
        if not columns:
            return []
        # Documents of a chunk are all of one group.
        return [(int(ids[0] % groups), PIECE, _wrapped(pack(*(np.concatenate(c) for c in zip(*columns))), np.array(lengths, np.uint32).tobytes(), b"".join(words)))]

    return load, work


class Pieces:
    """What a PIECE row holds."""

    def __init__(self, payload: bytes):
        head, lengths, self.text = _unwrapped(payload)
        self.src, self.edge, self.leaves, self.reaches, self.pos = unpack(head, np.uint64, np.uint64, np.uint64, np.uint32)
        self.next = (self.src[1:] == self.src[:-1]) & (self.pos[1:] == self.pos[:-1] + 1)
        self.begin = np.flatnonzero(np.concatenate([[True], ~self.next]))
        self.ends = np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64)

    def runs(self, heads: np.ndarray) -> np.ndarray:
        """Where runs begin, given the sorted edges that are heads."""
        return np.flatnonzero(_within(self.edge, heads))


def _within(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, came, follows, went, src) for either end of each edge: at the node it reaches, and at the one it leaves."""
    for b in batches:
        for payload in b.column("payload").to_pylist():
            p = Pieces(payload)
            edge = p.edge.view(np.int64)
            follows = pa.array(np.append(edge[1:], 0), mask=np.append(~p.next, True))
            none = pa.nulls(len(edge), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(p.reaches.view(np.int64)), pa.array(edge), follows, none, none], names=_END)
            yield pa.RecordBatch.from_arrays([pa.array(p.leaves.view(np.int64)), none, none, pa.array(edge), pa.array(p.src)], names=_END)


_END = ["node", "came", "follows", "went", "src"]


def _leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for payload in b.column("payload").to_pylist():
            p = Pieces(payload)
            yield pa.RecordBatch.from_arrays([pa.array(p.leaves.view(np.int64)), pa.array(p.edge.view(np.int64)), pa.array(p.src)], names=["node", "edge", "src"])


def _packed(table: DataFrame, kind: int, groups: int, *names: str) -> DataFrame:
    """ANSWERED rows for the groups of ``src``, holding further long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield rows(ANSWERED, _sent(groups, kind, b.column("src").to_numpy(), *(b.column(n).to_numpy() for n in names)))

    return table.select("src", *names).mapInArrow(run, ANSWERED)


def _over_pieces(told: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows)`` of each group: an iterator of (kind, payload), PIECE rows last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from per_group(batches, "grp", lambda _, it: work(it), ("kind", "payload"))

    return told.select("grp", "kind", "payload").repartitionById(partitions(told.sparkSession), F.col("grp")).sortWithinPartitions("grp", "kind").mapInArrow(run, schema)


def _sorted(parts: list[list[np.ndarray]], *kinds) -> list[np.ndarray]:
    """Columns of all parts in the order of the second, which holds edges."""
    if not parts:
        return [np.empty(0, k) for k in kinds]
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(columns[1], kind="stable")
    return [c[order] for c in columns]


def _runs(told: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(head, tail, size) of each run."""
    parts, heads = [], None
    for kind, payload in told:
        if kind == HEAD:
            parts.append(unpack(payload, np.uint64))
            continue
        heads = _sorted(parts, np.int64, np.uint64)[1] if heads is None else heads
        p = Pieces(payload)
        first = p.runs(heads)
        end = np.append(first[1:], len(p.edge))
        yield pa.RecordBatch.from_arrays([pa.array(p.edge[first].view(np.int64)), pa.array(p.edge[end - 1].view(np.int64)), pa.array((end - first).astype(np.int64))], names=["head", "tail", "size"])


def chained(links: DataFrame, runs: DataFrame) -> DataFrame:
    """(src, head, path, far) of runs that follow others: the first run of the path and how many edges lie before.

    ``links``: (came, went, src) where an edge that ends one run is followed by
    one that begins another, of the document src. Every round joins a run with
    the one it points to, and so doubles its reach. Runs on a cycle have no
    first one; they stay paths of their own.
    """
    follows = links.join(runs, F.col("came") == F.col("tail")).select("src", F.col("went").alias("head"), F.col("head").alias("path"), F.col("size").alias("far"))
    state = cut(follows.withColumn("open", F.lit(True)))
    count = state.count()
    for _ in range(count.bit_length() + 1 if count else 0):
        ahead = state.select(F.col("head").alias("h"), F.col("path").alias("p"), F.col("far").alias("f"))
        state = cut(state.join(ahead, F.col("path") == F.col("h"), "left").select("src", "head", F.coalesce("p", "path").alias("path"), (F.col("far") + F.coalesce("f", F.lit(0))).alias("far"), F.col("p").isNotNull().alias("open")))
        if state.where("open").isEmpty():
            return state.drop("open")
    return state.where("NOT open").drop("open")


def _coordinates(buckets: int):
    """ASKED rows for the buckets of edges: source, edge, coordinate along its path, and place in its source."""

    def run(told: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {HEAD: [], CHAIN: []}
        heads = chain = None
        for kind, payload in told:
            if kind == HEAD:
                parts[HEAD].append(unpack(payload, np.uint64))
                continue
            if kind == CHAIN:
                parts[CHAIN].append(unpack(payload, np.uint64, np.uint64, np.int64))
                continue
            if heads is None:
                heads, chain = _sorted(parts[HEAD], np.int64, np.uint64)[1], _sorted(parts[CHAIN], np.int64, np.uint64, np.uint64, np.int64)
            p = Pieces(payload)
            first = p.runs(heads)
            path, far = p.edge[first].copy(), np.zeros(len(first), np.uint64)
            if len(chain[1]):
                at = np.minimum(np.searchsorted(chain[1], path), len(chain[1]) - 1)
                hit = chain[1][at] == path
                path[hit], far[hit] = chain[2][at[hit]], chain[3][at[hit]].astype(np.uint64)
            size = np.diff(np.append(first, len(p.edge)))
            place = np.arange(len(p.edge)) - np.repeat(first, size)
            line = np.repeat(K.mix(path) + far, size) + place.astype(np.uint64)
            found = [(b, -1, pack(p.src[at], p.edge[at], line[at], p.pos[at])) for b, at in by_key((p.edge % np.uint64(buckets)).astype(np.int64), buckets)]
            yield rows(ASKED, found)

    return run


def _told_paths(groups: int):
    """PATH answers for the groups that hold an edge, from coordinates (kind -1) and members."""

    def run(asked: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        known, members = [], []
        for kind, payload in asked:
            if kind < 0:
                known.append(unpack(payload, np.uint64, np.uint64, np.uint32))
            else:
                members.append(unpack(payload, np.uint64))
        if not known or not members:
            return
        src, edge, line, pos = _sorted(known, np.int64, np.uint64, np.uint64, np.uint32)
        grp, asks = (np.concatenate(c) for c in zip(*members))
        at = np.minimum(np.searchsorted(edge, asks), len(edge) - 1)
        hit = edge[at] == asks
        grp, at = grp[hit], at[hit]
        for g, some in by_key(grp, groups):
            yield g, PATH, pack(src[at[some]], edge[at[some]], line[at[some]], pos[at[some]])

    return run


def _digest(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def spans(line: np.ndarray, src: np.ndarray, pos: np.ndarray, word: np.ndarray, doc: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) of edges in a row that follow one path in one source, or of single edges."""
    if not len(line):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    goes_on = np.zeros(len(line), bool)
    if not single:
        step = lambda x: x[1:] == x[:-1] + x.dtype.type(1)
        goes_on[1:] = step(line) & step(pos) & step(word) & (src[1:] == src[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~goes_on)
    return first, np.append(first[1:], len(line))


def _removed(groups: int, single: bool):
    """For each text its result row, and for each chunk the spans that sources have to verify."""

    def load(told):
        parts = [unpack(p, np.uint64, np.uint64, np.uint32) for k, p in told if k == PATH]
        denied = {tuple(map(int, r)) for k, p in told if k == DENIED for r in zip(*unpack(p, np.uint32, np.uint32, np.uint64, np.uint64))}
        return _sorted(parts, np.int64, np.uint64, np.uint64, np.uint32), denied

    def work(told, ids, docs, texts):
        (src, known, line, pos), denied = told
        e = Edges(texts)
        first = np.concatenate([[0], np.cumsum(e.words)])
        gone = np.zeros(first[-1] + 1, np.int64)
        asked = set()
        if len(known) and len(e.hash):
            at = np.minimum(np.searchsorted(known, e.hash), len(known) - 1)
            hit = np.flatnonzero((known[at] == e.hash) & (src[at] < ids[e.doc]))
            at, word, doc = at[hit], e.word[hit], e.doc[hit]
            split, last = [], -1
            begin, end = spans(line[at], src[at], pos[at], word, doc, single)
            for a, b in zip(begin.tolist(), end.tolist()):
                d, w, n = int(doc[a]), int(word[a]), b - a
                if d != last:
                    split, last = texts[d].split(), d
                request = (int(src[at[a]]), int(pos[at[a]]), n, *_digest(split[w : w + n + WINDOW - 1]))
                if request in denied:
                    continue
                asked.add(request)
                gone[first[d] + w] += 1
                gone[first[d] + w + n + WINDOW - 1] -= 1
        lost = np.cumsum(gone[:-1]) > 0
        result = []
        for i, t in enumerate(texts):
            out = lost[first[i] : first[i + 1]]
            words = t.split()
            kept = [w for w, x in zip(words, out.tolist()) if not x] if out.any() else words
            result.append((docs[i], int(e.words[i]), int(out.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        found = []
        if asked:
            s, p, n, d1, d2 = (np.array(c, k) for c, k in zip(zip(*asked), (np.int64, np.uint32, np.uint32, np.uint64, np.uint64)))
            back = np.full(len(s), ids[0] % groups, np.uint32)  # documents of a chunk are all of one group
            found = _sent(groups, REQUEST, s, p, n, d1, d2, back)
        return _both(found, result)

    return load, work


_KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def _both(found: list[tuple], result: list[tuple]) -> pa.RecordBatch:
    table = [(*f, None, None, None, None) for f in found] + [(None, None, None, *r) for r in result]
    columns = zip(*table) if table else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=[f.split()[0] for f in FOUND.split(", ")])


def _refused(told: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """DENIED answers about spans that the source does not hold at its coordinates."""
    parts, asked, fine = [], None, None
    for kind, payload in told:
        if kind == REQUEST:
            parts.append(unpack(payload, np.uint32, np.uint32, np.uint64, np.uint64, np.uint32))
            continue
        if not parts:
            return
        if asked is None:
            columns = [np.concatenate(c) for c in zip(*parts)]
            order = np.lexsort((columns[1], columns[0]))
            asked = [c[order] for c in columns]
            fine = np.zeros(len(order), bool)
        p = Pieces(payload)
        for k, begin in enumerate(p.begin.tolist()):
            end = int(p.begin[k + 1]) if k + 1 < len(p.begin) else len(p.edge)
            a, b = np.searchsorted(asked[0], [p.src[begin], p.src[begin] + 1]) if p.src[begin] < LAST else (len(asked[0]), len(asked[0]))
            a, b = a + np.searchsorted(asked[1][a:b], [p.pos[begin], p.pos[begin] + end - begin])
            if a == b:
                continue
            words = p.text[int(p.ends[k - 1]) if k else 0 : int(p.ends[k])].split(b" ")
            for i in range(int(a), int(b)):
                w, n = int(asked[1][i]) - int(p.pos[begin]), int(asked[2][i])
                fine[i] |= w + n + WINDOW - 1 <= len(words) and _digest(words[w : w + n + WINDOW - 1]) == (int(asked[3][i]), int(asked[4][i]))
    if asked is None and parts:
        asked = [np.concatenate(c) for c in zip(*parts)]
        fine = np.zeros(len(asked[0]), bool)
    if asked is not None and not fine.all():
        bad = np.flatnonzero(~fine)
        groups = int(asked[5].max()) + 1
        yield rows(ANSWERED, [(g, DENIED, pack(*(c[bad[at]] for c in asked[:5]))) for g, at in by_key(asked[5][bad].astype(np.int64), groups)])


def _as_blobs(told: DataFrame, load, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in over_groups(batches, load, work):
            if found:
                yield rows(ANSWERED, found)

    return told.mapInArrow(run, ANSWERED)


def graph(pieces: DataFrame, groups: int) -> DataFrame:
    """HEAD and CHAIN rows for the groups of sources, from their PIECE rows."""
    at = pieces.select("payload").mapInArrow(_ends, "node long, came long, follows long, went long, src long").groupBy("node")
    nodes = at.agg(F.count("came").alias("into"), F.count("went").alias("out"), F.max("came").alias("came"), F.max("follows").alias("follows"), F.max("went").alias("went"), F.max("src").alias("src"))
    inner = (F.col("into") == 1) & (F.col("out") == 1) & F.coalesce(F.col("follows") == F.col("went"), F.lit(False))
    breaks = cut(nodes.where((F.col("out") > 0) & ~inner))
    branching = breaks.where("out > 1").select("node")
    branches = pieces.select("payload").mapInArrow(_leaving, "node long, edge long, src long").join(branching, "node", "left_semi")
    heads = cut(_packed(breaks.where("out = 1").select("src", F.col("went").alias("edge")).unionByName(branches.select("src", "edge")), HEAD, groups, "edge"))
    runs = cut(_over_pieces(heads.unionByName(pieces), _runs, "head long, tail long, size long"), free=True)
    chain = chained(breaks.where("into = 1 AND out = 1").select("came", "went", "src"), runs)
    return heads.unionByName(_packed(chain, CHAIN, groups, "head", "path", "far"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT for each row: its words without those of windows that also start in a document with a smaller doc_id.

    Null and empty texts have no words. Rows with the same doc_id, repeated
    rows among them, are never smaller than each other, and a null doc_id is
    larger than any other. An empty table gives no rows.
    """
    buckets, groups = counts(docs.sparkSession)
    told = cut(settle(ask(docs, doc_id, text, _questions(buckets, groups)), _repeated(buckets, groups)), free=True)
    pieces = cut(_as_blobs(meet(docs, doc_id, text, told.where(f"kind = {SOURCE}"), groups), *_pieces(groups)), free=True)
    placed = _over_pieces(graph(pieces, groups).unionByName(pieces), _coordinates(buckets), ASKED)

    asks = told.where(f"kind = {MEMBER}").select(F.col("grp").alias("bucket"), "kind", "payload")
    paths = cut(settle(placed.unionByName(asks), _told_paths(groups)), free=True)

    def removed(answers: DataFrame, single: bool) -> DataFrame:
        load, work = _removed(groups, single)
        return cut(meet(docs, doc_id, text, answers, groups).mapInArrow(lambda it: over_groups(it, load, work), FOUND), free=True)

    def refused(found: DataFrame) -> DataFrame:
        return cut(_over_pieces(found.where("kind IS NOT NULL").select("grp", "kind", "payload").unionByName(pieces), _refused, ANSWERED), free=True)

    found = removed(paths, False)
    if not refused(found).isEmpty():  # some hash stands for two word sequences
        found = removed(paths, True)
        found = removed(paths.unionByName(refused(found)), True)
    return found.where("kind IS NULL").select(*[f.split()[0] for f in RESULT.split(", ")])
