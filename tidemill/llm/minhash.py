"""Near-duplicate documents by MinHash.

Minima of many universal hashes over a document's shingles are banded; equal
bands make candidates. Documents with equal sets are one node from the start.
Bands' stars give coarse clusters, in which pairs whose signatures agree
enough are verified on the full sets, in blocks of bounded size; the verified
links' components, by alternating large-star and small-star steps, are the
result. Neither step lists the pairs of a group: a block reports a spanning
forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import kernel as K
from tidemill.llm.components import connected_components
from tidemill.llm.exchange import LAST
from tidemill.llm.frames import add_columns, cut, partitions

SHINGLE = 5
PERCENT = 80  # links need 100 * intersection >= PERCENT * union
BANDS, ROWS = 32, 7  # a pair at 85 % shares no band with probability 4e-6, at 80 % 3e-4
MARGIN = 0.15  # signatures may disagree by so much more than the sets; six standard deviations
BLOCK_DOCS = 1024
FEW = 64 << 10

_rng = np.random.default_rng(9907)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin (and end).

    Words are lower-cased (A-Z); a text with fewer than ``width`` words has its
    whole word sequence as its only shingle, and one without words none.
    """
    data, at = K.joined([(t or "").encode() for t in texts], 1)
    data = K.LOWER[data]
    starts, ends = K.words_of(data)
    h = K.span_hashes(data, starts, ends)
    doc = np.searchsorted(at, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))[: len(texts)]
    first = np.concatenate([[0], np.cumsum(n)])
    if len(h) >= width:
        s = K.sequence_windows(h, width)
        inside = doc[: len(s)] == doc[width - 1 :]
        key, owner = s[inside], doc[: len(s)][inside]
    else:
        key, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = []
        for i in short:
            x = 0
            for v in h[first[i] : first[i + 1]].tolist():
                x = K.mix_int(x * 31 + v)
            whole.append(x)
        key, owner = np.concatenate([key, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts))[: len(texts)])])


def signatures(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minima of each set under each hash, sets x hashes; sets must not be empty."""
    out = np.empty((len(at) - 1, BANDS * ROWS), np.uint32)
    for a, b in K.batches(np.diff(at).tolist(), FEW):
        part, start = key[at[a] : at[b]], at[a:b] - at[a]
        for k in range(BANDS * ROWS):
            out[a:b, k] = np.minimum.reduceat(((part * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def _digests(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs that tell sets apart; 0 for empty sets."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((2, len(at) - 1), np.uint64)
    if len(some):
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[i][some] = K.mix(np.add.reduceat(K.mix(key ^ np.uint64(salt)), at[some]))
    return out[0].view(np.int64), out[1].view(np.int64)


def _profile():
    def run(texts):
        key, at = shingle_sets(texts)
        n = np.diff(at)
        d1, d2 = _digests(key, at)
        bands: list[bytes | None] = [None] * len(texts)
        some = np.flatnonzero(n)
        if len(some):
            sig = signatures(key, np.concatenate([at[some], at[-1:]])).astype(np.uint64).reshape(len(some), BANDS, ROWS)
            h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
            for r in range(ROWS):
                h = K.mix(h * np.uint64(K._BASE) + sig[:, :, r])
            for i, row in zip(some, h):
                bands[i] = row.tobytes()
        return pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), pa.array(bands, pa.binary())

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blob = b"".join(b.column("bands").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, np.int64)), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], names=["band", "node"])


def _linked(percent: int):
    """Spanning forests of the links in each block, rows sorted by (cluster, i, j)."""

    def forest(nodes: list[int], sets: list[bytes], sides: list[int], cross: bool) -> list[tuple[int, int]]:
        arrays = [np.frombuffer(s, np.uint64) for s in sets]
        at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
        sig = signatures(np.concatenate(arrays), at)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        size = np.diff(at)
        side = np.array(sides)
        held: dict[int, frozenset] = {}
        out = []
        for i in range(1, len(nodes)):
            agree = (sig[:i] == sig[i]).mean(axis=1)
            fits = (agree >= percent / 100 - MARGIN) & (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i]))
            if cross:
                fits &= side[:i] != side[i]
            found = np.flatnonzero(fits)
            for j in found[np.argsort(-agree[found], kind="stable")].tolist():
                if root(i) == root(j):
                    continue
                a, b = (held.get(x) or held.setdefault(x, frozenset(arrays[x].tolist())) for x in (i, j))
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
                    out.append((nodes[i], nodes[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, sets, sides = None, [], [], []
        for b in batches:
            found = []
            for c, i, j, side, node, s in zip(*(b.column(n).to_pylist() for n in ("cluster", "i", "j", "side", "node", "shingles"))):
                if (c, i, j) != current:
                    if len(nodes) > 1:
                        found += forest(nodes, sets, sides, current[1] != current[2])
                    current, nodes, sets, sides = (c, i, j), [], [], []
                nodes.append(node)
                sets.append(s)
                sides.append(side)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
        if len(nodes) > 1:
            found = forest(nodes, sets, sides, current[1] != current[2])
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return run


def _sets():
    def run(texts):
        key, at = shingle_sets(texts)
        d1, d2 = _digests(key, at)
        return pa.array(d1), pa.array(d2), pa.array([key[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())

    return run


def _grouped(source: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Profiles (node, mark, n_shingles, d1, d2) of ``source`` (node, mark, text), and (d1, d2, component, least) of each class of equal sets.

    A class, not an id, is a node of the graph, so rows that share an id, or
    have none, are not tied together by it.
    """
    spark = source.sparkSession
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("bands", T.BinaryType())]
    profiles = cut(add_columns(source, "text", fields, _profile, ["node", "mark"], 1 << 20))
    some = profiles.where("n_shingles > 0")
    classes = some.groupBy("d1", "d2").agg(F.min("node").alias("rep"), F.min_by("bands", F.struct("node", "bands")).alias("bands"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    banded = cut(classes.select(F.col("class").alias("node"), "bands").mapInArrow(_spread, "band long, node long"))
    least = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    coarse = connected_components(banded.join(least, "band").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = cut(coarse.select("node", F.col("component").alias("cluster")))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("members"))
    members = members.join(sizes, "cluster").join(classes.select(F.col("class").alias("node"), "rep", F.col("d1").alias("w1"), F.col("d2").alias("w2")), "node")
    wanted = source.select(F.col("node").alias("rep"), "text").join(members.withColumnRenamed("node", "class"), "rep")
    set_fields = [T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("shingles", T.BinaryType())]
    full = add_columns(wanted, "text", set_fields, _sets, ["class", "cluster", "members", "w1", "w2"]).where("d1 = w1 AND d2 = w2").dropDuplicates(["class"])
    blocks = F.ceil(F.col("members") / F.lit(BLOCK_DOCS)).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    placed = full.select("cluster", F.col("class").alias("node"), "shingles", blocks.alias("blocks"), own.alias("side"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "shingles")
    dealt = placed.repartition(partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    parts = cut(connected_components(dealt.mapInArrow(_linked(percent), "a long, b long")))
    tied = classes.select("class", "d1", "d2", "rep").join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = tied.groupBy("component").agg(F.min("rep").alias("least"))
    return profiles, tied.join(first, "component").select("d1", "d2", "component", "least")


def _nodes(docs: DataFrame, doc_id: str, text: str, mark: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("node"), mark.alias("mark"), F.col(f"`{text}`").alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    component_id is the least doc_id that links reach, the row's own included;
    kept says whether it is the row's own. Texts without words, null ones among
    them, have an empty set and link with nothing. A null doc_id is larger than
    any other and comes out as null. Rows are linked by their texts alone, so
    rows that share an id may be in different components; repeated rows are in
    one, and each of them is kept or none.
    """
    profiles, classes = _grouped(_nodes(docs, doc_id, text, F.lit(0)), percent)
    joined = profiles.select("node", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    least = F.coalesce("least", "node")
    shown = lambda c: F.when(c != LAST, c)
    return joined.select(shown(F.col("node")).alias("doc_id"), "n_shingles", shown(least).alias("component_id"), (least == F.col("node")).alias("kept"))


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, and all rows whose texts have no words.

    It is the row with the least doc_id, null last; of rows that share it the
    one whose columns hash lowest, so reruns agree. Rows with the same or no
    id, but different texts, are documents of their own.
    """
    hashed = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    mark = F.xxhash64(*hashed)
    profiles, classes = _grouped(_nodes(docs, doc_id, text, mark), percent)
    first = profiles.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("node", "mark")).alias("first"))
    chosen = first.join(classes, ["d1", "d2"]).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.node").alias("__node"), F.col("first.mark").alias("__mark"))
    known = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST))
    worded = F.coalesce(F.rlike(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    rows = docs.where(worded).withColumns({"__node": known, "__mark": mark})
    kept = rows.join(chosen, ["__node", "__mark"], "left_semi").dropDuplicates(["__node", "__mark"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~worded))
