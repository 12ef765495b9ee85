"""Quality by labelling lines with a linear-chain conditional random field.

Viterbi decoding marks each line of a text as content or boilerplate, and the
share of words in content lines decides whether the document is kept. The
field is trained here, on all lines of a bounded sample of labelled documents.
Labels are of documents, those of lines are latent: a document that is labelled
good is mostly content, one that is not is mostly boilerplate, and within that
bound each line takes the label that it fits better. Training alternates
between giving lines their labels and fitting the field to them, beginning
with a guess by the look of single lines, so the field learns how lines look
and how content and boilerplate follow each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import kernel as K
from tidemill.llm.frames import add_columns

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

SAMPLE_DOCS = 2_000  # labelled documents that the field is fitted on, with all their lines
SEGMENT = 32  # lines of a chain in training; longer documents are several chains
TURNS = 4  # of labelling lines and fitting
MAJORITY = 0.6  # share of a document's words that surely have its label
CONTENT_SHARE = 0.5

# Words and phrases that page furniture tends to hold (fixed values).
FURNITURE = ("cookie", "copyright", "all rights reserved", "subscribe", "sign up", "log in", "privacy policy", "terms of", "click here", "http", "licensed under", "javascript", "newsletter")

FEATURES = ("bias", "symbols", "symbol words", "bars", "digits", "short", "long", "ends a sentence", "capital", "repeats", "same words", "furniture", "word length", "other marks", "capitals")


def line_features(lines: list[str]) -> np.ndarray:
    """One row of FEATURES for each line."""
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, chars = len(words), max(1, len(line))
        if not n:
            continue
        symbols = sum(map(line.count, SYMBOLS))
        low = line.lower()
        distinct = len(set(words))
        out[i] = (
            1.0,
            min(1.0, 8.0 * symbols / chars),
            min(1.0, symbols / n),
            min(1.0, 3.0 * line.count("|") / n),
            min(1.0, 4.0 * sum(map(line.count, "0123456789")) / chars),
            n < 4,
            n > 12,
            line.rstrip()[-1:] in ".!?",
            words[0][:1].isupper(),
            line in seen,
            1.0 - distinct / n,
            any(f in low for f in FURNITURE),
            min(2.0, chars / n / 8.0),
            min(1.0, 6.0 * sum(map(line.count, "{}[]=_~^\\@")) / chars),
            sum(w.isupper() and len(w) > 1 for w in words) / n,
        )
        seen.add(line)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of states 0 (content) and 1 (boilerplate) and of their transitions."""

    emit: np.ndarray  # features x 2
    step: np.ndarray  # from x to
    start: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best label of each row."""
        score = (x @ self.emit).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = score[0][0] + float(self.start[0]), score[0][1] + float(self.start[1])
        back = []
        for e0, e1 in score[1:]:
            from0, from1 = a + s00 < b + s10, a + s01 < b + s11
            back.append((from0, from1))
            a, b = (b + s10 if from0 else a + s00) + e0, (b + s11 if from1 else a + s01) + e1
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return np.array(out[::-1], np.int8)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """How much the best labelling with boilerplate at a row beats the best one with content there."""
        e = x @ self.emit
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0] + self.start
        for i in range(1, len(e)):
            ahead[i] = (ahead[i - 1][:, None] + self.step).max(0) + e[i]
        for i in range(len(e) - 2, -1, -1):
            behind[i] = (self.step + (e[i + 1] + behind[i + 1])[None, :]).max(1)
        return (ahead + behind) @ np.array([-1.0, 1.0])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by Adam. x: chains x lines x features, y: chains x lines, 0 or 1; weight: of each chain."""
    chains, most, k = x.shape
    emit, step, start = np.zeros((k, 2)), np.zeros((2, 2)), np.zeros(2)
    live = np.arange(most)[None, :] < lengths[:, None]
    if not live.any() or y[live].min() == y[live].max():  # nothing to tell apart: everything is content
        return Field(emit, step, np.array([1.0, 0.0]))
    weight = np.full(chains, 1.0 / live.sum()) if weight is None else weight
    gold = np.eye(2)[y]
    first, second = [np.zeros_like(p) for p in (emit, step, start)], [np.zeros_like(p) for p in (emit, step, start)]
    for t in range(1, rounds + 1):
        e = x @ emit
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + start
        for i in range(1, most):
            new = _lse(alpha[:, i - 1, :, None] + step[None], 1) + e[:, i]
            alpha[:, i] = np.where(live[:, i, None], new, alpha[:, i - 1])
        for i in range(most - 2, -1, -1):
            new = _lse(step[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(live[:, i + 1, None], new, 0.0)
        z = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        diff = (gold * live[..., None] - p) * weight[:, None, None]
        pair = np.exp(alpha[:, :-1, :, None] + step[None, None] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        same = gold[:, :-1, :, None] * gold[:, 1:, None, :] * live[:, 1:, None, None]
        grads = [np.einsum("dlk,dls->ks", x, diff) - decay * emit, ((same - pair) * weight[:, None, None, None]).sum((0, 1)) - decay * step, diff[:, 0].sum(0) - decay * start]
        for q, g, m, v in zip((emit, step, start), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(emit, step, start)


def bounded(score: np.ndarray, size: np.ndarray, y: int, majority: float = MAJORITY) -> np.ndarray:
    """Labels of a document's lines: the likelier ones, but lines that hold ``majority`` of its words have its own.

    score: how much likelier boilerplate is, for each line; size: its words;
    y: 0 for a document of content, 1 for one of boilerplate. Lines change to
    the document's label in the order in which they come closest to it.
    """
    label = (score > 0).astype(np.int64)
    order = np.argsort(score if y == 0 else -score, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    label[order[before < majority * size.sum()]] = y
    return label


def train_latent(x: list[np.ndarray], size: list[np.ndarray], y: np.ndarray, turns: int = TURNS) -> Field:
    """A field from documents' lines (features and words of each) and labels of documents alone."""
    if not len(y) or y.min() == y.max():
        return train(np.zeros((1, 1, len(FEATURES))), np.array([1]), np.zeros((1, 1), np.int64))
    # Both labels weigh the same, whatever their share of the sample, and so do all documents of a label.
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    cuts = [(d, a, min(a + SEGMENT, len(f))) for d, f in enumerate(x) for a in range(0, len(f), SEGMENT)]
    lengths = np.array([b - a for _, a, b in cuts])
    rows = np.zeros((len(cuts), int(lengths.max()), len(FEATURES)))
    for i, (d, a, b) in enumerate(cuts):
        rows[i, : b - a] = x[d][a:b]
    weight = np.array([each[d] / len(x[d]) for d, *_ in cuts])

    def chained(labels: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(rows.shape[:2], np.int64)
        for i, (d, a, b) in enumerate(cuts):
            out[i, : b - a] = labels[d][a:b]
        return out

    # The first guess looks at single lines: chains of one line each.
    lines = np.concatenate(x)[:, None, :]
    of = np.repeat(np.arange(len(x)), [len(f) for f in x])
    field = train(lines, np.ones(len(lines), np.int64), y[of][:, None], (each / np.array([len(f) for f in x]))[of], rounds=40)
    score = [f @ (field.emit[:, 1] - field.emit[:, 0]) + field.start[1] - field.start[0] for f in x]
    for _ in range(turns):
        field = train(rows, lengths, chained([bounded(s, n, int(k)) for s, n, k in zip(score, size, y)]), weight)
        score = [field.margins(f) for f in x]
    return field


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field from all lines of the ``sample_docs`` labelled documents whose ids hash lowest.

    Rows with a null id, text or label are left out, as are texts without
    words; of a document labelled twice the larger label counts. Without
    labelled rows, or with one label alone, everything is content.
    """
    picked = (
        labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_docs)
    )
    # The sample is bounded, so it is broadcast.
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "id")

    def make():
        def run(values):
            held = [_inked(v) for v in values]
            yield pa.array([line_features(lines).astype("<f4").tobytes() for lines in held], pa.binary())
            yield pa.array([np.array([len(s.split()) for s in lines], "<i8").tobytes() for lines in held], pa.binary())

        return run

    found = add_columns(texts, "text", [T.StructField("x", T.BinaryType()), T.StructField("n", T.BinaryType())], make, ["id", "y"]).toArrow().to_pylist()
    found = sorted((r for r in found if r["x"]), key=lambda r: (r["id"], r["x"]))
    x = [np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)).astype(np.float64) for r in found]
    return train_latent(x, [np.frombuffer(r["n"], "<i8") for r in found], np.array([1 - r["y"] for r in found], np.int64))


def _inked(text: str | None) -> list[str]:
    """Lines with a word."""
    return [s for s in (text or "").split("\n") if s.split()]


def base_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; null has none."""
    texts = [t or "" for t in texts]
    data, at = K.joined([t.encode() for t in texts], 1)
    starts, ends = K.words_of(data)
    doc = np.searchsorted(at, starts, side="right") - 1
    n = len(texts)
    words = np.bincount(doc, minlength=n)[:n]
    repeat = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        h = K.sequence_windows(K.span_hashes(data, starts, ends), WINDOW)
        inside = doc[: len(h)] == doc[WINDOW - 1 :]
        where = np.flatnonzero(inside)
        key = K.mix(h[where] ^ (doc[where].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        twin = np.zeros(len(ordered), bool)
        same = ordered[1:] == ordered[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        hit = where[order[twin]]
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        repeat = np.bincount(doc[covered], minlength=n)[:n]
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = t.split("\n")
        if len(lines) > 1:
            inked = [s for s in lines if s.encode().split()]
            dup[i] = len(inked) - len(set(inked))
    return {
        "n_words": words,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


def content_share(field: Field, text: str | None) -> float:
    """Share of words in lines that Viterbi decoding marks as content; 0 without words."""
    lines = _inked(text)
    if not lines:
        return 0.0
    label = field.viterbi(line_features(lines).astype(np.float64))
    size = np.array([len(s.split()) for s in lines], np.float64)
    return float(size[label == 0].sum() / size.sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_share: float = CONTENT_SHARE) -> DataFrame:
    """Kept columns, COUNTS, ``base_failed``, ``content_share`` and ``kept`` of each row.

    A null text counts as the empty one: no words, so it fails the base rules.
    Repeated rows give repeated rows.
    """

    def make():
        def run(values):
            c = base_counts(values)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            share = np.array([content_share(field, v) for v in values])
            for name in COUNTS:
                yield pa.array(c[name], pa.int64())
            yield pa.array(failed)
            yield pa.array(share)
            yield pa.array(~failed & (share >= least_share))

        return run

    fields = [T.StructField(n, T.LongType()) for n in COUNTS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return add_columns(docs, text, fields, make, list(keep))
