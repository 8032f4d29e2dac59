"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins. Boosting goes round the
features in turn: each step fits a shallow tree (three leaves) to the gradient
over one feature's bins and adds it to that feature's lookup table. Then the
feature pairs with the strongest remaining interaction get small
two-dimensional tables the same way. A score is the logistic of the sum of the
looked-up entries, so scoring is a few vectorised bin additions per document.

The model is fitted on the driver from a bounded sample of labelled rows
(``max_rows``); everything else runs over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .store import bounded_batches
from .words import Text, blocks, windows

FEATURES = (
    "log_words", "word_chars", "symbols", "pipes", "exclaims", "capitals", "digits", "punctuation",
    "distinct", "repeat_next", "repeat_three", "repeat_lines", "line_words", "ended_lines", "short_words",
)
#: Labelled rows that the driver fits on, at most.
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 120, 40, 0.2


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _PIPE, _BANG = _set("#*$%&<>"), _set("|"), _set("!")
_UPPER, _LOWER, _DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("abcdefghijklmnopqrstuvwxyz"), _set("0123456789")
_PUNCT, _ENDS = _set(".,;:?!"), _set(".!?:;\"')")


def _repeated(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of a document's hashes that equal an earlier one of it."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    return np.bincount(d[1:][(d[1:] == d[:-1]) & (h[1:] == h[:-1])], minlength=n)


def text_features(text: Text) -> np.ndarray:
    """(documents, FEATURES) of one block; zeros for a text without words."""
    n, data = text.n, text.data
    out = np.zeros((n, len(FEATURES)))
    words = text.counts()
    if not len(text.start):
        return out
    hashes, doc = text.hashes(), text.doc_of_word()
    some = np.maximum(words, 1)
    chars = text.per_doc(text.word & ((data & 0xC0) != 0x80))
    upper, letters = text.per_doc(_UPPER[data]), text.per_doc(_UPPER[data] | _LOWER[data])
    same = np.zeros(len(doc), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    three, at = windows(hashes, text.first, 3)
    # a line starts at the first word after a line feed
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=breaks[1:])
    begins = np.ones(len(doc), bool)
    begins[1:] = (breaks[text.start[1:]] > breaks[text.start[:-1]]) | (doc[1:] != doc[:-1])
    lines = np.flatnonzero(begins)
    line_doc, last = doc[lines], np.append(lines[1:], len(doc)) - 1
    sums = np.zeros(len(doc) + 1, np.uint64)
    np.cumsum(hashes * (np.arange(len(doc), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), out=sums[1:])
    flat = np.zeros(len(doc) + 1, np.uint64)
    np.cumsum(hashes, out=flat[1:])
    base = lines.astype(np.uint64) * np.uint64(2)
    line_hash = (sums[last + 1] - sums[lines]) - base * (flat[last + 1] - flat[lines])  # words weighed by their place in the line
    n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    size = text.end - text.start
    out[:, 0] = np.log1p(words)
    out[:, 1] = chars / some
    for k, chosen in ((2, _SYMBOL), (3, _PIPE), (4, _BANG), (6, _DIGIT), (7, _PUNCT)):
        out[:, k] = text.per_doc(chosen[data]) / some
    out[:, 5] = upper / np.maximum(letters, 1)
    out[:, 8] = 1 - _repeated(doc, hashes, n) / some
    out[:, 9] = np.bincount(doc[same], minlength=n) / some
    out[:, 10] = _repeated(doc[at], three, n) / some
    out[:, 11] = _repeated(line_doc, line_hash, n) / n_lines
    out[:, 12] = np.log1p(words / n_lines)
    out[:, 13] = np.bincount(line_doc[_ENDS[data[text.end[last] - 1]]], minlength=n) / n_lines
    out[:, 14] = np.bincount(doc[size <= 3], minlength=n) / some
    out[words == 0] = 0
    return out


@dataclass
class Model:
    """Bin edges and lookup tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between quantiles, and one above a heap of equal least values."""
    inner = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")
    above = x[x > x.min()]
    extra = np.quantile(above, [0.0, 0.25, 0.5, 0.75], method="lower") if len(above) else []
    return np.unique(np.concatenate([inner, extra]))


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int = 3, smooth: float = 5.0) -> np.ndarray:
    """Values per bin of a tree with at most that many leaves over ordered bins."""
    spans = [(0, len(g))]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + smooth)
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gains = left_g**2 / (left_h + smooth) + (g[a:b].sum() - left_g) ** 2 / (h[a:b].sum() - left_h + smooth) - gain(a, b)
                c = int(np.argmax(gains))
                if gains[c] > best[0]:
                    best = (gains[c], k, a + c + 1)
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + smooth)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of one-feature tables, then of the strongest pairs' tables."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(intercept=float(np.log(rate / (1 - rate))))
    rate = y.mean()
    model = Model(float(np.log(rate / (1 - rate))), [_edges(x[:, k], BINS) for k in range(x.shape[1])], [], [_edges(x[:, k], PAIR_BINS)[: PAIR_BINS + 4] for k in range(x.shape[1])])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _leaves(np.bincount(bins[k], p - y, len(table)), np.bincount(bins[k], p * (1 - p), len(table)))
            table += step
            total += step[bins[k]]
    rough = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        cell, shape = rough[i] * sizes[j] + rough[j], (sizes[i], sizes[j])
        return np.bincount(cell, p - y, sizes[i] * sizes[j]).reshape(shape), np.bincount(cell, p * (1 - p), sizes[i] * sizes[j]).reshape(shape)

    def strength(i: int, j: int) -> float:
        g, h = sums(i, j)
        return float((g**2 / (h + 5)).sum() - (g.sum(1) ** 2 / (h.sum(1) + 5)).sum() - (g.sum(0) ** 2 / (h.sum(0) + 5)).sum())

    width = x.shape[1]
    chosen = sorted(((i, j) for i in range(width) for j in range(i + 1, width)), key=lambda ij: -strength(*ij))[:PAIRS]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = sums(i, j)
            step = np.zeros_like(table)
            rows = _leaves(g.sum(1), h.sum(1), 2)
            for value in np.unique(rows):  # a tree of depth two: rows in two groups, each cut along the other feature
                part = rows == value
                step[part] = RATE * _leaves(g[part].sum(0), h[part].sum(0), 2)
            table += step
            total += step[rough[i], rough[j]]
    return model


def _arrays(column: pa.Array):
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for _, text in blocks(iter([batch])):
        yield text_features(text)


def features_of(text: Column) -> Column:
    """An array column of FEATURES."""

    @arrow_udf("array<double>")
    def compute(column: pa.Array) -> pa.Array:
        rows = np.concatenate([np.zeros((0, len(FEATURES))), *_arrays(column)])
        return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), rows.ravel())

    return compute(text)


def score_of(text: Column, model: Model) -> Column:
    """A column of scores in 0 to 1, higher: label 1 likelier."""

    @arrow_udf("double")
    def compute(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(x) for x in _arrays(column))]))

    return compute(text)


def bucket_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3: rows with 1 are held out of training. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fits on labelled documents outside the held-out third: max_rows of them at most, chosen by a hash of the id.

    Null ids and labels are left out, and of labels or texts that share an id
    the least counts. Without labels, or with one class only, the score is the
    same for all texts.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (bucket_of(F.col("doc_id")) != 1))
    sample = usable.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows pairs of numbers
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", features_of(F.col("text")).alias("x"))
    rows = found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # max_rows at most
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    A null text is an empty one, and gets the score of a text without words.
    Repeated rows are scored each, a null doc_id stays null. An empty table
    gives an empty result. Other columns are ignored. No row is shuffled.
    """
    score = docs.select("doc_id", (bucket_of(F.col("doc_id")) == 1).alias("held_out"), score_of(F.col("text"), model).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model predicts as 1, with their columns.

    Each row is judged by its text alone: a null text as an empty one, repeated
    rows and null ids alike. An empty table gives an empty result. No row is
    shuffled.
    """
    return docs.where(score_of(F.col("text"), model) >= 0.5)
