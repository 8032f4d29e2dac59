"""Toxicity: a classifier chain of linear models over the words of the whole text.

Categories are predicted one after the other; each model also sees the
probabilities of the categories before it. While fitting, those are
out-of-fold predictions, so a later model does not trust an earlier one more
than it deserves on new texts. The last category is the label itself.

Words are folded to lower case and hashed into buckets. Which buckets the
models look at is decided by a count in Spark over all labelled rows outside
the held-out third (documents of either class that have the bucket); the models
are fitted on the driver from at most ``max_rows`` rows of at most ``width``
bits each. The labels name no category but the last. The earlier ones are
learned: clusters of the buckets that toxic texts have more often, by the toxic
texts that they share; a toxic text with a bucket of a cluster belongs to its
category. Having one is a bit too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_model import bucket_of
from .store import written
from .words import Text, blocks

#: The labels have one category; the groups before it are learned, and only their order has a meaning.
CATEGORIES = ("first_group", "second_group", "toxic")
#: Labelled rows that the driver fits on, at most; buckets that the models look at, at most.
MAX_ROWS, WIDTH = 12_000, 256
BUCKET_BITS, MIN_DOCS, MIN_DEVIATION, FOLDS, RIDGE = 20, 4, 4.0, 3, 1.0

_FOLD = np.full(256, 0x20, np.uint8)
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalnum() or _c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c


def folded(text: Text) -> Text:
    """The same documents in lower case, with words of letters and digits only."""
    return Text(_FOLD[text.data], text.docs)


def _buckets(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each distinct word bucket of a document."""
    shift = np.uint64(BUCKET_BITS)
    pairs = np.unique((text.doc_of_word().astype(np.uint64) << shift) | (text.hashes() >> np.uint64(64 - BUCKET_BITS)))
    return (pairs >> shift).astype(np.int64), (pairs & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, buckets) of labelled rows (doc_id, y, text)."""
    for part, plain in blocks(batches):
        text = folded(plain)
        doc, bucket = _buckets(text)
        lists = pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(text.n + 1)).astype(np.int32), pa.array(bucket))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "y", "buckets"])


def clustered(x: np.ndarray, y: np.ndarray, strength: np.ndarray, n: int) -> list[np.ndarray]:
    """n clusters of the columns of x with a positive strength, by cosine over the rows of class 1.

    The strongest column begins the first cluster, and the column least like
    those that have begun one the next; every other joins the one it is most
    like. Clusters are empty where there are too few columns.
    """
    able = np.flatnonzero(strength > 0)
    bits = x[y == 1][:, able].astype(float)
    bits /= np.maximum(np.sqrt((bits**2).sum(0)), 1e-9)
    like = bits.T @ bits
    begun: list[int] = []
    for _ in range(min(n, len(able))):
        near = like[begun].max(0) if begun else np.zeros(len(able))
        near[begun] = np.inf
        begun.append(int(np.lexsort((-strength[able], np.round(near, 9)))[0]))
    if not begun:
        return [np.zeros(0, np.int64) for _ in range(n)]
    of = np.argmax(like[begun], 0)
    of[begun] = np.arange(len(begun))
    return [able[of == k] for k in range(n)]


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression with a ridge penalty; the last one is the intercept."""
    full = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-6
    weights = np.zeros(full.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        slope = full.T @ (p - y) + penalty * weights
        curve = (full * (p * (1 - p) + 1e-6)[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def predict(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


@dataclass
class Chain:
    """The buckets looked at (ascending), the weights of each category's model, and the clusters of buckets (their places)."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: list[np.ndarray] = field(default_factory=list)
    clusters: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories) for rows of bits."""
        x = _with_clusters(x, self.clusters)
        for w in self.weights:
            x = np.column_stack([x, predict(x, w)])
        return x[:, len(self.buckets) + len(self.clusters) :]


def _with_clusters(x: np.ndarray, clusters: list[np.ndarray]) -> np.ndarray:
    """x and a bit a cluster: whether the row has any of its buckets."""
    return np.column_stack([x, *(x[:, c].any(axis=1) for c in clusters)])


def fit_chain(x: np.ndarray, labels: np.ndarray, buckets: np.ndarray, fold: np.ndarray, clusters: list[np.ndarray] | None = None) -> Chain:
    """labels: (rows, categories) in the order of the chain; fold: each row's fold."""
    chain = Chain(buckets, clusters=clusters or [])
    x = _with_clusters(x, chain.clusters)
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        chain.weights.append(fit_linear(x, y))
        out = np.zeros(len(y))
        for f in np.unique(fold):
            rest = fold != f
            out[~rest] = predict(x[~rest], fit_linear(x[rest], y[rest])) if rest.any() else y.mean()
        x = np.column_stack([x, out])
    return chain


def _bits(doc: np.ndarray, bucket: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(known)), np.float32)
    if len(known):
        at = np.minimum(np.searchsorted(known, bucket), len(known) - 1)
        hit = known[at] == bucket
        out[doc[hit], at[hit]] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, width: int = WIDTH) -> Chain:
    """Fits the chain on labelled documents outside the held-out third.

    Buckets are counted over all of them; the models see max_rows at most,
    chosen by a hash of the id. Null ids and labels are left out, and of rows
    that share an id the least counts. Without labels every probability is one
    half. A category without a bucket of its own has the labels of the last.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (bucket_of(F.col("doc_id")) != 1))
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"))
    # one plan at every size: the labels may be too many to broadcast
    found = docs.select("doc_id", "text").join(usable.hint("merge"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    seen = found.mapInArrow(_labelled, "doc_id long, y int, buckets array<int>")
    rows = written(seen.groupBy("doc_id", "y").agg(F.min("buckets").alias("buckets")), "toxicity-labelled")
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    if not totals["n"]:
        return Chain(weights=[np.zeros(k + 1) for k in range(len(CATEGORIES))])
    rate = (totals["p"] + 0.5) / (totals["n"] + 1)
    counts = rows.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("c"), F.sum("y").alias("c1"))
    deviation = (F.col("c1") - F.col("c") * rate) / F.sqrt(F.col("c") * (rate * (1 - rate)))
    chosen = counts.where(F.col("c") >= MIN_DOCS).withColumn("z", deviation).where(F.abs("z") >= MIN_DEVIATION).orderBy(F.desc(F.abs("z")), "bucket").limit(width)
    picked = sorted((r["bucket"], r["z"]) for r in chosen.select("bucket", "z").collect())  # width rows at most
    known = np.array([b for b, _ in picked], np.int32)
    kept = F.array_intersect("buckets", F.array(*[F.lit(int(b)) for b in known]).cast("array<int>"))
    sample = rows.select("doc_id", "y", kept.alias("own")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    local = sorted(sample.collect(), key=lambda r: r["doc_id"])  # max_rows short rows at most
    sizes = [len(r["own"]) for r in local]
    x = _bits(np.repeat(np.arange(len(local)), sizes), np.array([b for r in local for b in r["own"]], np.int32), len(local), known)
    y = np.array([r["y"] for r in local], float)
    clusters = clustered(x, y, np.array([z for _, z in picked]), len(CATEGORIES) - 1)
    member = [y * x[:, c].any(axis=1) if len(c) else y for c in clusters]
    return fit_chain(x, np.column_stack([*member, y]), known, np.arange(len(local)) % FOLDS, clusters)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """Probabilities of every row of docs (doc_id, text).

    Returns a row per input row: doc_id; held_out (never trained on); first_group,
    second_group, toxic_score in 0 to 1; toxic (toxic_score is 0.5 or more).

    A null or empty text has no words and gets the probabilities of such a
    text. Repeated rows are scored each, a null doc_id stays null. An empty
    table gives an empty result. Other columns are ignored. No row is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, plain in blocks(batches):
            doc, bucket = _buckets(folded(plain))
            p = chain.probabilities(_bits(doc, bucket, plain.n, chain.buckets))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, k].astype(float)) for k in range(p.shape[1]))], ["doc_id", *CATEGORIES[:-1], "toxic_score"])

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first_group double, second_group double, toxic_score double")
    return out.select("doc_id", (bucket_of(F.col("doc_id")) == 1).alias("held_out"), "first_group", "second_group", "toxic_score", (F.col("toxic_score") >= 0.5).alias("toxic"))
