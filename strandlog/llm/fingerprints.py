"""Document fingerprints by one-permutation MinHash.

Each shingle is hashed once. The high bits choose one of ``BINS`` bins, and a
bin keeps its least value. Empty bins are filled by optimal densification: bin
i looks at bins h(i, 1), h(i, 2), ... with a fixed hash until one is not empty,
and takes its value. Only the ``BITS`` low-order bits of every bin are stored,
packed; chance agreement of these is taken out of the likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .store import written
from .words import Text, blocks, mix64, shingles, stream

WORDS, BINS, BITS = 5, 512, 4
_EMPTY = np.uint64(2**64 - 1)
_BIN_BITS = BINS.bit_length() - 1
#: Text that one ordered run of documents holds, about; and the number of runs from which they grow instead.
RUN_BYTES, MAX_RUNS = 8 << 20, 65_536


def _values(text: Text) -> np.ndarray:
    """(documents, BINS) least values; a row of a text without words is empty."""
    hashes, offs = shingles(text.hashes(), text.first, WORDS)
    doc = np.repeat(np.arange(text.n), np.diff(offs))
    out = np.full(text.n * BINS, _EMPTY, np.uint64)
    at = doc * BINS + (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    np.minimum.at(out, at, hashes & np.uint64((1 << (64 - _BIN_BITS)) - 1))
    out = out.reshape(text.n, BINS)
    full = out != _EMPTY
    some = full.sum(1)
    one = np.flatnonzero(some == 1)
    out[one] = out[one].min(1, keepdims=True)  # every search ends at the only bin
    doc, empty = np.nonzero(~full & (some > 1)[:, None])
    step = np.arange(1, dtype=np.uint64)
    while len(doc):
        step = step + np.uint64(1)
        target = (mix64(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + step * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        hit = full[doc, target]
        out[doc[hit], empty[hit]] = out[doc[hit], target[hit]]
        doc, empty = doc[~hit], empty[~hit]
    return out


def codes(text: Text) -> np.ndarray:
    """(documents, BINS) low-order bits, as small integers.

    Values are hashed with their bin first, else bins that were filled with the
    same value would agree by chance all together.
    """
    return (mix64(_values(text) ^ stream(401, BINS)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(code: np.ndarray) -> list[str]:
    """Hexadecimal strings of the packed bits."""
    return [row.tobytes().hex() for row in (code[:, 0::2] << BITS) | code[:, 1::2]]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, chance agreement of the bits taken out.

    Two texts without words are alike (1), such a text and another are not (0).
    """
    chance = 1 / (1 << BITS)
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, (~some_a & ~some_b).astype(float))


def _texts(texts: list[bytes]) -> Text:
    docs = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return Text(np.frombuffer(b"".join(texts), np.uint8), docs)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, halo, doc_id, text) come in order; each one but a halo is compared with the next."""
    held: tuple | None = None  # the row before: (run, halo, doc_id, text, code, has words)
    for part, text in blocks(batches, limit=1 << 20):
        own = codes(text)
        some = text.counts() > 0
        texts = part.column(3).fill_null("").to_pylist()
        rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts, own, some.tolist(), strict=True))
        rows = [held, *rows] if held else rows
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1]]
        for at in range(0, len(pairs), 512):
            yield _compared(pairs[at : at + 512])


def _compared(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
    edited = []
    for a, b in pairs:
        half = len(a[3]) // 2
        edited.append((a[3][: len(a[3]) - half] + b[3][:half]).encode())
    changed = _texts(edited)
    codes_edited, some_edited = codes(changed), changed.counts() > 0
    own, following = np.array([a[4] for a, _ in pairs]), np.array([b[4] for _, b in pairs])
    some, some_next = np.array([a[5] for a, _ in pairs]), np.array([b[5] for _, b in pairs])
    prints = [x if s else "" for x, s in zip(packed(own), some.tolist(), strict=True)]
    prints_edited = [x if s else "" for x, s in zip(packed(codes_edited), some_edited.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
            pa.array(prints), pa.array(prints_edited), pa.array(likeness(own, codes_edited, some, some_edited)), pa.array(likeness(own, following, some, some_next)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs (doc_id, text); empty for a text without words.

    A null text is an empty one, a null doc_id stays null, repeated rows come
    each. An empty table gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in blocks(batches):
            found = [x if n else "" for x, n in zip(packed(codes(text)), text.counts().tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _runs(slim: DataFrame, n: int, rows: int):
    """A column function (doc_id, hash) -> run, whose runs stand in the order of doc_id (null first) and hash.

    Cuts are quantiles of doc_id. An id of more than two runs' rows is dealt
    over runs of its own by ranges of the hash; at most n / 2 ids are.
    """
    cuts = slim.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 8 * n).alias("c")).first()["c"] or []
    splits = np.unique(np.array(cuts, np.int64))
    limit = 2 * max(1, rows // n)
    hot = {r["doc_id"]: -(-r["n"] * 2 // limit) for r in slim.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()}
    nulls = hot.pop(None, 1)
    hot_ids = np.array(sorted(hot), np.int64)
    parts = np.array([hot[k] for k in hot_ids.tolist()], np.int64)

    def part_of(h: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        high = (h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of the hash
        return (high.astype(np.int64) * n) >> 32

    @arrow_udf("long")
    def run_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        lacks, h = ids.is_null().to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        i = ids.fill_null(0).to_numpy(zero_copy_only=False)
        # three places a cut: ids below a hot one, its parts, and ids behind it
        run = (np.searchsorted(splits, i).astype(np.int64) + 1) * 2 * (len(hot_ids) + 1) << 24
        if len(hot_ids):
            at = np.searchsorted(hot_ids, i)
            own = hot_ids[np.minimum(at, len(hot_ids) - 1)] == i
            run += (2 * at + own) << 24
            run[own] += part_of(h[own], parts[at[own]])
        return pa.array(np.where(lacks, part_of(h, nulls), run))

    return run_of


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs (doc_id, text) and of its edited text, compared with it and with the next.

    The next document is that with the next doc_id, after the last the first.
    The edited text has the last floor(n / 2) code points replaced by the first
    as many (or all) of the next one's. Documents are range-dealt into runs by
    doc_id; each run also gets the first document of the one after it, so the
    text is shuffled once and no task sees more than its run.

    Returns a row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text is an empty one; a
    null doc_id comes before all others; equal ids stand in the order of a hash
    of their texts. One document is its own next one. Texts without words have
    an empty fingerprint and are alike. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    slim = written(docs.select("doc_id", "hash", F.octet_length("text").alias("bytes")), "sizes")
    total = slim.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    n = min(MAX_RUNS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["b"] // RUN_BYTES)))
    run_of = _runs(slim, n, total["n"])

    # null comes first
    least = F.min(F.struct(F.when(F.col("doc_id").isNull(), 0).otherwise(1).alias("k"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("hash").alias("h")))
    firsts = slim.select(run_of("doc_id", "hash").alias("run"), "doc_id", "hash").groupBy("run").agg(least.alias("first")).orderBy("run").collect()  # a row a run
    follows = [(r["first"]["i"] if r["first"]["k"] else None, r["first"]["h"], firsts[k - 1]["run"]) for k, r in enumerate(firsts)]
    keys = F.broadcast(spark.createDataFrame(follows, "first_id long, first_hash long, run long"))
    halo = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")))
    halo = halo.groupBy("run", "doc_id").agg(F.min("text").alias("text"), F.min("hash").alias("hash")).select("run", F.lit(True).alias("halo"), "doc_id", "hash", "text")
    rows = docs.select(run_of("doc_id", "hash").alias("run"), F.lit(False).alias("halo"), "doc_id", "hash", "text").union(halo)
    ordered = rows.repartition(n, "run").sortWithinPartitions("run", "halo", "doc_id", "hash", "text").select("run", "halo", "doc_id", "text")
    return ordered.mapInArrow(_fingerprinted, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
