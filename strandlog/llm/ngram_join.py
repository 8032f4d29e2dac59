"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Each text gets MinHash values of its word shingles. Equal texts are one
   class from here on, so a group of copies of any size is one row.
2. Classes whose values agree in a band share a bucket. Buckets with the same
   members are kept once.
3. Within a bucket, MinHash values of a pair are compared a few at a time. With
   m agreements out of n the similarity has a Beta(m + 1, n - m + 1) posterior;
   the pair is dropped once P(similarity >= threshold) is below the tolerance.
   A pair that meets in several buckets counts in the first only.
4. The pairs that are left are verified on their whole shingle sets, exactly.

A bucket of any size is cut into blocks of a bounded number of members and of
shingle bytes, and a task sees two blocks at a time. Pairs stay inside tasks:
the pruning tells only which members have a pair left, verification finds the
pairs again beside the shingle sets, and returns each class's number of links
and a spanning forest, so the rows grow with the members of blocks, not with
their pairs. A class's exact number of links needs all of a bucket's pairs of
blocks: for members whose texts differ, work and rows sent grow with the square
of a bucket over BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import bounded_batches, written
from .words import blocks, shingles, stream

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-4
BANDS, ROWS = 24, 4
HASHES, STEP = BANDS * ROWS, 16
#: Members of a bucket's block and bytes of their shingle sets, about; a task compares two blocks.
BLOCK, BLOCK_BYTES = 256, 8 << 20
_LEAST_ID = -(2**63)


def needed_matches(threshold: float, tolerance: float, hashes: int, step: int) -> dict[int, int]:
    """{n compared: least m agreeing} for which P(J >= threshold | m of n) reaches the tolerance."""
    found = {}
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(Bin(n + 1, t) <= m) is the posterior's upper tail
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


def band_hashes(values: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of (n, HASHES) MinHash values."""
    out, salt = np.zeros((len(values), BANDS), np.uint64), stream(301, ROWS) | np.uint64(1)
    for j in range(ROWS):
        out = (out + values[:, j::ROWS].astype(np.uint64)) * salt[j]
        out ^= out >> np.uint64(29)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = stream(201, HASHES) | np.uint64(1), stream(202, HASHES)
    for part, text in blocks(batches):
        hashes, offs = shingles(text.hashes(), text.first, WORDS)
        some = np.flatnonzero(np.diff(offs))
        values = np.empty((len(some), HASHES), np.uint32)
        for k in range(HASHES if len(some) else 0):
            values[:, k] = np.minimum.reduceat(hashes * a[k] + b[k], offs[some]) >> np.uint64(32)
        own: list[bytes | None] = [None] * text.n
        for row, d in enumerate(some.tolist()):
            own[d] = values[row].tobytes()
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary()), pa.array(np.diff(offs), pa.int64())], ["doc_id", "text_key", "signature", "n_shingles"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(values)), BANDS)))
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(values))
            sizes = batch.column(2).take(pa.array(np.repeat(np.arange(len(values)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(band_hashes(values).view(np.int64).ravel()), keys, sizes], ["band", "bucket", "text_key", "n_shingles"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups, many to a table, of batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = _changes([batch.column(k).to_numpy() for k in range(keys)])
        if held:
            last = [held[-1].column(k)[-1].as_py() for k in range(keys)]
            if last != [batch.column(k)[0].as_py() for k in range(keys)]:
                change = np.concatenate([[0], change])
        if len(change):
            table = pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))])
            if table.num_rows:
                yield table
            held = []
        held.append(batch.slice(int(change[-1]) if len(change) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Positions from 1 where the key differs from the row before."""
    differ = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        differ |= c[1:] != c[:-1]
    return np.flatnonzero(differ) + 1


def _compared(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group: within a block, or across two."""
    if lo == hi:
        return np.triu_indices(len(block), 1)
    i, j = np.meshgrid(np.flatnonzero(block == lo), np.flatnonzero(block == hi), indexing="ij")
    return i.ravel(), j.ravel()


def _left(band: int, block: np.ndarray, lo: int, hi: int, values: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group that meet here first and that the posterior does not drop."""
    left, right = _compared(block, lo, hi)
    if band:
        hashed = band_hashes(values)
        new = ~(hashed[left, :band] == hashed[right, :band]).any(1)
        left, right = left[new], right[new]
    agree = np.zeros(len(left), np.int32)
    for n, m in least.items():
        agree += (values[left, n - STEP : n] == values[right, n - STEP : n]).sum(1, dtype=np.int32)
        keep = agree >= m
        left, right, agree = left[keep], right[keep], agree[keep]
    return left, right


_GROUP = ["band", "bucket", "lo", "hi", "text_key", "block", "signature"]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(table, first row, rows with a text_key once, their blocks, their signatures) of each group of rows of _GROUP."""
    for table in _groups(batches, 4):
        columns = [table.column(k).to_numpy() for k in range(4)]
        keys, blocks_, signatures = table.column(4).to_pylist(), table.column(5).to_numpy(), table.column(6).to_pylist()
        edges = [0, *_changes(columns).tolist(), len(keys)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            once = {}
            for k in range(s, e):
                once.setdefault(keys[k], k)  # repeated rows fall together
            rows = np.fromiter(once.values(), np.int64, len(once))
            yield table, s, rows, blocks_[rows], np.frombuffer(b"".join(signatures[k] for k in rows.tolist()), np.uint32).reshape(-1, HASHES)


def _pruned(least: dict[int, int]):
    """The rows of _GROUP that have a pair left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, s, rows, block, values in _each(batches):
            left, right = _left(table.column(0)[s].as_py(), block, table.column(2)[s].as_py(), table.column(3)[s].as_py(), values, least)
            if len(left):
                yield from table.take(pa.array(rows[np.union1d(left, right)])).combine_chunks().to_batches()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, text in blocks(batches):
        hashes, offs = shingles(text.hashes(), text.first, WORDS)
        sets = [np.unique(hashes[offs[d] : offs[d + 1]]).tobytes() for d in range(text.n)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["text_key", "shingles"])


def _verified(least: dict[int, int], threshold: float):
    """(text_key, links, root of its tree) of the members of each group (_GROUP and shingles) that have links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, s, rows, block, values in _each(batches):
            left, right = _left(table.column(0)[s].as_py(), block, table.column(2)[s].as_py(), table.column(3)[s].as_py(), values, least)
            if not len(left):
                continue
            sets = [np.frombuffer(table.column(7)[k].as_buffer(), np.uint64) for k in rows.tolist()]
            links, root = _links(left, right, sets, threshold)
            some = np.flatnonzero(links)
            keys = table.column(4).combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[some])), pa.array(links[some]), keys.take(pa.array(rows[root[some]]))], ["text_key", "links", "root"])

    return run


def _links(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links, and the root of its tree, of each set; left and right are pairs of sets to compare."""
    ids = np.unique(np.concatenate([sets[k] for k in np.union1d(left, right).tolist()]))
    mark, links, root = np.zeros(len(ids), bool), np.zeros(len(sets), np.int64), list(range(len(sets)))
    places: dict[int, np.ndarray] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def own(x: int) -> np.ndarray:
        if x not in places:
            places[x] = np.searchsorted(ids, sets[x]).astype(np.int32)
        return places[x]

    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    edges = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]]))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        i = int(left[s])
        mark[own(i)] = True
        for j in right[s:e].tolist():
            n, m = len(sets[i]), len(sets[j])
            if min(n, m) < threshold * max(n, m) - 1e-9:
                continue
            common = int(np.count_nonzero(mark[own(j)]))
            if common >= threshold * (n + m - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        mark[own(i)] = False
    return links, np.array([find(x) for x in range(len(sets))])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """All links of similarity >= threshold between different texts of docs (doc_id, text).

    Returns a row per input row: doc_id; class_id, the least doc_id among all
    texts that a chain of links joins; text_id, the least doc_id with exactly
    this text; n_links, the number of different texts that this one links to.

    A null text is an empty one. Texts without words have no shingles and no
    links (equal ones share a text_id). A text of 1 to 4 words is one shingle.
    Null doc_ids are never the least unless a class has no others; then its ids
    are null. Repeated rows are copies. An empty table gives an empty result.
    Other columns are ignored.
    """
    return _classes(docs, threshold, tolerance).select("doc_id", "class_id", "text_id", "n_links")


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _classes(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """near_duplicates with text_key, and head_key: that of the text of class_id (the least such one)."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), text.alias("text"))
    signed = written(keyed.mapInArrow(_signatures, "doc_id long, text_key binary, signature binary, n_shingles long"), "signatures")
    classes = signed.groupBy("text_key").agg(F.min("doc_id").alias("text_id"))
    unique = signed.groupBy("text_key").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")).where("signature is not null")

    banded = unique.select("text_key", "signature", "n_shingles").mapInArrow(_bands, "band int, bucket long, text_key binary, n_shingles long")
    banded = written(banded, "bands")
    member = F.xxhash64("text_key")
    sizes = banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.bit_xor(member).alias("x"), F.sum(member.cast("decimal(20,0)")).alias("s"), F.sum("n_shingles").alias("bytes")).where("n > 1")
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("bytes") / BLOCK_BYTES)).cast("int")
    kept = sizes.groupBy("n", "x", "s").agg(F.min(F.struct("band", "bucket", cuts.alias("blocks"))).alias("k")).select("k.*")
    block = F.pmod(F.xxhash64("text_key", F.lit(1)), F.col("blocks")).cast("int")
    grouped = banded.join(kept, ["band", "bucket"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = grouped.select("band", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "text_key", "block")
    group = ["band", "bucket", "lo", "hi"]
    compared = grouped.join(unique.select("text_key", "signature"), "text_key").select(*_GROUP)
    least = needed_matches(threshold, tolerance, HASHES, STEP)
    fields = "band int, bucket long, lo int, hi int, text_key binary, block int, signature binary"
    pruned = compared.repartition(*group).sortWithinPartitions(*group).mapInArrow(_pruned(least), fields)
    pruned = written(pruned, "candidates")

    id_of = F.coalesce(F.col("doc_id"), F.lit(_LEAST_ID))
    wanted = pruned.select("text_key").distinct().join(classes, "text_key").select("text_key", F.coalesce("text_id", F.lit(_LEAST_ID)).alias("_id"))
    texts = keyed.withColumn("_id", id_of).join(wanted, ["text_key", "_id"], "left_semi").select("text_key", "text")
    sets = texts.mapInArrow(_sets, "text_key binary, shingles binary")
    full = pruned.join(sets, "text_key").select(*_GROUP, "shingles")
    verified = full.repartition(*group).sortWithinPartitions(*group).mapInArrow(_verified(least, threshold), "text_key binary, links long, root binary")
    verified = written(verified, "links")

    joined = components(verified.select(F.col("text_key").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("text_key").agg(F.sum("links").alias("n_links"))
    known = classes.join(links, "text_key", "left").join(joined.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    head = F.min(F.when(F.col("text_id").isNotNull(), F.struct("text_id", "text_key")))
    heads = known.groupBy("root").agg(head.alias("head"))
    known = known.join(heads, "root").select("text_key", F.col("head.text_id").alias("class_id"), F.col("head.text_key").alias("head_key"), "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("doc_id", "text_key").join(known, "text_key").select("doc_id", "class_id", "text_id", "n_links", "text_key", "head_key")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of docs, with their columns, whose doc_id and text are the first of their class.

    Repeated rows with that id and text stay once; unrelated texts that share
    an id are decided about each. Rows without an id all stay: nothing says
    which of them a decision is about.
    """
    classes = _classes(docs, threshold, tolerance)
    heads = classes.where((F.col("doc_id") == F.col("class_id")) & (F.col("text_key") == F.col("head_key"))).select(F.col("doc_id").alias("_head_id"), F.col("text_key").alias("_head_key")).distinct()
    keyed = docs.withColumn("_text_key", _text_key())
    kept = keyed.join(heads, (F.col("doc_id") == F.col("_head_id")) & (F.col("_text_key") == F.col("_head_key")), "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


#: near_duplicates without pruning: a pair that the tolerance drops would be a difference.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (
  SELECT DISTINCT id, array_to_string(ws[p:p + 4], ' ') AS g
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
e AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS root FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, t.id AS text_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN m ON m.id = t.id LEFT JOIN k ON k.a = t.id
"""
