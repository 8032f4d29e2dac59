"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of a document. Its fingerprint is the
least hash among the ``GRAM``-word runs inside it, so neighbouring windows
mostly share one, equal windows always do, and there is about one fingerprint
for five words. Documents lie in blocks of about ``BLOCK_BYTES`` of text.

* Index: each batch becomes one immutable run: its texts, bucketed by block,
  and its fingerprints (fingerprint, block, whether two documents of the block
  have it), bucketed and sorted by fingerprint. A new batch is merge-joined
  with the runs before it, bucket by bucket; ``compact`` merges the fingerprint
  runs into one, which the next batch is joined with. An index stays at its
  path and can be opened again. History's texts are kept compressed, which
  takes less room than the digests of all their windows would; of them, only
  blocks that share a fingerprint with the batch are looked at.
* Candidates: fingerprints of two or more documents, one of the batch among
  them, go back to the blocks that hold them.
* Verification: those blocks send a 96-bit digest of every word sequence under
  a candidate fingerprint; equal digests meet, and the windows of all but the
  first document are marked.

No group grows with its passage: inside a block, windows that an earlier
document of the block covers are marked at once and not sent, so a passage of a
third of all documents is sent once a block. Windows under a fingerprint of
more than ``DEAL`` blocks are grouped by their own digests, with least ids
taken before the shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from ..operators.ordering import MAX_BUCKETS
from ..sources.shared import removed
from .ngram_join import _changes, _groups
from .store import bounded_batches, new_path, written
from .words import Text, text_column, windows

WINDOW, GRAM = 13, 5
#: Text of a block, about; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Blocks of a fingerprint from which its windows are grouped by digest.
DEAL = 256
#: Fingerprint runs that ``compact`` merges.
FANOUT = 4
#: What stands before every document of the batch.
_HISTORY = -(2**63)
_DIGEST = [("one", "<u8"), ("two", "<u4")]
_MANIFEST = "version long, place int, run long, texts string, prints string, buckets int"


def selected(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each window, its fingerprint)."""
    hashes = text.hashes()
    grams, at = windows(hashes, text.first, GRAM)
    _, starts = windows(hashes, text.first, WINDOW)
    least = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    least[at] = grams
    whole, span, width = least, 1, WINDOW - GRAM + 1
    while 2 * span <= width:  # least of 1, 2, 4, ... neighbours
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(whole) - width + 1], least[width - span :])
    return hashes, starts, least[starts]


def _numbered(run: int):
    """Adds block and seq to documents: the text that lies together, and a document's place in it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total, last, count = (run << 48) | (TaskContext.get().partitionId() << 24), 0, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            block = (ends - sizes) // BLOCK_BYTES
            heads = np.flatnonzero(np.concatenate([[block[0] != last], block[1:] != block[:-1]]))
            seq = np.arange(len(block)) + count  # of the block that the batch before began
            edges = [*heads.tolist(), len(block)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                seq[a:b] = np.arange(b - a)
            total, last, count = int(ends[-1]), int(block[-1]), int(seq[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(block + base), pa.array(seq.astype(np.int32)), *batch.columns], ["block", "seq", *batch.schema.names])

    return go


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, Text, np.ndarray, np.ndarray]]:
    """(block, rows, words, doc_ids, whether each is not null) of rows (block, seq, doc_id, text, ...) that come block by block."""
    for table in _groups(batches, 1):
        block = table.column(0).to_numpy()
        for a, b in zip([0, *(edges := _changes([block]).tolist())], [*edges, len(block)], strict=True):
            part = table.slice(a, b - a)
            data, offs = text_column(part.column("text"))
            ids = part.column("doc_id").combine_chunks()
            yield int(block[a]), part, Text(data, offs), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def _runs(starts: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Windows that do not share their fingerprint with the one before."""
    new = np.ones(len(starts), bool)
    new[1:] = (fps[1:] != fps[:-1]) | (starts[1:] != starts[:-1] + 1)
    return new


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, block, many) of each fingerprint of a block; many if documents with different ids have it."""
    for block, _, text, ids, known in _blocks(batches):
        _, starts, fps = selected(text)
        new = _runs(starts, fps)
        fps, doc = fps[new], np.searchsorted(text.first, starts[new], "right") - 1
        fps, doc = fps[known[doc]], ids[doc[known[doc]]]
        if not len(fps):
            continue
        order = np.argsort(fps)
        fps, doc = fps[order], doc[order]
        heads = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]]))
        many = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
        yield pa.RecordBatch.from_arrays([pa.array(fps[heads].view(np.int64)), pa.array(np.full(len(heads), block)), pa.array(many)], ["fp", "block", "many"])


def _later(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Digests (in two parts) that a smaller id has too."""
    order = np.argsort(one)
    first = one[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    if (~new[1:] & (two[order][1:] != two[order][:-1])).any():  # two digests share their first part
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    heads = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.append(heads, len(order))))
    later = np.zeros(len(order), bool)
    later[order] = ids[order] > least
    return later


_SENT = "fp long, hot boolean, id long, block long, seq int, start int, length int, digests binary"


def _sent(history: bool):
    """Digests of a block's windows under its candidate fingerprints, which stand in the row with seq 0.

    Those that the block itself settles come as spans without digests. Windows
    of history count as one document that is before all others.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, text, ids, known in _blocks(batches):
            lists = part.column("fps").combine_chunks().drop_null()
            if len(lists) != 1:
                raise RuntimeError("the rows of a block came apart from its candidates")
            cand, hots = lists.values.field(0).to_numpy(zero_copy_only=False).view(np.uint64), lists.values.field(1).to_numpy(zero_copy_only=False)
            order = np.argsort(cand)
            cand, hots = cand[order], hots[order]
            hashes, starts, fps = selected(text)
            doc = np.searchsorted(text.first, starts, "right") - 1
            at = np.minimum(np.searchsorted(cand, fps), len(cand) - 1)
            pick = np.flatnonzero((cand[at] == fps) & known[doc])
            if not len(pick):
                continue
            one, _ = windows(hashes, text.first, WINDOW, seed=1)
            two, _ = windows(hashes, text.first, WINDOW, seed=2)
            one, two, hot = one[pick], two[pick].astype(np.uint32), hots[at[pick]]
            own = np.arange(len(pick)) if history else ids[doc[pick]]
            settled = _later(one, two, own)
            local = starts[pick]
            rows = [] if history else [_rows(block, part, text, local[settled], doc[pick[settled]], None, None, None, None)]
            go = ~settled
            rows.append(_rows(block, part, text, local[go], doc[pick[go]], fps[pick[go]], hot[go], np.full(int(go.sum()), _HISTORY) if history else own[go], (one[go], two[go])))
            yield from (r for r in rows if r.num_rows)

    return go


def _rows(block: int, part: pa.Table, text: Text, starts: np.ndarray, doc: np.ndarray, fps, hot, ids, digests) -> pa.RecordBatch:
    """Windows as rows of _SENT: consecutive ones of a document under one fingerprint together, hot ones each alone."""
    n = len(starts)
    cut = np.ones(n, bool)
    cut[1:] = (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
    if fps is not None and n:
        cut[1:] |= (fps[1:] != fps[:-1]) | hot[1:]
    lead = np.flatnonzero(cut)
    sizes = np.diff(np.append(lead, n))
    head = doc[lead]
    seq = part.column("seq").to_numpy()[head].astype(np.int32)
    start = (starts[lead] - text.first[head]).astype(np.int32)
    if fps is None:
        empty = pa.nulls(len(lead))
        columns = [empty.cast(pa.int64()), pa.array(np.zeros(len(lead), bool)), empty.cast(pa.int64())]
        packed = empty.cast(pa.binary())
    else:
        raw = np.zeros(n, _DIGEST)
        raw["one"], raw["two"] = digests
        offsets = np.append(lead, n).astype(np.int32) * 12
        packed = pa.Array.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
        columns = [pa.array(fps[lead].view(np.int64)), pa.array(hot[lead]), pa.array(ids[lead])]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(lead), block)), pa.array(seq), pa.array(start), pa.array(sizes.astype(np.int32)), packed], [x.split()[0] for x in _SENT.split(", ")])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (block, seq, start, length) of windows whose digest a smaller id has, of rows that come by fp."""
    for table in _groups(batches, 1):
        ids, starts = table.column("id").to_numpy(), table.column("start").to_numpy()
        blocks, seqs, sizes = (table.column(c).to_numpy() for c in ("block", "seq", "length"))
        digests = np.frombuffer(b"".join(table.column("digests").to_pylist()), _DIGEST)
        row = np.repeat(np.arange(len(ids)), sizes)
        later = _later(digests["one"], digests["two"], ids[row])
        place = starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(later)
        if not len(at):
            continue
        cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
        lead = np.flatnonzero(cut)
        head = row[at[lead]]
        lengths = np.diff(np.append(lead, len(at))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(blocks[head]), pa.array(seqs[head]), pa.array(place[at[lead]].astype(np.int32)), pa.array(lengths)], ["block", "seq", "start", "length"])


def _joined(text: Text, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each document, a space after each but the last of a text that ends with it; offsets by document."""
    start, end = text.start[keep], text.end[keep]
    stop = np.minimum(end + 1, text.docs[1:][text.doc_of_word()[keep]])
    edges = np.zeros(len(text.data) + 1, np.int8)
    edges[start] += 1
    edges[stop] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8) > 0
    bounds = np.concatenate([[0], np.cumsum(text.per_doc(inside))])
    return np.where(text.word, text.data, 0x20).astype(np.uint8)[inside], bounds


def _cleaned(more: list[str]):
    """doc_id, n_words, n_removed, kept_sha256, kept and the columns ``more`` of rows (block, seq, doc_id, text, ..., spans)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_column(batch.column(batch.schema.get_field_index("text")))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offs, offs[a] + 2 * BLOCK_BYTES, "right")) - 1)
                yield one(batch.slice(a, b - a), Text(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
                a = b

    def one(part: pa.RecordBatch, text: Text) -> pa.RecordBatch:
        spans = part.column(part.schema.get_field_index("spans"))
        flat = spans.flatten()
        row = pc.list_parent_indices(spans).to_numpy()
        start, length = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cover = np.zeros(len(text.start) + 1, np.int64)
        np.add.at(cover, text.first[row] + start, 1)
        np.add.at(cover, text.first[row] + start + length + WINDOW - 1, -1)
        keep = np.cumsum(cover[:-1]) == 0
        counts, kept_words = text.counts(), np.diff(np.concatenate([[0], np.cumsum(keep)])[text.first])
        lines, bounds = _joined(text, keep)
        shas, kept = [], []
        for d, (n, left) in enumerate(zip(counts.tolist(), kept_words.tolist(), strict=True)):
            words = lines[bounds[d] : bounds[d + 1]].tobytes().rstrip(b" ")
            shas.append(hashlib.sha256(words).hexdigest())
            kept.append(words if left < n else None)
        columns = [part.column(part.schema.get_field_index("doc_id")), pa.array(counts, pa.int64()), pa.array(counts - kept_words, pa.int64()), pa.array(shas, pa.string())]
        columns += [pa.array(kept, pa.binary()).cast(pa.string()) if c == "kept" else part.column(part.schema.get_field_index(c)) for c in more]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", *more])

    return go


class FingerprintIndex:
    """Sorted immutable runs of fingerprints and the texts that they come from, at a path that all executors share.

    An index that is there is opened; else an empty one begins. Each version's
    list of runs is appended to a manifest, so an append that fails leaves the
    index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.version, self.texts, self.prints, self.runs = 0, [], [], 0
        self.names: list[str] = []
        try:
            known = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
            rows = known.join(known.agg(F.max("version").alias("version")), "version").orderBy("place").collect()  # a few rows a run
        except AnalysisException:
            rows = []
        for r in rows:
            self.version, self.buckets, self.runs = r["version"], r["buckets"], max(self.runs, r["run"])
            if r["texts"]:
                self.texts.append((r["texts"], self._opened(r["texts"], "block", spark.read.parquet(r["texts"]).schema)))
            if r["prints"]:
                self.prints.append((r["prints"], self._opened(r["prints"], "fp", spark.read.parquet(r["prints"]).schema)))

    def _opened(self, location: str, by: str, schema: StructType) -> str:
        """The bucketed table at a location, under a name of its own in this session."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{location}'")
        self.names.append(name)
        return name

    def _write(self, rows: DataFrame, by: str) -> tuple[str, str]:
        name, location = f"fingerprints_{uuid.uuid4().hex}", f"{self.path}/{by}-{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, by).sortWithinPartitions(by)
        dealt.write.option("compression", "zstd").option("path", location).bucketBy(self.buckets, by).sortBy(by).saveAsTable(name)
        self.names.append(name)
        return location, name

    def _commit(self, texts: list, prints: list, run: int) -> None:
        self.version, self.texts, self.prints, self.runs = self.version + 1, texts, prints, run
        n = max(len(texts), len(prints))
        rows = [(self.version, k, run, texts[k][0] if k < len(texts) else None, prints[k][0] if k < len(prints) else None, self.buckets) for k in range(n)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def append(self, docs: DataFrame, more: tuple[str, ...] = ("kept",)) -> DataFrame:
        """Adds a batch (doc_id long, text string, any other columns) and says what it repeats.

        Returns a row per row of the batch: doc_id, n_words, n_removed,
        kept_sha256 and the columns ``more`` (kept: the kept words joined by one
        space, null if all are; any other one as it came). A word goes if it is
        under a window that a document of an earlier batch, or one of this
        batch with a smaller doc_id, has too.
        """
        spark, run = self.spark, self.runs + 1
        schema = StructType([StructField("block", LongType()), StructField("seq", IntegerType()), *docs.schema])
        texts = self._write(docs.mapInArrow(_numbered(run), schema), "block")
        table = spark.table(texts[1])
        prints = self._write(table.select("block", "seq", "doc_id", "text").mapInArrow(_prints, "fp long, block long, many boolean"), "fp")

        shared = spark.table(prints[1]).groupBy("fp").agg(F.count("*").alias("n"), F.max("many").alias("many"))
        for k, (_, name) in enumerate(self.prints):
            older = spark.table(name).groupBy("fp").agg(F.count("*").alias(f"n{k}"))
            shared = shared.join(older.hint("merge"), "fp", "left")
        before = sum((F.coalesce(f"n{k}", F.lit(0)) for k in range(len(self.prints))), F.lit(0))
        shared = shared.where(F.col("many") | (F.col("n") > 1) | (before > 0)).select("fp", (F.col("n") + before > DEAL).alias("hot"))
        shared = written(shared, "shared")
        held = [spark.table(name).select("fp", "block").join(shared.hint("merge"), "fp") for _, name in [*self.prints, prints]]
        lists = held[0]
        for rows in held[1:]:
            lists = lists.union(rows)
        lists = written(lists.groupBy("block").agg(F.collect_list(F.struct("fp", "hot")).alias("fps")), "candidates")  # as many as a block has, at most

        sent = None
        for k, (_, name) in enumerate([*self.texts, texts]):
            history = k < len(self.texts)
            own = lists.where(F.shiftright("block", 48) == (F.lit(k + 1) if history else F.lit(run)))
            rows = spark.table(name).join(own.hint("merge"), "block")
            rows = rows.select("block", "seq", "doc_id", "text", F.when(F.col("seq") == 0, F.col("fps")).alias("fps")).mapInArrow(_sent(history), _SENT)
            sent = rows if sent is None else sent.union(rows)
        sent = written(sent, "windows")
        spans = sent.where("fp is null").select("block", "seq", "start", "length")
        plain = sent.where("not hot and fp is not null").repartition("fp").sortWithinPartitions("fp")
        spans = spans.union(plain.mapInArrow(_resolved, "block long, seq int, start int, length int"))
        hot = sent.where("hot").select("digests", "id", "block", "seq", "start", "length")
        least = hot.groupBy("digests").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digests", "least")
        spans = spans.union(hot.join(least, "digests").where("id > least").select("block", "seq", "start", "length"))

        by_row = spans.where(F.shiftright("block", 48) == run).groupBy("block", "seq").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
        by_block = written(by_row.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("seq", "spans"))).alias("hits")), "spans")
        self._commit([*self.texts, texts], [*self.prints, prints], run)
        told = table.join(by_block.hint("merge"), "block", "left").withColumn("spans", F.col("hits")[F.col("seq")]).drop("hits")
        kinds = {"kept": "string", **{f.name: f.dataType.simpleString() for f in docs.schema}}
        return told.mapInArrow(_cleaned(list(more)), ", ".join(["doc_id long, n_words long, n_removed long, kept_sha256 string", *(f"`{c}` {kinds[c]}" for c in more)]))

    def compact(self, fanout: int = FANOUT) -> None:
        """Merges the fingerprint runs into one once there are ``fanout`` of them; the next append is joined with that one."""
        if len(self.prints) < fanout:
            return
        rows = self.spark.table(self.prints[0][1])
        for _, name in self.prints[1:]:
            rows = rows.union(self.spark.table(name))
        old, merged = self.prints, self._write(rows, "fp")
        self._commit(self.texts, [merged], self.runs)
        for location, name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, location)

    def close(self) -> None:
        """Forgets the session's tables; the index stays at its path."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []

    def drop(self) -> None:
        """Deletes the index."""
        self.close()
        removed(self.spark, self.path)


def _batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """docs cut by doc_id into about equal parts, in ascending order; rows without an id are in the first."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [1.0], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))[: batches - 1]
    part = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return [docs.where(part == k) for k in range(len(cuts) + 1)]


def _indexed(docs: DataFrame, batches: int, more: tuple[str, ...]) -> DataFrame:
    """The rows that an index over batches of docs returns, written; the index goes."""
    bounded_batches(docs.sparkSession)
    index = FingerprintIndex(docs.sparkSession, new_path(docs.sparkSession, "fingerprint-index"))
    try:
        found = None
        for batch in _batches(docs, batches):
            index.compact(2)
            part = written(index.append(batch, more), "deduplicated")
            found = part if found is None else found.union(part)
        return found
    finally:
        index.drop()


def deduplicated(docs: DataFrame, batches: int = 3, more: tuple[str, ...] = ("kept",)) -> DataFrame:
    """Removes from docs (doc_id, text) each word under a window that a document with a smaller doc_id has too.

    Returns a row per input row: doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space), kept (those words; null if none was
    removed). Windows are judged on the input; documents go through an index in
    batches of ascending doc_id, whose number changes nothing in the result.

    A null text has no words. A null doc_id is not smaller than any, nor is any
    smaller than it: such rows keep all words and cover none. Rows with equal
    ids do not cover each other. Texts of fewer words than a window stay whole.
    An empty table gives an empty result. Other columns are ignored.
    """
    return _indexed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), batches, more)


def without_repeats(docs: DataFrame, batches: int = 3) -> DataFrame:
    """The rows of docs, with their columns, after the removal.

    A changed document's text is its kept words joined by one space, and a
    column n_chars follows it; documents with all words removed go. Unchanged
    documents keep their text as it is, null ones too.
    """
    # one column, so that no name of docs can clash
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(*[c for c in docs.columns if c != "text"], F.col("text").isNull().alias("_no_text")).alias("rest"))
    found = _indexed(whole, batches, ("kept", "text", "rest")).where("kept is null or kept <> ''")
    text = F.when(~F.col("rest._no_text"), F.coalesce("kept", "text"))
    new = {"text": text, "n_chars": F.when(F.col("kept").isNull(), F.col("rest.n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("kept"))}
    return found.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("rest")[c]).alias(c) for c in docs.columns])
