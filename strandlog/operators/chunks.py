"""Chunk rolling: a running sum that starts again, without a task that walks a whole domain.

Entries are range-sorted into blocks. A chunk that is open where a block begins
ends within the limit of it, so only the entries up to there can be the first
to begin a chunk in that block. From each of those a task follows the chunks to
the block's last one, and the position that the next chunk begins behind. These
exits, some a block, are linked to the entries of later blocks by a lookup;
those on the chain from the first entry of each domain, found by pointer
doubling, are where the chunks of each block really begin. A second pass over
the same blocks numbers the chunks from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..schemas import CHUNK_BYTES
from ..sources.shared import written
from . import ordering


def _following(exits: DataFrame) -> DataFrame:
    """(domain, ord, to) of exits (domain, ord, at, out): the ord of the first of them whose at is beyond out, null if none is."""
    marks = exits.select("domain", "at", F.lit(1).alias("kind"), "ord")
    asks = exits.select("domain", F.col("out").alias("at"), F.lit(0).alias("kind"), "ord")
    # looking forward is looking back in the falling order
    both = marks.union(asks).select("domain", (-F.col("at")).alias("fall"), "kind", (-F.col("ord")).alias("back"))
    found = ordering.latest(both, ["domain", "fall", "kind", "back"], F.when(F.col("kind") == 1, F.struct("domain", (-F.col("back")).alias("ord"), F.col("fall").alias("fall"))), "following")
    hit = (F.col("_latest.domain").eqNullSafe(F.col("domain"))) & (F.col("_latest.fall") < F.col("fall"))
    return found.where("kind = 0").select("domain", (-F.col("back")).alias("ord"), F.when(hit, F.col("_latest.ord")).alias("to"))


def _leaving(limit: int) -> Callable:
    """Of one block of a domain: ord and at (the position) of each entry that can begin its first chunk, then n, the chunks from there on, and out, the position that no chunk begins up to."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("ord").to_numpy(zero_copy_only=False), b.column("pos").to_numpy(zero_copy_only=False)) for b in batches]
        ords, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        _check_order(pos, pos[0])
        n = len(pos)
        entering = min(int(np.searchsorted(pos, pos[0] + limit, "right")) + 1, n)
        at, count = np.arange(entering), np.ones(entering, np.int64)
        while True:  # a step a chunk, for all of them together
            to = np.searchsorted(pos, pos[at] + limit, "right")
            if not (on := to < n).any():
                break
            at, count = np.where(on, to, at), count + on
        columns = [pa.repeat(key[0], entering), pa.repeat(key[1], entering), pa.array(ords[:entering]), pa.array(pos[:entering]), pa.array(pos[at] + limit), pa.array(count)]
        yield pa.RecordBatch.from_arrays(columns, ["_block", "domain", "ord", "at", "out", "n"])

    return run


def _numbering(limit: int) -> Callable:
    """Adds chunk to one block of a domain, whose first chunk begins at ord _first_begin (null: none begins here), after _chunks_before others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = bound = seen = None
        for batch in batches:
            pos, n = batch.column("pos").to_numpy(zero_copy_only=False), batch.num_rows
            if not n:
                continue
            _check_order(pos, pos[0] if seen is None else seen)
            seen, begins = pos[-1], np.zeros(n, np.int64)
            if number is None:
                number = batch.column("_chunks_before")[0].as_py() - 1
            if bound is None:
                enter = batch.column("_first_begin")[0].as_py()
                hits = np.flatnonzero(batch.column("ord").to_numpy(zero_copy_only=False) == enter) if enter is not None else ()
                if len(hits):
                    begins[hits[0]], bound = 1, pos[hits[0]] + limit
            while bound is not None and (k := int(np.searchsorted(pos, bound, "right"))) < n:
                begins[k], bound = 1, pos[k] + limit
            chunk = number + np.cumsum(begins)
            number = int(chunk[-1])
            yield batch.drop_columns(["_block", "_first_begin", "_chunks_before"]).append_column("chunk", pa.array(chunk, pa.int32()))

    return run


def _check_order(pos: np.ndarray, least: int) -> None:
    if pos[0] < least or (pos[1:] < pos[:-1]).any():
        raise RuntimeError("the rows of a block are not in order")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``ordering.in_order`` sorted inside their blocks; grouping them by block and domain keeps that order."""
    return rows.sortWithinPartitions("_block", "domain", "ord")


def rolled(entries: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """Adds chunk to entries (domain, ord, pos, size): from 0, a new one after the entry that took a chunk beyond the limit.

    ord is a number that is unique in a domain. An empty table gives an empty result.
    """
    entries = entries.withColumns({"ord": F.col("ord").cast("long"), "pos": F.col("pos").cast("long")})
    rows = ordering.in_order(entries, ["domain", "ord"], "entries")
    fields = StructType([rows.schema["_block"], rows.schema["domain"], rows.schema["ord"]]).add("at", LongType()).add("out", LongType()).add("n", LongType())
    exits = written(_in_blocks(rows.select("_block", "domain", "ord", "pos")).groupBy("_block", "domain").applyInArrow(_leaving(limit), fields), "exits")
    links = written(_following(exits).where("to is not null"), "chain")
    begins = written(exits.groupBy("domain").agg(F.min("ord").alias("ord")), "begins")
    while True:  # after k rounds links jump 2^k blocks and begins holds the first 2^k entries of the chain
        more = begins.join(links, ["domain", "ord"]).select("domain", F.col("to").alias("ord"))
        grown = written(begins.union(more).distinct(), "begins")
        if grown.count() == begins.count():
            break
        begins = grown
        ahead = links.select("domain", F.col("ord").alias("to"), F.col("to").alias("far"))
        links = written(links.join(ahead, ["domain", "to"]).select("domain", "ord", F.col("far").alias("to")), "chain")
    told = exits.join(begins.withColumn("_there", F.lit(True)), ["domain", "ord"], "left").groupBy("_block", "domain")
    starts = told.agg(F.min(F.when(F.col("_there"), F.col("ord"))).alias("_first_begin"), F.coalesce(F.sum(F.when(F.col("_there"), F.col("n"))), F.lit(0)).alias("_n"))
    before = Window.partitionBy("domain").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = written(starts.select("_block", "domain", "_first_begin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_chunks_before")), "starts")
    placed = rows.alias("r").join(starts.alias("s"), (F.col("r._block") == F.col("s._block")) & F.col("r.domain").eqNullSafe(F.col("s.domain"))).select("r.*", "_first_begin", "_chunks_before")
    return _in_blocks(placed).groupBy("_block", "domain").applyInArrow(_numbering(limit), StructType(list(entries.schema.fields)).add("chunk", IntegerType()))


#: Per domain: the open chunk, its bytes, the bytes written so far and the last entry id.
OPEN = "domain string, chunk int, size long, pos long, last long"


def rolled_on(batch: DataFrame, state: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """domain, ord, entry_id, size, pos, chunk, carried of a batch of entries (domain, ord, entry_id, size) that follows others.

    state (OPEN) is what the batches before left; its open chunks are carried
    rows, as one entry a domain. An entry with the id of the one before it is a
    repeated delivery and is dropped.
    """
    rows = written(batch.select("domain", F.col("ord").cast("long").alias("ord"), F.col("entry_id").cast("long").alias("entry_id"), F.col("size").cast("long").alias("size")), "arrived")
    firsts = rows.groupBy("domain").agg((F.min("ord") - 1).alias("ord"))
    held = state.join(firsts, "domain").select("domain", "ord", F.col("last").alias("entry_id"), "size", F.lit(True).alias("carried"))
    seen = ordering.previous(rows.withColumn("carried", F.lit(False)).unionByName(held), ["domain"], ["ord"], ["entry_id"])
    fresh = seen.where(F.col("_previous").isNull() | (F.col("_previous.entry_id") != F.col("entry_id"))).drop("_previous")
    summed = ordering.running_sum(fresh, ["domain"], ["ord"], F.col("size"), "_sum")
    bases = state.select("domain", (F.col("pos") - F.col("size")).alias("_base"), F.col("chunk").alias("_chunk"))
    placed = summed.join(bases, "domain", "left").withColumn("pos", F.col("_sum") + F.coalesce("_base", F.lit(0)))
    found = rolled(placed, limit)
    chunk = (F.col("chunk") + F.coalesce("_chunk", F.lit(0))).cast("int").alias("chunk")
    return found.select("domain", "ord", "entry_id", "size", "pos", chunk, "carried")


def open_chunks(rolled_: DataFrame) -> DataFrame:
    """The state (OPEN) that rolled entries leave: a row a domain."""
    ends = rolled_.groupBy("domain", "chunk").agg(F.sum("size").alias("size"), F.max(F.col("pos") + F.col("size")).alias("pos"), F.max_by("entry_id", "ord").alias("last"))
    return ends.groupBy("domain").agg(F.max(F.struct("chunk", "size", "pos", "last")).alias("s")).select("domain", "s.*")


def chunk_sizes(chunked: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """domain, chunk, n_entries, size, full of each chunk."""
    sizes = chunked.groupBy("domain", "chunk").agg(F.count("*").alias("n_entries"), F.sum("size").alias("size"))
    return sizes.withColumn("full", F.col("size") > limit)
