"""Entry views: canonical entries of any table, positions, and the two scans with their dedupe rules."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fits_inline, is_external, is_index, key_hash, leaf, stored_size, sync_id_hex
from . import ordering


def entries(df: DataFrame, domain: Column, key: Column, value: Column, order: Column, time: Column) -> DataFrame:
    """Canonical entries: domain, ord, time, entry_id, flags, key, value, size.

    The entry id is the first 32 bits of the md5 of the order key, so reruns
    agree. Rows whose key is too long are not entries. Null keys and values are
    empty.
    """
    key, value = F.coalesce(key.cast("string"), F.lit("")), F.coalesce(value.cast("string"), F.lit(""))
    rows = df.where(fits_inline(key))
    external = F.when(fits_inline(value), 0).otherwise(1)
    return rows.select(
        domain.alias("domain"), order.alias("ord"), time.alias("time"), key_hash(order.cast("string")).alias("entry_id"), external.alias("flags"),
        key.alias("key"), value.alias("value"), stored_size(key, value).alias("size"),
    )


def positioned(rows: DataFrame) -> DataFrame:
    """Adds pos, the byte where the entry begins in its domain's log, and n_before, the entries before it that are no index entries."""
    counted = F.when(is_index(F.col("flags")), 0).otherwise(1).cast("long")
    return ordering.running_sums(rows, ["domain"], ["ord"], {"pos": F.col("size"), "n_before": counted})


def ordinals(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """Adds the number of entries before each in its domain."""
    return ordering.running_sum(rows, ["domain"], ["ord"], F.lit(1).cast("long"), name)


def scanned(rows: DataFrame) -> DataFrame:
    """What a scan returns: no entry with the id of the entry just before it, then no index entries.

    Index entries count as the entry before; equal ids further apart stay.
    """
    seen = ordering.previous(rows, ["domain"], ["ord"], ["entry_id"])
    fresh = F.col("_previous").isNull() | (F.col("_previous.entry_id") != F.col("entry_id"))
    return seen.where(fresh).where(~is_index(F.col("flags"))).drop("_previous")


def bulk_pairs(rows: DataFrame) -> DataFrame:
    """What the bulk reader returns: index and external entries go first, then adjacent equal ids."""
    plain = rows.where(~is_index(F.col("flags")) & ~is_external(F.col("flags")))
    seen = ordering.previous(plain, ["domain"], ["ord"], ["entry_id"])
    return seen.where(F.col("_previous").isNull() | (F.col("_previous.entry_id") != F.col("entry_id"))).drop("_previous")


def distinct_ids(rows: DataFrame) -> DataFrame:
    """One entry, the first, of each (time, entry_id) of a domain."""
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in ("domain", "time", "entry_id")]), "ord")
    return rows.groupBy("domain", "time", "entry_id").agg(first.alias("_e")).select("domain", "time", "entry_id", "_e.*")


def id_dump(rows: DataFrame) -> DataFrame:
    """domain, ordinal, written (time as text), sync_id and entry as hex, leaf of every entry."""
    written = F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, time)"), "yyyy/MM/dd HH:mm:ss")
    return ordinals(rows).select("domain", "ordinal", written.alias("written"), sync_id_hex(F.col("time"), F.col("entry_id")).alias("sync_id"), F.hex("entry_id").alias("entry"), leaf(F.col("entry_id")).alias("leaf"))


def as_log(rows: DataFrame) -> DataFrame:
    """Columns that the entrylog sink takes."""
    return rows.select("time", "entry_id", F.col("flags").bitwiseAND(F.lit(2)).cast("int").alias("flags"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


def first_entries(rows: DataFrame, n: int) -> DataFrame:
    """The first n entries of each domain: a scan that stops early. Ranks are cut before the shuffle too."""
    order = Window.partitionBy("domain").orderBy("ord")
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def grouped_pairs(pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds nth: a value's place among those of its key, the last one first. A row a value, so a key may have any number."""
    falling = pairs.withColumn("_fall", -F.col(order))
    return ordering.running_sum(falling, keys, ["_fall"], F.lit(1).cast("long"), "nth").drop("_fall")


class Stop(Exception):
    """Raised by a fold's step: the scan ends with the state given."""

    def __init__(self, state: Any):
        super().__init__()
        self.state = state


def folded(rows: DataFrame, zero: Any, step: Callable[[Any, dict], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """The fold of rows (domain, ord, ...) in the order of domain and ord by a function of the caller.

    step(state, entry) gives the next state; merge(left, right) joins the states
    of two stretches that follow one another, each folded from zero. Stretches
    are range-sorted blocks, folded in tasks; only their states, one a block,
    come to the driver. A step may raise Stop(state): what follows is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, stopped, block = zero, False, None
        for batch in batches:
            for entry in batch.to_pylist():
                block = entry.pop("_block")
                if not stopped:
                    try:
                        state = step(state, entry)
                    except Stop as stop:
                        state, stopped = stop.state, True
        if block is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "stopped": [stopped], "state": [pickle.dumps(state)]})

    by = [F.col("domain").asc_nulls_first(), F.col("ord").asc_nulls_first()]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_block", F.spark_partition_id())
    state = zero
    for row in dealt.mapInArrow(run, "block int, stopped boolean, state binary").orderBy("block").collect():  # a row a block
        state = merge(state, pickle.loads(bytes(row["state"])))
        if row["stopped"]:
            break
    return state
