"""Inverted key index in blocks of a fixed number of entries: posting lists, segments, gap codes, refresh.

A posting list lies in one block, so its length is bounded by the block's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType

from ..functions import bit_width, is_index, key_hash
from ..schemas import BLOCK_ENTRIES
from . import ordering


def blocked(positioned: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Adds block: each ``block_entries`` entries of a domain that are not index entries, in order."""
    return positioned.where(~is_index(F.col("flags"))).withColumn("block", F.floor(F.col("n_before") / block_entries).cast("long"))


def block_ranges(blocks: DataFrame) -> DataFrame:
    """domain, block, range_start, range_end, n_entries; a range starts where the one before ends."""
    ends = blocks.groupBy("domain", "block").agg(F.max(F.col("pos") + F.col("size")).alias("range_end"), F.count("*").alias("n_entries"))
    before = ends.select("domain", (F.col("block") + 1).alias("block"), F.col("range_end").alias("_before"))
    return ends.join(before, ["domain", "block"], "left").select("domain", "block", F.coalesce("_before", F.lit(0)).cast("long").alias("range_start"), "range_end", "n_entries")


def postings(blocks: DataFrame) -> DataFrame:
    """domain, block, key_hash, positions (ascending)."""
    hashed = blocks.select("domain", "block", key_hash(F.col("key")).alias("key_hash"), "pos")
    return hashed.groupBy("domain", "block", "key_hash").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def gaps(found: DataFrame) -> DataFrame:
    """domain, block, key_hash, n, gaps, bits of each posting list.

    The list is stored as the first position in 32 bits, then the gaps in
    gamma code, then the code of 1 as an end mark if there is more than one.
    """
    n = F.size("positions")
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get("positions", i) - F.get("positions", i - 1))).otherwise(F.array().cast("array<bigint>"))
    rows = found.withColumn("n", n).withColumn("gaps", steps)
    bits = F.lit(32) + F.aggregate("gaps", F.lit(0), lambda total, gap: total + 2 * bit_width(gap) - 1) + F.when(F.col("n") > 1, 1).otherwise(0)
    return rows.select("domain", "block", "key_hash", "n", "gaps", bits.cast("long").alias("bits"))


def _gamma_bits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit lengths, first bits) of the Elias gamma codes of positive numbers: as many zeros as the number has bits less one, then the number."""
    widths = np.floor(np.log2(values.astype(np.longdouble))).astype(np.int64) + 1
    return 2 * widths - 1, np.concatenate([[0], np.cumsum(2 * widths - 1)[:-1]])


@arrow_udf(BinaryType())
def _code_of(lists: pa.Array) -> pa.Array:
    out = []
    for item in lists:
        positions = item.values.to_numpy()
        values = np.append(np.diff(positions), 1) if len(positions) > 1 else np.zeros(0, np.int64)  # 1 is the end mark
        sizes, starts = _gamma_bits(values) if len(values) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        bits = np.zeros(32 + int(sizes.sum()), np.uint8)
        bits[:32] = positions[0] >> np.arange(31, -1, -1) & 1
        widths = (sizes + 1) // 2
        within = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
        bits[32 + np.repeat(starts + widths - 1, widths) + within] = np.repeat(values, widths) >> (np.repeat(widths, widths) - 1 - within) & 1
        out.append(np.packbits(bits).tobytes())
    return pa.array(out, pa.binary())


@arrow_udf(ArrayType(LongType()))
def _positions_of(codes: pa.Array) -> pa.Array:
    out = []
    for code in codes.to_pylist():
        bits = np.unpackbits(np.frombuffer(code, np.uint8))
        positions = [int.from_bytes(code[:4], "big")]
        ones, at, k = np.flatnonzero(bits[32:]) + 32, 32, 0
        while k < len(ones):  # a step a code: its first one tells its width
            width = int(ones[k]) - at + 1
            end = at + 2 * width - 1
            gap = int("".join(map(str, bits[ones[k] : end].tolist())), 2)
            at, k = end, int(np.searchsorted(ones, end))
            positions.append(positions[-1] + gap)
        out.append(positions[:-1] if len(positions) > 1 else positions)  # without the end mark
    return pa.array(out, pa.list_(pa.int64()))


def encoded(found: DataFrame) -> DataFrame:
    """domain, block, key_hash, code: the stored bits of each posting list, filled up to whole bytes."""
    return found.select("domain", "block", "key_hash", _code_of("positions").alias("code"))


def decoded(codes: DataFrame) -> DataFrame:
    """The posting lists of ``encoded``, read code by code."""
    return codes.select("domain", "block", "key_hash", _positions_of("code").alias("positions"))


def segments(found: DataFrame) -> DataFrame:
    """domain, block, n_single, n_multi, key_bits: the two packed segments of each block."""
    one = F.size("positions") == 1
    return found.groupBy("domain", "block").agg(F.count_if(one).alias("n_single"), F.count_if(~one).alias("n_multi"), F.max(bit_width(F.get("positions", F.lit(0)))).cast("int").alias("value_bits"))


def covered(ranges: DataFrame) -> DataFrame:
    """domain, covered: the end of the chain of ranges without a gap, from 0 on; other ranges are passed over.

    The chain is followed by doubling: each range points to the one that starts
    at its end.
    """
    links = ranges.select("domain", F.col("range_start").alias("a"), F.col("range_end").alias("b")).where("a < b").distinct()
    while True:
        ahead = links.select("domain", F.col("a").alias("b"), F.col("b").alias("c"))
        longer = links.join(ahead, ["domain", "b"], "left").select("domain", "a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("grew"))
        longer = ordering.written(longer, "ranges")
        links = longer.select("domain", "a", "b")
        if not longer.where("grew").limit(1).count():
            break
    return links.where("a = 0").groupBy("domain").agg(F.max("b").alias("covered"))


def tail(positioned: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entries that no range of the gap-free chain covers: those that a refresh has to index."""
    known = covered(ranges)
    return positioned.join(known, "domain", "left").where(F.col("pos") >= F.coalesce("covered", F.lit(0))).drop("covered")
