"""Running values over an order, for groups of any size.

Rows are range-sorted by group and order into blocks, and kept as a table
bucketed by block, so that windows inside blocks need no second shuffle. What
the blocks before a block hold comes from one small row a block and group. No
task sees a whole group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path, written


#: Spark's limit of buckets, unless a session raises it.
MAX_BUCKETS = 100_000


def _sorted(names: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in names]


def in_order(df: DataFrame, by: list[str], label: str = "ordered") -> DataFrame:
    """df range-sorted by ``by``, with the number of each row's block in ``_block``: the only shuffle of the rows."""
    spark = df.sparkSession
    name, buckets = f"ordered_{uuid.uuid4().hex}", min(MAX_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(*_sorted(by)).withColumn("_block", F.spark_partition_id())
    dealt.write.option("compression", "zstd").option("path", new_path(spark, label)).bucketBy(buckets, "_block").saveAsTable(name)
    rows = spark.table(name)  # later reads see the same blocks
    spark.sql(f"DROP TABLE {name}")  # the name only: files at a given path stay
    return rows


def _within(by: list[str], keys: list[str] | None = None) -> Window:
    return Window.partitionBy("_block", *(keys or [])).orderBy(*_sorted(by))


def _equal(left: str, right: str, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def running_sum(df: DataFrame, keys: list[str], by: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each in its group ``keys``, in the order of ``by``."""
    return running_sums(df, keys, by, {name: value})


def running_sums(df: DataFrame, keys: list[str], by: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds, by name, the sums of the values over the rows before each in its group ``keys``, in one pass over the order."""
    rows = in_order(df.withColumns({f"_v_{n}": v for n, v in values.items()}), [*keys, *by])
    sums = rows.groupBy("_block", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_block", *keys, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values])
    window = _within(by, keys).rowsBetween(Window.unboundedPreceding, -1)
    own = {f"_o_{n}": F.coalesce(F.sum(f"_v_{n}").over(window), F.lit(0)) for n in values}
    joined = rows.withColumns(own).alias("r").join(carried.alias("c"), (F.col("r._block") == F.col("c._block")) & _equal("r", "c", keys))
    told = joined.select("r.*", *[F.col(f"c._c_{n}") for n in values]).withColumns({n: F.col(f"_c_{n}") + F.col(f"_o_{n}") for n in values})
    return told.drop("_block", *[f"_{k}_{n}" for k in "voc" for n in values])


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds a gapless number from 0 in the order of ``by``, over the whole table: rows are counted while they are written."""
    # the high bits of the id are the partition's number, the low ones count its rows
    rows = df.repartitionByRange(*_sorted(by)).sortWithinPartitions(*_sorted(by)).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, name).withColumn("_block", F.shiftright("_id", 33))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # one row a block
    return rows.join(bases, "_block").withColumn(name, F.col("_base") + F.col("_id") - F.shiftleft("_block", 33)).drop("_block", "_id", "_base")


def latest(df: DataFrame, by: list[str], value: Column, label: str = "ordered") -> DataFrame:
    """Adds ``_latest``: the last value that is not null among the rows before and with each, in the order of ``by``."""
    rows = in_order(df.withColumn("_value", value), by, label)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*by))).alias("_last"))
    every = ends.select("_block", F.last("_last", True).over(before).alias("_before"))  # one row a block
    own = F.last("_value", True).over(_within(by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(every, "_block").withColumn("_latest", F.coalesce("_own", "_before")).drop("_block", "_own", "_before", "_value")


def previous(df: DataFrame, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """Adds ``_previous``: the ``columns`` of the row before each in its group ``keys``, in the order of ``by``; null for a first row."""
    held = F.struct(*keys, *[c for c in columns if c not in keys])
    rows = in_order(df.withColumn("_held", held), [*keys, *by])
    order = [*keys, *by]
    ends = rows.groupBy("_block").agg(F.max_by("_held", F.struct(*order)).alias("_last"))
    carried = ends.select("_block", F.lag("_last").over(Window.orderBy("_block")).alias("_before"))  # one row a block
    own = F.lag("_held").over(_within(order))
    joined = rows.withColumn("_own", own).join(carried, "_block").withColumn("_previous", F.coalesce("_own", "_before"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_previous.{k}").eqNullSafe(F.col(k))
    return joined.withColumn("_previous", F.when(same, F.col("_previous"))).drop("_block", "_held", "_own", "_before")
