"""Shared storage between stages, and ranks that no single task computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path, written

__all__ = ["bounded_batches", "new_path", "ranked", "written"]

#: Bytes of an Arrow batch; an executor holds several for each of its tasks, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold about BATCH_BYTES from here on (one row at least), unless it has a limit of its own.

    Results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def ranked(df: DataFrame, group: str, order: list[Column], spread: Column, counts: DataFrame, target: int, name: str) -> DataFrame:
    """Adds a gapless rank from 0 within each group, for groups of any size.

    counts has (group, n) of every group. A group is dealt over ceil(n / target)
    parts by the hash ``spread``; a part's rows are numbered in one window and
    raised by the sizes of the parts before it. No window sees more than about
    ``target`` rows. df must give the same rows each time it is read.
    """
    parts = counts.select(group, F.ceil(F.col("n") / F.lit(target)).cast("long").alias("_parts"))
    dealt = df.join(F.broadcast(parts), group).withColumn("_part", F.pmod(spread, F.col("_parts")))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_size"))
    sizes = sizes.select(group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_part").orderBy(*order)
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(sizes, [group, "_part"])
        .withColumn(name, F.col("_before") + F.col("_own"))
        .drop("_parts", "_part", "_own", "_before")
    )
