"""Values stored outside the log: which are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_external


def missing(entries: DataFrame, present: DataFrame, on: str = "ext_file") -> DataFrame:
    """External entries whose file is not among ``present``."""
    return entries.where(is_external(F.col("flags"))).join(present.select(on), on, "left_anti")


def census(entries: DataFrame, present: DataFrame, on: str = "ext_file") -> DataFrame:
    """domain, n_external, n_missing."""
    there = present.select(on).distinct().withColumn("_there", F.lit(True))
    external = entries.where(is_external(F.col("flags"))).join(there, on, "left")
    return external.groupBy("domain").agg(F.count("*").alias("n_external"), F.count_if(F.col("_there").isNull()).alias("n_missing"))
