"""A session for tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from glob import glob
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata"


@lru_cache(maxsize=1)
def spark() -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
    }
    found = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    return found


def plain(value: object) -> object:
    return round(value, 6) if isinstance(value, float) else value


def rows_of(df: DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return sorted(found.columns), sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
