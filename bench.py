"""Times headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from strandlog.plans.queries import QUERIES

HEADLINES = (
    "lookup_many", "lookup_single", "lookup_via_index", "entry_positions", "scan_dedupe", "bulk_kv", "chunk_roll", "stream_chunks", "owner_lookup", "replica_placement",
    "inverted_index", "index_gaps", "index_tail", "merkle_tree", "leaf_diff", "sync_send", "sync_inbox", "replica_consistency", "external_census", "recent_stats", "log_round_trip",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        from strandlog.llm.queries import QUERIES as more
    except ImportError:
        more = {}
    names = {**{n: QUERIES[n] for n in HEADLINES}, **more}
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name, run in names.items():
        began = time.time()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
