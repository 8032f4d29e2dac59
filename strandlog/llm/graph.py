"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the component's least node.

    Each round hooks every neighbour of a node to the least one (first the
    larger neighbours, then the smaller ones), which halves path lengths and
    never adds edges. Only a count and a checksum of the edges reach the
    driver. A round's edges are a table in the shared folder, so a lost
    executor costs one round at most. Least neighbours are tables too: the join
    with them has a plain shuffle on either side, so that Spark can deal a hub's
    edges over several tasks. Nulls and loops are no edges.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        low = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "edges")
    hooked = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    roots = hooked.select(F.col("root").alias("node"), "root").distinct().join(hooked.select("node"), "node", "left_anti")
    return hooked.union(roots)
