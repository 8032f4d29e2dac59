"""Status reports of domains, replicas and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent(samples: DataFrame, n: int = 5, more: list[str] | None = None) -> DataFrame:
    """key, rank, ts, value and more: the last n samples of each key, newest first. Ranks are cut before the shuffle too."""
    order = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id"))
    return samples.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("key", "rank", "ts", "value", *(more or []))


def replica_status(entries: DataFrame, limit: int) -> DataFrame:
    """node, domain_id, num_entries, size, full of entries (node, domain_id, size)."""
    found = entries.groupBy("node", "domain_id").agg(F.count("*").alias("num_entries"), F.sum("size").alias("size"))
    return found.withColumn("full", F.col("size") > limit)


def domain_listing(registry: DataFrame, placement: DataFrame, status: DataFrame) -> DataFrame:
    """A row for each copy of each domain: domain_id, name, chunk, node, owner, n_replicas, num_entries, reply.

    registry (domain_id, name, chunk), placement (domain_id, node, rank), status
    (domain_id, node, num_entries); copies without a status say noreply.
    """
    copies = placement.groupBy("domain_id").agg((F.count("*") - 1).alias("n_replicas"))
    rows = registry.join(placement, "domain_id").join(copies, "domain_id").join(status.select("domain_id", "node", "num_entries"), ["domain_id", "node"], "left")
    reply = F.when(F.col("num_entries").isNull(), F.lit("noreply")).otherwise(F.lit("ok"))
    return rows.select("domain_id", "name", "chunk", "node", (F.col("rank") == 0).alias("owner"), "n_replicas", "num_entries", reply.alias("reply"))


def on_node(listing: DataFrame, node: str) -> DataFrame:
    """The copies of a domain listing that a node holds."""
    return listing.where(F.col("node") == node)


def by_name(listing: DataFrame, name: str) -> DataFrame:
    """domain_id, name, chunk, n_copies, n_replies, num_entries (the most of a copy) of the chunks of one domain: a row a chunk."""
    found = listing.where(F.col("name") == name).groupBy("domain_id", "name", "chunk")
    return found.agg(F.count("*").alias("n_copies"), F.count_if(F.col("reply") == "ok").alias("n_replies"), F.max("num_entries").alias("num_entries"))


def domain_number(text: str) -> str:
    """A domain id given as a decimal number, or in hex behind 0x, as 32 hex digits; ValueError for any other text."""
    number = int(text[2:], 16) if text[:2].lower() == "0x" else int(text, 10)
    if not 0 <= number < 1 << 128:
        raise ValueError(f"not a domain id: {text}")
    return f"{number:032x}"


def of_domain(listing: DataFrame, id_: str) -> DataFrame:
    """place, node, owner, num_entries, reply of the copies of one domain (by ``domain_number``): the owner first, then by node."""
    found = listing.where(F.col("domain_id") == domain_number(id_))
    order = Window.orderBy(F.desc("owner"), "node")  # the copies of one domain
    return found.select((F.row_number().over(order) - 1).alias("place"), "node", "owner", "num_entries", "reply")


def replica_report(placement: DataFrame, status: DataFrame, limit: int) -> DataFrame:
    """domain_id, node, owner, num_entries, size, full, max_repl_entries of the copies with a status.

    status has (domain_id, node, num_entries, size). An owner knows the most
    entries that one of its replicas has; a replica does not, and has 0.
    """
    rows = placement.join(status, ["domain_id", "node"])
    most = rows.where("rank > 0").groupBy("domain_id").agg(F.max("num_entries").alias("_most"))
    owner = F.col("rank") == 0
    known = F.when(owner, F.coalesce("_most", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.join(most, "domain_id", "left").select("domain_id", "node", owner.alias("owner"), "num_entries", "size", (F.col("size") > limit).alias("full"), known.alias("max_repl_entries"))


def ring_report(health: DataFrame, linked: DataFrame, stats: DataFrame) -> DataFrame:
    """node, ok, previous_node, next_node and the columns of stats (node, ...); null for a node without statistics."""
    return linked.select("node", "previous_node", "next_node").join(health.select("node", "ok"), "node").join(stats, "node", "left")


def matching(registry: DataFrame, text: str) -> DataFrame:
    """Domains whose name contains the text."""
    return registry.where(F.col("name").contains(text))
