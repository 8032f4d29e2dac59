"""Consistent-hash ring: owners, neighbours, health, replica placement.

Ids are 32 lower-case hex digits. A node owns the ids from its own up to the
next node's; ids below the smallest belong to the first node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import ordering

_BUCKET_DIGITS = 3
_TOP = "g"  # above every hex digit


def nodes_of(df: DataFrame, name: Column, host: Column) -> DataFrame:
    """node_id, node, host of each row; the id is the md5 of the name."""
    return df.select(F.md5(name.cast("binary")).alias("node_id"), name.alias("node"), host.cast("string").alias("host"))


def named_nodes(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """Nodes whose name is the prefix and a hex id, with that id, zero-padded, in ring order."""
    digits = F.regexp_extract(F.col(name), f"^{prefix}([0-9a-fA-F]{{1,32}})$", 1)
    return df.where(digits != "").withColumn("node_id", F.lpad(F.lower(digits), 32, "0")).orderBy("node_id")


def discovered(df: DataFrame, name: str, prefix: str, host: str, hosts: DataFrame) -> DataFrame:
    """The named nodes (``named_nodes``) on the listed hosts (host)."""
    return named_nodes(df.join(hosts.select(F.col("host").alias(host)), host, "left_semi"), name, prefix)


def ranked(nodes: DataFrame) -> DataFrame:
    """Adds place: the node's number in the ring, from 0."""
    return ordering.numbered(nodes, ["node_id"], "place")


def neighbours(nodes: DataFrame) -> DataFrame:
    """Adds previous_node and next_node; the ring is closed."""
    placed = ranked(nodes)
    total = nodes.agg(F.count("*").alias("total"))
    rows = placed.crossJoin(F.broadcast(total))  # one row
    names = placed.select(F.col("place").alias("_p"), F.col("node").alias("_n"))
    left = names.withColumnsRenamed({"_p": "_lp", "_n": "previous_node"})
    right = names.withColumnsRenamed({"_p": "_rp", "_n": "next_node"})
    joined = rows.join(left, F.pmod(F.col("place") - 1, F.col("total")) == F.col("_lp")).join(right, (F.col("place") + 1) % F.col("total") == F.col("_rp"))
    return joined.select(*placed.columns, "previous_node", "next_node")


def owners(requests: DataFrame, id_: str, nodes: DataFrame) -> DataFrame:
    """Adds node: the owner of each request's id.

    Both sides meet on the first hex digits of the id, of which a node holds
    all that its range covers, so this is a hash join at any size of the ring.
    """
    placed = neighbours(nodes).alias("a").join(ranked(nodes).select((F.col("place") - 1).alias("_p"), F.col("node_id").alias("_high")).alias("b"), F.col("a.place") == F.col("b._p"), "left")
    ranges = placed.select("a.node", F.when(F.col("a.place") == 0, F.lit("")).otherwise(F.col("a.node_id")).alias("_low"), F.coalesce("b._high", F.lit(_TOP)).alias("_high"))
    first = F.coalesce(F.conv(F.substring("_low", 1, _BUCKET_DIGITS), 16, 10).cast("int"), F.lit(0))
    last = F.when(F.col("_high") == _TOP, 16**_BUCKET_DIGITS - 1).otherwise(F.conv(F.substring("_high", 1, _BUCKET_DIGITS), 16, 10).cast("int"))
    covered = ranges.select("node", "_low", "_high", F.explode(F.sequence(first, last)).alias("_bucket"))
    asked = requests.withColumn("_bucket", F.conv(F.substring(F.col(id_), 1, _BUCKET_DIGITS), 16, 10).cast("int"))
    return asked.join(covered, (asked["_bucket"] == covered["_bucket"]) & (F.col(id_) >= F.col("_low")) & (F.col(id_) < F.col("_high"))).select(*requests.columns, "node")


def health(links: DataFrame) -> DataFrame:
    """node and ok for nodes (node_id, node, prev_node, next_node) as they see their neighbours.

    A node is ok if the one before it in the ring, the last for the first,
    takes it for its next one, and it takes that one for its previous one.
    """
    placed = ranked(links)
    total = placed.agg(F.count("*").alias("total"))
    before = placed.select(F.col("place").alias("_p"), F.col("node").alias("_node"), F.col("next_node").alias("_next"))
    joined = placed.crossJoin(F.broadcast(total)).join(before, F.pmod(F.col("place") - 1, F.col("total")) == F.col("_p"))  # total is one row
    ok = F.coalesce((F.col("_node") == F.col("prev_node")) & (F.col("_next") == F.col("node")), F.lit(False))
    return joined.select("node", ok.alias("ok"))


def rogues(nodes: DataFrame) -> DataFrame:
    """Nodes (place, node_id, node) that break the order of the ring, read from the smallest id on.

    A node is rogue if an earlier one has an id that is not smaller. For each
    node the greatest id before it is a running maximum, which only changes at
    its records, so the last record before a node tells it.
    """
    start = nodes.agg(F.min(F.struct("node_id", "place")).alias("s"), F.count("*").alias("n")).select(F.col("s.place").alias("_start"), "n")
    turned = nodes.crossJoin(F.broadcast(start)).withColumn("turn", F.pmod(F.col("place") - F.col("_start"), F.col("n"))).drop("_start", "n")  # one row
    blocks = ordering.in_order(turned, ["turn"])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("_block").agg(F.max("node_id").alias("_top")).select("_block", F.max("_top").over(before).alias("_carried"))
    own = F.max("node_id").over(Window.partitionBy("_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    highest = F.greatest(F.col("_own"), F.col("_carried"))
    return blocks.withColumn("_own", own).join(tops, "_block").where(F.col("node_id") <= highest).select("node_id", "node")


def parallel(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two rings (node_id, node) without a common node: the one that has to go, with the larger least id; else nothing."""
    common = a.join(b, "node_id", "left_semi").limit(1).agg(F.count("*").alias("common"))
    ends = a.agg(F.min("node_id").alias("low_a")).crossJoin(b.agg(F.min("node_id").alias("low_b"))).crossJoin(common)  # one row each
    both = a.select("node_id", "node", F.lit("a").alias("ring")).union(b.select("node_id", "node", F.lit("b").alias("ring")))
    loser = F.when(F.col("low_a") > F.col("low_b"), F.lit("a")).otherwise(F.lit("b"))
    return both.crossJoin(F.broadcast(ends)).where((F.col("common") == 0) & (F.col("ring") == loser)).select("node_id", "node", "ring")


def strangers(nodes: DataFrame, ring: DataFrame) -> DataFrame:
    """node, kind: alien (alive, not in the ring) or unknown (in the ring, not alive)."""
    alien = nodes.select("node").exceptAll(ring.select("node")).withColumn("kind", F.lit("alien"))
    return alien.union(ring.select("node").exceptAll(nodes.select("node")).withColumn("kind", F.lit("unknown")))


def successors(nodes: DataFrame, me: str) -> DataFrame:
    """Other nodes in the order in which ``me`` (an id) tries them: larger ids first, then the rest."""
    others = nodes.where(F.col("node_id") != me).withColumn("_wrapped", (F.col("node_id") < me).cast("int"))
    return ordering.numbered(others, ["_wrapped", "node_id"], "rank").select("rank", "node_id", "node")


def placed_replicas(owned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replicas of domains (domain_id, node, nrepl): domain_id, node, rank; rank 0 is the owner.

    From the owner backwards, nodes on the owner's host are passed over, until
    nrepl others have a copy or the ring is closed. Numbered among the nodes of
    other hosts, these are the ones just before the owner. The last node of the
    host before such a number tells how many to add for its place in the ring,
    so the work is a row a node and a copy, however many nodes a host has.
    """
    placed = ranked(nodes.where(F.col("host").isNotNull()))
    members = written(ordering.running_sum(placed.select("place", "node", "host"), ["host"], ["place"], F.lit(1).cast("long"), "_same"), "members")
    members = members.withColumn("_at", F.col("place") - F.col("_same"))  # nodes of other hosts before it
    needs = owned.groupBy("node").agg(F.max("nrepl").cast("long").alias("need"))
    total = members.agg(F.count("*").alias("total"))
    others = members.groupBy("host").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(total)).select("host", (F.col("total") - F.col("_n")).alias("others"))  # total is one row
    owner = members.groupBy("node").agg(F.max(F.struct("place", "host", "_at")).alias("_o")).select(F.col("node").alias("owner"), "_o.host", "_o._at")  # the last of one name owns
    first = owner.join(needs.withColumnRenamed("node", "owner"), "owner").join(others, "host").where("need > 0 and others > 0")
    ranks = first.withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.least("need", "others"))))
    asks = ranks.select("host", F.pmod(F.col("_at") - F.col("rank"), F.col("others")).alias("_at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("_same"), "owner", "rank")
    marks = members.select("host", "_at", F.lit(0).alias("kind"), "_same", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("rank"))
    found = ordering.latest(marks.union(asks), ["host", "_at", "kind", "_same"], F.when(F.col("kind") == 0, F.struct("host", "_same")), "copies").where("kind = 1")
    passed = F.when(F.col("_latest.host") == F.col("host"), F.col("_latest._same") + 1).otherwise(0)
    at = found.select("owner", "rank", (F.col("_at") + passed).alias("place"))
    chain = written(at.join(placed.select("place", F.col("node").alias("replica")), "place").select("owner", "replica", "rank"), "chains")
    copied = owned.join(chain, owned["node"] == chain["owner"]).where(F.col("rank") <= F.col("nrepl")).select("domain_id", F.col("replica").alias("node"), F.col("rank").cast("int").alias("rank"))
    return owned.select("domain_id", "node", F.lit(0).alias("rank")).union(copied)


def redirect(counts: DataFrame) -> DataFrame:
    """domain_id, node: for owners (rank 0) that hold fewer entries than a replica, the nearest copy with the most.

    counts has (domain_id, node, rank, num_entries); an owner without the domain counts 0.
    """
    most = counts.groupBy("domain_id").agg(F.max("num_entries").alias("most"), F.max(F.when(F.col("rank") == 0, F.col("num_entries"))).alias("own"))
    behind = counts.join(most, "domain_id").where("rank > 0 and num_entries >= most and coalesce(own, 0) < most")
    return behind.groupBy("domain_id").agg(F.min_by("node", "rank").alias("node"))


def replicated(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """One row a copy of entries (domain_id, ...): each with node and rank of every replica in placed.

    A domain_id is one chunk, so its entries are bounded by the chunk limit.
    The copies, a few a chunk, are hashed; the entries need no sort.
    """
    return entries.join(placed.select("domain_id", "node", "rank").hint("shuffle_hash"), "domain_id")


def _places(nodes: DataFrame) -> DataFrame:
    """node, place, total: the ring's order, with its number of nodes."""
    total = nodes.agg(F.count("*").alias("total"))
    return ranked(nodes).select("node", "place").crossJoin(F.broadcast(total))  # one row


def put_targets(owned: DataFrame, holders: DataFrame, nodes: DataFrame) -> DataFrame:
    """domain_id, node, reply: where a put for each of owned (domain_id, node) goes.

    That is the first node, from the owner backwards, which holds the domain in
    holders (domain_id, node). Without one the request comes back to the owner,
    and the reply is invalid_domain.
    """
    at = owned.join(_places(nodes), "node").select("domain_id", F.col("place").alias("_from"), "total")
    there = holders.join(_places(nodes).select("node", "place"), "node")
    steps = F.pmod(F.col("_from") - F.col("place"), F.col("total"))
    first = at.join(there, "domain_id", "left").groupBy("domain_id").agg(F.min_by("node", steps).alias("node"))
    return first.withColumn("reply", F.when(F.col("node").isNull(), F.lit("invalid_domain")).otherwise(F.lit("ok")))


def owner_hops(holders: DataFrame, owned: DataFrame, nodes: DataFrame) -> DataFrame:
    """domain_id, node, owner, hops: steps forward on the ring from each holder that is not the owner to the owner, whom it tells of itself."""
    places = _places(nodes)
    own = owned.select("domain_id", F.col("node").alias("owner")).join(places.select(F.col("node").alias("owner"), F.col("place").alias("_to"), "total"), "owner")
    rows = holders.select("domain_id", "node").join(places.select("node", "place"), "node").join(own, "domain_id").where("node <> owner")
    return rows.select("domain_id", "node", "owner", F.pmod(F.col("_to") - F.col("place"), F.col("total")).alias("hops"))


def any_node(nodes: DataFrame, seed: str) -> DataFrame:
    """One node, by the least hash of node and seed: any one, and the same one for the same seed."""
    return nodes.orderBy(F.md5(F.concat("node", F.lit(seed)).cast("binary"))).limit(1)
