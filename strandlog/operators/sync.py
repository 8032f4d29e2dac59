"""Replica synchronisation: leaf hashes, hash tree, differences, exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crc_pair, leaf, sync_id_hex
from ..schemas import LEAVES
from ..sources.shared import written

IDS = ["time", "entry_id"]


def leaves(rows: DataFrame) -> DataFrame:
    """leaf, hash, n for all LEAVES leaves; the hash is the XOR of the entry ids, 0 for none, so equal copies cancel."""
    found = rows.groupBy(leaf(F.col("entry_id")).alias("leaf")).agg(F.bit_xor("entry_id").alias("hash"), F.count("*").alias("n"))
    every = rows.sparkSession.range(LEAVES).select(F.col("id").cast("int").alias("leaf"))
    return every.join(found, "leaf", "left").select("leaf", F.coalesce("hash", F.lit(0)).alias("hash"), F.coalesce("n", F.lit(0)).alias("n"))


def leaf_ids(rows: DataFrame) -> DataFrame:
    """leaf, time, entry_id of every entry: the id lists of the leaves, one row an id."""
    return rows.select(leaf(F.col("entry_id")).alias("leaf"), *IDS)


def leaf_distribution(hashed: DataFrame) -> DataFrame:
    """least, middle (lower median), most, total of the entries a leaf."""
    return hashed.agg(F.min("n").alias("least"), F.expr("percentile_disc(0.5) within group (order by n)").cast("long").alias("middle"), F.max("n").alias("most"), F.sum("n").alias("total"))


def _level_above(below: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: crc_pair(F.get(below, 2 * i), F.get(below, 2 * i + 1)))


def tree(hashed: DataFrame) -> DataFrame:
    """level (1 is the root), idx, hash of the tree over the LEAVES leaf hashes.

    The leaves are a row of fixed size, so the levels are array expressions.
    """
    row = hashed.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("leaf", "hash"))), lambda x: x["hash"]).alias("h0"))  # LEAVES numbers, whatever the log
    names, n, k = ["h0"], LEAVES, 0
    while n > 1:
        n, k = n // 2, k + 1
        row = row.withColumn(f"h{k}", _level_above(names[-1], n))
        names.append(f"h{k}")
    levels = F.array(*[F.struct(F.lit(len(names) - k).alias("level"), F.col(c).alias("hashes")) for k, c in enumerate(names)])
    flat = row.select(F.explode(levels).alias("l")).select("l.level", F.posexplode("l.hashes").alias("idx", "hash"))
    return flat.select("level", "idx", "hash")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """level, idx of the nodes in which two trees differ."""
    return a.alias("a").join(b.alias("b"), ["level", "idx"], "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select("level", "idx")


def children(parents: DataFrame) -> DataFrame:
    """The nodes below those of a level."""
    return parents.select((F.col("level") + 1).alias("level"), F.explode(F.array(2 * F.col("idx"), 2 * F.col("idx") + 1)).alias("idx"))


def descended(a: DataFrame, b: DataFrame) -> DataFrame:
    """leaf of all leaves that differ, found from the root down; nothing if the roots agree."""
    depth = LEAVES.bit_length()
    nodes = differing(a, b)
    picked = nodes.where("level = 1")
    for level in range(2, depth + 1):
        picked = nodes.where(F.col("level") == level).join(children(picked), ["level", "idx"], "left_semi")
    return picked.select(F.col("idx").alias("leaf"))


def leaf_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """leaf, hash_a, hash_b of the leaves that differ."""
    joined = leaves(a).select("leaf", F.col("hash").alias("hash_a")).join(leaves(b).select("leaf", F.col("hash").alias("hash_b")), "leaf")
    return joined.where("hash_a <> hash_b")


def missing(here: DataFrame, there: DataFrame, differ: DataFrame | None = None) -> DataFrame:
    """time, entry_id of the entries here that are not there, each once; only in leaves of ``differ`` if given."""
    ids = leaf_ids(here) if differ is None else leaf_ids(here).join(differ.select("leaf"), "leaf", "left_semi")
    return ids.select(*IDS).distinct().join(there.select(*IDS), IDS, "left_anti")


def outbox(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries for each requester, one scan for all: requests has (time, entry_id, requester); repeated ones count once."""
    return rows.join(requests.select(*IDS, "requester").distinct(), IDS)


def inbox(rows: DataFrame, arrived: DataFrame) -> DataFrame:
    """rows and those of arrived that are new, each id once: the one that came last, by ``arrival``."""
    columns = [c for c in rows.columns if c not in IDS]
    last = arrived.groupBy(*IDS).agg(F.max_by(F.struct(*columns), "arrival").alias("_e")).select(*IDS, "_e.*")
    return rows.unionByName(last.join(rows.select(*IDS), IDS, "left_anti").select(rows.columns))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """What both replicas hold after the exchange."""
    return a.unionByName(b.join(a.select(*IDS), IDS, "left_anti"))


def resync(owner: DataFrame, replica: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Both copies after one round: leaf hashes tell where they differ, ids in those leaves what each lacks, and that is sent.

    ``order`` is the column by which entries arrive.
    """
    differ = written(leaf_diff(owner, replica), "leaves")

    def got(here: DataFrame, there: DataFrame) -> DataFrame:
        asked = missing(there, here, differ).withColumn("requester", F.lit("here"))
        return inbox(here, outbox(there, asked).drop("requester").withColumn("arrival", F.col(order)))

    return got(owner, replica), got(replica, owner)


def tree_dump(rows: DataFrame) -> DataFrame:
    """kind, level, idx, value of a replica's tree: T rows hold a node's hash, L rows an id of a leaf (one row an id), both in hex."""
    nodes = tree(leaves(rows)).select(F.lit("T").alias("kind"), "level", "idx", F.lpad(F.hex("hash"), 8, "0").alias("value"))
    ids = leaf_ids(rows).select(F.lit("L").alias("kind"), F.lit(LEAVES.bit_length()).alias("level"), F.col("leaf").alias("idx"), sync_id_hex(F.col("time"), F.col("entry_id")).alias("value"))
    return nodes.union(ids)


def consistency(replicas: DataFrame, by: Column | str = "domain") -> DataFrame:
    """domain, n_replicas, counts_agree, sizes_agree, leaves_agree of replicas (replica, domain, entry_id, size).

    Leaf hashes are compared as one checksum of all leaves of a domain.
    """
    hashed = replicas.groupBy(by, "replica", leaf(F.col("entry_id")).alias("leaf")).agg(F.bit_xor("entry_id").alias("hash"), F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = hashed.groupBy(by, "replica").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.when(F.col("hash") != 0, F.xxhash64("leaf", "hash"))).alias("mark"))
    one = lambda c: F.count_distinct(c) <= 1
    return whole.groupBy(by).agg(F.count("*").alias("n_replicas"), one("n").alias("counts_agree"), one("size").alias("sizes_agree"), one("mark").alias("leaves_agree"))
