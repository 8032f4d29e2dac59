"""The registered queries: entry logs built from the given tables, and one query an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import chunks, entries, external, index, lookup, monitor, ring, sync
from ..sources import entrylog
from ..sources.shared import new_path, written
from ..streaming import chunk_stream, recent_stream
from ..streaming import posting_stream as postings_of_stream

CHUNK_LIMIT, BLOCK, NREPL, FRESH, EARLY = 20_000, 1000, 3, 5, 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of events: a domain a type, a key a user, in the order of event_id."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return entries.entries(table(spark, sf_dir, "events"), F.col("event_type"), F.col("user_id"), F.col("props"), F.col("event_id"), seconds)


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of documents: a domain a language; long texts are external."""
    return entries.entries(table(spark, sf_dir, "documents"), F.coalesce("lang", F.lit("")), F.col("source"), F.col("text"), F.col("doc_id"), F.lit(0).cast("long"))


def urgent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return orders.select(F.col("o_custkey").cast("string").alias("key")).distinct()


def repeated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with index entries, repeats just after an entry (some behind an index entry) and far repeats."""
    base = event_entries(spark, sf_dir).withColumn("n", F.col("ord")).withColumn("flags", F.when(F.col("n") % 23 == 0, 1).otherwise(0))
    marker = base.where("n % 50 = 0").withColumn("ord", F.col("n") * 4 + 1).withColumn("flags", F.lit(2)).withColumn("entry_id", fn.key_hash(F.concat(F.lit("m"), F.col("n").cast("string"))))
    near = base.where("n % 10 = 0").withColumn("ord", F.col("n") * 4 + 2)
    far = base.where("n % 17 = 0").withColumn("ord", F.col("n") + 10**12)
    return base.withColumn("ord", F.col("n") * 4).unionByName(marker).unionByName(near).unionByName(far).drop("n")


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.nodes_of(table(spark, sf_dir, "supplier"), F.col("s_name"), F.col("s_nationkey"))


def rolled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, ord, entry_id, size, pos, chunk of the event entries."""
    rows = event_entries(spark, sf_dir).select("domain", "ord", "entry_id", "flags", "size")
    return chunks.rolled(entries.positioned(rows).select("domain", "ord", "entry_id", "size", "pos"), CHUNK_LIMIT)


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the chunk's domain id, as a table: most queries read it more than once."""
    return written(rolled_events(spark, sf_dir), "chunked").withColumn("domain_id", fn.domain_id(F.col("domain"), F.col("chunk")))


def registry(rows: DataFrame) -> DataFrame:
    """Chunks of the event domains."""
    found = rows.select("domain", "chunk").distinct().withColumn("domain_id", fn.domain_id(F.col("domain"), F.col("chunk")))
    return found.select("domain_id", F.col("domain").alias("name"), "chunk", F.lit(NREPL).alias("nrepl"))


def placement(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    nodes = supplier_nodes(spark, sf_dir)
    owned = written(ring.owners(registry(rows), "domain_id", nodes), "owned")
    return written(ring.placed_replicas(owned, nodes), "placed")


def copies(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """domain_id, node, rank, num_entries, size of the copies, each of which has lost some entries."""
    held = ring.replicated(rows, placed).where((F.col("ord") * (F.col("rank") + 2)) % 7 != 3)
    return held.groupBy("domain_id", "node", "rank").agg(F.count("*").alias("num_entries"), F.sum("size").alias("size"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain listing, where nodes whose id begins with 0 or 1 do not answer."""
    rows = chunked(spark, sf_dir)
    placed = placement(spark, sf_dir, rows)
    answers = copies(rows, placed).where(~F.substring(F.md5(F.col("node").cast("binary")), 1, 1).isin("0", "1"))
    return monitor.domain_listing(registry(rows), placed, answers)


def holders(placed: DataFrame) -> DataFrame:
    """Copies that are there: of some domains not the owner's, of others none."""
    last = F.substring("domain_id", 32, 1)
    return placed.where(~(last.isin(*"01234567") & (F.col("rank") == 0)) & ~last.isin("0", "f") & ~(last.isin("1", "2") & (F.col("rank") == 1)))


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = event_entries(spark, sf_dir)
    return rows.where("ord % 10 <> 0"), rows.where("ord % 7 <> 0")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.blocked(entries.positioned(event_entries(spark, sf_dir)), BLOCK)


# lookup


@query
def lookup_many(spark, sf_dir):
    return lookup.many(entries.positioned(event_entries(spark, sf_dir)), urgent_keys(spark, sf_dir)).select("domain", "key", "pos", "value")


@query
def lookup_single(spark, sf_dir):
    rows = event_entries(spark, sf_dir).withColumn("pos", F.col("ord"))  # the order is all that it needs
    return lookup.single(rows, urgent_keys(spark, sf_dir))


@query
def lookup_via_index(spark, sf_dir):
    rows = entries.positioned(event_entries(spark, sf_dir))
    return lookup.via_index(rows, index.postings(index.blocked(rows, BLOCK)), urgent_keys(spark, sf_dir)).select("domain", "key", "pos", "value")


@query
def lookup_key(spark, sf_dir):
    """All values of the least requested key."""
    key = urgent_keys(spark, sf_dir).agg(F.min("key").alias("key")).first()["key"] or ""
    return lookup.of_key(entries.positioned(event_entries(spark, sf_dir)), key).select("domain", "key", "pos", "value")


@query
def positional_read(spark, sf_dir):
    """Reads at every tenth entry's byte, and at bytes inside others."""
    rows = entries.positioned(event_entries(spark, sf_dir))
    asked = rows.where("ord % 10 = 0").select("domain", "pos").union(rows.where("ord % 15 = 1").select("domain", F.col("pos") + 1))
    return lookup.at(rows, asked).select("domain", "pos", "entry_id", "key", "reply")


# entries and scans


@query
def early_stop(spark, sf_dir):
    return entries.first_entries(event_entries(spark, sf_dir), EARLY).select("domain", "ord", "key")


@query
def grouped_pairs(spark, sf_dir):
    return entries.grouped_pairs(event_entries(spark, sf_dir), ["key"], "ord").select("key", "nth", "ord", "value")


@query
def folded_scan(spark, sf_dir):
    """A fold of the caller's: number of entries, their bytes, and how often the domain changes from one to the next."""

    def step(state, entry):
        n, size, changes, first, last = state
        return n + 1, size + entry["size"], changes + (n > 0 and entry["domain"] != last), first if n else entry["domain"], entry["domain"]

    def merge(a, b):
        if not a[0] or not b[0]:
            return b if not a[0] else a
        return a[0] + b[0], a[1] + b[1], a[2] + b[2] + (a[4] != b[3]), a[3], b[4]

    n, size, changes, *_ = entries.folded(event_entries(spark, sf_dir).select("domain", "ord", "size"), (0, 0, 0, None, None), step, merge)
    return spark.createDataFrame([(n, size, changes)], "n long, size long, changes long")


@query
def frame_values(spark, sf_dir):
    """Values framed for a reply and read back; every seventh frame is cut short."""
    framed = event_entries(spark, sf_dir).select("ord", fn.frame(F.col("value")).alias("frame"))
    cut = F.when(F.col("ord") % 7 == 0, F.expr("substring(frame, 1, length(frame) - 1)")).otherwise(F.col("frame"))
    return framed.select("ord", fn.frame_value(cut).alias("value"))


@query
def json_replies(spark, sf_dir):
    """Entries as JSON replies, and the key that is read back from each."""
    reply = F.to_json(F.struct("ord", "domain", "key", "size"))
    rows = event_entries(spark, sf_dir).select("ord", reply.alias("reply"))
    return rows.select("ord", "reply", F.from_json("reply", "ord long, domain string, key string, size long")["key"].alias("key"))


@query
def entry_positions(spark, sf_dir):
    return entries.positioned(event_entries(spark, sf_dir)).select("domain", "ord", "entry_id", "size", "pos")


@query
def internal_external_split(spark, sf_dir):
    return document_entries(spark, sf_dir).select(F.col("ord").alias("doc_id"), fn.is_external(F.col("flags")).alias("external"), F.octet_length("value").cast("long").alias("value_bytes"), "size")


@query
def scan_dedupe(spark, sf_dir):
    return entries.scanned(repeated_entries(spark, sf_dir)).select("domain", "ord", "entry_id", "key")


@query
def bulk_kv(spark, sf_dir):
    return entries.bulk_pairs(repeated_entries(spark, sf_dir)).select("domain", "ord", "key", "value")


@query
def distinct_entries(spark, sf_dir):
    return entries.distinct_ids(repeated_entries(spark, sf_dir)).select("domain", "time", "entry_id", "ord")


@query
def flag_parse(spark, sf_dir):
    return repeated_entries(spark, sf_dir).groupBy(F.array_join(fn.flag_names(F.col("flags")), ",").alias("names")).agg(F.count("*").alias("n"), F.sum(fn.guard_u32(F.col("entry_id"))).alias("id_sum"))


@query
def id_dump(spark, sf_dir):
    return entries.id_dump(event_entries(spark, sf_dir))


@query
def reply_frames(spark, sf_dir):
    return event_entries(spark, sf_dir).select("ord", fn.frame(F.col("value")).alias("frame"))


# domains, chunks


@query
def domain_registry(spark, sf_dir):
    return registry(chunked(spark, sf_dir)).withColumn("shown", fn.display_id(F.col("domain_id")))


@query
def chunk_roll(spark, sf_dir):
    return rolled_events(spark, sf_dir).select("domain", "ord", "chunk")


@query
def chunk_sizes(spark, sf_dir):
    return chunks.chunk_sizes(rolled_events(spark, sf_dir), CHUNK_LIMIT)


@query
def stream_chunks(spark, sf_dir):
    """chunk_roll by a stream: state a domain, the table as files that arrive.

    No limit of files a batch: files needn't follow the order of ord.
    """
    source = table(spark, sf_dir, "events")
    arriving = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = entries.entries(arriving, F.col("event_type"), F.col("user_id"), F.col("props"), F.col("event_id"), seconds)
    out = new_path(spark, "stream")
    chunk_stream(rows, out, f"{out}-state", CHUNK_LIMIT).awaitTermination()
    return spark.read.parquet(out).select("domain", "ord", "chunk", "pos")


# ring


@query
def owner_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("request_id"))
    return ring.owners(asked, "request_id", supplier_nodes(spark, sf_dir))


@query
def node_sort(spark, sf_dir):
    named = supplier_nodes(spark, sf_dir).select(F.concat(F.lit("strand-"), F.upper("node_id")).alias("name"))
    return ring.named_nodes(named, "name", "strand-").select("name", "node_id")


@query
def node_discovery(spark, sf_dir):
    """Nodes whose name has the prefix, on the hosts with an even number."""
    named = supplier_nodes(spark, sf_dir).select(F.concat(F.when(F.col("host") % 3 == 0, "other-").otherwise("strand-"), "node_id").alias("name"), "host")
    hosts = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("host"))
    return ring.discovered(named, "name", "strand-", "host", hosts).select("name", "node_id", "host")


@query
def ring_neighbours(spark, sf_dir):
    return ring.neighbours(supplier_nodes(spark, sf_dir)).select("node_id", "node", "previous_node", "next_node")


@query
def ring_health(spark, sf_dir):
    linked = ring.neighbours(supplier_nodes(spark, sf_dir))
    broken = F.substring("node_id", 1, 1).isin("3", "a")
    return ring.health(linked.select("node_id", "node", F.when(broken, F.col("node")).otherwise(F.col("previous_node")).alias("prev_node"), "next_node"))


@query
def rogue_nodes(spark, sf_dir):
    listed = ring.nodes_of(table(spark, sf_dir, "supplier"), F.col("s_name"), F.col("s_nationkey"))
    placed = listed.join(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("node"), (F.col("s_suppkey") - 1).alias("place")), "node")
    return ring.rogues(placed.select("place", "node_id", "node"))


@query
def parallel_rings(spark, sf_dir):
    nodes = supplier_nodes(spark, sf_dir)
    first = F.substring("node_id", 32, 1).isin(*"01234567")
    return ring.parallel(nodes.where(first), nodes.where(~first))


@query
def ring_strangers(spark, sf_dir):
    nodes = supplier_nodes(spark, sf_dir)
    return ring.strangers(nodes.where(F.substring("node_id", 1, 1) != "7"), nodes.where(F.substring("node_id", 1, 1) != "c"))


@query
def successor_candidates(spark, sf_dir):
    nodes = supplier_nodes(spark, sf_dir)
    me = nodes.agg(F.min_by("node_id", "node").alias("me")).first()["me"] or ""
    return ring.successors(nodes, me)


@query
def replica_placement(spark, sf_dir):
    return placement(spark, sf_dir, chunked(spark, sf_dir))


@query
def replicated_entries(spark, sf_dir):
    rows = chunked(spark, sf_dir)
    return ring.replicated(rows, placement(spark, sf_dir, rows)).select("domain_id", "ord", "entry_id", "node", "rank")


@query
def redirect_target(spark, sf_dir):
    rows = chunked(spark, sf_dir)
    return ring.redirect(copies(rows, placement(spark, sf_dir, rows)))


@query
def put_target(spark, sf_dir):
    placed = placement(spark, sf_dir, chunked(spark, sf_dir))
    return ring.put_targets(placed.where("rank = 0"), holders(placed), supplier_nodes(spark, sf_dir))


@query
def owner_hops(spark, sf_dir):
    placed = placement(spark, sf_dir, chunked(spark, sf_dir))
    return ring.owner_hops(holders(placed), placed.where("rank = 0"), supplier_nodes(spark, sf_dir))


@query
def any_node(spark, sf_dir):
    return ring.any_node(supplier_nodes(spark, sf_dir), "7")


# index


@query
def inverted_index(spark, sf_dir):
    found = index.postings(blocks(spark, sf_dir))
    return found.select("domain", "block", "key_hash", F.size("positions").cast("long").alias("n"), F.array_join("positions", ",").alias("positions"))


@query
def index_blocks(spark, sf_dir):
    return index.block_ranges(blocks(spark, sf_dir))


@query
def index_gaps(spark, sf_dir):
    return index.gaps(index.postings(blocks(spark, sf_dir))).select("domain", "block", "key_hash", "bits", fn.padded_bytes(F.col("bits")).alias("bytes"))


@query
def index_codes(spark, sf_dir):
    return index.encoded(index.postings(blocks(spark, sf_dir))).withColumn("code", F.hex("code"))


@query
def index_decoded(spark, sf_dir):
    found = index.decoded(index.encoded(index.postings(blocks(spark, sf_dir))))
    return found.select("domain", "block", "key_hash", F.array_join("positions", ",").alias("positions"))


@query
def index_segments(spark, sf_dir):
    return index.segments(index.postings(blocks(spark, sf_dir)))


@query
def index_tail(spark, sf_dir):
    rows = entries.positioned(event_entries(spark, sf_dir))
    known = index.block_ranges(index.blocked(rows, BLOCK // 10)).where("block <> 3")
    return index.tail(rows, known).select("domain", "ord", "pos")


@query
def posting_stream(spark, sf_dir):
    """Postings of a stream of entries, a segment a batch; here, how many positions each key has in all of them."""
    source = table(spark, sf_dir, "events")
    arriving = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    rows = entries.entries(arriving, F.col("event_type"), F.col("user_id"), F.col("props"), F.col("event_id"), F.lit(0).cast("long"))
    out = new_path(spark, "postings")
    postings_of_stream(rows.withColumn("pos", F.col("ord")), out, f"{out}-state").awaitTermination()
    found = spark.read.parquet(out)
    return found.groupBy("domain", "key_hash").agg(F.sum(F.size("positions")).alias("n"), F.min(F.get("positions", F.lit(0))).alias("first"))


# synchronisation


@query
def sync_empty_owner(spark, sf_dir):
    """What a replica sends to an owner that has nothing."""
    _, b = replicas(spark, sf_dir)
    empty = b.where("false")
    return sync.missing(b, empty, sync.leaf_diff(empty, b))


@query
def resync(spark, sf_dir):
    """The ids of both copies after a round."""
    owner, replica = sync.resync(*replicas(spark, sf_dir), "ord")
    return owner.select(F.lit("owner").alias("copy"), *sync.IDS, "key").union(replica.select(F.lit("replica"), *sync.IDS, "key"))


@query
def tree_dump(spark, sf_dir):
    return sync.tree_dump(event_entries(spark, sf_dir))


@query
def leaf_hashes(spark, sf_dir):
    return sync.leaves(event_entries(spark, sf_dir))


@query
def leaf_counts(spark, sf_dir):
    return sync.leaf_distribution(sync.leaves(event_entries(spark, sf_dir)))


@query
def merkle_tree(spark, sf_dir):
    return sync.tree(sync.leaves(event_entries(spark, sf_dir)))


@query
def merkle_descent(spark, sf_dir):
    a, b = replicas(spark, sf_dir)
    return sync.descended(sync.tree(sync.leaves(a)), sync.tree(sync.leaves(b)))


@query
def leaf_diff(spark, sf_dir):
    return sync.leaf_diff(*replicas(spark, sf_dir))


@query
def sync_send(spark, sf_dir):
    a, b = replicas(spark, sf_dir)
    return sync.missing(a, b, sync.leaf_diff(a, b))


@query
def sync_request(spark, sf_dir):
    a, b = replicas(spark, sf_dir)
    return sync.missing(b, a, sync.leaf_diff(a, b))


@query
def sync_outbox(spark, sf_dir):
    a, b = replicas(spark, sf_dir)
    asked = sync.missing(b, a).withColumn("requester", F.lit("a"))
    others = b.where("ord % 11 = 0").select(*sync.IDS, F.lit("c").alias("requester"))
    return sync.outbox(b, asked.union(others).union(others)).select("requester", *sync.IDS, "key")


@query
def sync_inbox(spark, sf_dir):
    a, b = replicas(spark, sf_dir)
    late = b.where("ord % 5 = 0").withColumn("key", F.lit("late")).withColumn("arrival", F.col("ord") + 10**9)
    return sync.inbox(a, b.withColumn("arrival", F.col("ord")).unionByName(late)).select(*sync.IDS, "key")


@query
def replica_consistency(spark, sf_dir):
    a, b = replicas(spark, sf_dir)
    both = sync.merged(a, b).withColumn("replica", F.lit("a")).unionByName(sync.merged(b, a).where("ord % 1000 <> 1 or domain > 'c'").withColumn("replica", F.lit("b")))
    return sync.consistency(both)


# external values, monitoring


@query
def external_census(spark, sf_dir):
    present = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    return external.census(document_entries(spark, sf_dir), present, "ord")


@query
def external_missing(spark, sf_dir):
    present = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    return external.missing(document_entries(spark, sf_dir), present, "ord").select(F.col("ord").alias("doc_id"), "domain")


@query
def recent_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts", "value")
    return monitor.recent(rows, FRESH)


@query
def replica_status(spark, sf_dir):
    rows = entries.positioned(event_entries(spark, sf_dir)).select(F.lit("n1").alias("node"), F.col("domain").alias("domain_id"), "size")
    return monitor.replica_status(rows, CHUNK_LIMIT)


@query
def domain_listing(spark, sf_dir):
    return listing(spark, sf_dir)


@query
def node_domains(spark, sf_dir):
    rows = written(listing(spark, sf_dir), "listing")
    node = rows.agg(F.min("node").alias("node")).first()["node"] or ""
    return monitor.on_node(rows, node).select("domain_id", "name", "chunk", "owner", "n_replicas", "reply")


@query
def domain_by_name(spark, sf_dir):
    return monitor.by_name(listing(spark, sf_dir), "click")


@query
def domain_status(spark, sf_dir):
    """Every copy of the domain with the least id."""
    rows = written(listing(spark, sf_dir), "listing")
    least = rows.agg(F.min("domain_id").alias("id")).first()["id"] or "0"
    return monitor.of_domain(rows, f"0x{least}")


@query
def replica_report(spark, sf_dir):
    rows = chunked(spark, sf_dir)
    placed = placement(spark, sf_dir, rows)
    return monitor.replica_report(placed, copies(rows, placed).drop("rank"), CHUNK_LIMIT)


@query
def ring_report(spark, sf_dir):
    linked = ring.neighbours(supplier_nodes(spark, sf_dir))
    health = ring.health(linked.select("node_id", "node", F.col("previous_node").alias("prev_node"), "next_node"))
    stats = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("node"), F.col("s_acctbal").alias("free"))
    return monitor.ring_report(health, linked, stats)


@query
def domain_filter(spark, sf_dir):
    return monitor.matching(registry(chunked(spark, sf_dir)), "c").select("name", "chunk", "domain_id")


@query
def recent_live(spark, sf_dir):
    """recent_stats by a stream: the table as files that arrive."""
    source = table(spark, sf_dir, "events")
    arriving = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    out = new_path(spark, "recent")
    return recent_stream(arriving.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts", "value"), out, f"{out}-state", FRESH).select("key", "rank", "ts", "value")


# log files


def _logged(spark: SparkSession, rows: DataFrame) -> str:
    entrylog.register(spark)
    path = new_path(spark, "log")
    entries.as_log(rows).write.format("entrylog").mode("append").option("path", path).save()
    return path


@query
def log_round_trip(spark, sf_dir):
    """Events written as log files and read back by the source."""
    path = _logged(spark, event_entries(spark, sf_dir))
    back = spark.read.format("entrylog").option("path", path).load()
    return back.select("time", "entry_id", "flags", "size", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query
def log_tail(spark, sf_dir):
    """Events written as log files and read by the stream that follows them."""
    path, out = _logged(spark, event_entries(spark, sf_dir)), new_path(spark, "tail")
    stream = spark.readStream.format("entrylog").option("path", path).load()
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    back = spark.read.schema(stream.schema).parquet(out)
    return back.select("time", "entry_id", "size", F.col("key").cast("string").alias("key"))


@query
def log_external_values(spark, sf_dir):
    """Documents written as log files, long texts beside them, and joined again with their checksums compared."""
    path = _logged(spark, document_entries(spark, sf_dir))
    back = entrylog.read_values(entrylog.decoded(spark, path), path)
    return back.select("entry_id", fn.is_external(F.col("flags")).alias("external"), "size", F.md5("value").alias("value_md5"))
