"""Operators on small made-up inputs, against plain Python."""

from __future__ import annotations

import random
import tempfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlog import functions as fn
from strandlog.api import Archive, DomainExists, InvalidDomain
from strandlog.operators import chunks, entries, index, monitor, ordering, ring, sync
from strandlog.plans import oracles, queries
from strandlog.streaming import chunk_stream

from .session import rows_of, spark, sql_rows


def frame(rows, schema):
    return spark().createDataFrame(rows, schema)


def test_orders_over_one_large_group():
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"d{i % 5}", i, rng.randrange(1, 9)) for i in range(2000)]
    rng.shuffle(rows)
    df = frame(rows, "k string, o long, v long").repartition(7)
    seen, last, sums, before = {}, {}, {}, {}
    for k, o, v in sorted(rows):
        sums[k, o], seen[k] = seen.get(k, 0), seen.get(k, 0) + v
        before[k, o], last[k] = last.get(k), v
    assert {(r["k"], r["o"]): r["s"] for r in ordering.running_sum(df, ["k"], ["o"], F.col("v"), "s").collect()} == sums
    assert {(r["k"], r["o"]): r["_previous"] and r["_previous"]["v"] for r in ordering.previous(df, ["k"], ["o"], ["v"]).collect()} == before
    assert sorted(r["n"] for r in ordering.numbered(df, ["k", "o"], "n").collect()) == list(range(2000))


@pytest.mark.parametrize("limit", [0, 100, 900, 10**9])
def test_chunks_roll_as_one_pass_does(limit):
    rng = random.Random(limit)
    rows, expected = [], {}
    for domain in ("a", "b", "c"):
        pos = size = chunk = 0
        for o in range(1 if domain == "c" else 700):
            if size > limit:
                chunk, size = chunk + 1, 0
            n = rng.randrange(40, 400)
            rows.append((domain, o, pos, n))
            expected[domain, o] = chunk
            pos, size = pos + n, size + n
    found = chunks.rolled(frame(rows, "domain string, ord long, pos long, size long"), limit)
    assert {(r["domain"], r["ord"]): r["chunk"] for r in found.collect()} == expected
    assert chunks.rolled(frame([], "domain string, ord long, pos long, size long"), limit).count() == 0


def test_few_entries_take_part_in_the_search_for_chunks(monkeypatch):
    """The entries that links are made for grow with the blocks, not with the entries."""
    kept, tables = chunks.written, {}

    def spy(df, label):
        found = kept(df, label)
        tables[label] = max(tables.get(label, 0), found.count())
        return found

    monkeypatch.setattr(chunks, "written", spy)
    rows = spark().range(30_000).select(F.lit("d").alias("domain"), F.col("id").alias("ord"), (F.col("id") * 50).alias("pos"), F.lit(50).alias("size"))
    found = chunks.rolled(rows, 990)
    assert found.agg(F.max("chunk")).first()[0] == 30_000 // 20 - 1 and found.where("chunk <> floor(ord / 20)").count() == 0
    assert tables.get("chain", 0) < 2000 and tables.get("exits", 0) < 2000


def test_posting_lists_come_back():
    rng = random.Random(4)
    rows = [("d", 0, k, sorted(rng.sample(range(10**6), rng.randrange(1, 60)))) for k in range(50)]
    found = frame(rows, "domain string, block long, key_hash long, positions array<long>")
    back = {r["key_hash"]: r["positions"] for r in index.decoded(index.encoded(found)).collect()}
    assert back == {k: p for _, _, k, p in rows}
    sizes = {r["key_hash"]: r["bits"] for r in index.gaps(found).collect()}
    assert {k: -(-n // 8) for k, n in sizes.items()} == {r["key_hash"]: len(r["code"]) for r in index.encoded(found).collect()}


def test_tree_equals_plain_checksums_and_ignores_order():
    ids = [random.Random(i).randrange(2**32) for i in range(3000)]
    level = [0] * 8192
    for i in ids:
        level[i & 8191] ^= i
    while len(level) > 1:
        level = [zlib.crc32(level[k].to_bytes(4, "big") + level[k + 1].to_bytes(4, "big")) for k in range(0, len(level), 2)]
    a, b = frame([(i,) for i in ids], "entry_id long"), frame([(i,) for i in reversed(ids)], "entry_id long")
    roots = [sync.tree(sync.leaves(x)).where("level = 1").first()["hash"] for x in (a, b)]
    assert roots == [level[0]] * 2
    assert sync.descended(sync.tree(sync.leaves(a)), sync.tree(sync.leaves(b))).count() == 0


def test_descent_finds_the_changed_leaves_from_either_side():
    rng = random.Random(8)
    base = [(rng.randrange(2**32),) for _ in range(2000)]
    extra = [(rng.randrange(2**32),) for _ in range(50)]
    a, b = frame(base, "entry_id long"), frame(base + extra, "entry_id long")
    x, y = sync.tree(sync.leaves(a)), sync.tree(sync.leaves(b))
    one, two = ({r["leaf"] for r in sync.descended(*p).collect()} for p in ((x, y), (y, x)))
    assert one == two == {e[0] & 8191 for e in extra}


def test_equal_copies_cancel_in_a_leaf():
    assert sync.leaves(frame([(9,), (9,)], "entry_id long")).where("leaf = 9").first()["hash"] == 0


def test_two_replicas_meet():
    rows = [(1, i, f"k{i}", 50, "d") for i in range(1600)]
    schema = "time long, entry_id long, key string, size long, domain string"
    a, b = frame(rows[:900], schema), frame(rows[700:], schema)
    both = sync.merged(a, b).withColumn("replica", F.lit("a")).unionByName(sync.merged(b, a).withColumn("replica", F.lit("b")))
    found = sync.consistency(both).first()
    assert both.count() == 3200 and found["counts_agree"] and found["leaves_agree"]


def test_ring_rules():
    nodes = frame([("10" + "0" * 30, "n1", "h1"), ("50" + "0" * 30, "n2", "h1"), ("a0" + "0" * 30, "n3", "h2")], "node_id string, node string, host string")
    asked = frame([("00" + "0" * 30,), ("10" + "0" * 30,), ("4f" + "f" * 30,), ("50" + "0" * 30,), ("ff" + "f" * 30,)], "id string")
    assert {r["id"][:2]: r["node"] for r in ring.owners(asked, "id", nodes).collect()} == {"00": "n1", "10": "n1", "4f": "n1", "50": "n2", "ff": "n3"}
    owned = frame([("d", "n2", 5)], "domain_id string, node string, nrepl int")
    assert sorted((r["node"], r["rank"]) for r in ring.placed_replicas(owned, nodes).collect()) == [("n2", 0), ("n3", 1)]  # n1 shares the owner's host
    assert ring.parallel(nodes, nodes).count() == 0
    one = nodes.where("node = 'n1'")
    assert ring.neighbours(one).first()["next_node"] == "n1" and ring.placed_replicas(frame([("d", "n1", 2)], "domain_id string, node string, nrepl int"), one).count() == 1


def test_replicas_are_those_of_a_walk_and_take_few_rows():
    rng = random.Random(6)
    for hosts in ("ab", "aaaaab", "abcdefgh", "a"):
        nodes = [(f"{rng.randrange(16**32):032x}", f"n{i}", rng.choice(hosts)) for i in range(60)]
        order, owned = sorted(nodes), [(f"d{i}", f"n{i}", i % 5) for i in range(60)]
        expected = []
        for domain, node, nrepl in owned:
            at = next(i for i, n in enumerate(order) if n[1] == node)
            back = [order[at - k][1] for k in range(1, 60) if order[at - k][2] != order[at][2]][:nrepl]
            expected += [(domain, n, k) for k, n in enumerate([node, *back])]
        found = ring.placed_replicas(frame(owned, "domain_id string, node string, nrepl int"), frame(nodes, "node_id string, node string, host string"))
        assert sorted((r["domain_id"], r["node"], r["rank"]) for r in found.collect()) == sorted(expected)


def most_rows(df):
    """The greatest number of rows that a step of df's plan gives."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        plans += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
        if plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
    return most


def test_replicas_on_a_large_host_take_no_row_a_pair_of_nodes():
    nodes = spark().range(1500).select(F.md5(F.col("id").cast("string").cast("binary")).alias("node_id"), F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") % 500 == 0, "b").otherwise("a").alias("host"))
    owned = nodes.select(F.col("node_id").alias("domain_id"), "node", F.lit(3).alias("nrepl"))
    assert most_rows(ring.placed_replicas(owned, nodes)) < 20_000  # of 2 million pairs


@pytest.mark.parametrize("name", ["domain_by_name", "domain_status", "node_domains"])
def test_listings_of_a_large_host_take_no_row_a_pair_of_nodes(name, monkeypatch, tmp_path):
    con, kept, most = duckdb.connect(), queries.written, []

    def spy(df, label):
        most.append(most_rows(df))
        return kept(df, label)

    for module in (queries, ring):
        monkeypatch.setattr(module, "written", spy, raising=False)
    con.sql(f"COPY (SELECT i AS s_suppkey, 'Supplier#' || i AS s_name, CASE WHEN i % 500 = 0 THEN 1 ELSE 0 END AS s_nationkey FROM range(1500) t(i)) TO '{tmp_path}/supplier.parquet'")
    event = "i AS event_id, TIMESTAMP '2024-01-01' AS ts, i % 7 AS user_id, CASE WHEN i % 3 = 0 THEN 'view' ELSE 'click' END AS event_type, 1.0 AS value, repeat('p', 4000) AS props"
    con.sql(f"COPY (SELECT {event} FROM range(1500) t(i)) TO '{tmp_path}/events.parquet'")
    found = queries.QUERIES[name](spark(), str(tmp_path))
    assert max([most_rows(found), *most]) < 50_000  # of some 300,000 pairs
    assert rows_of(found) == sql_rows(oracles.ORACLES[name], str(tmp_path))[1]


def test_entries_are_copied_without_a_sort():
    rows = frame([("d", i) for i in range(9)], "domain_id string, ord long")
    found = ring.replicated(rows, frame([("d", "n", 0), ("d", "m", 1)], "domain_id string, node string, rank int"))
    kept = spark().conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark().conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 18 and "Sort" not in plan
    finally:
        spark().conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_archive():
    store = Archive(spark(), tempfile.mkdtemp(prefix="spark-"))
    store.create("orchard")
    with pytest.raises(DomainExists):
        store.create("orchard")
    pairs = frame([(i, "pear" if i % 2 else f"k{i}", f"v{i}") for i in range(40)], "o long, key string, value string")
    store.put("orchard", pairs, "o")
    store.put("orchard", frame([(0, "pear", "last")], "o long, key string, value string"), "o")
    assert [r["value"] for r in store.get("orchard", "pear").collect()] == [f"v{i}" for i in range(1, 40, 2)] + ["last"]
    assert store.get_single("orchard", "pear") == "v1" and store.get("orchard", "no").count() == 0 and store.get("none", "pear").count() == 0
    assert store.get_many("orchard", frame([("pear",), ("k0",), ("k0",)], "key string")).count() == 22
    for bad, error in ((lambda: store.get_single("orchard", "no"), KeyError), (lambda: store.put("none", pairs, "o"), InvalidDomain)):
        with pytest.raises(error):
            bad()
    with pytest.raises(Exception, match="key too large"):
        store.put("orchard", frame([(1, "k" * 4096, "v")], "o long, key string, value string"), "o")


def test_archive_rolls_chunks_and_reads_over_them():
    store = Archive(spark(), tempfile.mkdtemp(prefix="spark-"), chunk_bytes=500)
    store.create("logs", noindex="true", nrepl="2")
    rng, sizes, chunk, held = random.Random(3), {}, 0, 0
    for batch in range(1, 4):
        rows = [(i, f"k{i % 3}", "v" * rng.randrange(0, 90) + str(i)) for i in range(30)]
        store.put("logs", frame(rows, "o long, key string, value string").repartition(3), "o")
        for o, key, value in rows:
            if held > 500:
                chunk, held = chunk + 1, 0
            sizes[batch, o] = chunk
            held += 40 + len(key) + len(value)
    found = {(r["batch"], r["ord"]): r["chunk"] for r in store.scan("logs").collect()}
    assert found == sizes and chunk > 5
    listed = store.domains().collect()
    assert sorted(r["chunk"] for r in listed) == list(range(chunk + 1)) and len({r["domain_id"] for r in listed}) == chunk + 1
    assert all(r["noindex"] and r["nrepl"] == 2 for r in listed)
    assert store.get("logs", "k1").count() == 30
    store.delete("logs")
    assert store.domains().count() == store.scan("logs").count() == 0
    store.create("logs")
    with pytest.raises(InvalidDomain):
        store.delete("other")
    for bad in ({"nrepl": "x"}, {"keycache": "maybe"}, {"unknown": 1}, {"nrepl": -1}):
        with pytest.raises(ValueError):
            store.create("new", **bad)
    store.create("new")  # a refused option leaves the name free


def test_fold_stops_early():
    rows = frame([("d", i, i) for i in range(1000)], "domain string, ord long, v long").repartition(5)

    def step(state, entry):
        if entry["v"] == 700:
            raise entries.Stop(state)
        return state + [entry["v"]] if len(state) < 3 else state[:2] + [entry["v"]]

    merge = lambda a, b: b if not a else a if not b else [*a[:2], b[-1]]
    assert entries.folded(rows, [], step, merge) == [0, 1, 699]
    assert entries.folded(rows.where("false"), [], step, merge) == []


def test_small_functions():
    row = frame([("/a//b/c", 33)], "p string, n long").select(fn.path_parts(F.col("p")).alias("p"), fn.padded_bytes(F.col("n")).alias("n")).first()
    assert row["p"] == ["a", "b", "c"] and row["n"] == 5
    assert monitor.domain_number("0xFf") == "0" * 30 + "ff" == monitor.domain_number("255")
    for bad in ("0x", "ff", "-1", str(1 << 128)):
        with pytest.raises(ValueError):
            monitor.domain_number(bad)


def test_guard():
    assert frame([(2**32 - 1,)], "n long").select(fn.guard_u32(F.col("n")).alias("n")).first()["n"] == 2**32 - 1
    with pytest.raises(Exception, match="unsigned"):
        frame([(2**32,)], "n long").select(fn.guard_u32(F.col("n")).alias("n")).collect()


def test_chunk_stream_carries_open_chunks_over_batches(tmp_path):
    session, rng, expected = spark(), random.Random(4), {}
    fields = "domain string, ord long, entry_id long, size long"
    batches = [[("a" if rng.random() < 0.8 else f"b{k}", k * 1000 + i, k * 1000 + i, rng.randrange(1, 60)) for i in range(300)] for k in range(1, 4)]
    batches[1].insert(0, ("a", 1, 7, 11))  # a late ord comes after the batches before
    last = max(r for r in batches[0] if r[0] == "a")
    batches[1].insert(0, ("a", 0, last[2], 50))  # delivered again
    state = {}
    for k, rows in enumerate(batches):
        part = tmp_path / f"part{k}"
        session.createDataFrame(rows, fields).coalesce(1).write.parquet(str(part))
        for domain, order, entry_id, size in sorted(rows):
            chunk, held, pos, before = state.get(domain, (0, 0, 0, -1))
            if entry_id == before:
                continue
            if held > 500:
                chunk, held = chunk + 1, 0
            expected[domain, order] = (chunk, pos)
            state[domain] = (chunk, held + size, pos + size, entry_id)
        out = str(tmp_path / "out")
        arriving = session.readStream.schema(fields).parquet(str(tmp_path / "part*"))
        chunk_stream(arriving, out, str(tmp_path / "state"), 500).awaitTermination()
    found = session.read.parquet(out).collect()
    assert {(r["domain"], r["ord"]): (r["chunk"], r["pos"]) for r in found} == expected and len(found) == len(expected)


def test_few_entries_of_a_stream_take_part_in_the_search_for_chunks(tmp_path, monkeypatch):
    """What chunk_stream links grows with the blocks, not with the entries that arrive."""
    kept, tables = chunks.written, {}

    def spy(df, label):
        found = kept(df, label)
        tables[label] = max(tables.get(label, 0), found.count())
        return found

    monkeypatch.setattr(chunks, "written", spy)
    session, out = spark(), str(tmp_path / "out")
    for k in range(2):
        rows = session.range(k * 30_000, (k + 1) * 30_000).select(F.lit("d").alias("domain"), F.col("id").alias("ord"), F.col("id").alias("entry_id"), F.lit(50).cast("long").alias("size"))
        rows.write.parquet(str(tmp_path / f"part{k}"))
        arriving = session.readStream.schema(rows.schema).parquet(str(tmp_path / "part*"))
        chunk_stream(arriving, out, str(tmp_path / "state"), 990).awaitTermination()
    found = session.read.parquet(out)
    assert found.count() == 60_000 and found.where("chunk <> floor(ord / 20) or pos <> ord * 50").count() == 0
    assert tables["chain"] < 2000 and tables.get("exits", 0) < 2000
