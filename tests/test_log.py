"""The log format: round trips, damage, following a file, the sink and the source."""

from __future__ import annotations

import os
import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlog.sources import codec, entrylog

from .session import spark

U32 = st.integers(0, 2**32 - 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=60), st.binary(max_size=200), U32, U32), max_size=12))
def test_entries_come_back(rows):
    data = b"".join(codec.encode(k, v, t, i) for k, v, t, i in rows)
    assert [(e.key, e.value, e.time, e.entry_id) for e in codec.scan(data)] == rows
    assert codec.whole_bytes(data) == len(data)


def test_limits():
    assert codec.made(b"k", b"v" * 4095, 1, 2)[1] is None
    raw, name = codec.made(b"k", b"v" * 4096, 1, 2)
    entry = codec.read_entry(raw, 0)
    assert entry.flags == 1 and codec.link(entry.value)[1] == name
    for bad in ((b"k" * 4096, b"", 1, 1), (b"", b"", 2**32, 1), (b"", b"", 1, -1)):
        with pytest.raises(ValueError):
            codec.encode(*bad)


def sequential(n):
    return [(f"user/{i:07d}".encode(), b"seen " * 3 + i.to_bytes(4, "little"), i, i + 1) for i in range(n)]


def test_scan_goes_on_after_damage():
    rows = sequential(3000)
    data = bytearray(b"".join(codec.encode(k, v, t, i) for k, v, t, i in rows))
    size = len(data) // 3000
    first, n = 61_003, 1700
    data[first : first + n] = random.Random(1).randbytes(n)
    found = [e.entry_id - 1 for e in codec.scan(bytes(data))]
    lost = set(range(3000)) - set(found)
    assert found == sorted(found) and lost == set(range(first // size, (first + n - 1) // size + 1))


def test_half_written_end_is_no_error():
    whole = codec.encode(b"a", b"b", 1, 1)
    for cut in range(1, len(whole)):
        data = whole + whole[:cut]
        assert len(list(codec.scan(data))) == 1 and codec.whole_bytes(data) == len(whole)


def test_an_entry_inside_a_half_written_one_is_not_read_by_a_follower():
    inner = codec.encode(b"in", b"side", 1, 5)
    whole, outer = codec.encode(b"a", b"b", 1, 1), codec.encode(b"out", b"x" * 50 + inner + b"y" * 50, 1, 2)
    for cut in range(1, len(outer)):
        data = whole + outer[:cut]
        assert codec.whole_bytes(data) == len(whole) and [e.entry_id for e in codec.scan(data, follow=True)] == [1]
    assert [e.entry_id for e in codec.scan(whole + outer, follow=True)] == [1, 2]
    assert [e.entry_id for e in codec.scan(whole + outer[:-20])] == [1, 5]  # a final file: what can be read is


def test_a_magic_number_inside_a_value():
    head = codec.encode(b"x", b"y", 1, 1)[:4]
    data = codec.encode(b"k", head * 5, 1, 7) + codec.encode(b"k2", b"", 1, 8)
    assert [e.entry_id for e in codec.scan(data)] == [7, 8]


def test_source_sink_and_stream():
    session = spark()
    entrylog.register(session)
    path = tempfile.mkdtemp(prefix="spark-")
    rows = [(5, i, 0, f"k{i % 7}".encode(), (b"x" * 5000 if i % 50 == 0 else f"v{i}".encode())) for i in range(1, 301)]
    df = session.createDataFrame(rows, "time long, entry_id long, flags int, key binary, value binary")
    df.repartition(3).write.format("entrylog").mode("append").option("path", path).save()
    assert not [x for x in os.listdir(path) if x.endswith(".partial")]
    back = session.read.format("entrylog").option("path", path).load()
    full = entrylog.read_values(back, path)
    assert sorted((r["entry_id"], bytes(r["key"]), bytes(r["value"])) for r in full.collect()) == sorted((i, k, v) for _, i, _, k, v in rows)
    assert sorted(tuple(r) for r in entrylog.decoded(session, path).select("entry_id", "pos", "size").collect()) == sorted(tuple(r) for r in back.select("entry_id", "pos", "size").collect())
    first = min((r["pos"] for r in back.collect() if r["pos"]))
    late = session.read.format("entrylog").option("path", path).option("startpos", first).load()
    assert late.count() == back.where(f"pos >= {first}").count()

    out, state = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")

    def drain():
        stream = session.readStream.format("entrylog").option("path", path).load().select("entry_id", "pos")
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["entry_id"] for r in session.read.parquet(out).collect())

    assert drain() == list(range(1, 301))
    name = next(x for x in sorted(os.listdir(path)) if x.endswith(".log"))
    with open(f"{path}/{name}", "ab") as file:  # a whole entry and a half one
        half = codec.encode(b"half", codec.encode(b"inner", b"v", 9, 999), 9, 302)
        file.write(codec.encode(b"new", b"v", 9, 301) + half[:-6])
    assert drain() == list(range(1, 302))
    with open(f"{path}/{name}", "ab") as file:
        file.write(half[-6:])
    assert drain() == list(range(1, 303))


def test_missing_external_value_is_null():
    session = spark()
    entrylog.register(session)
    path = tempfile.mkdtemp(prefix="spark-")
    rows = [(1, i, 0, b"k", bytes([64 + i]) * 5000) for i in range(1, 6)]
    session.createDataFrame(rows, "time long, entry_id long, flags int, key binary, value binary").write.format("entrylog").mode("append").option("path", path).save()
    files = sorted(x for x in os.listdir(path) if x.startswith("value-"))
    os.remove(f"{path}/{files[0]}")
    with open(f"{path}/{files[1]}", "wb") as file:
        file.write(b"other")
    found = entrylog.read_values(entrylog.decoded(session, path), path).collect()
    assert len(files) == 5 and sorted(r["value"] is None for r in found) == [False] * 3 + [True] * 2


def test_files_of_the_sink_are_bounded():
    path, n = tempfile.mkdtemp(prefix="spark-"), 4000
    entrylog.register(spark())
    rows = spark().range(n).selectExpr("id AS time", "id AS entry_id", "0 AS flags", "CAST(id AS STRING) AS key", "repeat('x', 3000) AS value").coalesce(1)
    rows.selectExpr("time", "entry_id", "flags", "CAST(key AS BINARY) AS key", "CAST(value AS BINARY) AS value").write.format("entrylog").mode("append").option("path", path).save()
    sizes = [os.path.getsize(f"{path}/{x}") for x in os.listdir(path)]
    assert len(sizes) > 1 and max(sizes) < (1 << 22) + 5000
    back = entrylog.decoded(spark(), path).groupBy().agg({"entry_id": "sum", "*": "count"}).first()
    assert sorted(back) == [n, n * (n - 1) // 2]
