"""The registered queries in DuckDB SQL, from the same tables."""

from __future__ import annotations

from .queries import BLOCK, CHUNK_LIMIT, EARLY, FRESH, NREPL


def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _bytes(text: str) -> str:
    return f"octet_length(encode({text}))"


def _entries(domain: str, key: str, value: str, order: str, time: str, source: str) -> str:
    stored = f"CASE WHEN {_bytes('value')} < 4096 THEN {_bytes('value')} ELSE 27 END"
    return f"""e AS (
  SELECT *, {_hash("ord::VARCHAR")} AS entry_id, CASE WHEN {_bytes("value")} < 4096 THEN 0 ELSE 1 END AS flags,
         (40 + {_bytes("key")} + {stored})::BIGINT AS size
  FROM (SELECT {domain} AS domain, {order} AS ord, {time} AS time, coalesce({key}::VARCHAR, '') AS key,
               coalesce({value}::VARCHAR, '') AS value FROM {source}) WHERE {_bytes("key")} < 4096)"""


E = _entries("event_type", "user_id", "props", "event_id", "floor(epoch(ts))::BIGINT", "events")
DOCS = _entries("coalesce(lang, '')", "source", "text", "doc_id", "0::BIGINT", "documents")
P = f"""{E}, p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY domain ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM e)"""
URGENT = "SELECT o_custkey::VARCHAR FROM orders WHERE o_orderpriority = '1-URGENT'"
SCAN = f"""{E}, b AS (SELECT domain, ord AS n, entry_id, key, value, CASE WHEN ord % 23 = 0 THEN 1 ELSE 0 END AS flags, time FROM e),
s AS (
  SELECT domain, n * 4 AS ord, entry_id, key, value, flags, time FROM b
  UNION ALL SELECT domain, n * 4 + 1, {_hash("'m' || n::VARCHAR")}, key, value, 2, time FROM b WHERE n % 50 = 0
  UNION ALL SELECT domain, n * 4 + 2, entry_id, key, value, flags, time FROM b WHERE n % 10 = 0
  UNION ALL SELECT domain, n + 1000000000000, entry_id, key, value, flags, time FROM b WHERE n % 17 = 0)"""
BLOCKS = f"""{P}, o AS (SELECT *, ((row_number() OVER (PARTITION BY domain ORDER BY ord) - 1) // {BLOCK})::BIGINT AS block, {_hash("key")} AS key_hash FROM p)"""
POSTED = f"""{BLOCKS}, g AS (
  SELECT *, pos - lag(pos) OVER (PARTITION BY domain, block, key_hash ORDER BY pos) AS gap FROM o)"""
NODES = "nodes AS (SELECT md5(s_name) AS node_id, s_name AS node, s_nationkey::VARCHAR AS host FROM supplier)"
RING = f"""{NODES}, r AS (
  SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS place, count(*) OVER () AS total,
         coalesce(lead(node_id) OVER (ORDER BY node_id), 'g') AS high FROM nodes)"""
ROLLED = f"""{P}, o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS rn FROM p),
r AS (
  SELECT domain, ord, rn, 0 AS chunk, size AS acc, size, pos FROM o WHERE rn = 1
  UNION ALL
  SELECT o.domain, o.ord, o.rn, CASE WHEN r.acc > {CHUNK_LIMIT} THEN r.chunk + 1 ELSE r.chunk END,
         CASE WHEN r.acc > {CHUNK_LIMIT} THEN o.size ELSE r.acc + o.size END, o.size, o.pos
  FROM r JOIN o ON o.domain = r.domain AND o.rn = r.rn + 1)"""
REGISTRY = f"""{ROLLED},
ch AS (SELECT r.*, p.entry_id, md5(r.chunk::VARCHAR || ' ' || r.domain) AS domain_id FROM r JOIN p ON r.domain = p.domain AND r.ord = p.ord),
reg AS (SELECT DISTINCT domain_id, domain AS name, chunk FROM ch)"""
PLACED = f"""{REGISTRY}, {RING.replace("r AS (", "g AS (")},
own AS (SELECT reg.*, g.node, g.host, g.place AS at, g.total FROM reg JOIN g ON (domain_id >= g.node_id OR g.place = 0) AND domain_id < g.high),
c AS (
  SELECT own.domain_id, g.node, row_number() OVER (PARTITION BY own.domain_id ORDER BY (own.at - g.place + own.total) % own.total) AS rank
  FROM own JOIN g ON g.host <> own.host),
pl AS (
  SELECT domain_id, node, 0 AS rank FROM own UNION ALL SELECT domain_id, node, rank::INTEGER FROM c WHERE rank <= {NREPL})"""
COUNTED = f"""{PLACED}, ct AS (
  SELECT pl.domain_id, pl.node, pl.rank, count(*) AS num_entries, sum(ch.size)::BIGINT AS size
  FROM pl JOIN ch ON ch.domain_id = pl.domain_id WHERE (ch.ord * (pl.rank + 2)) % 7 <> 3 GROUP BY ALL)"""
HOLDERS = f"""{PLACED}, x AS (SELECT *, substr(domain_id, 32, 1) AS last FROM pl),
h AS (SELECT domain_id, node, rank FROM x WHERE NOT (last <= '7' AND rank = 0) AND last NOT IN ('0', 'f') AND NOT (last IN ('1', '2') AND rank = 1))"""
LISTING = f"""{COUNTED}, k AS (SELECT domain_id, count(*) - 1 AS n_replicas FROM pl GROUP BY domain_id),
ls AS (
  SELECT reg.domain_id, name, chunk, pl.node, pl.rank = 0 AS owner, n_replicas, ct.num_entries, CASE WHEN ct.num_entries IS NULL THEN 'noreply' ELSE 'ok' END AS reply
  FROM reg JOIN pl ON reg.domain_id = pl.domain_id JOIN k ON k.domain_id = pl.domain_id
  LEFT JOIN ct ON ct.domain_id = pl.domain_id AND ct.node = pl.node AND substr(md5(ct.node), 1, 1) NOT IN ('0', '1'))"""
AB = f"{E}, a AS (SELECT * FROM e WHERE ord % 10 <> 0), b AS (SELECT * FROM e WHERE ord % 7 <> 0)"


def _leaves(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT i::INTEGER AS leaf, coalesce(bit_xor(entry_id), 0)::BIGINT AS hash, count(entry_id) AS n
  FROM range(8192) AS x(i) LEFT JOIN {source} ON (entry_id & 8191) = i GROUP BY i)"""


def _crc(a: str, b: str) -> str:
    """CRC-32 of two 32-bit numbers; the polynomial is a fixed value."""
    octets = ", ".join(f"({x} >> {s}) & 255" for x in (a, b) for s in (24, 16, 8, 0))
    bits = "list_reduce([xor(acc, octet), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce([4294967295::BIGINT, {octets}], lambda acc, octet: {bits}), 4294967295)"


def _tree(leaf_table: str, prefix: str) -> str:
    parts = [f"{prefix}0 AS (SELECT leaf AS idx, hash FROM {leaf_table})"]
    for k in range(1, 14):
        below = f"SELECT idx // 2 AS idx, max(hash) FILTER (idx % 2 = 0) AS x, max(hash) FILTER (idx % 2 = 1) AS y FROM {prefix}{k - 1} GROUP BY idx // 2"
        parts.append(f"{prefix}{k} AS (SELECT idx, {_crc('x', 'y')} AS hash FROM ({below}))")
    every = " UNION ALL ".join(f"SELECT {14 - k} AS level, idx::INTEGER AS idx, hash::BIGINT AS hash FROM {prefix}{k}" for k in range(14))
    return f"{', '.join(parts)}, {prefix} AS ({every})"


def _missing(here: str, there: str) -> str:
    return f"SELECT DISTINCT time, entry_id FROM {here} WHERE (time, entry_id) NOT IN (SELECT (time, entry_id) FROM {there})"


_ROLL = f"WITH RECURSIVE {ROLLED}"
_CODE = """lpad(bin(min(pos)), 32, '0') || coalesce(string_agg(lpad(bin(gap), 2 * length(bin(gap))::INTEGER - 1, '0'), '' ORDER BY pos) FILTER (gap IS NOT NULL), '')
  || CASE WHEN count(*) > 1 THEN '1' ELSE '' END"""

ORACLES: dict[str, str] = {
    "lookup_many": f"WITH {P} SELECT domain, key, pos, value FROM p WHERE key IN ({URGENT})",
    "lookup_single": f"WITH {E} SELECT domain, key, arg_min(value, ord) AS value FROM e WHERE key IN ({URGENT}) GROUP BY domain, key",
    "lookup_via_index": f"WITH {P} SELECT domain, key, pos, value FROM p WHERE key IN ({URGENT})",
    "lookup_key": f"WITH {P} SELECT domain, key, pos, value FROM p WHERE key = (SELECT min(x) FROM ({URGENT}) AS t(x))",
    "positional_read": f"""WITH {P}, q AS (SELECT domain, pos FROM p WHERE ord % 10 = 0 UNION ALL SELECT domain, pos + 1 FROM p WHERE ord % 15 = 1)
SELECT q.domain, q.pos, entry_id, key, CASE WHEN p.pos IS NULL THEN 'invalid_entry' ELSE 'ok' END AS reply FROM q LEFT JOIN p ON p.domain = q.domain AND p.pos = q.pos""",
    "early_stop": f"WITH {E} SELECT domain, ord, key FROM e QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ord) <= {EARLY}",
    "grouped_pairs": f"WITH {E} SELECT key, row_number() OVER (PARTITION BY key ORDER BY ord DESC) - 1 AS nth, ord, value FROM e",
    "folded_scan": f"""WITH {E}, l AS (SELECT size, domain <> lag(domain) OVER (ORDER BY domain, ord) AS turn FROM e)
SELECT count(*) AS n, sum(size)::BIGINT AS size, count(*) FILTER (turn) AS changes FROM l""",
    "frame_values": f"WITH {E} SELECT ord, CASE WHEN ord % 7 <> 0 THEN value END AS value FROM e",
    "json_replies": f"""WITH {E} SELECT ord, '{{"ord":' || ord || ',"domain":"' || domain || '","key":"' || key || '","size":' || size || '}}' AS reply, key FROM e""",
    "entry_positions": f"WITH {P} SELECT domain, ord, entry_id, size, pos FROM p",
    "internal_external_split": f"WITH {DOCS} SELECT ord AS doc_id, flags = 1 AS external, {_bytes('value')}::BIGINT AS value_bytes, size FROM e",
    "scan_dedupe": f"""WITH {SCAN}, l AS (SELECT *, lag(entry_id) OVER (PARTITION BY domain ORDER BY ord) AS prev FROM s)
SELECT domain, ord, entry_id, key FROM l WHERE (prev IS NULL OR prev <> entry_id) AND flags & 2 = 0""",
    "bulk_kv": f"""WITH {SCAN}, l AS (SELECT *, lag(entry_id) OVER (PARTITION BY domain ORDER BY ord) AS prev FROM s WHERE flags = 0)
SELECT domain, ord, key, value FROM l WHERE prev IS NULL OR prev <> entry_id""",
    "distinct_entries": f"WITH {SCAN} SELECT domain, time, entry_id, min(ord) AS ord FROM s GROUP BY domain, time, entry_id",
    "flag_parse": f"""WITH {SCAN} SELECT CASE flags WHEN 1 THEN 'external' WHEN 2 THEN 'iblock' ELSE '' END AS names, count(*) AS n, sum(entry_id)::BIGINT AS id_sum
FROM s GROUP BY flags""",
    "id_dump": f"""WITH {E} SELECT domain, (row_number() OVER (PARTITION BY domain ORDER BY ord) - 1)::BIGINT AS ordinal,
  strftime(make_timestamp(time * 1000000), '%Y/%m/%d %H:%M:%S') AS written,
  lpad(upper(to_hex(time)), 8, '0') || lpad(upper(to_hex(entry_id)), 8, '0') AS sync_id, upper(to_hex(entry_id)) AS entry, (entry_id & 8191)::INTEGER AS leaf FROM e""",
    "reply_frames": f"WITH {E} SELECT ord, {_bytes('value')}::VARCHAR || ' ok ' || value AS frame FROM e",
    "domain_registry": f"WITH RECURSIVE {REGISTRY} SELECT domain_id, name, chunk, {NREPL} AS nrepl, upper(ltrim(domain_id, '0')) AS shown FROM reg",
    "chunk_roll": f"{_ROLL} SELECT domain, ord, chunk FROM r",
    "chunk_sizes": f"{_ROLL} SELECT domain, chunk, count(*) AS n_entries, sum(size)::BIGINT AS size, sum(size) > {CHUNK_LIMIT} AS \"full\" FROM r GROUP BY domain, chunk",
    "stream_chunks": f"{_ROLL} SELECT domain, ord, chunk, pos FROM r",
    "owner_lookup": f"""WITH {RING}, q AS (SELECT event_id, md5(event_id::VARCHAR) AS request_id FROM events)
SELECT event_id, request_id, coalesce(r.node, (SELECT node FROM r WHERE place = 0)) AS node FROM q ASOF LEFT JOIN r ON q.request_id >= r.node_id""",
    "node_sort": f"WITH {NODES} SELECT 'strand-' || upper(node_id) AS name, node_id FROM nodes",
    "node_discovery": f"""WITH {NODES} SELECT 'strand-' || node_id AS name, node_id, host FROM nodes
WHERE host::INTEGER % 3 <> 0 AND host IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 2 = 0)""",
    "ring_neighbours": f"""WITH {RING} SELECT r.node_id, r.node, x.node AS previous_node, y.node AS next_node
FROM r JOIN r x ON x.place = (r.place - 1 + r.total) % r.total JOIN r y ON y.place = (r.place + 1) % r.total""",
    "ring_health": f"""WITH {RING}, l AS (
  SELECT r.node_id, r.node, r.place, r.total, CASE WHEN substr(r.node_id, 1, 1) IN ('3', 'a') THEN r.node ELSE x.node END AS prev_node, y.node AS next_node
  FROM r JOIN r x ON x.place = (r.place - 1 + r.total) % r.total JOIN r y ON y.place = (r.place + 1) % r.total)
SELECT l.node, (b.node = l.prev_node AND b.next_node = l.node) AS ok FROM l JOIN l b ON b.place = (l.place - 1 + l.total) % l.total""",
    "rogue_nodes": f"""WITH {NODES}, s AS (SELECT nodes.*, s_suppkey - 1 AS place FROM nodes JOIN supplier ON s_name = node),
t AS (SELECT *, (place - (SELECT arg_min(place, node_id) FROM s) + (SELECT count(*) FROM s)) % (SELECT count(*) FROM s) AS turn FROM s),
m AS (SELECT *, max(node_id) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM t)
SELECT node_id, node FROM m WHERE node_id <= high""",
    "parallel_rings": f"""WITH {NODES}, k AS (SELECT node_id, node, CASE WHEN substr(node_id, 32, 1) <= '7' THEN 'a' ELSE 'b' END AS ring FROM nodes),
low AS (SELECT ring, min(node_id) AS low FROM k GROUP BY ring)
SELECT node_id, node, ring FROM k WHERE ring = (SELECT arg_max(ring, low) FROM low)""",
    "ring_strangers": f"""WITH {NODES} SELECT node, 'alien' AS kind FROM nodes WHERE substr(node_id, 1, 1) = 'c'
UNION ALL SELECT node, 'unknown' FROM nodes WHERE substr(node_id, 1, 1) = '7'""",
    "successor_candidates": f"""WITH {NODES}, me AS (SELECT arg_min(node_id, node) AS me FROM nodes)
SELECT row_number() OVER (ORDER BY node_id < me, node_id) - 1 AS rank, node_id, node FROM nodes, me WHERE node_id <> me""",
    "replica_placement": f"WITH RECURSIVE {PLACED} SELECT domain_id, node, rank FROM pl",
    "replicated_entries": f"WITH RECURSIVE {PLACED} SELECT pl.domain_id, ord, entry_id, node, rank FROM pl JOIN ch ON ch.domain_id = pl.domain_id",
    "put_target": f"""WITH RECURSIVE {HOLDERS}, s AS (
  SELECT own.domain_id, h.node, (own.at - g.place + own.total) % own.total AS step FROM own JOIN h ON h.domain_id = own.domain_id JOIN g ON g.node = h.node),
m AS (SELECT domain_id, arg_min(node, step) AS node FROM s GROUP BY domain_id)
SELECT own.domain_id, m.node, CASE WHEN m.node IS NULL THEN 'invalid_domain' ELSE 'ok' END AS reply FROM own LEFT JOIN m ON m.domain_id = own.domain_id""",
    "owner_hops": f"""WITH RECURSIVE {HOLDERS} SELECT h.domain_id, h.node, own.node AS owner, (own.at - g.place + own.total) % own.total AS hops
FROM h JOIN own ON own.domain_id = h.domain_id JOIN g ON g.node = h.node WHERE h.node <> own.node""",
    "any_node": f"WITH {NODES} SELECT node_id, node, host FROM nodes ORDER BY md5(node || '7') LIMIT 1",
    "redirect_target": f"""WITH RECURSIVE {COUNTED}, m AS (SELECT domain_id, max(num_entries) AS most, max(num_entries) FILTER (rank = 0) AS own FROM ct GROUP BY domain_id)
SELECT ct.domain_id, arg_min(ct.node, ct.rank) AS node FROM ct JOIN m ON ct.domain_id = m.domain_id
WHERE rank > 0 AND num_entries >= most AND coalesce(own, 0) < most GROUP BY ct.domain_id""",
    "inverted_index": f"WITH {BLOCKS} SELECT domain, block, key_hash, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM o GROUP BY domain, block, key_hash",
    "index_blocks": f"""WITH {BLOCKS}, x AS (SELECT domain, block, max(pos + size) AS range_end, count(*) AS n_entries FROM o GROUP BY domain, block)
SELECT domain, block, coalesce(lag(range_end) OVER (PARTITION BY domain ORDER BY block), 0)::BIGINT AS range_start, range_end, n_entries FROM x""",
    "index_gaps": f"""WITH {POSTED}, b AS (SELECT domain, block, key_hash,
  (32 + coalesce(sum(2 * length(bin(gap)) - 1), 0) + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END)::BIGINT AS bits FROM g GROUP BY domain, block, key_hash)
SELECT *, ((bits + 7) // 8)::BIGINT AS bytes FROM b""",
    "index_codes": f"""WITH {POSTED}, b AS (SELECT domain, block, key_hash, {_CODE} AS code FROM g GROUP BY domain, block, key_hash)
SELECT domain, block, key_hash, hex(from_binary(rpad(code, ((length(code) + 7) // 8 * 8)::INTEGER, '0'))) AS code FROM b""",
    "index_decoded": f"WITH {BLOCKS} SELECT domain, block, key_hash, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM o GROUP BY domain, block, key_hash",
    "index_segments": f"""WITH {BLOCKS}, x AS (SELECT domain, block, key_hash, count(*) AS n, min(pos) AS low FROM o GROUP BY domain, block, key_hash)
SELECT domain, block, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n > 1) AS n_multi,
  max(CASE WHEN low = 0 THEN 0 ELSE length(bin(low)) END)::INTEGER AS value_bits FROM x GROUP BY domain, block""",
    "index_tail": f"""WITH {P}, o AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY ord) - 1) // {BLOCK // 10} AS block FROM p),
k AS (SELECT domain, max(pos + size) AS covered FROM o WHERE block < 3 GROUP BY domain)
SELECT p.domain, p.ord, p.pos FROM p JOIN k ON p.domain = k.domain WHERE p.pos >= k.covered""",
    "leaf_hashes": f"WITH {E}, {_leaves('e', 'l')} SELECT leaf, hash, n FROM l",
    "sync_empty_owner": f"WITH {AB} SELECT DISTINCT time, entry_id FROM b",
    "resync": f"""WITH {AB}, u AS (SELECT time, entry_id, key FROM a UNION SELECT time, entry_id, key FROM b)
SELECT 'owner' AS copy, time, entry_id, key FROM u UNION ALL SELECT 'replica', time, entry_id, key FROM u""",
    "tree_dump": f"""WITH {E}, {_leaves('e', 'l')}, {_tree('l', 't')} SELECT 'T' AS kind, level, idx, lpad(upper(to_hex(hash)), 8, '0') AS value FROM t
UNION ALL SELECT 'L', 14, (entry_id & 8191)::INTEGER, lpad(upper(to_hex(time)), 8, '0') || lpad(upper(to_hex(entry_id)), 8, '0') FROM e""",
    "posting_stream": f"WITH {E} SELECT domain, {_hash('key')} AS key_hash, count(*) AS n, min(ord) AS first FROM e GROUP BY domain, {_hash('key')}",
    "leaf_counts": f"WITH {E}, {_leaves('e', 'l')} SELECT min(n) AS least, quantile_disc(n, 0.5) AS middle, max(n) AS most, sum(n)::BIGINT AS total FROM l",
    "merkle_tree": f"WITH {E}, {_leaves('e', 'l')}, {_tree('l', 't')} SELECT level, idx, hash FROM t",
    "merkle_descent": f"WITH {AB}, {_leaves('a', 'la')}, {_leaves('b', 'lb')} SELECT la.leaf FROM la JOIN lb ON la.leaf = lb.leaf WHERE la.hash <> lb.hash",
    "leaf_diff": f"WITH {AB}, {_leaves('a', 'la')}, {_leaves('b', 'lb')} SELECT la.leaf, la.hash AS hash_a, lb.hash AS hash_b FROM la JOIN lb ON la.leaf = lb.leaf WHERE la.hash <> lb.hash",
    "sync_send": f"WITH {AB} {_missing('a', 'b')}",
    "sync_request": f"WITH {AB} {_missing('b', 'a')}",
    "sync_outbox": f"""WITH {AB}, q AS (SELECT time, entry_id, 'a' AS requester FROM ({_missing("b", "a")}) UNION SELECT time, entry_id, 'c' FROM b WHERE ord % 11 = 0)
SELECT q.requester, b.time, b.entry_id, b.key FROM b JOIN q ON b.time = q.time AND b.entry_id = q.entry_id""",
    "sync_inbox": f"""WITH {AB}, v AS (SELECT time, entry_id, key, ord AS arrival FROM b UNION ALL SELECT time, entry_id, 'late', ord + 1000000000 FROM b WHERE ord % 5 = 0)
SELECT time, entry_id, key FROM a UNION ALL
SELECT time, entry_id, arg_max(key, arrival) FROM v WHERE (time, entry_id) NOT IN (SELECT (time, entry_id) FROM a) GROUP BY time, entry_id""",
    "replica_consistency": f"""WITH {AB}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE (time, entry_id) NOT IN (SELECT (time, entry_id) FROM a)),
x AS (SELECT *, 'a' AS replica FROM u UNION ALL SELECT *, 'b' FROM u WHERE ord % 1000 <> 1 OR domain > 'c'),
h AS (SELECT domain, replica, entry_id & 8191 AS leaf, bit_xor(entry_id) AS hash, count(*) AS n, sum(size) AS size FROM x GROUP BY ALL),
w AS (SELECT domain, replica, sum(n) AS n, sum(size) AS size, string_agg(leaf::VARCHAR || ':' || hash::VARCHAR, ',' ORDER BY leaf) FILTER (hash <> 0) AS root FROM h GROUP BY ALL)
SELECT domain, count(*) AS n_replicas, count(DISTINCT n) <= 1 AS counts_agree, count(DISTINCT size) <= 1 AS sizes_agree, count(DISTINCT root) <= 1 AS leaves_agree FROM w GROUP BY domain""",
    "external_census": f"""WITH {DOCS} SELECT domain, count(*) AS n_external, count(*) FILTER (ord NOT IN (SELECT doc_id FROM labels)) AS n_missing FROM e WHERE flags = 1 GROUP BY domain""",
    "external_missing": f"WITH {DOCS} SELECT ord AS doc_id, domain FROM e WHERE flags = 1 AND ord NOT IN (SELECT doc_id FROM labels)",
    "recent_stats": f"""SELECT key, rank::INTEGER AS rank, ts, value FROM (
  SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank, ts, value FROM events) WHERE rank <= {FRESH}""",
    "replica_status": f"WITH {E} SELECT 'n1' AS node, domain AS domain_id, count(*) AS num_entries, sum(size)::BIGINT AS size, sum(size) > {CHUNK_LIMIT} AS \"full\" FROM e GROUP BY domain",
    "domain_listing": f"WITH RECURSIVE {LISTING} SELECT * FROM ls",
    "node_domains": f"WITH RECURSIVE {LISTING} SELECT domain_id, name, chunk, owner, n_replicas, reply FROM ls WHERE node = (SELECT min(node) FROM ls)",
    "domain_by_name": f"""WITH RECURSIVE {LISTING} SELECT domain_id, name, chunk, count(*) AS n_copies, count(*) FILTER (reply = 'ok') AS n_replies, max(num_entries) AS num_entries
FROM ls WHERE name = 'click' GROUP BY domain_id, name, chunk""",
    "domain_status": f"""WITH RECURSIVE {LISTING} SELECT row_number() OVER (ORDER BY owner DESC, node) - 1 AS place, node, owner, num_entries, reply
FROM ls WHERE domain_id = (SELECT min(domain_id) FROM ls)""",
    "replica_report": f"""WITH RECURSIVE {COUNTED}, m AS (SELECT domain_id, max(num_entries) AS most FROM ct WHERE rank > 0 GROUP BY domain_id)
SELECT ct.domain_id, node, rank = 0 AS owner, num_entries, size, size > {CHUNK_LIMIT} AS "full",
  (CASE WHEN rank = 0 THEN coalesce(most, 0) ELSE 0 END)::BIGINT AS max_repl_entries FROM ct LEFT JOIN m ON m.domain_id = ct.domain_id""",
    "ring_report": f"""WITH {RING} SELECT r.node, x.node AS previous_node, y.node AS next_node, true AS ok, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS free
FROM r JOIN r x ON x.place = (r.place - 1 + r.total) % r.total JOIN r y ON y.place = (r.place + 1) % r.total JOIN supplier ON s_name = r.node""",
    "recent_live": f"""SELECT key, rank::INTEGER AS rank, ts, value FROM (
  SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank, ts, value FROM events) WHERE rank <= {FRESH}""",
    "domain_filter": f"WITH RECURSIVE {REGISTRY} SELECT name, chunk, domain_id FROM reg WHERE contains(name, 'c')",
    "log_round_trip": f"WITH {E} SELECT time, entry_id, flags, size, key, value FROM e",
    "log_tail": f"WITH {E} SELECT time, entry_id, size, key FROM e",
    "log_external_values": f"WITH {DOCS} SELECT entry_id, flags = 1 AS external, size, md5(value) AS value_md5 FROM e",
}
