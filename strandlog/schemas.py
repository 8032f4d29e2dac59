"""Fixed values and schemas of the entry log."""

from __future__ import annotations

# Fixed values of the log format.
MAGIC_HEAD = 0x47DA66B5
MAGIC_TAIL = 0xACC50F5D
HEADER_BYTES = 36
OVERHEAD_BYTES = 40  # header and tail
MAX_INLINE = 4096  # keys and inline values are shorter
FLAG_EXTERNAL = 1
FLAG_INDEX = 2
LEAVES = 8192
BLOCK_ENTRIES = 10_000
CHUNK_BYTES = 104_857_600

#: What the log source returns.
LOG = "file string, pos long, size long, time long, entry_id long, flags int, key binary, value binary, ext_file string, ext_crc long"
#: What the log sink takes.
LOG_IN = "time long, entry_id long, flags int, key binary, value binary"
