"""Column functions: hashes, ids, bit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FLAG_EXTERNAL, FLAG_INDEX, LEAVES, MAX_INLINE, OVERHEAD_BYTES


def key_hash(key: Column) -> Column:
    """First 32 bits of the md5 of a key, as a non-negative long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def domain_id(name: Column, chunk: Column) -> Column:
    """128-bit id of a chunk of a domain, as 32 lower-case hex digits, which sort as the numbers do."""
    return F.md5(F.concat(chunk.cast("string"), F.lit(" "), name).cast("binary"))


def display_id(id_: Column) -> Column:
    """An id in upper case without leading zeros."""
    return F.upper(F.ltrim(id_, F.lit("0")))


def sync_id_hex(time: Column, entry_id: Column) -> Column:
    """time and entry id, 32 bits each, as 16 upper-case hex digits."""
    return F.concat(F.lpad(F.hex(time), 8, "0"), F.lpad(F.hex(entry_id), 8, "0"))


def leaf(entry_id: Column) -> Column:
    return entry_id.bitwiseAND(F.lit(LEAVES - 1)).cast("int")


def crc_pair(left: Column, right: Column) -> Column:
    """CRC-32 of two 32-bit values, big-endian, one after the other."""
    return F.crc32(F.unhex(F.concat(F.lpad(F.hex(left), 8, "0"), F.lpad(F.hex(right), 8, "0"))))


def bit_width(n: Column) -> Column:
    """Bits of a number's binary form; 0 for 0."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def is_external(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(FLAG_EXTERNAL)) != 0


def is_index(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(FLAG_INDEX)) != 0


def flag_names(flags: Column) -> Column:
    return F.array_compact(F.array(F.when(is_external(flags), F.lit("external")), F.when(is_index(flags), F.lit("iblock"))))


def fits_inline(value: Column) -> Column:
    """Whether a key or a value is stored in the log itself."""
    return F.octet_length(value) < MAX_INLINE


def link_size() -> int:
    """Stored bytes of an external value: its CRC and the name of its file."""
    return 4 + len("value-00000000-00000000")


def stored_size(key: Column, value: Column) -> Column:
    """Bytes of an entry in the log."""
    return (F.octet_length(key) + F.when(fits_inline(value), F.octet_length(value)).otherwise(link_size()) + OVERHEAD_BYTES).cast("long")


def guard_u32(n: Column) -> Column:
    """n, or an error if it does not fit into 32 unsigned bits."""
    return F.when((n >= 0) & (n < 1 << 32), n).otherwise(F.raise_error(F.concat(F.lit("not an unsigned 32-bit number: "), n.cast("string"))).cast("long"))


def frame(value: Column) -> Column:
    """A value of a reply stream: its length in bytes, a code, itself."""
    return F.concat(F.octet_length(value).cast("string"), F.lit(" ok "), value)


def frame_value(framed: Column) -> Column:
    """The value of a frame; null if the frame is not whole or does not say ok."""
    size = F.regexp_extract(framed, r"^(\d+) ok ", 1)
    value = F.substring(framed, F.length(size) + 5, F.length(framed))
    return F.when((size != "") & (F.octet_length(value) == size.try_cast("int")), value)


def path_parts(path: Column) -> Column:
    """The parts of a path that are not empty."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def padded_bytes(bits: Column) -> Column:
    """Bytes that so many bits take."""
    return F.ceil(bits / 8).cast("long")
