"""The binary form of log entries: encoding, checked decoding, recovery after damage."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from ..schemas import FLAG_EXTERNAL, FLAG_INDEX, HEADER_BYTES, MAGIC_HEAD, MAGIC_TAIL, MAX_INLINE, OVERHEAD_BYTES

_HEAD = struct.pack("<I", MAGIC_HEAD)
_TAIL = struct.pack("<I", MAGIC_TAIL)
_FIELDS = "<7I"  # time, entry id, flags, key CRC, key length, value CRC, value length


class Entry(NamedTuple):
    pos: int
    size: int
    time: int
    entry_id: int
    flags: int
    key: bytes
    value: bytes  # as stored: of an external entry, its link


class Truncated(Exception):
    """The data end inside an entry."""


def encode(key: bytes, stored: bytes, time: int, entry_id: int, flags: int = 0) -> bytes:
    """Bytes of an entry; ValueError for a key that is too long or a number beyond 32 bits."""
    if len(key) >= MAX_INLINE:
        raise ValueError(f"a key has fewer than {MAX_INLINE} bytes, not {len(key)}")
    try:
        fields = struct.pack(_FIELDS, time, entry_id, flags, zlib.crc32(key), len(key), zlib.crc32(stored), len(stored))
    except struct.error as error:
        raise ValueError("a header field does not fit into 32 bits") from error
    return b"".join((_HEAD, struct.pack("<I", zlib.crc32(fields)), fields, key, stored, _TAIL))


def made(key: bytes, value: bytes, time: int, entry_id: int, flags: int = 0) -> tuple[bytes, str | None]:
    """(bytes of the entry, file name of the value if it is external)."""
    if len(value) < MAX_INLINE and not flags & FLAG_INDEX:
        return encode(key, value, time, entry_id, flags), None
    crc = zlib.crc32(value)
    name = f"value-{entry_id:08x}-{crc:08x}"
    return encode(key, struct.pack(">I", crc) + name.encode(), time, entry_id, flags | FLAG_EXTERNAL), name


def link(stored: bytes) -> tuple[int, str]:
    """(CRC, file name) of an external entry's stored value."""
    return struct.unpack(">I", stored[:4])[0], stored[4:].decode("utf-8", "replace")


def read_entry(data: bytes, pos: int) -> Entry | None:
    """The entry at exactly pos; None if there is no valid one. Truncated if the data end first."""
    head = data[pos : pos + HEADER_BYTES]
    if not _HEAD.startswith(head[:4]) and head[:4] != _HEAD:
        return None
    if len(head) < HEADER_BYTES:
        raise Truncated
    crc, fields = struct.unpack("<I", head[4:8])[0], head[8:]
    if zlib.crc32(fields) != crc:
        return None
    time, entry_id, flags, key_crc, key_size, value_crc, value_size = struct.unpack(_FIELDS, fields)
    end = pos + OVERHEAD_BYTES + key_size + value_size
    if end > len(data):
        raise Truncated
    body = pos + HEADER_BYTES
    key, value = bytes(data[body : body + key_size]), bytes(data[body + key_size : end - 4])
    if data[end - 4 : end] != _TAIL or zlib.crc32(key) != key_crc or zlib.crc32(value) != value_crc:
        return None
    return Entry(pos, end - pos, time, entry_id, flags, key, value)


def scan(data: bytes, start: int = 0, follow: bool = False) -> Iterator[Entry]:
    """Valid entries from start on. After damage the scan goes on at the next head that begins a valid one.

    An entry that the data cut off hides what lies in its value from a reader
    that follows the file: with ``follow`` the scan ends there. Without it the
    file is final, and what can be read behind a cut head is.
    """
    pos = start
    while 0 <= pos < len(data):
        try:
            entry = read_entry(data, pos)
        except Truncated:
            if follow:
                return
            entry = None
        if entry is None:
            pos = data.find(_HEAD, pos + 1)
        else:
            yield entry
            pos += entry.size


def whole_bytes(data: bytes, start: int = 0) -> int:
    """Position after the last entry that is whole and before which nothing is cut off."""
    end = start
    for entry in scan(data, start, follow=True):
        end = entry.pos + entry.size
    return end
