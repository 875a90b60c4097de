"""The directory of a ZIP file on any pyarrow file system, read by ranges: end record, ZIP64 records, central directory."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

_TAIL = 22 + 0xFFFF  # the end record with the longest comment
_PIECE = 1 << 20


@dataclass
class Member:
    name: str
    method: int   # 0 is stored
    start: int    # of the content
    packed: int   # bytes in the file
    size: int


def _at(file, start: int, count: int) -> bytes:
    file.seek(start)
    data = file.read(count)
    if len(data) != count:
        raise ValueError(f"the archive ends before byte {start + count}")
    return data


def _directory(file) -> tuple[int, int, int]:
    """Start, bytes and entries of the central directory."""
    total = file.size()
    tail = _at(file, max(0, total - _TAIL), min(total, _TAIL))
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at + 3)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = max(0, total - _TAIL) + at
    if end >= 20 and (locator := _at(file, end - 20, 20))[:4] == b"PK\x06\x07":
        record = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
    return start, length, entries


def _wide(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
    """The three numbers with those that overflow taken from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return tuple(next(wide) if n == 0xFFFFFFFF else n for n in (size, packed, offset))
        at += 4 + length
    return size, packed, offset


def members(file) -> Iterator[Member]:
    """All members, from the central directory read in pieces; contents are not touched."""
    start, length, entries = _directory(file)
    held, at = b"", start
    for _ in range(entries):
        while True:
            if len(held) >= 46:
                name, extra, note = struct.unpack_from("<HHH", held, 28)
                if len(held) >= 46 + name + extra + note:
                    break
            piece = _at(file, at, min(_PIECE, start + length - at))
            if not piece:
                raise ValueError("the central directory is cut off")
            held, at = held + piece, at + len(piece)
        if held[:4] != b"PK\x01\x02":
            raise ValueError("no central directory entry where one should be")
        flags, method = struct.unpack_from("<HH", held, 8)
        packed, size = struct.unpack_from("<II", held, 20)
        offset = struct.unpack_from("<I", held, 42)[0]
        size, packed, offset = _wide(held[46 + name:46 + name + extra], size, packed, offset)
        local = _at(file, offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("no local header where the directory says")
        content = offset + 30 + sum(struct.unpack_from("<HH", local, 26))
        yield Member(held[46:46 + name].decode("utf-8" if flags & 0x800 else "cp437"), method, content, packed, size)
        held = held[46 + name + extra + note:]
