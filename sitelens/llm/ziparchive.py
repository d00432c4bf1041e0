"""Stored-member ZIP files with ZIP64 records: a writer, and a reader by byte ranges.

Only the directory structures and the asked ranges are read; nothing is
extracted.  Members are stored, not deflated, so a byte range of a member is a
byte range of the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

LOCAL = struct.Struct("<IHHHHHIIIHH")
CENTRAL = struct.Struct("<IHHHHHHIIIHHHHHII")
END = struct.Struct("<IHHHHIIH")
END64 = struct.Struct("<IQHHIIQQQQ")
LOCATOR64 = struct.Struct("<IIQI")
LOCAL_MARK, CENTRAL_MARK, END_MARK, END64_MARK, LOCATOR64_MARK = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATE_1980 = 0x21  # 1980-01-01, so that equal contents give equal files


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    size: int
    header_at: int


def zip_chunks(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """The bytes of a ZIP file of stored members; ``zip64`` forces the 64-bit records that large files need."""
    at, directory = 0, []
    for name, parts in members:
        raw, size, crc = name.encode(), sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        large = zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        shown = FULL32 if large else size
        yield LOCAL.pack(LOCAL_MARK, 45 if large else 20, 0x800, 0, 0, DATE_1980, crc, shown, shown, len(raw), len(extra)) + raw + extra
        yield from parts
        far = zip64 or at >= FULL32
        fields = struct.pack("<QQ", size, size) * large + struct.pack("<Q", at) * far
        extra_central = struct.pack("<HH", 1, len(fields)) + fields if fields else b""
        directory.append(
            CENTRAL.pack(CENTRAL_MARK, 45, 45 if large or far else 20, 0x800, 0, 0, DATE_1980, crc, shown, shown, len(raw), len(extra_central), 0, 0, 0, 0, FULL32 if far else at)
            + raw
            + extra_central
        )
        at += LOCAL.size + len(raw) + len(extra) + size
    central, n = b"".join(directory), len(directory)
    yield central
    if zip64 or n >= FULL16 or at >= FULL32 or len(central) >= FULL32:
        yield END64.pack(END64_MARK, END64.size - 12, 45, 45, 0, 0, n, n, len(central), at)
        yield LOCATOR64.pack(LOCATOR64_MARK, 0, at + len(central), 1)
        yield END.pack(END_MARK, 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
    else:
        yield END.pack(END_MARK, 0, 0, n, n, len(central), at, 0)


def read_directory(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """All members, from the end record, the ZIP64 records if any, and the central directory.

    ``read(at, n)`` gives a byte range of the file of ``size`` bytes.
    """
    tail_at = max(0, size - END.size - FULL16 - LOCATOR64.size)
    tail = read(tail_at, size - tail_at)
    mark = struct.pack("<I", END_MARK)
    at = tail.rfind(mark)
    while at >= 0 and (at + END.size > len(tail) or at + END.size + END.unpack_from(tail, at)[-1] != len(tail)):
        at = tail.rfind(mark, 0, at + len(mark) - 1)  # the mark may also stand in the comment
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = END.unpack_from(tail, at)
    if at >= LOCATOR64.size and struct.unpack_from("<I", tail, at - LOCATOR64.size)[0] == LOCATOR64_MARK:
        end64_at = LOCATOR64.unpack_from(tail, at - LOCATOR64.size)[2]
        count, length, start = END64.unpack(read(end64_at, END64.size))[7:]
    data, p, members = read(start, length), 0, []
    for _ in range(count):
        f = CENTRAL.unpack_from(data, p)
        if f[0] != CENTRAL_MARK:
            raise ValueError("broken central directory")
        method, crc, packed, plain, n_name, n_extra, n_comment, header_at = f[4], f[7], f[8], f[9], f[10], f[11], f[12], f[16]
        p += CENTRAL.size
        name, extra = data[p : p + n_name].decode("utf-8"), data[p + n_name : p + n_name + n_extra]
        p += n_name + n_extra + n_comment
        packed, header_at = _wide(extra, plain, packed, header_at)
        members.append(Member(name, method, crc, packed, header_at))
    return members


def _wide(extra: bytes, plain: int, packed: int, header_at: int) -> tuple[int, int]:
    """Sizes and offset with the ZIP64 field's values for those that are full."""
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, p)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
            if plain == FULL32:
                next(values)
            if packed == FULL32:
                packed = next(values)
            if header_at == FULL32:
                header_at = next(values)
        p += 4 + n
    return packed, header_at


def data_start(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where a stored member's bytes begin in the file."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = LOCAL.unpack(read(member.header_at, LOCAL.size))
    if head[0] != LOCAL_MARK:
        raise ValueError(f"{member.name} has no local header")
    return member.header_at + LOCAL.size + head[9] + head[10]
