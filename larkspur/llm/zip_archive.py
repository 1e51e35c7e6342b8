"""ZIP directories read by ranges: nothing is extracted, nothing read whole.

Central directories and their ZIP64 forms are parsed from the end of the file;
a stored member's bytes are then any range of the file. Deflated members can
be read whole. Encrypted members and archives of several disks are refused.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass


class BytesSource:
    """Ranges of bytes in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class FileSource:
    """Ranges of a file in any store that pyarrow reads."""

    def __init__(self, uri: str):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int  # 0 stored, 8 deflated
    flags: int
    crc: int
    packed: int
    size: int
    header_at: int


_END, _CENTRAL, _LOCAL = struct.Struct("<IHHHHIIH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHHIIIHH")
_END64, _LOCATOR64 = struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")


class ZipArchive:
    def __init__(self, source):
        self.source = source
        self.members = {m.name: m for m in self._directory()}
        self._data_at: dict[str, int] = {}

    def _directory(self) -> list[Member]:
        total = self.source.size()
        tail_at = max(0, total - (_END.size + 65535 + _LOCATOR64.size))
        tail = self.source.read(tail_at, total - tail_at)
        at = len(tail)
        while True:  # the last end record whose comment reaches the end of the file
            at = tail.rfind(b"PK\x05\x06", 0, at)
            if at < 0:
                raise ValueError("no end of a central directory")
            if at + _END.size <= len(tail) and at + _END.size + _END.unpack_from(tail, at)[7] == len(tail):
                break
        _, disk, first_disk, _, count, size, start, _ = _END.unpack_from(tail, at)
        end_at = tail_at + at
        located = at - _LOCATOR64.size
        if located >= 0 and tail[located : located + 4] == b"PK\x06\x07":
            _, disk64, where, _ = _LOCATOR64.unpack_from(tail, located)
            record = self.source.read(where, _END64.size)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            _, _, _, _, disk, first_disk, _, count, size, start = _END64.unpack(record)
            end_at, disk = where, disk or disk64
        if disk or first_disk:
            raise ValueError("an archive of several disks")
        if start + size > end_at:
            raise ValueError("a central directory that runs into its end record")
        data, at, members = self.source.read(start, size), 0, []
        for _ in range(count):
            head = _CENTRAL.unpack_from(data, at)
            if head[0] != 0x02014B50:
                raise ValueError("a broken central directory")
            _, _, _, flags, method, _, _, crc, packed, full, n_name, n_extra, n_comment, _, _, _, header_at = head
            at += _CENTRAL.size
            name = data[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            packed, full, header_at = _wide(data[at + n_name : at + n_name + n_extra], full, packed, header_at)
            at += n_name + n_extra + n_comment
            members.append(Member(name, method, flags, crc, packed, full, header_at))
        return members

    def data_at(self, name: str) -> int:
        """Where a member's bytes begin."""
        if name not in self._data_at:
            m = self.members[name]
            if m.flags & 1:
                raise ValueError("an encrypted member")
            head = _LOCAL.unpack(self.source.read(m.header_at, _LOCAL.size))
            if head[0] != 0x04034B50:
                raise ValueError("no local header where the directory points")
            self._data_at[name] = m.header_at + _LOCAL.size + head[9] + head[10]
        return self._data_at[name]

    def read_range(self, name: str, at: int, n: int) -> bytes:
        """Bytes of a stored member."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError("only stored members have ranges")
        if at < 0 or n < 0 or at + n > m.size:
            raise ValueError("a range beyond the member")
        return self.source.read(self.data_at(name) + at, n)

    def read(self, name: str) -> bytes:
        """A whole small member, such as an index; its checksum is verified."""
        m = self.members[name]
        data = self.source.read(self.data_at(name), m.packed)
        if m.method == 8:
            data = zlib.decompressobj(-15).decompress(data)
        elif m.method != 0:
            raise ValueError(f"compression method {m.method}")
        if len(data) != m.size or zlib.crc32(data) != m.crc:
            raise ValueError(f"{name} is damaged")
        return data


def _wide(extra: bytes, full: int, packed: int, header_at: int) -> tuple[int, int, int]:
    """Sizes and place, from the ZIP64 field where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            full = next(values) if full == 0xFFFFFFFF else full
            packed = next(values) if packed == 0xFFFFFFFF else packed
            header_at = next(values) if header_at == 0xFFFFFFFF else header_at
        at += 4 + n
    return packed, full, header_at


def write_stored(members: dict[str, bytes], zip64: bool = False) -> bytes:
    """An archive of stored members; zip64 writes the wide records even where they aren't needed."""
    out, central = bytearray(), bytearray()
    for name, data in members.items():
        raw, crc, at, n = name.encode(), zlib.crc32(data), len(out), len(data)
        wide = zip64 or n >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        size32 = 0xFFFFFFFF if wide else n
        local = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        out += _LOCAL.pack(0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size32, size32, len(raw), len(local)) + raw + local + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central += _CENTRAL.pack(0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size32, size32, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + extra
    start, size, count = len(out), len(central), len(members)
    out += central
    if zip64 or count >= 0xFFFF or start + size >= 0xFFFFFFFF:
        at = len(out)
        out += _END64.pack(0x06064B50, 44, 45, 45, 0, 0, count, count, size, start) + _LOCATOR64.pack(0x07064B50, 0, at, 1)
        out += _END.pack(0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        out += _END.pack(0x06054B50, 0, 0, count, count, size, start, 0)
    return bytes(out)
