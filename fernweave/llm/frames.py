"""Independent zstandard frames with a trailing seek table.

The layout is the public seekable format: data frames, then a skippable frame with one entry per data frame
(compressed size, decompressed size, low 32 bits of the XXH64 of the content) and a 9-byte footer. Between the
data frames and the seek table stands one more skippable frame with the caller's index, which plain zstd
readers pass over. A reader fetches the footer, the tables, and then only the frames that it needs.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import xxhash
import zstandard

INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOT_MAGIC = 0x8F92EAB1
LEVEL = 3


def index_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue().to_pybytes())


class FrameWriter:
    """Appends frames to an open file and ends it with the index and the seek table."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.entries = out, []
        self.comp = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def add(self, data: bytes) -> int:
        """Write one frame; its number."""
        packed = self.comp.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return len(self.entries) - 1

    def finish(self, index: pa.Table) -> None:
        body = index_bytes(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        foot = struct.pack("<IBI", len(self.entries), 0x80, FOOT_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(foot)) + table + foot)


class FrameReader:
    """Random access to the frames of a file; nothing but the tables is read ahead."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != FOOT_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * n - 8
        head, length = struct.unpack("<II", self.at(start, 8))
        if head != SEEK_MAGIC or length != 12 * n + 9:
            raise ValueError("damaged seek table")
        raw = self.at(start + 8, 12 * n)
        self.entries = [struct.unpack_from("<III", raw, 12 * k) for k in range(n)]
        self.starts, at = [], 0
        for packed, _, _ in self.entries:
            self.starts.append(at)
            at += packed
        head, length = struct.unpack("<II", self.at(at, 8))
        if head != INDEX_MAGIC or at + 8 + length != start:
            raise ValueError("damaged index")
        plain = zstandard.ZstdDecompressor().decompress(self.at(at + 8, length))
        self.index = pa.ipc.open_stream(plain).read_all()
        self.decomp = zstandard.ZstdDecompressor()

    def at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError("the file is too short")
        return data

    def frame(self, k: int) -> bytes:
        packed, plain, check = self.entries[k]
        data = self.decomp.decompress(self.at(self.starts[k], packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return data
