"""Operator 9: media columns as MPEG transport streams.

Method: a payload is cut into access units, each in one PES packet with a presentation timestamp, carried by
188-byte transport packets after a program association and a program map table. Each unit starts with a packet
that is marked as random-access point. Reading parses both tables, checks sync bytes, table checksums and the
continuity counters, reassembles the elementary packets and returns their timestamps and random-access points.

Defined results: a null text is the empty one and gives one padded block; a text of any length is one stream in
memory, about 1.1 times its bytes, whose timestamps wrap at 2^33 ticks as the format has it; equal texts give equal
values, so there are no ties; rows that repeat an id, null ids included, stay; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

BLOCK = 576  # samples of 10 ms at 57.6 kHz
UNIT = 16 * BLOCK
TICKS = 900  # of the 90 kHz clock in a block
PACKET, PMT_PID, DATA_PID, PRIVATE_STREAM = 188, 0x100, 0x101, 0xBD
MEDIA = "doc_id long, n_bytes long, media binary, timestamps array<long>, random_access array<long>"
MEDIA_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64()))])
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units long, last_timestamp long, random_access_points long"
OUT_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in OUT.split(", "))])


@cache
def crc_table() -> tuple[int, ...]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ crc_table()[(c >> 24) ^ b]
    return c


def table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A transport packet with one section of a program table."""
    section = bytes([table_id]) + struct.pack(">H", 0xB000 | (5 + len(body) + 4)) + struct.pack(">HBBB", number, 0xC1, 0, 0) + body
    section += struct.pack(">I", section_crc(section))
    packet = struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section
    return packet + b"\xff" * (PACKET - len(packet))


@cache
def tables() -> bytes:
    programs = table_packet(0, 0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    streams = table_packet(PMT_PID, 0x02, 1, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", 0x06, 0xE000 | DATA_PID, 0xF000))
    return programs + streams


@cache
def layout(length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For a PES packet of `length` bytes: the transport packets without it, where its bytes go, their number."""
    rest, packets, places = length, [], []
    while rest:
        first = not packets
        field = 2 if first else 0  # an adaptation field that marks the random-access point
        room = PACKET - 4 - field
        if rest < room:
            field += room - rest
        packet = bytearray(b"\xff" * PACKET)
        packet[0:4] = struct.pack(">BHB", 0x47, (0x4000 if first else 0) | DATA_PID, 0x30 if field else 0x10)
        if field:
            packet[4] = field - 1
            if field > 1:
                packet[5] = 0x40 if first else 0
        start = len(packets) * PACKET + 4 + field
        taken = PACKET - 4 - field
        places.append(np.arange(start, start + taken))
        packets.append(bytes(packet))
        rest -= taken
    return np.frombuffer(b"".join(packets), np.uint8), np.concatenate(places), len(packets)


def pes_head(length: int, pts: int) -> bytes:
    stamp = struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)
    return struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, length + 8, 0x80, 0x80, 5) + stamp


def mux(payload: bytes) -> tuple[bytes, list[int], list[int]]:
    """The transport stream of a payload of whole blocks, its timestamps and the packet numbers of its
    random-access points."""
    out, stamps, points, packets, at = [tables()], [], [], 2, 0
    data = np.frombuffer(payload, np.uint8)
    while at < len(data):
        n = UNIT if len(data) - at >= UNIT else len(data) - at
        units = (len(data) - at) // n if n == UNIT else 1
        plain, places, count = layout(n + 14)
        block = np.tile(plain, (units, 1))
        own = [(at + k * n) // BLOCK * TICKS for k in range(units)]
        heads = np.frombuffer(b"".join(pes_head(n, t % (1 << 33)) for t in own), np.uint8).reshape(units, 14)
        block[:, places[:14]] = heads
        block[:, places[14:]] = data[at : at + units * n].reshape(units, n)
        flags = block.reshape(-1, PACKET)[:, 3]
        flags |= ((packets - 2 + np.arange(units * count)) & 15).astype(np.uint8)
        out.append(block.tobytes())
        stamps += own
        points += range(packets, packets + units * count, count)
        packets += units * count
        at += units * n
    return b"".join(out), stamps, points


def section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    start = 5 + raw[4]
    length = struct.unpack_from(">H", raw, start + 1)[0] & 0xFFF
    whole = raw[start : start + 3 + length]
    if raw[start] != table_id or section_crc(whole):
        raise ValueError("damaged program table")
    return whole[8:-4]


def demux(media: bytes) -> tuple[bytes, list[int], list[int]]:
    """The payload of the first program's first stream, its timestamps, and the packets that are random-access
    points; ValueError on lost sync, a damaged table or a gap in the continuity counters."""
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if not (packets[:, 0] == 0x47).all():
        raise ValueError("lost sync")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    programs = section(packets[np.flatnonzero(pid == 0)[0]], 0x00)
    pmt = struct.unpack_from(">HH", programs)[1] & 0x1FFF
    streams = section(packets[np.flatnonzero(pid == pmt)[0]], 0x02)
    skip = 4 + (struct.unpack_from(">H", streams, 2)[0] & 0xFFF)
    data_pid = struct.unpack_from(">BH", streams, skip)[1] & 0x1FFF
    numbers = np.flatnonzero(pid == data_pid)
    own = packets[numbers]
    counters = own[:, 3] & 15
    if len(own) > 1 and ((counters[1:] - counters[:-1]) & 15 != 1).any():
        raise ValueError("continuity counters have a gap")
    has_field = own[:, 3] & 0x20 != 0
    offset = np.where(has_field, 5 + own[:, 4].astype(np.int32), 4)
    points = numbers[has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)]
    data = own[np.arange(PACKET) >= offset[:, None]].tobytes()
    ends = np.cumsum(PACKET - offset)
    starts = (ends - (PACKET - offset))[own[:, 1] & 0x40 != 0].tolist()
    parts, stamps = [], []
    for at, end in zip(starts, [*starts[1:], len(data)], strict=True):
        code, length, _, _, head = struct.unpack_from(">IHBBB", data, at)
        if code >> 8 != 1 or at + 6 + length != end:
            raise ValueError("damaged elementary packet")
        a, b, c = struct.unpack_from(">BHH", data, at + 9)
        stamps.append((a >> 1 & 7) << 30 | b >> 1 << 15 | c >> 1)
        parts.append(data[at + 9 + head : end])
    return b"".join(parts), stamps, points.tolist()


def feature(samples: np.ndarray, stamps: list[int]) -> str:
    """Length in milliseconds, mean, spread, mean step between samples, and the share of each 16th of the range."""
    wide = samples.astype(np.int64)
    shares = np.bincount(samples >> 4, minlength=16) * 1000 // len(samples)
    step = int(np.abs(np.diff(wide)).sum()) * 1000 // max(1, len(wide) - 1)
    total, squares = int(wide.sum()), int((wide * wide).sum())
    variance = (squares * len(wide) - total * total) // (len(wide) * len(wide))
    return f"{(stamps[-1] + TICKS) // 90}:{total * 1000 // len(wide)}:{variance}:{step}:" + ".".join(map(str, shares))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and the text's padded UTF-8 as a transport stream with its index."""
    common.short_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                rows.append((doc, len(raw), *mux(raw + b"\xff" * (BLOCK if not raw else -len(raw) % BLOCK))))
            yield common.to_batch(rows, MEDIA_SCHEMA)

    return common.whole_text(docs).mapInArrow(write, MEDIA)


def from_media(media: DataFrame) -> DataFrame:
    """Digests and features of what the stored streams hold."""
    common.short_batches(media.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, stream, known, ways in zip(*(batch.column(f.name).to_pylist() for f in MEDIA_SCHEMA), strict=True):
                payload, stamps, points = demux(stream)
                if stamps != known or points != ways:
                    raise ValueError(f"the index of {doc} doesn't fit its stream")
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(np.frombuffer(payload, np.uint8), stamps), len(stamps), stamps[-1], len(points)))
            yield common.to_batch(rows, OUT_SCHEMA)

    return media.mapInArrow(read, OUT)


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` as a stored transport stream, read back."""
    media = common.materialize(to_media(common.table(spark, sf_dir, "documents")), "media")
    return from_media(media)
