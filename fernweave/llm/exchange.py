"""Which hashes stand more than once, counted over the cluster in packed messages.

A task packs the hashes of some megabytes of text (a source) into one message for each block of the hash range. The
task of a block finds what stands more than once and answers each source. A hash that repeats inside a source is
sent once with its count, so a hash found everywhere costs a block one entry per source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

U = np.uint64
NUMBERS, COUNTS = 0, 1
MESSAGE = pa.schema([("dest", pa.int32()), ("src", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("data", pa.binary()), ("often", pa.binary())])
MESSAGE_DDL = "dest int, src long, kind int, docs binary, data binary, often binary"
LOW = 40  # bits that are sent; the block's number adds to them
MASK = (1 << LOW) - 1
OFTEN = np.dtype([("low", "u1", 5), ("count", "<u4")])


def zip_array(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def unzip_array(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), dtype)


def low_bytes(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def from_low(x: bytes | np.ndarray) -> np.ndarray:
    flat = np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.ascontiguousarray(x).reshape(-1)
    wide = np.zeros((len(flat) // 5, 8), np.uint8)
    wide[:, :5] = flat.reshape(-1, 5)
    return wide.view("<u8").reshape(-1)


def keys_of(values: np.ndarray, blocks: int) -> np.ndarray:
    """What an exchange knows of 64-bit values: the block, and the bits that were sent. Equal for all sources."""
    return ((values >> U(LOW)) % U(blocks)) << U(LOW) | values & U(MASK)


def from_answer(x: bytes, dest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the values of a block and the bit lengths of their counts."""
    packed = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return from_low(packed[:, :5]) | U(dest) << U(LOW), packed[:, 5]


def from_answers(parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """from_answer() of several blocks, one after the other."""
    both = [from_answer(x, dest) for x, dest in parts]
    return np.concatenate([v for v, _ in both] or [np.zeros(0, np.uint64)]), np.concatenate([b for _, b in both] or [np.zeros(0, np.uint8)])


def repeated(values: np.ndarray) -> np.ndarray:
    """Whether each value stands more than once."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(values), bool)
    if len(values):
        out[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return out


def split(values: np.ndarray, owner: np.ndarray, docs: int, own: int, blocks: int) -> tuple[np.ndarray, list[tuple]]:
    """values with their documents (ascending) in a source: which repeat inside it, and the messages."""
    twice, rows = repeated(values), []
    lone, lone_owner = values[~twice], owner[~twice]
    often, count = np.unique(values[twice], return_counts=True)
    block_of = lambda x: ((x >> U(LOW)) % U(blocks)).astype(np.int32)
    dest = block_of(lone)
    order = np.argsort(dest, kind="stable")
    low, lone_owner = low_bytes(lone[order]), lone_owner[order]
    bounds = np.searchsorted(dest[order], np.arange(blocks + 1))
    dest2 = block_of(often)
    order2 = np.argsort(dest2, kind="stable")
    packed = np.zeros(len(often), OFTEN)
    packed["low"], packed["count"] = low_bytes(often[order2]), np.minimum(count[order2], 0xFFFFFFFF)
    bounds2 = np.searchsorted(dest2[order2], np.arange(blocks + 1))
    for b in range(blocks):
        a, e, a2, e2 = bounds[b], bounds[b + 1], bounds2[b], bounds2[b + 1]
        if a < e or a2 < e2:
            counts = np.bincount(lone_owner[a:e], minlength=docs).astype("<u4")
            rows.append((b, own, COUNTS, zip_array(counts), low[a:e].tobytes(), packed[a2:e2].tobytes()))
    return twice, rows


def bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of counts, as bytes."""
    return np.ceil(np.log2(x + 1.0)).astype(np.uint8)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """(value, rows) of rows that come sorted by a column; one value's rows are held at a time."""
    now, held = None, []
    for batch in batches:
        for value, row in zip(batch.column(key).to_pylist(), zip(*(c.to_pylist() for c in batch.columns), strict=True), strict=True):
            if held and value != now:
                yield now, held
                held = []
            now = value
            held.append(row)
    if held:
        yield now, held


def to_blocks(sent: DataFrame, parts: int) -> DataFrame:
    """Messages at the task of their block, one block after the other."""
    return sent.repartition(parts, "dest").sortWithinPartitions("dest")


def to_sources(answered: DataFrame, parts: int) -> DataFrame:
    """Messages at the task of their source, one source after the other, its NUMBERS first."""
    return answered.repartition(parts, "src").sortWithinPartitions("src", "kind")


def answer(values_too: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over to_blocks(): for each source the number of repeated values by document
    and, with `values_too`, those values and the ones it had sent with a count, six bytes each: 40 bits and the bit length
    of the value's count in the corpus; `dest` is the block. NUMBERS messages pass."""

    def reply(messages: list[tuple]) -> pa.RecordBatch:
        lone = from_low(b"".join(m[4] for m in messages))
        often = np.frombuffer(b"".join(m[5] for m in messages), OFTEN)
        values = np.concatenate([lone, from_low(often["low"])])
        weight = np.concatenate([np.ones(len(lone), np.int64), often["count"].astype(np.int64)])
        _, which = np.unique(values, return_inverse=True)
        total = np.bincount(which.reshape(-1), weights=weight).astype(np.int64)[which.reshape(-1)] if len(values) else weight
        flag, rows, at, at2 = (total[: len(lone)] > 1).astype(np.int64), [], 0, len(lone)
        sums = np.concatenate(([0], np.cumsum(flag)))
        for _, src, _, docs, data, more in messages:
            ends = at + np.concatenate(([0], np.cumsum(unzip_array(docs, "<u4").astype(np.int64))))
            got, end, end2 = sums[ends], at + len(data) // 5, at2 + len(more) // OFTEN.itemsize
            out = np.zeros((0, 6), np.uint8)
            if values_too:
                take = np.flatnonzero(flag[at:end])
                out = np.column_stack([np.frombuffer(data, np.uint8).reshape(-1, 5)[take], bits(total[at:end][take])])
                more = np.column_stack([low_bytes(values[at2:end2]), bits(total[at2:end2])]).tobytes()
            rows.append((messages[0][0], src, COUNTS, zip_array((got[1:] - got[:-1]).astype("<u4")), out.tobytes(), more if values_too else b""))
            at, at2 = end, end2
        return common.to_batch(rows, MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "dest"):
            if numbers := [r for r in rows if r[2] == NUMBERS]:
                yield common.to_batch(numbers, MESSAGE)
            if messages := [r for r in rows if r[2] != NUMBERS]:
                yield reply(messages)

    return run
