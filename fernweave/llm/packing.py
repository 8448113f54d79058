"""Operator 6: bounded-space online best-fit packing.

Method: documents are encoded, longer ones cut into pieces of the sequence length, and each task packs its
pieces in one pass. A packer keeps a fixed number of open bins; a bitset keyed by free space finds the fullest
bin that still takes a piece. When no open bin takes it, a new bin opens, and if there are then too many, the
fullest closes first. Memory is bounded by the number of open bins, so any task takes any number of pieces.

Defined results: a null text is the empty one (one end id); a text longer than a sequence is cut into pieces of the
sequence length, whole; rows that repeat an id, null ids included, are packed each; an empty table gives no rows;
further columns are ignored. Among bins of equal free space the one that got to it last is taken, so ties are settled
by the order of the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenize import encoder

OPEN_BINS = 2048
#: Pieces that one task packs; what its open bins leave free at the end is lost once per so many pieces.
PIECES_PER_TASK = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED_SCHEMA = PIECE_SCHEMA.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


class BestFit:
    """put(length) -> (bin, offset)."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.open, self.bins = 0, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.size:
            raise ValueError(f"a piece of {length} doesn't fit {self.size}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self.take(free)
        else:
            if length < self.size and self.open >= self.open_bins:  # a full piece fills its bin and leaves the open ones alone
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            found, free = self.bins, self.size
            self.bins += 1
        if free > length:
            left = free - length
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.size - free

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        self.open -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return found


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Each document's ids and an end id, cut at multiples of size where longer: doc_id, piece, start, length,
    ids_crc32 of the piece."""
    common.short_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield common.to_batch(rows, PIECE_SCHEMA)

    return common.whole_text(docs).mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, size: int = 4096, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to pieces of (doc_id, piece, start, length, ids_crc32).

    Pieces are dealt by a hash of their document and position, in an order mixed by another hash, so each task
    sees the same mix of lengths; the mix is what online best-fit wants. Full pieces are sequences of their own.
    """
    kept = common.materialize(pieces, "pieces")  # encoded once, though counted and dealt
    tasks = max(1, -(-kept.count() // per_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.put(n) for n in batch.column("length").to_pylist()]
            sequence = pa.array([base + b for b, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in PIECE_SCHEMA), sequence, pa.array([o for _, o in placed], pa.int64())], schema=PACKED_SCHEMA)

    mixed = F.xxhash64("doc_id", "piece", "start")
    dealt = kept.repartition(tasks, "doc_id", "piece").sortWithinPartitions(mixed, "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer, end_id, size), size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, packed into sequences of at most 4096 ids of the 49k word vocabulary."""
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
