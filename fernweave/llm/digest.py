"""Operator 4: improbable-feature digests of documents.

Method: every window of 64 bytes has an entropy; how rare its entropy is among all windows of the corpus ranks it.
In each run of 16 windows the leftmost rarest one is a feature, and in each run of 16 pieces of 8 bytes the leftmost one
of least hash; texts of every size have both, by the same runs, so a text and its cut or edited copy meet however long
they are. Features go in text order into a chain of 2048-bit Bloom filters of at most 160 features each, five bits a
feature. Two chains are as like as their filters' bits overlap beyond chance.

The rank table is counted over all windows of all documents and has a fixed size. Documents are compared with
their neighbours in id order: they are dealt by ranges of ids, and each range also gets the first document of
the next.

Defined results: a null or empty text has an empty fingerprint; a text shorter than a window has pieces only, one shorter
than a piece has itself as its feature. Two equal fingerprints have likeness 1, an empty one and another 0. A null id sorts first, rows that repeat an id are
ordered by text. A single row is its own next. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import U, mix

WIDTH, PIECE, RUN, PER_FILTER, BITS, HASHES = 64, 8, 16, 160, 2048, 5
BINS = 1001
CHUNK = 1 << 17
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

_K = np.arange(WIDTH + 1)
_F = np.zeros(WIDTH + 1)
_F[1:] = _K[1:] * np.log2(_K[1:])
#: What one more byte of k there already adds to the sum of k log k, in 2^-20.
_STEP = np.round(np.diff(_F) * (1 << 20)).astype(np.int64)
_TOP = int(_STEP.sum())


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of 64 bytes, 0 to 1000."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WIDTH):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    total = np.empty(n - WIDTH + 1, np.int64)
    total[0] = _STEP[before[:WIDTH]].sum()
    np.cumsum(_STEP[before[WIDTH:]] - _STEP[after[: n - WIDTH]], out=total[1:])
    total[1:] += total[0]
    return (_TOP - total) * (BINS - 1) // _TOP


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK bytes."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def starts_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.cumsum(sizes) - sizes, sizes


def window_starts(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin+1, … for count windows of each text."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - begin, count)


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows have each entropy."""
    out = np.zeros(BINS, np.int64)
    for a, e in chunks(texts):
        begin, size = starts_of(texts[a:e])
        bins = entropy_bins(np.frombuffer(b"".join(texts[a:e]), np.uint8))
        out += np.bincount(bins[window_starts(begin, np.maximum(size - WIDTH + 1, 0))], minlength=BINS)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, the rarest first; entropies that no window has rank as rare as the rarest."""
    return np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(np.uint64)


def least_of_runs(order: np.ndarray, begin: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Places below n that are the leftmost least of a run of RUN places of their text; order has the places' own."""
    at_bits = U(n.bit_length())
    valid = window_starts(begin, count)
    key = np.full(n + RUN, np.iinfo(np.uint64).max, np.uint64)
    key[valid] = order << at_bits | valid.astype(np.uint64)
    have = 1
    while have < RUN:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    runs = window_starts(begin, np.where(count > 0, np.maximum(count - RUN + 1, 1), 0))
    least = (key[runs] & ((U(1) << at_bits) - U(1))).astype(np.int64)
    return least[np.diff(least, prepend=-1) > 0]


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's features in text order."""
    out: list[np.ndarray] = []
    for a, e in chunks(texts):
        part = texts[a:e]
        begin, size = starts_of(part)
        begin = begin + RUN * np.arange(len(part))  # a gap after each text, so that no run reaches the next one
        data = np.frombuffer(b"".join(t + b"\0" * RUN for t in part) + b"\0" * WIDTH, np.uint8)
        windows = np.maximum(size - WIDTH + 1, 0)
        wide = least_of_runs(rank[entropy_bins(data)[window_starts(begin, windows)]], begin, windows, len(data))
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WIDTH)[wide]).view("<u8")
        h = np.zeros(len(wide), np.uint64)
        for k in range(8):
            h = mix(h + eight[:, k] + U(0x9E3779B97F4A7C15))
        pieces = np.where(size > 0, np.maximum(size - PIECE + 1, 1), 0)
        at = window_starts(begin, pieces)
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, PIECE)).view("<u8").reshape(-1)
        mixed = np.zeros(len(data), np.uint64)
        mixed[at] = mix(words[at] + np.repeat(size < PIECE, pieces).astype(np.uint64))
        narrow = least_of_runs(mixed[at] >> U(len(data).bit_length()), begin, pieces, len(data))
        places, marks = np.concatenate([wide, narrow]), np.concatenate([h, mixed[narrow]])
        order = np.argsort(places, kind="stable")
        edges = np.searchsorted(places[order], np.append(begin, len(data)))
        out += np.split(marks[order], edges[1:-1])
    return out


def filters(marks: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters of feature hashes: a row of 32 64-bit words each."""
    n = -(-len(marks) // PER_FILTER)
    bits = np.zeros((n, BITS), np.uint8)
    row = np.arange(len(marks)) // PER_FILTER
    for k in range(HASHES):
        bits[row, (marks >> U(11 * k) & U(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def as_string(chain: np.ndarray) -> str:
    return base64.b64encode(chain.astype("<u8").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").reshape(-1, BITS // 64)


def one_way(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of a of the best likeness to a filter of b: their shared bits beyond chance."""
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.zeros(len(a))
    for k in range(len(b)):
        both = np.bitwise_count(a & b[k]).sum(1, dtype=np.int64)
        most = np.minimum(na, nb[k])
        chance = na * nb[k] / BITS
        best = np.maximum(best, np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), both >= most))
    return float(np.clip(best, 0, 1).mean())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) != len(b):
        return one_way(a, b) if len(a) < len(b) else one_way(b, a)
    return (one_way(a, b) + one_way(b, a)) / 2


def rank_table(texts: DataFrame) -> np.ndarray:
    """rarity() over every window of every text; 1001 numbers reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            total += histogram([t.encode() for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_pydict({"bin": pa.array(range(BINS), pa.int32()), "n": pa.array(total, pa.int64())})

    counts = np.zeros(BINS, np.int64)
    for r in texts.select("text").mapInArrow(tally, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r.bin] = r.n
    return rarity(counts)


def in_ranges(docs: DataFrame) -> DataFrame:
    """Documents with the range of ids that they fall in, and in each range once more, as `tail`, the first
    document after it (after the last range: of the first)."""
    spark = docs.sparkSession
    texts = common.whole_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = 3 * common.shuffle_partitions(spark)
    cuts = texts.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 100 * n).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts))
    # the number of cuts at or below the key, by binary search in an array of a fixed number of cuts
    texts = texts.withColumn("part", F.lit(0))
    step = 1 << len(cuts).bit_length() >> 1
    while step:
        table, up = F.array(*[F.lit(c).cast("long") for c in cuts]), F.col("part") + step
        texts = texts.withColumn("part", F.when((up <= len(cuts)) & (F.get(table, up - 1) <= F.col("key")), up).otherwise(F.col("part")))
        step //= 2
    first = sorted((r.part, r.key) for r in texts.groupBy("part").agg(F.min("key").alias("key")).collect())
    if not first:
        return texts.withColumn("tail", F.lit(0))
    after = {key: first[k - 1][0] for k, (_, key) in enumerate(first)}  # a few numbers for each range
    heads = spark.createDataFrame([(key, part) for key, part in after.items()], "key long, part int")
    tails = texts.drop("part").join(F.broadcast(heads), "key").withColumn("tail", F.lit(1))
    cols = ["part", "tail", "key", "doc_id", "text"]
    both = texts.withColumn("tail", F.lit(0)).select(cols).union(tails.select(cols))
    return both.repartition(common.shuffle_partitions(spark), "part").sortWithinPartitions("part", "tail", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; and its likeness to the next one."""
    common.short_batches(docs.sparkSession, 128)
    rank = rank_table(common.whole_text(docs))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            for part, tail, _, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == part:
                    yield held[1], held[2], text
                held = None if tail else (part, doc, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for x in pairs(batches):
            block.append(x)
            size += len(x[1])
            if size >= CHUNK:
                yield digest(block, rank)
                block, size = [], 0
        if block:
            yield digest(block, rank)

    return in_ranges(docs).mapInArrow(run, OUT)


def digest(block: list[tuple], rank: np.ndarray) -> pa.RecordBatch:
    """Rows for documents in order, each with the text of the next."""
    texts, edited = [t for _, t, _ in block], []
    for _, text, after in block:
        n = len(text) // 2
        edited.append((text[: len(text) - n] + after[:n]).encode())
    own = [t.encode() for t in texts]
    last = block[-1][2].encode()
    chains = [filters(m) for m in features([*own, *edited, last], rank)]
    n, rows = len(block), []
    for k, (doc, text, after) in enumerate(block):
        following = k + 1 if k + 1 < n and texts[k + 1] == after else (2 * n if k + 1 == n else None)
        other = chains[following] if following is not None else filters(features([after.encode()], rank)[0])
        rows.append((doc, len(text), hashlib.sha256(edited[k]).hexdigest(), as_string(chains[k]), as_string(chains[n + k]), likeness(chains[k], chains[n + k]), likeness(chains[k], other)))
    return common.to_batch(rows, OUT_SCHEMA)


def op4_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
