"""Operator 12: lines that stand in several documents, by range-partitioned hashes and keep bitmaps.

Method:
1. A task hashes the keys of its lines (128 bits) and sorts those of some megabytes of text by hash, document and place. Of
   one hash in such a block only the rows of the smallest document travel, as a map-side combine: the others hold
   a line that stands earlier and are settled there and then. So a line that stands everywhere sends a row a block.
2. Hashes are uniform, so ranges of equal width are balanced without sampling: a row goes to the partition of its range,
   and partitions are sorted by hash, document and place. A stream over a partition meets the first occurrence of a hash
   first and remembers that document alone; rows of other documents are reported with their places.
3. Reported places meet by document and become a bit for each line, packed and compressed. Texts take no part in any of
   this; they are joined with their bitmaps once, at the end, where lines are cut.

A line's key is the line without spaces and \\x09-\\x0D at both ends, A-Z in lower case; lines end at \\n.

Defined results: a null or empty text is one empty line; a text of any length is split whole; a null id counts as the
smallest; rows that share an id are one document, so a line in two of them isn't repeated by that and stays in both, and
each row gets its own result; an empty table gives no rows; further columns are ignored. Keys are compared by a 128-bit
cryptographic hash. A block holds BLOCK_BYTES of text or, if that is longer, one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points that a key has at least.
SHORTEST = 10
BLOCK_BYTES = 32 << 20
SPACE = b" \t\n\v\f\r"
#: Stands for a null id inside the operator; it is the smallest.
NO_ID = -(1 << 63)
#: Rows of hashes have no n_lines; rows of documents have it, and pass.
PLACED = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n_lines", pa.int32()), ("first", pa.int32()), ("places", pa.binary())])
PLACED_DDL = "hi long, lo long, doc_id long, mark long, n_lines int, first int, places binary"
DROPPED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary())])
DROPPED_DDL = "doc_id long, mark long, n_lines int, places binary"
BITMAPS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
BITMAPS_DDL = "doc_id long, mark long, n_lines long, n_dropped long, keep binary"


def marked(docs: DataFrame) -> DataFrame:
    """doc_id (a null one as NO_ID), text and its hash; the pair of id and hash names a row."""
    return common.whole_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("mark", F.xxhash64("text"))


def key_of(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """The key of a line; None if it is too short to be compared."""
    key = line.strip(SPACE).lower()
    if len(key) < shortest or (len(key) < 4 * shortest and len(key.decode()) < shortest):
        return None
    return key


class Block:
    """Line hashes of some texts."""

    def __init__(self) -> None:
        self.digests, self.row, self.place = bytearray(), [], []
        self.docs: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, doc: int, mark: int, text: bytes, shortest: int) -> None:
        lines = text.split(b"\n")
        for place, line in enumerate(lines):
            if (key := key_of(line, shortest)) is not None:
                self.digests += hashlib.blake2b(key, digest_size=16).digest()
                self.row.append(len(self.docs))
                self.place.append(place)
        self.docs.append((doc, mark, len(lines)))
        self.size += len(text)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The rows that travel, and a row a document with the places that are settled."""
        pair = np.frombuffer(bytes(self.digests), "<i8").reshape(-1, 2)
        row, place = np.array(self.row, np.int64), np.array(self.place, np.int32)
        ids, marks, counts = (np.array(x, np.int64) for x in zip(*self.docs, strict=True))
        order = np.lexsort((place, row, ids[row], pair[:, 1], pair[:, 0]))
        hi, lo, row, place = pair[order, 0], pair[order, 1], row[order], place[order]
        new = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))[: len(hi)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(hi)), 0)) if len(hi) else row
        goes = ids[row] == ids[row[start]]
        later = ~goes
        settled = np.lexsort((place[later], row[later]))
        at = np.searchsorted(row[later][settled], np.arange(len(ids) + 1))
        local = place[later][settled]
        yield packed(marks, np.zeros(len(ids), np.int64), ids, marks, counts, local, at)
        hi, lo, row, place = hi[goes], lo[goes], row[goes], place[goes]
        edge = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (row[1:] != row[:-1])))[: len(hi)])
        for a in range(0, len(edge), 1 << 16):
            part = edge[a : a + (1 << 16)]
            ends = np.append(part, edge[a + len(part)] if a + len(part) < len(edge) else len(hi))
            yield packed(hi[part], lo[part], ids[row[part]], marks[row[part]], np.zeros(len(part), np.int64), place, ends)


def packed(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, mark: np.ndarray, n_lines: np.ndarray, places: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """A batch of PLACED; row k has places[ends[k]:ends[k + 1]]."""
    data = places[ends[0] : ends[-1]].astype("<i4")
    offsets = (ends - ends[0]).astype(np.int32) * 4
    lists = pa.Array.from_buffers(pa.binary(), len(hi), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    first = np.where(ends[1:] > ends[:-1], np.append(places, 0)[np.minimum(ends[:-1], len(places))], 0)
    return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(doc), pa.array(mark), pa.array(n_lines.astype(np.int32)), pa.array(first.astype(np.int32)), lists], schema=PLACED)


def hashed(docs: DataFrame, shortest: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        block = Block()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), texts, strict=True):
                block.add(doc, mark, text.as_py(), shortest)
                if block.size >= block_bytes:
                    yield from block.rows()
                    block = Block()
        if block.docs:
            yield from block.rows()

    return marked(docs).select("doc_id", "mark", "text").mapInArrow(run, PLACED_DDL)


def after_the_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by hash, document and place: those of a hash whose document isn't its first one."""
    last, owner = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc, lines = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc_id", "n_lines"))
        passes = lines > 0
        at = np.flatnonzero(~passes)
        out = passes.copy()
        if len(at):
            h, low, d = hi[at], lo[at], doc[at]
            new = np.concatenate(([last != (h[0], low[0])], (h[1:] != h[:-1]) | (low[1:] != low[:-1])))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
            owners = np.where(begin >= 0, d[np.maximum(begin, 0)], owner)
            out[at] = d != owners
            last, owner = (h[-1], low[-1]), owners[-1]
        if out.any():
            yield batch.filter(pa.array(out)).select(DROPPED.names)


def to_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by document, a document's own row first: a compressed bit for each of its lines."""
    zip_ = zstandard.ZstdCompressor(level=3)

    def row(key: tuple[int, int], n_lines: int, places: list[bytes]) -> tuple:
        keep = np.ones(n_lines, bool)
        keep[np.frombuffer(b"".join(places), "<i4")] = False
        return (*key, n_lines, int(n_lines - keep.sum()), zip_.compress(np.packbits(keep).tobytes()))

    def rows() -> Iterator[tuple]:
        now, n_lines, places = None, 0, []
        for batch in batches:
            for doc, mark, lines, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, mark) != now:
                    if now is not None:
                        yield row(now, n_lines, places)
                    now, n_lines, places = (doc, mark), lines, []
                if found:
                    places.append(found)
        if now is not None:
            yield row(now, n_lines, places)

    yield from common.batches_of(rows(), BITMAPS)


def keep_bitmaps(docs: DataFrame, shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id (a null one as NO_ID), mark (hash of the text), n_lines, n_dropped and keep: the zstandard-compressed bits of
    the lines, first line in the highest bit, one row for each pair of id and text."""
    parts = common.shuffle_partitions(docs.sparkSession)
    common.short_batches(docs.sparkSession)
    place_of = F.expr(f"cast(shiftright(shiftrightunsigned(hi, 33) * {parts}L, 31) as int)")
    ranges = hashed(docs, shortest, block_bytes).repartitionById(parts, place_of).sortWithinPartitions("hi", "lo", "doc_id", "mark", "first")
    found = ranges.mapInArrow(after_the_first, DROPPED_DDL).repartition(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", F.desc("n_lines"))
    return found.mapInArrow(to_bitmaps, BITMAPS_DDL)


def kept_lines(text: str, keep: bytes, n_lines: int) -> str:
    """The lines of a text whose bit is set."""
    bits = np.unpackbits(np.frombuffer(zstandard.decompress(keep), np.uint8), count=n_lines)
    return "\n".join(line for line, b in zip(text.split("\n"), bits.tolist(), strict=True) if b)


def deduplicate_lines(docs: DataFrame, shortest: int = SHORTEST, texts: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs (and with `texts` kept_text)."""
    ddl = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * texts
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, n_lines, n_dropped, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept = kept_lines(text, keep, n_lines) if n_dropped else text
                rows.append((doc, n_lines, n_dropped, hashlib.sha256(kept.encode()).hexdigest(), *[kept] * texts))
            yield common.to_batch(rows, schema)

    joined = marked(docs).join(keep_bitmaps(docs, shortest), ["doc_id", "mark"])
    return joined.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "n_lines", "n_dropped", "keep").mapInArrow(cut, ddl)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: lines of ten code points and more that stand in two documents."""
    return deduplicate_lines(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT keyed.*, coalesce(doc_id <> first, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
