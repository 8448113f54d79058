"""Operator 7: encoding and decoding with a table of distinct words.

Method: Spark splits the texts into words. Blocks of some megabytes of text keep their documents as numbers of the
block's distinct words, in a file each in the shared folder; both are written once, so nothing is read twice in hope of
the same order, and documents aren't shuffled. The distinct words go to the parts of the word table, dealt by a hash of the word, where each distinct word of the corpus is encoded
once. Ids come back to their block, one block at a time, and are joined to the documents by word number and position;
decoding joins the ids with the table of ids and pieces, which is as long as the vocabulary.

The rows that travel are packed (the words or ids of one block and part of the table in one row), as a row for each
word and block takes more disk than the texts.

The vocabulary must drop white space and cut at it (Encoder.kind "word").

Defined results: a null or empty text, or one of white space, has no ids and decodes to the empty text; a text of any
length is in one block; equal texts get equal values; rows that repeat an id, null ids included, stay; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .exchange import unzip_array, zip_array
from .tokenize import Encoder, encoder

BLOCK_BYTES = 1 << 24
DOCS = -1  # dest of the row with a block's documents; words have the number of their part of the table
DDL = "block long, dest int, data binary, sizes binary"
SCHEMA = pa.schema([("block", pa.int64()), ("dest", pa.int32()), ("data", pa.binary()), ("sizes", pa.binary())])
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def split_words(docs: DataFrame) -> DataFrame:
    """doc_id and the words of its text, with empty ones where white space follows white space."""
    return common.whole_text(docs).select("doc_id", F.split(F.translate("text", "\n\t\r", "   "), " ").alias("words"))


def planes(x: np.ndarray, level: int = 3) -> bytes:
    """Numbers below 2^32 with all their lowest bytes first, then the next ones, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), level)


def from_planes(x: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view("<u4").reshape(-1)


def numbered(words: DataFrame, tables: int, folder: str) -> DataFrame:
    """For each block a row with the file of its documents as word numbers, and one for each part of the word table with the
    block's words there. Words are numbered by frequency; what follows the numbers is each word's place in the order by
    part. Each attempt of a task writes files of its own, and only rows of the attempt that counts name them."""

    def block_rows(block: int, held: list[pa.RecordBatch]) -> list[tuple]:
        ids = pa.concat_arrays([b.column(0) for b in held])
        lists = pa.concat_arrays([b.column(1) for b in held])
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        real = np.fromiter((w != "" for w in names), bool, len(names))
        kept = real[index] if len(names) else np.zeros(0, bool)
        ends = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(sizes)))]
        index = index[kept]
        by_count = np.argsort(-np.bincount(index, minlength=len(names)), kind="stable")
        by_count = by_count[real[by_count]]
        number = np.zeros(len(names), np.int64)
        number[by_count] = np.arange(len(by_count))
        dest = np.fromiter((zlib.crc32(names[k].encode()) % tables for k in by_count.tolist()), np.int64, len(by_count))
        order = np.argsort(dest, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        head = np.column_stack([pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), np.diff(ends)]).astype(np.int64)
        name = f"{folder}/{block}-{uuid.uuid4().hex}.zst"
        with common.AtomicFile(name) as out:
            out.write(planes(np.concatenate([number[index], place]), 6))
        rows: list[tuple] = [(block, DOCS, name.encode(), zip_array(head))]
        bounds = np.searchsorted(dest[order], np.arange(tables + 1))
        by_part = by_count[order].tolist()
        for d in np.flatnonzero(np.diff(bounds)).tolist():
            rows.append((block, d, zstandard.compress("\n".join(names[k] for k in by_part[bounds[d] : bounds[d + 1]]).encode(), 3), b""))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                for row in block_rows(block, held):
                    yield common.to_batch([row], SCHEMA)
                block, held, size = block + 1, [], 0
        if held:
            for row in block_rows(block, held):
                yield common.to_batch([row], SCHEMA)

    return words.mapInArrow(run, DDL)


def encoded(asked: DataFrame, tokenizer: str) -> DataFrame:
    """asked: the words of blocks, sorted by part of the table. The ids of each row's words; a part of the table encodes each
    distinct word once and is dropped before the next one is begun."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now, known = encoder(tokenizer), None, {}
        for batch in batches:
            for block, dest, data in zip(*(batch.column(c).to_pylist() for c in ("block", "dest", "data")), strict=True):
                if dest != now:
                    now, known = dest, {}
                words = zstandard.decompress(data).decode().split("\n")
                for w in words:
                    if w not in known:
                        known[w] = enc.piece(w)
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), "<u4", len(ids)) // 4
                yield common.to_batch([(block, dest, planes(np.frombuffer(b"".join(ids), "<u4")), planes(sizes))], SCHEMA)

    return asked.mapInArrow(run, DDL)


def piece_table(tokenizer: str) -> pa.Table:
    """id and piece, with the space that parts it from the next one, of the whole vocabulary."""
    tok = encoder(tokenizer).tok
    n = tok.get_vocab_size()
    return pa.table({"id": pa.array(range(n), pa.int64()), "piece": pa.array([f"{tok.id_to_token(k) or ''} " for k in range(n)], pa.large_string())})


def pieces_of(ids: np.ndarray, pieces: pa.Table) -> pa.LargeStringArray:
    """The piece of each id, by a join of the distinct ids with the table."""
    distinct, which = np.unique(ids, return_inverse=True)
    joined = pa.table({"id": pa.array(distinct, pa.int64())}).join(pieces, "id", join_type="left outer").sort_by("id")
    found = joined.column("piece").combine_chunks()
    if found.null_count:
        raise ValueError("an id is not in the vocabulary")
    return found.take(pa.array(which.reshape(-1)))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each span, in a row."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def restored(name: bytes, head: bytes, answers: list[tuple[bytes, bytes]], pieces: pa.Table) -> pa.RecordBatch:
    """A block's documents from the ids of its words, given in order of the parts of the table."""
    table = unzip_array(head, np.int64).reshape(-1, 3)
    with common.open_input(name.decode()) as source:
        both = from_planes(source.read()).astype(np.int64)
    n = int(table[:, 2].sum())
    numbers, place = both[:n], both[n:]
    flat = np.concatenate([from_planes(d) for d, _ in answers] or [np.zeros(0, "<u4")])
    sizes = np.concatenate([from_planes(s) for _, s in answers] or [np.zeros(0, "<u4")]).astype(np.int64)
    if len(sizes) != len(place):
        raise RuntimeError("a block got answers for another number of words")
    starts = np.cumsum(sizes) - sizes
    own, size = place[numbers], sizes[place[numbers]]
    ids = flat[spans(starts[own], size)].astype("<u4")
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(table[:, 2])))]
    named = pieces_of(ids, pieces)
    text, text_at = memoryview(named.buffers()[2] or b""), np.frombuffer(named.buffers()[1], np.int64, len(named) + 1)[ends].tolist()
    view, at = memoryview(ids.tobytes()), ends.tolist()
    shas = [hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
    decoded = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(text_at, text_at[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0], pa.int64(), mask=table[:, 1] == 1), pa.array(np.diff(ends), pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], schema=OUT_SCHEMA)


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian, 32 bits) and of the decoded text."""
    if Encoder(tokenizer).kind != "word":
        raise ValueError("the tokenizer must drop white space and cut at it")
    spark = docs.sparkSession
    common.short_batches(spark)
    parts = common.shuffle_partitions(spark)
    blocks = common.materialize(numbered(split_words(docs), 3 * parts, common.new_dir(spark, "numbers")), "blocks")
    asked = blocks.where(F.col("dest") != DOCS).repartition(parts, "dest").sortWithinPartitions("dest")
    both = blocks.where(F.col("dest") == DOCS).unionByName(encoded(asked, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, docs_, answers = piece_table(tokenizer), None, []
        for batch in batches:
            for _, dest, data, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if dest != DOCS:
                    answers.append((data, sizes))
                    continue
                if docs_ is not None:
                    yield restored(*docs_, answers, pieces)
                docs_, answers = (data, sizes), []
        if docs_ is not None:
            yield restored(*docs_, answers, pieces)

    return both.repartition(parts, "block").sortWithinPartitions("block", "dest").mapInArrow(run, OUT)


def op7_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with the 49k word vocabulary."""
    import public_tokenizers

    return encode_and_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
