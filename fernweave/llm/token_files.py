"""Operator 2: token-id files of independent zstandard frames with a seek table and per-frame checksums.

Method: documents are range-partitioned by id, each task encodes its documents in order and writes one file of
independent frames (frames.py) whose index maps a document to frame and offset, so that a reader decompresses
only the frames of the documents asked for.

Defined results: a null text is the empty one (one end id); a text longer than a frame's size is a frame of its own with
what came before it; a null id sorts first; rows that repeat an id all stay, ordered by text, so ties are between equal
rows; an empty table gives no file and no rows; further columns are ignored. Ids that don't fit id_bytes are an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .frames import FrameReader, FrameWriter
from .tokenize import encoder

FRAME_BYTES = 1 << 18
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.int64()), ("offset", pa.int64())])
MANIFEST = "file string, part long, docs long, tokens long"
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame long"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_bytes: int = 4, partitions: int | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; the manifest (a row per file) as DataFrame.

    Files are numbered in id order. id_bytes: 2 where the vocabulary has at most 65,536 ids, else 4. The write
    runs now; the manifest is as long as the number of files.
    """
    if max(encoder(tokenizer).tok.get_vocab_size() - 1, end_id) >= 1 << 8 * id_bytes:
        raise ValueError(f"ids of {tokenizer} don't fit {id_bytes} bytes")
    spark = docs.sparkSession
    common.short_batches(spark)
    n = partitions or common.shuffle_partitions(spark)
    texts = common.whole_text(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (b for b in batches if b.num_rows)
        first = next(full, None)
        if first is None:
            return
        enc, dtype, part = encoder(tokenizer), f"<u{id_bytes}", TaskContext.get().partitionId()
        end, held, size, frame, index, tokens = np.array([end_id], dtype).tobytes(), [], 0, 0, [], 0
        name = f"{path}/{part:08d}.tokens.zst"
        with common.AtomicFile(name) as out:
            writer = FrameWriter(out)
            for batch in chain([first], full):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = enc.ids(text)
                    if id_bytes != 4:
                        ids = np.frombuffer(ids, "<u4").astype(dtype).tobytes()
                    ids += end
                    index.append((doc, len(ids) // id_bytes, frame, size))
                    tokens += len(ids) // id_bytes
                    held.append(ids)
                    size += len(ids)
                    if size >= FRAME_BYTES:
                        frame = writer.add(b"".join(held)) + 1
                        held, size = [], 0
            if held:
                writer.add(b"".join(held))
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*index, strict=True), INDEX, strict=True)]
            meta = {"id_bytes": str(id_bytes), "end_id": str(end_id)}
            writer.finish(pa.Table.from_arrays(columns, schema=INDEX.with_metadata(meta)))
        yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "docs": [len(index)], "tokens": [tokens]})

    return spark.createDataFrame(texts.mapInArrow(write, MANIFEST).collect(), MANIFEST)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`: the ids in all files before. The sum runs over one row per file."""
    rows, at, out = sorted(manifest.collect(), key=lambda r: r.part), 0, []
    for r in rows:
        out.append((r.file, r.part, at))
        at += r.tokens
    spark = manifest.sparkSession
    frame = spark.createDataFrame(out, "file string, part long, start long")
    return frame.repartition(max(1, len(out)), "part") if out else frame


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, decoded from the files frame by frame: doc_id, start, n_tokens, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), and the file and frame that hold it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("frame", pa.int64())])
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                yield from common.batches_of(documents(name, start), schema)

    return with_starts(manifest).mapInArrow(read, OUT)


def documents(name: str, start: int) -> Iterator[tuple]:
    with common.open_input(name) as source:
        reader = FrameReader(source)
        width, now, data = int(reader.index.schema.metadata[b"id_bytes"]), -1, b""
        for doc, n, frame, offset in zip(*(c.to_pylist() for c in reader.index.columns), strict=True):
            if frame != now:
                now, data = frame, reader.frame(frame)
            ids = data[offset : offset + n * width]
            if width != 4:
                ids = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
            yield doc, start, n, zlib.crc32(ids), name, frame
            start += n


def fetch_tokens(name: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file; only their frames are decompressed."""
    out: dict[int, np.ndarray] = {}
    with common.open_input(name) as source:
        reader = FrameReader(source)
        width, index = int(reader.index.schema.metadata[b"id_bytes"]), reader.index.to_pylist()
        frames: dict[int, bytes] = {}
        for row in index:
            if row["doc_id"] in doc_ids:
                if row["frame"] not in frames:
                    frames = {row["frame"]: reader.frame(row["frame"])}
                out[row["doc_id"]] = np.frombuffer(frames[row["frame"]], f"<u{width}", row["n_tokens"], row["offset"])
    return out


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, written with the 50k byte vocabulary and end id 2, and read back."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, common.new_dir(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, id_bytes=2)
    return read_token_files(manifest)
