"""Operator 1: WARC archives as seekable zstandard bundles.

Method: records are grouped into independent frames, a seek table ends the file, and an index maps each record
identifier to its frame and the offset inside it (frames.py). Records with equal payloads of at least 1000
bytes keep one response, the record with the largest id; the others are revisit records that refer to it.

Defined results: a null html is the empty payload; a payload longer than a frame's size is a frame of its own with what
came before it; a null id is lower than any other and never the one referred to unless all are null; rows that repeat id
and payload are all written alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .frames import FrameReader, FrameWriter

FRAME_BYTES = 1 << 18
REVISIT_BYTES = 1000
URN = "urn:fernweave:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([("record_id", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, frame long"
OUT_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in OUT.split(", "))])


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the records that revisit another; only digests are shuffled."""
    keys = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    sha = hashlib.sha1(payload).digest()
    body = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>", f"Fernweave-Payload-Length: {len(payload)}"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(sha).decode(), "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return fields, body


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages (page_id, url, html) now, a bundle per task; the manifest (file, records) as DataFrame."""
    spark = pages.sparkSession
    common.short_batches(spark)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    again = revisits(plain).select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "refers_to")
    rows = plain.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (b for b in batches if b.num_rows)
        first = next(full, None)
        if first is None:
            return
        name, index, held, size, frame = f"{path}/{TaskContext.get().partitionId():08d}.warc.zst", [], [], 0, 0
        with common.AtomicFile(name) as out:
            writer = FrameWriter(out)
            for batch in chain([first], full):
                for page, url, html, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = record(page, url, html.encode(), other)
                    index.append((f"{URN}{'' if page is None else page}", frame, size, len(raw)))
                    held.append(raw)
                    size += len(raw)
                    if size >= FRAME_BYTES:
                        frame = writer.add(b"".join(held)) + 1
                        held, size = [], 0
            if held:
                writer.add(b"".join(held))
            writer.finish(pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*index, strict=True), INDEX, strict=True)], schema=INDEX))
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [len(index)]})

    return spark.createDataFrame(rows.mapInArrow(write, "file string, records long").collect(), "file string, records long")


def number(urn: str) -> int | None:
    n = urn.strip("<>").removeprefix(URN)
    return int(n) if n else None


def records_of(name: str) -> Iterator[tuple]:
    with common.open_input(name) as source:
        reader, now, data = FrameReader(source), -1, b""
        for _, frame, offset, length in zip(*(c.to_pylist() for c in reader.index.columns), strict=True):
            if frame != now:
                now, data = frame, reader.frame(frame)
            fields, body = parse(data[offset : offset + length])
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
            kind = fields["WARC-Type"]
            if kind == "response" and hashlib.sha1(body).digest() != digest:
                raise ValueError("a payload doesn't fit its digest")
            size = len(body) if kind == "response" else int(fields["Fernweave-Payload-Length"])
            other = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
            yield number(fields["WARC-Record-ID"]), size, digest.hex(), kind, other, fields.get("WARC-Target-URI"), name, frame


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the bundles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                yield from common.batches_of(records_of(name), OUT_SCHEMA)

    return manifest.repartition(max(1, manifest.count()), "file").mapInArrow(read, OUT)


def fetch(name: str, record_id: str) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record; only its frame is decompressed."""
    with common.open_input(name) as source:
        reader = FrameReader(source)
        row = next((r for r in reader.index.to_pylist() if r["record_id"] == record_id), None)
        if row is None:
            raise KeyError(record_id)
        return parse(reader.frame(row["frame"])[row["offset"] : row["offset"] + row["length"]])


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages`, archived and read back."""
    records = read_archives(write_archives(common.table(spark, sf_dir, "pages"), common.new_dir(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first = p.page_id THEN NULL ELSE f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 1000
"""
