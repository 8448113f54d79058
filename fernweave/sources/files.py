"""Files to text: listing, classification, decoding by type, and the rows of a source.

Files are read by Spark's binary reader, so any file system that Spark reaches will do. Decoding runs over Arrow
batches of few files.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File types that are read, and the size from which a JSON file is left out.
TEXT_SUFFIXES = ("txt", "md", "csv", "json")
DOCUMENT_SUFFIXES = ("docx", "pdf")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg")
MAX_JSON_BYTES = 20 * 1024 * 1024

PARSED = "path string, text string, content_type string, status string"
PARSED_SCHEMA = pa.schema([("path", pa.string()), ("text", pa.string()), ("content_type", pa.string()), ("status", pa.string())])
Recognizer = Callable[[bytes, str], str]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content of all files below a folder but hidden ones, which Spark doesn't list; the content is read only where it
    is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def skip_reason(path: Column, length: Column, images: bool = True, max_json: int = MAX_JSON_BYTES) -> Column:
    """Why a file isn't imported; null where it is."""
    name = F.element_at(F.split(path, "/"), -1)
    known = [*TEXT_SUFFIXES, *DOCUMENT_SUFFIXES, *(IMAGE_SUFFIXES if images else ())]
    return F.when(F.startswith(name, F.lit(".")), "hidden").when((suffix(path) == "json") & (length > max_json), "large_json").when(~suffix(path).isin(known), "unsupported")


def importable(files: DataFrame, **options) -> DataFrame:
    return files.where(skip_reason(F.col("path"), F.col("length"), **options).isNull()).orderBy("path")


def skip_counts(files: DataFrame, **options) -> DataFrame:
    return files.select(skip_reason(F.col("path"), F.col("length"), **options).alias("reason")).where("reason IS NOT NULL").groupBy("reason").count()


def decode(raw: bytes) -> str:
    """UTF-8, else GB18030, else UTF-8 without what isn't."""
    for name in ("utf-8", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "ignore")


def docx_text(raw: bytes) -> str:
    """Paragraphs outside tables, then table rows, read from the document's XML."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    lines = [text(p) for p in body.findall(f"{w}p")]
    lines += [" | ".join(text(c) for c in row.findall(f"{w}tc")) for table in body.findall(f"{w}tbl") for row in table.findall(f"{w}tr")]
    return "\n".join(x for x in lines if x.strip())


def parse(name: str, raw: bytes, recognize: Recognizer | None = None) -> tuple[str, str, str]:
    """(text, content type, status) of a file."""
    kind = name.rpartition(".")[2].lower()
    if kind in IMAGE_SUFFIXES or kind == "pdf":
        text = recognize(raw, f"image/{kind}") if recognize else ""
        return text.strip(), "ocr" if text else "text", "parsed" if text.strip() else "requires_ocr"
    if kind == "csv":
        text, content = "\n".join(" | ".join(c.strip() for c in row) for row in csv.reader(io.StringIO(decode(raw)))), "table"
    elif kind == "json":
        text, content = json.dumps(json.loads(decode(raw)), ensure_ascii=False, indent=2), "text"
    elif kind == "docx":
        text, content = docx_text(raw), "text"
    else:
        text, content = decode(raw), "text"
    return re.sub(r"\r\n?", "\n", text).strip(), content, "parsed"


def parse_files(files: DataFrame, recognize: Recognizer | None = None) -> DataFrame:
    """path, text, content_type, status of each file; a file that can't be read has status `failed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((path, *parse(path, raw or b"", recognize)))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    rows.append((path, "", "text", "failed"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PARSED_SCHEMA)], schema=PARSED_SCHEMA)

    return files.select("path", "content").mapInArrow(run, PARSED)


def object_key(checksum: Column, name: Column) -> Column:
    """A key below the checksum with a name of plain signs."""
    return F.concat_ws("/", F.lit("sources"), F.substring(checksum, 1, 12), F.regexp_replace(name, r"[^0-9A-Za-z一-鿿._-]+", "_"))


def sources(files: DataFrame) -> DataFrame:
    """A row for each distinct content: source_id, checksum, filename, object_key, status."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.sha2("content", 256).alias("checksum"), name.alias("filename")).groupBy("checksum").agg(F.min("filename").alias("filename"))
    return rows.select(F.concat(F.lit("source:uploaded:"), F.substring("checksum", 1, 12)).alias("source_id"), "checksum", "filename", object_key(F.col("checksum"), F.col("filename")).alias("object_key"), F.lit("uploaded").alias("status"))
