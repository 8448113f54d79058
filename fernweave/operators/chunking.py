"""Documents to parent units and child chunks. Greedy splitting depends on what came before, so
it runs as Python over Arrow batches, a row at a time; nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import CHILD_MAX, CHILD_TARGET, PARENT_MAX, PARENT_TARGET

MARK = re.compile(r"(?<=[。！？；;])")
CHUNKS = "unit_id string, unit_index int, chunk_id string, chunk_index int, start int, end int, content string"
UNITS = "unit_id string, unit_index int, start int, end int, content string"
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def pieces_of(text: str) -> list[str]:
    """Paragraphs between blank lines, cut after sentence marks."""
    return [p.strip() for para in re.split(r"\n{2,}", text) for p in MARK.split(para) if p.strip()]


def split_text(text: str, target: int, most: int, base: int = 0) -> list[tuple[str, int, int]]:
    """(content, start, end) of greedy pieces: a buffer is given out when the next sentence would reach the target; a
    sentence too long that meets an empty buffer is cut hard. Places are looked up from the last end on."""
    whole = text.strip()
    if not whole:
        return []
    if len(whole) <= target:
        return [(whole, base, base + len(whole))]
    found, buffer = [], ""
    for piece in pieces_of(whole):
        joined = buffer + piece
        if len(joined) < target:
            buffer = joined
        elif buffer:
            found.append(buffer)
            buffer = piece
        elif len(joined) > most:
            found += [joined[k : k + most] for k in range(0, len(joined), most)]
        else:
            buffer = joined
    if buffer:
        found.append(buffer)
    out, at = [], 0
    for content in found:
        place = whole.find(content, at)
        place = at if place < 0 else place
        out.append((content, base + place, base + place + len(content)))
        at = place + len(content)
    return out


def _split(docs: DataFrame, key: str, text: str, out: str, columns: str, rows_of: Callable[[object, str], list[tuple]]) -> DataFrame:
    """The rows of each document, after its key, which stays a string or is a long."""
    kind = "string" if docs.select(key).schema[0].dataType == StringType() else "long"
    schema = pa.schema([(out, ARROW[kind]), *((n, ARROW[t]) for n, t in (c.split() for c in columns.split(", ")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *row) for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in rows_of(doc, body or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col(key).cast(kind), text).mapInArrow(run, f"{out} {kind}, {columns}")


def unit_documents(docs: DataFrame, key: str, text: str, parent: tuple[int, int] = (PARENT_TARGET, PARENT_MAX)) -> DataFrame:
    """Each document's parent units: key, unit_id, unit_index, start, end, content."""
    return _split(docs, key, text, key, UNITS, lambda doc, body: [(f"unit:{doc}:{u:04d}", u, start, end, content) for u, (content, start, end) in enumerate(split_text(body, *parent), 1)])


def chunk_documents(docs: DataFrame, key: str, text: str, parent: tuple[int, int] = (PARENT_TARGET, PARENT_MAX), child: tuple[int, int] = (CHILD_TARGET, CHILD_MAX), out: str = "doc_id") -> DataFrame:
    """Each document's child chunks with the unit that they are part of; chunks are numbered through the document."""

    def rows_of(doc: object, body: str) -> list[tuple]:
        rows: list[tuple] = []
        for u, (content, a, _) in enumerate(split_text(body, *parent), 1):
            for piece, start, end in split_text(content, *child, a):
                n = len(rows) + 1
                rows.append((f"unit:{doc}:{u:04d}", u, f"chunk:{doc}:{n:04d}", n, start, end, piece))
        return rows

    return _split(docs, key, text, out, CHUNKS, rows_of)


def dictionary_hits(chunks: DataFrame, key: str, text: str, terms: dict[str, str]) -> DataFrame:
    """(key, name, label, pos) of the dictionary terms that a chunk contains, by place, longer first, name. The
    dictionary is a parameter of fixed size."""
    entries = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("label"), F.locate(n, F.col(text)).alias("at")) for n, v in terms.items()))
    found = F.filter(entries, lambda e: e["at"] > 0)
    ordered = F.array_sort(F.transform(found, lambda e: F.struct(e["at"].alias("at"), (-F.length(e["name"])).alias("n"), e["name"].alias("name"), e["label"].alias("label"))))
    return chunks.select(key, F.posexplode(ordered).alias("pos", "e")).select(key, F.col("e.name").alias("name"), F.col("e.label").alias("label"), "pos")


def rule_relations(hits: DataFrame, key: str, rules: dict[tuple[str, str], str]) -> DataFrame:
    """Relations between two terms of one chunk whose labels have a rule."""
    a = hits.select(key, F.col("name").alias("source"), F.col("label").alias("a"))
    b = hits.select(key, F.col("name").alias("target"), F.col("label").alias("b"))
    rule = F.coalesce(*(F.when((F.col("a") == x) & (F.col("b") == y), r) for (x, y), r in rules.items()))
    return a.join(b, key).where("source <> target").withColumn("relation", rule).where("relation IS NOT NULL").select(key, "source", "target", "relation")
