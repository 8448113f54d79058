"""Operators as stages of a corpus pipeline: documents in, documents out.

Columns other than doc_id and text pass unchanged, whatever their names; n_chars, where it is there, follows the text. An
empty table gives an empty table with the same columns; null texts pass as they are where nothing is taken out of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, secrets, substring, toxicity
from .jaccard import jaccard_components


def fresh(docs: DataFrame, *stems: str) -> list[str]:
    """Names like the stems that no column of docs has, in any case of letters."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in stems:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(docs: DataFrame) -> list[Column]:
    """The columns by their names, dots and quotes included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def hashable(docs: DataFrame) -> list[Column]:
    """The columns in a form that Spark can hash: those that hold a map, however deep, as JSON."""
    return [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns(docs), docs.schema, strict=True)]


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with another text."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose toxicity score is below the threshold. A null text is scored as the empty one; a text of any length is
    scored whole; rows are judged each by itself, so repeats and null ids need no rule."""
    return toxicity.keep_ordinary(docs, toxicity.fit_sample(toxicity.sample(docs, labels)))


def without_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each group of documents that link, the one with the smallest id; of rows that repeat id and text, the one
    whose columns hash least. Documents without words and rows without an id stay."""
    groups = common.materialize(jaccard_components(docs, n, num, den), "groups")
    common.release(docs.sparkSession)
    key, h, place = fresh(docs, "kept", "h", "place")
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    own = docs.where("doc_id IS NOT NULL").join(kept, docs.doc_id.cast("long") == kept[key], "left_semi").withColumn(h, F.xxhash64("text"))
    order = Window.partitionBy("doc_id", h).orderBy(F.xxhash64(*hashable(docs)))
    first = own.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(columns(docs))
    return first.unionByName(docs.where("doc_id IS NULL"))


def without_repeats(docs: DataFrame, window: int = substring.WINDOW) -> DataFrame:
    """Documents without the words of windows that also start earlier; what is left is joined by spaces. A document
    that loses nothing keeps its text as it is, one that loses all keeps an empty one. Null ids count as the smallest."""
    key, of, left = fresh(docs, "key", "of", "left")
    done = substring.deduplicate(docs, window, texts=True).where("kept_text IS NOT NULL")
    cut = common.materialize(done.select(F.coalesce("doc_id", F.lit(substring.NO_ID)).alias(key), F.col("h").alias(of), F.col("kept_text").alias(left)).distinct(), "cut")
    common.release(docs.sparkSession)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(substring.NO_ID))).withColumn(of, F.xxhash64(F.coalesce("text", F.lit(""))))
    return with_text(keyed.join(cut, [key, of], "left"), F.coalesce(left, "text")).select(columns(docs))


def without_secrets(docs: DataFrame, ledger: secrets.BlobLedger) -> DataFrame:
    """Documents with each finding replaced by a mask; null texts stay null, rows that repeat an id are masked each."""
    sha, spans = fresh(docs, "sha", "spans")
    keyed = secrets.addressed(docs, "text", sha)
    found = ledger.scan(keyed.select(F.col(sha).alias("sha"), F.coalesce("text", F.lit("")).alias("text")))
    hits = common.materialize(found.where("spans <> ''").select(F.col("sha").alias(sha), F.col("spans").alias(spans)), "hits")
    common.release(docs.sparkSession)
    joined = keyed.join(hits, sha, "left").select(*columns(docs), spans)
    names, at = docs.columns, docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found_ = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            masked = pa.array([secrets.redact(t, s) if s else t for t, s in zip(texts, found_, strict=True)], batch.schema.field(at).type)
            columns = [masked if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    by_place = joined.toDF(*(f"c{k}" for k in range(len(joined.columns))))  # a name with a dot can't be handed to mapInArrow
    return with_text(by_place.mapInArrow(mask, docs.schema), F.col("text"))
