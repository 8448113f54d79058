"""What an answer is made of: hits of chunks, the context of the graph under one budget, and the trace of a retrieval.

Rows of one question are few (the tops of searches); the tables behind them are filtered and joined by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import query as Q
from ..functions import text as T
from . import relational, retrieval

HEADS = {"Entities": "Entity,Score,Description", "Relations": "From Entity,To Entity,Score,Description", "Community Report": None}
MOST_TOKENS = 8196


def chunk_hits(asked: DataFrame, chunks: DataFrame, words: list[str], vectors: DataFrame | None, top_k: int) -> DataFrame:
    """asked: one row of qid, text, t (tokens) and v (vector, may be null). The top_k chunks (chunk_id, content, token, vector, score)
    by token similarity, cosine to their vectors (chunk_id, v) where there are some, and a bonus for words. Candidates are
    those that hold a word and the most similar by vector."""
    chunks = chunks.select("chunk_id", "content")
    found = relational.lexical_candidates(chunks, words, ["content"], ["chunk_id"], K.LEXICAL_CANDIDATES).select("chunk_id", "content")
    scored = None
    if vectors is not None:
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        both = vectors.crossJoin(F.broadcast(asked.select("v")).withColumnRenamed("v", "q")).where("q IS NOT NULL")  # one question
        length = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q")))
        cosine = F.round(dot(F.col("v"), F.col("q")) / F.when(length == 0, 1.0).otherwise(length), 6)
        scored = both.select("chunk_id", cosine.alias("vector"))
        near = scored.orderBy(F.desc("vector"), "chunk_id").limit(K.LEXICAL_CANDIDATES).select("chunk_id")
        found = found.unionByName(chunks.join(near, "chunk_id", "left_semi")).dropDuplicates(["chunk_id"])
    similar = retrieval.token_similarity(asked, "qid", F.col("t"), found, "chunk_id", T.query_tokens(F.col("content"))).select("chunk_id", F.round("similarity", 6).alias("token"))
    rows = found.join(similar, "chunk_id", "left").withColumn("token", F.coalesce("token", F.lit(0.0)))
    rows = rows.join(scored, "chunk_id", "left") if scored is not None else rows.withColumn("vector", F.lit(None).cast("double"))
    bonus = T.literal_bonus(F.array(*map(F.lit, words)).cast("array<string>"), F.col("content"))
    score = F.round(retrieval.hybrid(F.col("token"), F.coalesce("vector", F.lit(0.0))) + bonus, 6)
    return rows.withColumn("score", score).where("score > 0.000001").orderBy(F.desc("score"), "chunk_id").limit(top_k)


def line(*fields: Column) -> Column:
    return Q.csv_row(*fields)


def context_lines(entities: DataFrame, relations: DataFrame, reports: DataFrame) -> DataFrame:
    """section, place, line: entity_name, score, description; source_name, target_name, score, description; title, content."""
    score = F.format_string("%.2f", F.col("score").cast("double"))
    ents = entities.select(F.lit("Entities").alias("section"), "place", line(F.col("entity_name"), score, Q.description_text(F.col("description"))).alias("line"))
    rels = relations.select(F.lit("Relations").alias("section"), "place", line(F.col("source_name"), F.col("target_name"), score, Q.description_text(F.col("description"))).alias("line"))
    told = reports.select(F.lit("Community Report").alias("section"), "place", Q.report_text(F.col("place"), F.col("title"), F.col("content")).alias("line"))
    return ents.unionByName(rels).unionByName(told)


def context(lines: DataFrame, budget: int = MOST_TOKENS) -> str:
    """The lines as text, as many as a budget of estimated tokens lets in, entities first, then relations, then reports."""
    kept = relational.within_sections(lines.withColumn("_q", F.lit(0)), "_q", "section", list(HEADS), ["place"], T.token_estimate(F.col("line")), budget)
    by: dict[str, list[str]] = {}
    for r in kept.orderBy("place").collect():  # the tops of three searches
        by.setdefault(r.section, []).append(r.line)
    return "".join(f"\n---- {s} ----\n" + "\n".join([*([head] if head else []), *by[s]]) for s, head in HEADS.items() if s in by)
