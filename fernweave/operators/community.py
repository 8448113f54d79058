"""Search in the entities and relations of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GRAPH_TOP_K
from ..functions import text as T
from .retrieval import hybrid

def prefiltered(rows: DataFrame, text: Column, words: list[str], order: list, limit: int, forced: list[str] | None = None, key: str = "id") -> DataFrame:
    """Rows in which a word stands, the most words first; rows that a vector search found stay anyway. Without words the
    first rows."""
    if not words:
        return rows.withColumn("bonus", F.lit(0.0)).orderBy(*order).limit(limit)
    bonus = F.round(T.literal_bonus(F.array(*map(F.lit, words)), text), 6)
    keep = F.col("bonus") > 0
    if forced:
        keep = keep | F.col(key).isin(forced)
    return rows.withColumn("bonus", bonus).where(keep).orderBy(F.desc("bonus"), *order).limit(limit)


def search(rows: DataFrame, key: str, text: str, question_tokens: list[str], words: list[str], order: list, top_k: int = GRAPH_TOP_K, threshold: float = 0.0) -> DataFrame:
    """The rows most like a question: four times top_k rows by literal words, scored by token similarity and bonus."""
    some = prefiltered(rows, F.col(text), words, order, 4 * top_k, key=key)
    weights = T.bag_entries(F.array(*map(F.lit, question_tokens)).cast("array<string>"))
    own = F.transform(T.bag_entries(T.query_tokens(F.col(text))), lambda e: e["key"])
    scored = some.withColumn("_own", own).withColumn("_q", weights)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e["weight"])
    shared = F.filter("_q", lambda e: F.array_contains(F.col("_own"), e["key"]))
    similarity = (1e-9 + add(shared) / 10) / (1e-9 + add(F.col("_q")) / 10)
    return scored.withColumn("similarity", F.round(hybrid(similarity, F.lit(0.0)), 6)).where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), *order).limit(top_k).drop("_own", "_q")


def ranked(rows: DataFrame, similarity: str, weight: str, order: list, limit: int = 6) -> DataFrame:
    """The first rows by similarity times weight."""
    return rows.withColumn("score", F.col(similarity) * F.col(weight)).orderBy(F.desc("score"), *order).limit(limit)


def double_hits(rows: DataFrame, name: str, similarity: str, names: list[str]) -> DataFrame:
    """Twice the similarity for what the types also gave."""
    return rows.withColumn(similarity, F.when(F.col(name).isin(names), F.col(similarity) * 2).otherwise(F.col(similarity)))
