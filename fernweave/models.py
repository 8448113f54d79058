"""What models do for the engine, as functions over frames with deterministic stand-ins. A real model is passed in place of
any of them; it runs where its function puts it, such as in mapInPandas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import query as Q
from .functions import text as T
from .operators import reports, resolution, retrieval
from .operators.chunking import dictionary_hits, rule_relations

Extraction = tuple[DataFrame, DataFrame]


def hash_vectors(rows: DataFrame) -> DataFrame:
    """(chunk_id, dim, value) of chunks (chunk_id, content)."""
    return retrieval.hash_embedding(rows, "chunk_id", F.col("content"), 1024)


def overlap_scores(rows: DataFrame) -> DataFrame:
    """rows (question, content) with `rerank`."""
    return rows.withColumn("rerank", retrieval.overlap_rerank(T.query_tokens(F.col("question")), T.query_tokens(F.col("content")), F.col("content")))


def dictionary_extraction(rows: DataFrame) -> Extraction:
    return reports.demo_extraction(rows, "chunk_id", "content")


def rule_rewrite(question: Column) -> Column:
    """struct(types, entities, source) of a question."""
    return Q.rewrite(F.lit(""), Q.answer_types(question), Q.entity_keywords(T.query_tokens(question)))


def outlined(rows: DataFrame) -> DataFrame:
    """Reports of communities (names, relation_texts): title of the first names, the relations as findings."""
    title = F.array_join(F.slice("names", 1, 3), "、")
    summary = F.concat(F.array_join(F.slice("names", 1, 6), "、"), F.lit("；"), F.array_join(F.slice("relation_texts", 1, 6), "；"))
    return rows.withColumn("title", title).withColumn("summary", summary).withColumn("rating", F.lit(5.0))


def quoted(question: str, hits: list[dict]) -> str:
    """An answer of the evidence alone."""
    return "\n".join([f"# {question}", *(f"- {h['content']} [{h['evidence_id']}]" for h in hits)])


@dataclass(frozen=True)
class Models:
    embed: Callable[[DataFrame], DataFrame] = hash_vectors
    rerank: Callable[[DataFrame], DataFrame] = overlap_scores
    extract: Callable[[DataFrame], Extraction] = dictionary_extraction
    rewrite: Callable[[Column], Column] = rule_rewrite
    decide: Callable[[DataFrame], DataFrame] = resolution.by_containment
    report: Callable[[DataFrame], DataFrame] = outlined
    answer: Callable[[str, list[dict]], str] = field(default=quoted)


def extraction(rows: DataFrame, mode: str, models: Models, terms: dict[str, str] | None = None, rules: dict[tuple[str, str], str] | None = None, rounds: int = 2) -> Extraction:
    """Entities and relations of chunks: `ner` by a dictionary and rules, `light` by one call of the model, `general` by further rounds
    that add what the ones before have missed, until one adds nothing."""
    if mode == "ner":
        hits = dictionary_hits(rows, "chunk_id", "content", terms or reports.DEMO_TERMS)
        return hits, rule_relations(hits, "chunk_id", rules or reports.DEMO_RULES)
    if mode not in ("light", "general"):
        raise ValueError(f"unknown mode {mode}")
    entities, relations = models.extract(rows)
    for _ in range(rounds if mode == "general" else 0):
        more, links = models.extract(rows)
        new, new_links = more.join(entities, ["chunk_id", "name", "label"], "left_anti"), links.join(relations, ["chunk_id", "source", "target", "relation"], "left_anti")
        if new.isEmpty() and new_links.isEmpty():
            break
        entities, relations = entities.unionByName(new), relations.unionByName(new_links)
    return entities, relations
