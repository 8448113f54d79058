"""Retrieval by anchors: nodes named by a question, by intent, with the neighbourhood that the intent asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_id

# What an intent looks for, and how far round it.
ANCHOR_LABELS = {"formula": ("Formula", "Syndrome", "Symptom"), "herb": ("Herb", "Formula"), "general": ("Symptom", "Syndrome", "Formula", "Herb")}
REACH = {"formula": 3, "herb": 2, "general": 3}
MAX_NODES, MAX_EDGES = 120, 240


def named_nodes(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Nodes whose name holds a term, with the place of the first such term."""
    hits = F.array_compact(F.array(*(F.when(F.contains("name", F.lit(t)), F.lit(k)) for k, t in enumerate(terms)))) if terms else F.array().cast("array<int>")
    return nodes.withColumn("term", F.array_min(hits)).where("term IS NOT NULL")


def anchors(nodes: DataFrame, ranked: DataFrame, terms: list[str], intent: str, top_k: int = 1) -> DataFrame:
    """(place, id): for each label that the intent looks for the first node that a term names, by term and order, else the best ranked
    one. nodes: id, label, name, ord; ranked: id, label, place."""
    labels = ANCHOR_LABELS.get(intent, ANCHOR_LABELS["general"])
    named = named_nodes(nodes, terms).select("label", F.struct(F.lit(0).alias("how"), "term", "ord", "id").alias("x"))
    other = ranked.select("label", F.struct(F.lit(1).alias("how"), F.lit(0).alias("term"), F.col("place").cast("long").alias("ord"), "id").alias("x"))
    best = named.unionByName(other).where(F.col("label").isin(*labels)).groupBy("label").agg(F.min("x").alias("x"))
    order = F.create_map(*(v for k, name in enumerate(labels) for v in (F.lit(name), F.lit(k))))
    return best.select(order[F.col("label")].alias("place"), F.col("x.id").alias("id")).orderBy("place").limit(max(top_k, 1))


def reranked(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Nodes by a reranker's scores (id, score), those that it left out after them in their order."""
    return nodes.join(scores, "id", "left").orderBy(F.col("score").desc_nulls_last(), "ord")


def seeds(anchor_ids: DataFrame, ranked: DataFrame, visible: DataFrame) -> DataFrame:
    """(id, place): anchors, then ranked nodes, of those that are visible; each once."""
    both = anchor_ids.select("id", F.struct(F.lit(0).alias("l"), "place").alias("p")).unionByName(ranked.select("id", F.struct(F.lit(1).alias("l"), F.col("place").cast("int").alias("place")).alias("p")))
    first = both.groupBy("id").agg(F.min("p").alias("p")).join(visible.select("id"), "id", "left_semi")
    return first.withColumn("place", F.row_number().over(Window.orderBy("p"))).select("id", "place")  # hits of one question


def path_strings(nodes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """The first edges as `name -relation-> name`."""
    name = lambda e: nodes.select(F.col("id").alias(e), F.col("name").alias(f"{e}_name"))
    rows = edges.join(name("source"), "source").join(name("target"), "target").orderBy("ord").limit(most)
    return rows.select("ord", F.concat(F.col("source_name"), F.lit(" -"), F.col("relation"), F.lit("-> "), F.col("target_name")).alias("path"))


def highlighted(nodes: DataFrame, edges: DataFrame, most_edges: int = 6, most_nodes: int = 5) -> DataFrame:
    """(id, place): ends of the first edges, or the first nodes where there are no edges; each once."""
    ends = edges.orderBy("ord").limit(most_edges).select("ord", F.posexplode(F.array("source", "target")).alias("end", "id"))
    shown = ends.groupBy("id").agg(F.min(F.struct("ord", "end")).alias("place"))
    if not shown.isEmpty():
        return shown
    return nodes.orderBy("ord").limit(most_nodes).select("id", F.struct("ord", F.lit(0).alias("end")).alias("place"))


def chunk_cards(hits: DataFrame, existing: DataFrame) -> DataFrame:
    """Evidence cards (id, snippet, place) of chunk hits (chunk_id, content, place) that aren't there yet."""
    cards = hits.select(evidence_id(F.col("chunk_id")).alias("id"), F.col("content").alias("snippet"), "place")
    return cards.groupBy("id").agg(F.min_by("snippet", "place").alias("snippet"), F.min("place").alias("place")).join(existing.select("id"), "id", "left_anti")
