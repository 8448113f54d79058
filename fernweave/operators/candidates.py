"""What was extracted from sources, as candidates, and the graph that is published of them.

Evidence stays a row for each owner and unit, never an array of a candidate's units, so that a name which stands in a third
of all units costs no task more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .reports import resolved_evidence


def entity_id(label: Column, name: Column) -> Column:
    return F.concat(F.lit("entity:"), F.lower(label), F.lit(":"), name)


def relation_id(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(F.lit("relation:"), source, F.lit(":"), relation, F.lit(":"), target)


def _sure(rows: DataFrame, default: float) -> Column:
    return (F.coalesce("confidence", F.lit(default)) if "confidence" in rows.columns else F.lit(default)).cast("double").alias("confidence")


def candidates(entities: DataFrame, relations: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, citations) of sources. entities: chunk_id, name, label; relations: chunk_id, source, target, relation, either
    with or without confidence; units: chunk_id, source_id. A candidate is one row a source, with its highest confidence; citations are
    distinct (source_id, owner, unit_id). The ends of a relation are entities of its own unit, of several with the name the one
    with the least id; a relation without both ends, or with a null in it, goes, as does an entity without name or label."""
    owner = units.select("chunk_id", "source_id")
    found = entities.join(owner, "chunk_id").select("source_id", "chunk_id", "name", "label", entity_id(F.col("label"), F.col("name")).alias("entity_id"), _sure(entities, 0.8))
    found = found.where("entity_id IS NOT NULL")
    names = found.groupBy("chunk_id", "name").agg(F.min("entity_id").alias("id"))
    ends = relations.select("chunk_id", "source", "target", "relation", _sure(relations, 0.78))
    for end in ("source", "target"):
        ends = ends.join(names.select("chunk_id", F.col("name").alias(end), F.col("id").alias(f"{end}_entity_id")), ["chunk_id", end])
    ends = ends.join(owner, "chunk_id").withColumn("relation_id", relation_id(F.col("source_entity_id"), F.col("relation"), F.col("target_entity_id"))).where("relation_id IS NOT NULL")
    nodes = found.groupBy("source_id", "entity_id").agg(F.min("label").alias("label"), F.min("name").alias("name"), F.max("confidence").alias("confidence"))
    edges = ends.groupBy("source_id", "relation_id", "source_entity_id", "target_entity_id", "relation").agg(F.max("confidence").alias("confidence"))
    cited = found.select("source_id", F.col("entity_id").alias("owner"), F.col("chunk_id").alias("unit_id")).unionByName(ends.select("source_id", F.col("relation_id").alias("owner"), F.col("chunk_id").alias("unit_id")))
    return nodes, edges, cited.distinct()


def publication(entities: DataFrame, relations: DataFrame, citations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence) of the candidates of some sources. Of a node or edge that several sources have, the one with the last
    id counts, with its evidence; an edge both of whose ends aren't nodes goes. evidence: a row for each edge and chunk that it cites,
    a unit by its first three chunks."""
    nodes = entities.groupBy(F.col("entity_id").alias("id")).agg(*(F.max_by(c, "source_id").alias(c) for c in ("label", "name", "confidence")), F.max("source_id").alias("source_id"))
    kept = ("source_entity_id", "target_entity_id", "relation", "confidence")
    last = relations.groupBy("relation_id").agg(*(F.max_by(c, "source_id").alias(c) for c in kept), F.max("source_id").alias("source_id"))
    for end in ("source_entity_id", "target_entity_id"):
        last = last.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    refs = citations.withColumnRenamed("owner", "relation_id").join(last.select("relation_id", "source_id"), ["relation_id", "source_id"], "left_semi")
    cited = resolved_evidence(refs.select(F.col("relation_id").alias("owner"), F.lit(0).alias("pos"), F.col("unit_id").alias("ref")), chunks.select("chunk_id", "unit_id")).select("owner", "chunk_id")
    evidence = cited.join(chunks.select("chunk_id", "source_id", F.col("content").alias("snippet")), "chunk_id").select("owner", T.evidence_id(F.col("chunk_id")).alias("id"), "source_id", "snippet")
    edges = last.select(F.col("relation_id").alias("id"), F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"), "relation", "confidence", "source_id")
    return nodes, edges, evidence
