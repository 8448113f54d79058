"""Retrieval over entities and relations of an index: scores from text, from types asked for and from paths, fused and cut.

The hits of one question are at most GRAPH_TOP_K entities and as many relations, so all that follows the two searches is
small; the tables of entities and relations are only filtered and joined. Names of a type asked for may be many and are
joined, not listed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GRAPH_TOP_K
from ..functions.query import node_id
from ..storage import materialize
from .community import search
from .graph import path_scores
from .index_rows import best_hops


@dataclass(frozen=True)
class Found:
    entities: DataFrame
    relations: DataFrame
    reports: DataFrame
    nodes: DataFrame
    edges: DataFrame


def typed_names(entities: DataFrame, types: list[str]) -> DataFrame:
    """Names of entities whose type or name was asked for."""
    return entities.where(F.col("entity_type").isin(types) | F.col("entity_name").isin(types)).select(F.col("entity_name").alias("name")).distinct()


def by_name(hits: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Hits of one key as one: values of the last in order, place of the first."""
    placed = hits.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most GRAPH_TOP_K rows
    rest = [c for c in placed.columns if c not in (*keys, "place")]
    return placed.groupBy(*keys).agg(F.min("place").alias("place"), *(F.max_by(c, "place").alias(c) for c in rest))


def typed_ends(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with `hits`: how many of the ends are names asked for."""
    out = rows
    for end in ("from_name", "to_name"):
        out = out.join(names.select(F.col("name").alias(end), F.lit(1).alias(f"{end}_hit")), end, "left")
    return out.withColumn("hits", F.coalesce("from_name_hit", F.lit(0)) + F.coalesce("to_name_hit", F.lit(0))).drop("from_name_hit", "to_name_hit")


def fused(relations: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """relations (from_name <= to_name, sim, weight) raised by paths, in either direction of a pair the sorted one first, and by
    ends asked for; what is left of the paths becomes relations of its own."""
    p = paths.select("from_name", "to_name", F.col("sim").alias("path_sim"), F.col("weight").alias("path_weight"))
    known = typed_ends(relations, names).join(p, ["from_name", "to_name"], "left")
    known = known.withColumn("sim", F.col("sim") * (1 + F.coalesce("path_sim", F.lit(0.0)) + F.col("hits"))).drop("path_sim", "path_weight", "hits")
    left = typed_ends(p.join(relations.select("from_name", "to_name"), ["from_name", "to_name"], "left_anti"), names)
    new = left.select("from_name", "to_name", (F.col("path_sim") * (1 + F.col("hits"))).alias("sim"), F.col("path_weight").alias("weight"))
    return known.unionByName(new, allowMissingColumns=True)


def with_details(scored: DataFrame, relations: DataFrame) -> DataFrame:
    """Scored pairs without a relation get that of their ends in either direction, the heaviest, then least id."""
    pair = lambda d: (F.least("from_name", "to_name").alias("low"), F.greatest("from_name", "to_name").alias("high"))
    few = F.broadcast(scored.select(*pair(scored)).distinct())  # pairs of one question
    best = relations.select(*pair(relations), F.struct((-F.col("weight")).alias("w"), "relation_id", "relation_type", "display", "evidence", F.col("from_name").alias("f"), F.col("to_name").alias("t")).alias("r")).join(few, ["low", "high"], "left_semi").groupBy("low", "high").agg(F.min("r").alias("r"))
    joined = scored.withColumn("low", F.least("from_name", "to_name")).withColumn("high", F.greatest("from_name", "to_name")).join(best, ["low", "high"], "left")
    filled = [F.coalesce(c, F.col(f"r.{c}")).alias(c) for c in ("relation_id", "relation_type", "display", "evidence")]
    return joined.select("from_name", "to_name", "sim", "weight", *filled, F.coalesce("source_name", F.col("r.f"), "from_name").alias("source_name"), F.coalesce("target_name", F.col("r.t"), "to_name").alias("target_name"))


def result_nodes(entities: DataFrame, relations: DataFrame, known: DataFrame) -> DataFrame:
    """id, label, name, score: the scored entities, then the ends of relations, which lose a score they had; an end that is no
    entity is an ExternalSource."""
    scored = entities.select("entity_name", F.round("score", 6).alias("score"))
    ends = relations.select(F.explode(F.array("source_name", "target_name")).alias("entity_name")).distinct().withColumn("end", F.lit(True))
    names = scored.join(ends, "entity_name", "full")
    few = F.broadcast(names.select("entity_name").distinct())  # names of one question
    one = known.join(few, "entity_name", "left_semi").groupBy("entity_name").agg(F.max_by(F.struct("entity_id", "entity_type"), "entity_id").alias("e"))
    joined = names.join(one, "entity_name", "left")
    return joined.select(F.coalesce("e.entity_id", node_id(F.lit(""), F.col("entity_name"))).alias("id"), F.coalesce("e.entity_type", F.lit("ExternalSource")).alias("label"), F.col("entity_name").alias("name"), F.when(F.col("end").isNull(), F.col("score")).alias("score"))


def result_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, source, target, relation, display, evidence of scored relations; order: with evidence first, then id."""
    end = lambda e: nodes.select(F.col("name").alias(f"{e}_name"), F.col("id").alias(e))
    rows = relations.join(end("source"), "source_name", "left").join(end("target"), "target_name", "left")
    ident = F.coalesce("relation_id", F.concat_ws(":", F.lit("edge"), "from_name", "to_name"))
    cited = F.coalesce("evidence", F.array().cast("array<string>"))
    out = rows.select(ident.alias("id"), "source", "target", F.coalesce("relation_type", F.lit("RELATED_TO")).alias("relation"), F.coalesce("display", F.lit("相关")).alias("display"), cited.alias("evidence"))
    return out.orderBy((F.size("evidence") == 0).cast("int"), "id")


def retrieve(entities: DataFrame, relations: DataFrame, reports: DataFrame, tokens: list[str], words: list[str], types: list[str], entity_topn: int = 6, relation_topn: int = 6, report_topn: int = 1, paths: Callable[[DataFrame], DataFrame] | None = None) -> Found:
    """entities: entity_id, entity_name, entity_type, description, rank, n_hop; relations: relation_id, from_name, to_name,
    relation_type, display, content_with_weight, weight, evidence; reports: title, names, weight. tokens of the question, words
    to find entities by, types asked for. paths: the paths (id, path, weights, place) of some entities (id), for entities without n_hop;
    then only paths of what was found are made."""
    ents = search(entities, "entity_id", "description", words or tokens, words, [F.desc("rank"), "entity_name", "entity_id"], GRAPH_TOP_K)
    ents = materialize(by_name(ents.withColumnRenamed("similarity", "sim"), ["entity_name"], [F.desc("sim"), F.desc("rank"), "entity_id"]), "entities")
    if paths is not None:
        ents = materialize(ents.join(best_hops(paths(ents.select(F.col("entity_id").alias("id")))).withColumnRenamed("id", "entity_id"), "entity_id", "left"), "entities")
    rels = search(relations, "relation_id", "content_with_weight", tokens, words, [F.desc("weight"), "from_name", "to_name", "relation_id"], GRAPH_TOP_K)
    pairs = rels.select(F.least("from_name", "to_name").alias("a"), F.greatest("from_name", "to_name").alias("b"), F.col("similarity").alias("sim"), F.col("weight").cast("double").alias("weight"), "relation_id", "relation_type", "display", "evidence", F.col("from_name").alias("source_name"), F.col("to_name").alias("target_name"))
    pairs = by_name(pairs, ["a", "b"], [F.desc("sim"), F.desc("weight"), "relation_id"]).withColumnsRenamed({"a": "from_name", "b": "to_name"}).drop("place")
    names = typed_names(entities, types)
    hops = path_scores(ents.select("sim", F.explode("n_hop").alias("p")).select("sim", "p.path", "p.weights"))
    both = ents.join(names.withColumnRenamed("name", "entity_name").withColumn("typed", F.lit(True)), "entity_name", "left")
    score = F.col("sim") * F.when(F.col("typed"), 2).otherwise(1) * F.col("rank")
    best = materialize(both.withColumn("score", score).orderBy(F.desc("score"), "place").limit(entity_topn), "entities")
    scored = with_details(fused(pairs, names, hops), relations)
    top = materialize(scored.withColumn("score", F.col("sim") * F.col("weight")).orderBy(F.desc("score"), "from_name", "to_name").limit(relation_topn), "relations")
    wanted = best.agg(F.collect_list("entity_name").alias("wanted"))  # one row of at most entity_topn names
    shared = F.size(F.array_intersect("names", "wanted"))
    told = reports.join(F.broadcast(wanted)).withColumn("shared", shared).where("shared > 0").orderBy(F.desc("shared"), F.desc("weight"), F.desc("title")).limit(report_topn)
    nodes = result_nodes(best, top, entities)
    return Found(best, top, told, nodes, result_edges(top, nodes))
