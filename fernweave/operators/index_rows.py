"""Rows of the retrieval index: documents, chunks, entities and relations, from candidates of sources and from a graph.

Evidence is gathered once by key and joined; arrays keep the order in which ids came (column `ord`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_PATHS, RELATION_WEIGHTS
from ..functions import text as T
from ..functions.query import tag_levels
from .graph import lookup
from .relational import eligible


def none() -> Column:
    return F.array().cast("array<string>")


def in_order(ids: str) -> Column:
    """Arrays of a group one after the other by `ord`, each id once."""
    return T.ordered_unique(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(ids).alias("ids")))), lambda x: x["ids"])))


def document_rows(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """sources: source_id, filename, checksum, status, object_key; counts: source_id, chunks, eligible. A document without
    chunks has none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = sources.join(counts, "source_id", "left")
    return joined.select(F.col("source_id").alias("doc_id"), "source_id", "filename", "checksum", "status", "object_key", zero("chunks").alias("chunk_count"), zero("eligible").alias("eligible_chunk_count"))


def chunk_rows(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks: chunk_id, source_id, page_id, unit_id, chunk_index, section_title, section_path, content, token_count; pages:
    page_id, page_number. Terms, weighted content, page (1 where unknown) and whether the chunk counts."""
    path = F.coalesce("section_path", none())
    title = F.coalesce(F.when(F.col("section_title") != "", F.col("section_title")), F.when(F.size(path) > 0, F.element_at(path, -1)), F.lit(""))
    rows = chunks.join(pages.select("page_id", "page_number"), "page_id", "left").withColumn("title", title).withColumn("section_path", path)
    rows = rows.withColumn("important", F.slice(T.query_tokens(F.concat_ws(" ", "title", "content")), 1, 12))
    tokens = F.when(F.coalesce("token_count", F.lit(0)) > 0, F.col("token_count")).otherwise(T.token_estimate(F.col("content")))
    return rows.select(
        "chunk_id", F.col("source_id").alias("doc_id"), "source_id", F.coalesce(F.when(F.col("unit_id") != "", F.col("unit_id")), "chunk_id").alias("parent_unit_id"),
        F.col("chunk_index").alias("chunk_order"), F.coalesce("page_number", F.lit(1)).alias("page_number"), "title", "section_path", "content",
        T.weighted_content(F.col("title"), F.col("section_path"), F.col("important"), F.col("content")).alias("content_with_weight"),
        F.array_join(T.query_tokens(F.col("content")), " ").alias("content_tokens"), F.array_join(T.query_tokens(F.col("title")), " ").alias("title_tokens"), "important",
        tokens.alias("token_count"), eligible(F.coalesce("token_count", F.lit(0)), F.col("content")).cast("int").alias("available"),
    )


def entity_rows(entities: DataFrame) -> DataFrame:
    """Candidates (source_id, entity_id, name, normalized_name, label, confidence, chunk_ids) as entities of the index."""
    text = F.concat_ws(" ", "name", "label")
    content = F.to_json(F.struct(text.alias("description"), F.col("source_id").alias("source")))
    return entities.select(F.concat_ws(":", "source_id", "entity_id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("label").alias("entity_type"), F.col("entity_id").alias("source_node_id"), content.alias("content_with_weight"), text.alias("description"), F.greatest(F.col("confidence"), F.lit(0.01)).alias("rank"), T.ordered_unique(F.array("normalized_name", "name")).alias("aliases"), F.col("chunk_ids").alias("evidence"))


def relation_rows(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates (source_id, relation_id, source_entity_id, target_entity_id, relation, display, confidence, chunk_ids) as relations;
    an end that is no candidate goes by its id."""
    rows = relations
    for end in ("source", "target"):
        rows = rows.join(entities.select("source_id", F.col("entity_id").alias(f"{end}_entity_id"), F.col("name").alias(f"{end}_name")), ["source_id", f"{end}_entity_id"], "left")
    a, b = F.coalesce("source_name", "source_entity_id"), F.coalesce("target_name", "target_entity_id")
    display = F.coalesce(F.when(F.col("display") != "", F.col("display")), "relation")
    return rows.select(F.concat_ws(":", "source_id", "relation_id").alias("relation_id"), a.alias("from_name"), b.alias("to_name"), F.col("relation").alias("relation_type"), display.alias("display"), F.concat_ws(" ", a, display, b).alias("content_with_weight"), F.greatest(F.lit(1), F.bround("confidence").cast("int")).alias("weight"), F.col("chunk_ids").alias("evidence"), F.col("relation_id").alias("source_edge_id"))


def candidate_evidence(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, label, chunk_ids), with label '' for any, and (from_name, to_name, relation, chunk_ids) of relations whose ends are
    candidates of their source. Both inputs have `ord`."""
    keyed = entities.select("name", F.explode(F.array("label", F.lit(""))).alias("label"), "ord", "chunk_ids")
    end = lambda e: entities.select("source_id", F.col("entity_id").alias(f"{e}_entity_id"), F.col("name").alias(f"{e}_name")).distinct()
    named = relations.join(end("source"), ["source_id", "source_entity_id"]).join(end("target"), ["source_id", "target_entity_id"])
    by_ends = named.groupBy(F.col("source_name").alias("from_name"), F.col("target_name").alias("to_name"), "relation")
    return keyed.groupBy("name", "label").agg(in_order("chunk_ids").alias("chunk_ids")), by_ends.agg(in_order("chunk_ids").alias("chunk_ids"))


def source_chunks(c: Column) -> Column:
    """Ids from a list in one string."""
    return F.coalesce(T.keywords(F.split(c, ",")), none())


def entity_content(aliases: Column, name: Column, label: Column, description: Column, summary: Column, canonical: Column) -> Column:
    """An entity's text for the index as JSON."""
    also = F.when(F.size(aliases) > 0, F.concat(F.lit("别名："), F.array_join(aliases, "、")))
    text = F.concat_ws("\n", F.coalesce(F.when(description != "", description), F.concat_ws(" ", name, label)), also, F.when(summary != "", summary))
    return F.to_json(F.struct(text.alias("description"), canonical.alias("canonical_name")))


def best_hops(paths: DataFrame) -> DataFrame:
    """id, n_hop: the best paths of a node in order."""
    hop = F.transform(F.array_sort(F.collect_list(F.struct("place", "path", "weights"))), lambda x: F.struct(x["path"].alias("path"), x["weights"].alias("weights")))
    return paths.where(F.col("place") <= MAX_PATHS).groupBy("id").agg(hop.alias("n_hop"))


def no_evidence(spark: SparkSession) -> DataFrame:
    """Evidence of relations where there is none; Spark sees that it is empty and leaves the joins with it out."""
    return spark.createDataFrame([], "from_name string, to_name string, relation string, chunk_ids array<string>").where(F.lit(False))


def level_counts(rows: DataFrame) -> DataFrame:
    """rows: tags. level, community, n of the tags of all rows; equal lists of tags are counted before they are parsed."""
    each = rows.groupBy("tags").agg(F.count("*").alias("n")).select("n", F.inline(tag_levels(F.col("tags"))))
    return each.groupBy("level", "community").agg(F.sum("n").alias("n"))


def graph_entity_rows(nodes: DataFrame, paths: DataFrame | None, evidence: DataFrame) -> DataFrame:
    """nodes: id, label, name, description, pagerank, rank, source_chunks; paths: id, path, weights, place (n_hop_paths());
    evidence: candidate_evidence()'s first. Entities with their best paths, if given, and all their chunks."""
    own = evidence.where("label <> ''").select("name", "label", F.col("chunk_ids").alias("by_label"))
    any_ = evidence.where("label = ''").select("name", F.col("chunk_ids").alias("by_name"))
    joined = (nodes.join(best_hops(paths), "id", "left") if paths is not None else nodes).join(own, ["name", "label"], "left").join(any_, "name", "left")
    ids = T.ordered_unique(F.concat(source_chunks(F.coalesce("source_chunks", F.lit(""))), F.coalesce("by_label", none()), F.coalesce("by_name", none())))
    text = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.concat_ws(" ", "name", "label"))
    return joined.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("label").alias("entity_type"), text.alias("description"), F.coalesce("pagerank", "rank", F.lit(1.0)).alias("rank"), *(["n_hop"] if paths is not None else []), ids.alias("evidence"))


def graph_relation_rows(edges: DataFrame, nodes: DataFrame, evidence: DataFrame, spelled: Callable[[str], Column] = F.col) -> DataFrame:
    """edges: id, source, target, relation, display, evidence_ids; evidence: candidate_evidence()'s second. Relations by names, with
    the chunks that edges cite and those of candidates in the same direction, else in the other one. spelled: the text of
    an end, which stands for the name of one that is no node."""
    name = lambda e: nodes.select(F.col("id").alias(e), F.col("name").alias(f"{e}_name"))
    rows = edges.join(name("source"), "source", "left").join(name("target"), "target", "left")
    rows = rows.withColumn("from_name", F.coalesce("source_name", spelled("source"))).withColumn("to_name", F.coalesce("target_name", spelled("target")))
    there = evidence.select("from_name", "to_name", "relation", F.col("chunk_ids").alias("there"))
    back = evidence.select(F.col("to_name").alias("from_name"), F.col("from_name").alias("to_name"), "relation", F.col("chunk_ids").alias("back"))
    keys = ["from_name", "to_name", "relation"]
    rows = rows.join(there, keys, "left").join(back, keys, "left")
    cited = F.transform(F.filter("evidence_ids", lambda e: e.rlike("^(chunk|evidence):")), lambda e: F.regexp_replace(e, "^evidence:", "chunk:"))
    found = F.when(F.size("there") > 0, F.col("there")).otherwise(F.coalesce("back", none()))
    weight = F.greatest(F.lit(1), F.bround(lookup(RELATION_WEIGHTS, F.col("relation")).cast("decimal(10,4)") * 10).cast("int"))
    return rows.select(F.col("id").alias("relation_id"), "from_name", "to_name", F.col("relation").alias("relation_type"), "display", F.concat_ws(" ", "from_name", "display", "to_name").alias("content_with_weight"), weight.alias("weight"), T.ordered_unique(F.concat(F.coalesce(cited, none()), found)).alias("evidence"))


def subgraph_groups(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes: id, refs; edges: source, target, relation, refs, arrays of chunk or evidence ids. (source_id, id) and (source_id,
    source, target, relation): a node belongs to the sources of its refs, an edge to those of its own, else to those of its ends."""
    groups = lambda d: T.ordered_unique(F.transform(F.coalesce("refs", none()), T.source_group))
    own = nodes.select(F.explode(groups(nodes)).alias("source_id"), "id")
    direct = edges.where(F.size(F.coalesce("refs", none())) > 0).select(F.explode(groups(edges)).alias("source_id"), "source", "target", "relation")
    rest = edges.where(F.size(F.coalesce("refs", none())) == 0).select("source", "target", "relation")
    ends = [rest.join(own.withColumnRenamed("id", e), e).select("source_id", "source", "target", "relation") for e in ("source", "target")]
    return own, direct.unionByName(ends[0]).unionByName(ends[1]).distinct()


def artifacts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Subgraphs as rows: artifact_id, source_id, node and edge counts, nodes and edges as JSON. One source's graph is a row."""
    n = nodes.groupBy("source_id").agg(F.count("*").alias("nodes"), F.to_json(F.array_sort(F.collect_list("id"))).alias("node_json"))
    e = edges.groupBy("source_id").agg(F.count("*").alias("edges"), F.to_json(F.array_sort(F.collect_list(F.struct("source", "relation", "target")))).alias("edge_json"))
    rows = n.join(e, "source_id", "left")
    return rows.select(F.concat(F.lit("subgraph:"), "source_id").alias("artifact_id"), F.lit("subgraph").alias("kind"), "source_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "node_json", F.coalesce("edge_json", F.lit("[]")).alias("edge_json"))


def artifact_of(rows: DataFrame, source_id: str) -> DataFrame:
    """The first artifact of a source."""
    return rows.where(F.col("source_id") == source_id).orderBy("artifact_id").limit(1)


def type_pool(samples: DataFrame, kind: str, names: str) -> DataFrame:
    """Kinds that have samples, with them; a row for each kind."""
    return samples.where(F.size(names) > 0).select(kind, names)
