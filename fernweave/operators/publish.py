"""From what was ingested to what is served: units, totals, the published graph, and rows for other stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize
from .index_rows import none
from .reports import first_chunks

IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"


def section_path(source_title: Column, directory: Column, title: Column) -> Column:
    """Titles from the document down, each once."""
    return T.ordered_unique(F.array(source_title, directory, title))


def units_of_chunks(chunks: DataFrame) -> DataFrame:
    """A unit for each chunk that has none, numbered by the chunk's place in its source."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_index", "chunk_id"))
    rows = chunks.withColumn("_n", place).where(F.coalesce("unit_id", F.lit("")) == "")
    return rows.select("source_id", F.concat_ws(":", F.lit("unit"), "source_id", F.format_string("%04d", "_n")).alias("unit_id"), F.col("_n").alias("unit_index"), "content", "chunk_id")


def units_as_chunks(units: DataFrame) -> DataFrame:
    """Units in the shape of chunks, for extraction from whole units."""
    return units.select(F.col("unit_id").alias("chunk_id"), "source_id", F.col("unit_index").alias("chunk_index"), "content", F.length("content").alias("token_count"))


def job_totals(**tables: DataFrame) -> DataFrame:
    """(kind, total) of tables such as units, chunks, entities and relations."""
    out = None
    for kind, rows in tables.items():
        one = rows.agg(F.count("*").alias("total")).select(F.lit(kind).alias("kind"), "total")
        out = one if out is None else out.unionByName(one)
    return out


def published_ids(sources: DataFrame) -> DataFrame:
    """source_id of published sources, each once."""
    return sources.where("status = 'published'").select("source_id").distinct()


def bundle(source_id: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """What each table holds of one source."""
    return {kind: rows.where(F.col("source_id") == source_id) for kind, rows in tables.items()}


def rebuildable(sources: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Sources whose file is stored, of some ids or all."""
    rows = sources.where(F.coalesce("object_key", F.lit("")) != "")
    return (rows.where(F.col("source_id").isin(ids)) if ids else rows).orderBy("source_id")


def publishable(relations: Column, force: bool = False) -> Column:
    """A run is published if it found relations, or by force."""
    return F.lit(True) if force else F.coalesce(relations > 0, F.lit(False))


def published_graph(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence) of candidates. Entities of one id are one node, the last source counts; relations keep those whose
    ends are nodes; evidence are the chunks that relations cite, units by their first three chunks. A relation without an id cites none.

    entities: source_id, entity_id, label, name, ord; relations: source_id, relation_id, source_entity_id, target_entity_id,
    relation, display, chunk_ids, ord; chunks: chunk_id, source_id, unit_id, content.

    Relations are dealt by their id once and stay there. What is looked up elsewhere is only what they lack, ends that aren't
    nodes and refs that aren't plain chunks; both are written to the shared folder, so that Spark knows their size when it joins them."""
    nodes = entities.groupBy(F.col("entity_id").alias("id")).agg(*(F.max_by(c, "ord").alias(c) for c in ("label", "name", "source_id")))
    kept = ("source_entity_id", "target_entity_id", "relation", "display", "chunk_ids")
    last = relations.select(F.col("relation_id").alias("id"), *kept, "ord").repartition("id").groupBy("id").agg(*(F.max_by(c, "ord").alias(c) for c in kept))
    unknown = unknown_ends(relations, entities)
    for end in ("source_entity_id", "target_entity_id"):
        last = last.where(F.col(end).isNotNull()).join(unknown.withColumnRenamed("end", end), end, "left_anti")
    last = last.join(replaced_refs(relations, chunks), F.col("id") == F.col("owner"), "left")
    cited = F.flatten(F.transform(F.array_compact("chunk_ids"), lambda ref: F.coalesce(F.try_element_at("replaced", ref), F.array(ref))))
    last = last.withColumn("cited", F.coalesce(F.when(F.col("id").isNotNull(), F.array_distinct(cited)), none()))
    edges = last.select("id", F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"), "relation", F.coalesce(F.when(F.col("display") != "", F.col("display")), "relation").alias("display"), F.transform("cited", T.evidence_id).alias("evidence_ids"))
    evidence = chunks.join(last.select(F.explode("cited").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select(T.evidence_id(F.col("chunk_id")).alias("id"), "source_id", F.col("content").alias("snippet"))
    return nodes, edges, evidence


def unknown_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """end: each end of a relation that is no entity, once; of overridden relations too."""
    ends = relations.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("end")).distinct()
    return materialize(ends.join(entities.select(F.col("entity_id").alias("end")).distinct(), "end", "left_anti"), "unknown-ends")


def replaced_refs(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(owner, replaced): for relations that cite something else than plain chunks, what each such ref stands for: a unit for its first
    three chunks, after itself if it is a chunk as well, anything else for nothing."""
    refs = relations.select(F.col("relation_id").alias("owner"), F.explode("chunk_ids").alias("ref")).where("owner IS NOT NULL AND ref IS NOT NULL")
    units = chunks.where("unit_id <> ''").select(F.col("unit_id").alias("ref")).distinct()
    no_chunk = refs.join(chunks.select(F.col("chunk_id").alias("ref")), "ref", "left_anti").select("owner", "ref", F.lit(False).alias("own"))
    unit = refs.join(units, "ref", "left_semi").select("owner", "ref", F.lit(True).alias("own"))
    odd = materialize(no_chunk.unionByName(unit).groupBy("owner", "ref").agg(F.min("own").alias("own")), "odd-refs")
    first = first_chunks(chunks.join(odd.select(F.col("ref").alias("unit_id")).distinct(), "unit_id", "left_semi"))
    stands = first.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    ids = F.concat(F.when(F.col("own"), F.array("ref")).otherwise(none()), F.coalesce("ids", none()))
    return odd.join(stands, "ref", "left").groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("ref", ids))).alias("replaced"))


def vector_payloads(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is embedded of a published graph: id, content_type, text."""
    more = [F.when(F.col("description") != "", F.col("description"))] if "description" in nodes.columns else []
    text = F.concat_ws(" ", "name", "label", *more)
    return nodes.select("id", F.lit("entity").alias("content_type"), text.alias("text")).unionByName(evidence.select("id", F.lit("evidence").alias("content_type"), F.col("snippet").alias("text")))


def counts_by_type(payloads: DataFrame) -> DataFrame:
    """How many rows of each type a run would write."""
    return payloads.groupBy("content_type").agg(F.count("*").alias("n"))


def identifier(c: Column) -> Column:
    """A label or relation that may stand in a statement; any other is an error."""
    return F.when(c.rlike(IDENTIFIER), c).otherwise(F.raise_error(F.concat(F.lit("not an identifier: "), F.coalesce(c, F.lit("null")))))


def merge_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(list, id, statement, parameters): upserts for a graph store, nodes before edges; further columns become properties."""
    props = lambda d, known: F.to_json(F.struct(*(F.col(c) for c in d.columns if c not in known)))
    n = nodes.select(F.lit(0).alias("list"), "id", F.concat(F.lit("MERGE (n:"), identifier(F.col("label")), F.lit(" {id: $id}) SET n += $properties")).alias("statement"), props(nodes, ("label",)).alias("parameters"))
    e = edges.select(F.lit(1).alias("list"), "id", F.concat(F.lit("MATCH (a {id: $source}), (b {id: $target}) MERGE (a)-[r:"), identifier(F.col("relation")), F.lit(" {id: $id}]->(b) SET r += $properties")).alias("statement"), props(edges, ("relation",)).alias("parameters"))
    return n.unionByName(e)


def structured_cards(edges: DataFrame) -> DataFrame:
    """Evidence of typed relations as text: edges with id, file, source_type, source_name, display, target_type, target_name."""
    return edges.select("id", F.col("file").alias("title"), F.concat(F.col("source_type"), F.lit("「"), F.col("source_name"), F.lit("」"), F.col("display"), F.col("target_type"), F.lit("「"), F.col("target_name"), F.lit("」")).alias("snippet"))


def progress(log: DataFrame, key: str) -> DataFrame:
    """The last status of each key in a log of JSON lines (column value, ord); lines that can't be read are passed over."""
    said = F.from_json("value", f"{key} string, status string")
    rows = log.select("ord", said.alias("r")).select("ord", F.col(f"r.{key}").alias(key), F.col("r.status").alias("status")).where(F.col(key).isNotNull() & F.col("status").isNotNull())
    return rows.groupBy(key).agg(F.max_by("status", "ord").alias("status"))


def to_do(items: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Items that a log doesn't have as completed; failed ones come again."""
    return items.join(progress(log, key).where("status = 'completed'").select(key), key, "left_anti")
