"""Question terms, community reports, index rows from graphs, and deterministic stand-ins for model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, ordered_unique

# Endings that are cut from question terms.
SUFFIXES = (
    "有哪些组成",
    "有什么组成",
    "的组成是什么",
    "组成是什么",
    "有哪些主治",
    "有什么主治",
    "的主治是什么",
    "主治是什么",
    "有哪些功效",
    "有什么功效",
    "的功效是什么",
    "功效是什么",
    "有什么作用",
    "的作用是什么",
    "作用是什么",
    "有哪些",
    "是什么",
    "怎么处理",
)

# The dictionary and rules of the deterministic extraction.
DEMO_TERMS = {
    "头痛": "Symptom",
    "发热头痛": "Symptom",
    "不寐": "Symptom",
    "失眠": "Symptom",
    "心脾两虚": "Syndrome",
    "补益心脾": "Treatment",
    "归脾汤": "Formula",
    "党参": "Herb",
}
DEMO_RULES = {
    ("头痛", "心脾两虚"): "MANIFESTS_AS",
    ("失眠", "心脾两虚"): "MANIFESTS_AS",
    ("不寐", "心脾两虚"): "MANIFESTS_AS",
    ("心脾两虚", "补益心脾"): "RECOMMENDS_TREATMENT",
    ("补益心脾", "归脾汤"): "RECOMMENDS_FORMULA",
    ("心脾两虚", "归脾汤"): "RECOMMENDS_FORMULA",
    ("归脾汤", "党参"): "COMPOSED_OF",
}
TOP_NODES = 6
LEVEL_STEP = 1_000_000


def question_term(c: Column) -> Column:
    """A term without white space, outer marks and question endings; a term is never cut to nothing."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\s+", ""), "^[？?。！!，,；;]+|[？?。！!，,；;]+$", "")
    endings = "|".join(sorted(SUFFIXES, key=len, reverse=True))
    return F.regexp_replace(plain, f"(?<=.)(?:{endings})+$", "")


def reports(nodes: DataFrame, edges: DataFrame, community: str, level: int = 0) -> DataFrame:
    """nodes: id, name, label, visual_weight and a community column. A report of each community: its heaviest nodes
    as title, the names, how often each label comes, and the relations inside. Communities of higher levels need two
    nodes; their ids go up by a million a level."""
    order = Window.partitionBy(community).orderBy(F.desc("visual_weight"), "label", "name", "id")
    ranked = nodes.where(F.col(community).isNotNull()).withColumn("_n", F.row_number().over(order))
    entry = F.struct("_n", "name")
    body = ranked.groupBy(community).agg(
        F.count("*").alias("size"),
        ordered_unique(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= TOP_NODES, entry))), lambda x: x["name"])).alias("top"),
        F.round(F.sum("visual_weight"), 6).alias("weight"),
    )
    inside = edges.join(nodes.select(F.col("id").alias("source"), F.col(community).alias("c"), F.col("name").alias("s")), "source").join(nodes.select(F.col("id").alias("target"), F.col(community).alias("d"), F.col("name").alias("t")), "target").where("c = d")
    counts = inside.groupBy(F.col("c").alias(community)).agg(F.count("*").alias("relations"))
    out = body.join(counts, community, "left").where((F.lit(level) == 0) | (F.col("size") >= 2))
    return out.select((F.col(community) + level * LEVEL_STEP).alias("report_id"), F.array_join(F.slice("top", 1, 3), "、").alias("title"), F.array_join("top", "|").alias("entities"), "size", "weight", F.coalesce("relations", F.lit(0)).alias("relations"))


def report_search(found: DataFrame, names: Column, wanted: list[str], limit: int = 1) -> DataFrame:
    """Reports that share entities with those wanted: most shared, heaviest, last title first."""
    shared = F.size(F.array_intersect(names, F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)
    return found.withColumn("shared", shared).where("shared > 0").orderBy(F.desc("shared"), F.desc("weight"), F.desc("title")).limit(limit)


def demo_extraction(chunks: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of each chunk by the fixed dictionary and rules."""
    hits = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("label")) for n, v in DEMO_TERMS.items())), lambda e: F.contains(F.col(text), e["name"]))
    pairs = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(r).alias("relation")) for (a, b), r in DEMO_RULES.items()))
    rules = F.filter(pairs, lambda e: F.contains(F.col(text), e["source"]) & F.contains(F.col(text), e["target"]))
    entities = chunks.select(key, F.inline(hits)).withColumn("confidence", F.lit(0.8))
    return entities, chunks.select(key, F.inline(rules)).withColumn("confidence", F.lit(0.78))


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(ref, sub, chunk_id): the first three chunks of each unit; a chunk without a unit is in none."""
    place = F.row_number().over(Window.partitionBy("unit_id").orderBy("chunk_id"))
    return chunks.where("unit_id <> ''").withColumn("_n", place).where("_n <= 3").select(F.col("unit_id").alias("ref"), F.col("_n").alias("sub"), "chunk_id")


def resolved_evidence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence: (owner, pos, ref); chunks: (chunk_id, unit_id). Refs that are chunks stay, units stand for their
    first three chunks: (owner, chunk_id) in order, each once."""
    own = chunks.select(F.col("chunk_id").alias("ref"), F.lit(0).alias("sub"), "chunk_id")
    both = evidence.join(own.unionByName(first_chunks(chunks)), "ref")
    return both.groupBy("owner", "chunk_id").agg(F.min(F.struct("pos", "sub")).alias("place"))


def graph_from_candidates(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of a source as nodes and edges; relations to unknown ends go."""
    nodes = entities.dropDuplicates(["entity_id"]).select(F.col("entity_id").alias("id"), "label", "name")
    edges = relations
    for end in ("source_entity_id", "target_entity_id"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges.select(F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"), "relation")


def focus_window(text: Column, hints: list[str], width: int = 700, otherwise: int = 3000) -> Column:
    """The text around the first place of a hint, or its start."""

    def cut(t: Column) -> Column:
        found = F.filter(F.array(*(F.locate(h, t) for h in hints)), lambda p: p > 0)
        at = F.array_min(found)
        start = F.greatest(F.lit(1), at - width)
        return F.array(F.when(at.isNull(), F.substring(t, 1, otherwise)).otherwise(F.substring(t, start, at + width - start)))

    return F.element_at(once(text, cut), 1) if hints else F.substring(text, 1, otherwise)
