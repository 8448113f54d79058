"""Graphs from typed text files: nodes as `type<TAB>name` lines, relations as JSON records between such values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_unique, stable_edge_id
from ..operators.relational import carried_forward

# Node types of the files, with label and id prefix.
NODE_TYPES = {
    "中药名": ("Herb", "herb"),
    "方名": ("Formula", "formula"),
    "处方": ("Prescription", "prescription"),
    "主治": ("Indication", "indication"),
    "功能主治": ("Indication", "indication"),
    "功能": ("Function", "function"),
    "别名": ("Alias", "alias"),
    "来源": ("Source", "source"),
    "分布": ("DistributionArea", "distribution_area"),
    "四气": ("Property", "property"),
    "五味": ("Flavor", "flavor"),
    "归经": ("Meridian", "meridian"),
    "剂量": ("Dose", "dose"),
    "中药材": ("Category", "category"),
    "方剂": ("Category", "category"),
}

# Relations of the files, with the graph's relation and its display.
RELATIONS = {
    "include": ("INCLUDES", "包含"),
    "from": ("FROM_SOURCE", "来源"),
    "distribution area": ("DISTRIBUTED_IN", "分布"),
    "four properties": ("HAS_PROPERTY", "四气"),
    "five flavors": ("HAS_FLAVOR", "五味"),
    "channel tropism": ("ENTERS_MERIDIAN", "归经"),
    "functions": ("HAS_FUNCTION", "功能"),
    "attending": ("TREATS", "主治"),
    "another name": ("HAS_ALIAS", "别名"),
    "prescription type": ("HAS_PRESCRIPTION", "处方"),
    "composition": ("COMPOSED_OF", "组成"),
    "dose": ("HAS_DOSE", "剂量"),
}


def pick(table: dict[str, tuple[str, str]], key: Column, k: int) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for a, b in table.items() for x in (a, b[k]))), key)


def typed(value: Column) -> tuple[Column, Column, Column]:
    """(id, label, name) of a typed value: the type is what stands before the first tab, the name all that follows. Null where there
    is no tab, type or name; an unknown type with a name is an error."""
    kind, name = F.trim(F.regexp_extract(value, r"^([^\t]*)\t", 1)), F.trim(F.regexp_extract(value, r"(?s)^[^\t]*\t(.*)$", 1))
    there = (kind != "") & (name != "")
    unknown = F.raise_error(F.concat(F.lit("unsupported node type: "), kind))
    prefix, label = (F.when(there, F.coalesce(pick(NODE_TYPES, kind, k), unknown)) for k in (1, 0))
    name = F.when(there, name)
    return F.concat(prefix, F.lit(":"), name), label, name


def structured_graph(lines: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines: value. relations: file, ord, node_1, relation, node_2. (nodes, edges): every end is a node; a dose
    belongs to the last prescription before it in its file; what a formula does counts as what it treats."""
    named = [relations.select(F.col(c).alias("value")) for c in ("node_1", "node_2")]
    values = lines.select("value").union(named[0]).union(named[1]).distinct()
    ident, label, name = typed(F.col("value"))
    nodes = values.select(ident.alias("id"), label.alias("label"), name.alias("name")).where("id IS NOT NULL").distinct()
    source, target = typed(F.col("node_1")), typed(F.col("node_2"))
    rows = relations.select("file", "ord", source[0].alias("s"), source[1].alias("s_label"), target[0].alias("t"), target[1].alias("t_label"), pick(RELATIONS, F.lower(F.trim("relation")), 0).alias("relation"), pick(RELATIONS, F.lower(F.trim("relation")), 1).alias("display"))
    rows = carried_forward(rows, ["file"], ["ord"], F.col("t"), F.col("t_label") == "Prescription", "prescription")
    treats = (F.col("relation") == "HAS_FUNCTION") & F.col("s_label").isin("Prescription", "Formula")
    rows = rows.withColumn("source", F.when(F.col("relation") == "HAS_DOSE", F.coalesce("prescription", "s")).otherwise(F.col("s")))
    rows = rows.withColumn("display", F.when(treats, "功能主治").otherwise(F.col("display"))).withColumn("relation", F.when(treats, "TREATS").otherwise(F.col("relation")))
    known = rows.where("source IS NOT NULL AND t IS NOT NULL AND relation IS NOT NULL")
    cited = F.struct("file", "ord", F.concat_ws(":", F.lit("evidence"), "file", F.col("ord").cast("string")).alias("e"))
    edges = known.groupBy("source", "relation", F.col("t").alias("target")).agg(F.min_by("display", F.struct("file", "ord")).alias("display"), ordered_unique(F.transform(F.array_sort(F.collect_list(cited)), lambda x: x["e"])).alias("evidence_ids"))
    return nodes, edges.withColumn("id", stable_edge_id(F.col("source"), F.col("relation"), F.col("target")))
