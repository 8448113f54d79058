"""Names that mean the same: candidate pairs are decided, checked and merged, and edges follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..jobs import checkpoint_key, with_checkpoints
from ..sources.tables import Table
from .graph import merged_names, name_pairs, retargeted

Decider = Callable[[DataFrame], DataFrame]


def likely_same(a: Column, b: Column) -> Column:
    """One name holds the other one."""
    return F.contains(a, b) | F.contains(b, a)


def by_containment(pairs: DataFrame) -> DataFrame:
    return pairs.where(likely_same(F.col("a"), F.col("b")))


def checked(decided: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """Decided pairs that were asked for, in either order, and whose names differ."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    said = decided.where("a <> b").select(kind, low.alias("a"), high.alias("b")).distinct()
    return said.join(pairs.select(kind, low.alias("a"), high.alias("b")).distinct(), [kind, "a", "b"], "left_semi")


def decide(pairs: DataFrame, kind: str, decider: Decider = by_containment, table: Table | None = None) -> DataFrame:
    """pairs (kind, a, b) that mean the same by a decider, such as a model; answers are kept in a table, so that a run that
    was cut off asks only for what is missing."""
    if table is None:
        return checked(decider(pairs), pairs, kind)
    asked = pairs.withColumn("key", F.sha2(F.to_json(F.struct(kind, "a", "b")), 256))

    def answer(new: DataFrame) -> DataFrame:
        yes = checked(decider(new.drop("key")), new, kind).withColumn("payload", F.lit("same"))
        return new.join(yes, [kind, "a", "b"], "left").select("key", F.coalesce("payload", F.lit("different")).alias("payload"))

    return with_checkpoints(asked, table, "key", answer).where("payload = 'same'").select(kind, "a", "b")


def moves(nodes: DataFrame, kind: str = "label", decider: Decider = by_containment, table: Table | None = None) -> DataFrame:
    """(id, canonical) of nodes (id, label, name) whose names were found to mean the same as one with a shorter, or else lesser,
    name of their kind."""
    same = decide(name_pairs(nodes, kind, "name"), kind, decider, table)
    keyed = same.select(F.concat_ws("\t", kind, "a").alias("a"), F.concat_ws("\t", kind, "b").alias("b"))
    names = merged_names(keyed, keyed).where("name <> canonical")
    ids = nodes.groupBy(F.concat_ws("\t", kind, "name").alias("name")).agg(F.min("id").alias("target"))
    targets = names.join(ids.withColumnRenamed("name", "canonical"), "canonical").select("name", "target")
    return nodes.withColumn("_key", F.concat_ws("\t", kind, "name")).join(targets, F.col("_key") == targets.name).select("id", F.col("target").alias("canonical"))


def resolve(nodes: DataFrame, edges: DataFrame, kind: str = "label", decider: Decider = by_containment, table: Table | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, name), edges (source, target, relation): nodes whose names were found to mean the same give way to
    the one with the shortest, then least, name of their kind; edges go to it, loops and repeats go."""
    gone = moves(nodes, kind, decider, table)
    return nodes.join(gone.select("id"), "id", "left_anti"), retargeted(edges, gone)


def report_key(level: int, community: int, names: list[str], relations: list[str]) -> str:
    """The checkpoint key of a community's report."""
    return checkpoint_key(level, community, names, relations)
