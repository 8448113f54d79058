"""Connected components of a graph given by edges, by alternating large-star and small-star steps.

Each step takes a minimum per node, which is summed up before the shuffle, and joins it back, so a node with
very many edges is split like any skewed join side. Edges are written to the shared folder after each round, and those
of rounds before the last are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """edges: (a, b) of long, in any direction, loops and repeats allowed. (node, component) of every node that
    has an edge to another one; the component is its smallest node."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept, state = common.Rounds(edges.sparkSession, "edges"), None
    now = kept.put(now)
    for _ in range(rounds):
        now = kept.put(small_star(large_star(now)).where("u <> v").distinct())
        seen = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(u % 1000003)")).first())
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = seen
    raise RuntimeError("components did not converge")
