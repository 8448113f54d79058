"""Counters, coverage and plans over index tables. Each table is read once; only sums are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_ODD_LENGTH, MIN_COVERAGE
from ..functions.text import ratio


def audit(chunks: DataFrame, tokens: Column, embedded: Column, failed: Column, evidence: Column) -> DataFrame:
    """One row of counters of an index table."""
    return chunks.agg(
        F.count("*").alias("total"), F.count_if(embedded).alias("embedded"), F.count_if(failed).alias("failed"), F.count_if(~embedded & ~failed).alias("missing"),
        F.count_if(evidence).alias("with_evidence"), F.count_if(tokens < 30).alias("short"), F.count_if(tokens > 512).alias("long"),
    )


def sync_target(embedded: Column, total: Column, target: float = MIN_COVERAGE) -> tuple[Column, Column]:
    """How many rows must have a vector for the coverage, and how many of those lack one."""
    wanted = F.least(total, F.ceil(total * target)).cast("long")
    return wanted, F.greatest(F.lit(0), wanted - embedded).cast("long")


def readiness(counters: DataFrame, coverage: float = MIN_COVERAGE, odd: float = MAX_ODD_LENGTH) -> DataFrame:
    """Ratios of an audit row, and what they block or warn of."""
    ratios = counters.select("*", ratio(F.col("embedded"), F.col("total")).alias("vector_ratio"), ratio(F.col("with_evidence"), F.col("total")).alias("evidence_ratio"), ratio(F.col("short"), F.col("total")).alias("short_ratio"), ratio(F.col("long"), F.col("total")).alias("long_ratio"))
    block = F.array_compact(F.array(F.when(F.col("vector_ratio") < coverage, "vector_coverage"), F.when(F.col("evidence_ratio") < coverage, "evidence_coverage")))
    warn = F.array_compact(F.array(F.when(F.col("short_ratio") > odd, "short_chunks"), F.when(F.col("long_ratio") > odd, "long_chunks")))
    return ratios.select("vector_ratio", "evidence_ratio", "short_ratio", "long_ratio", F.array_join(block, ",").alias("blockers"), F.array_join(warn, ",").alias("warnings"), (F.size(block) == 0).alias("ready"))


def sync_plan(by_type: DataFrame, kind: str = "content_type", target: float = MIN_COVERAGE) -> DataFrame:
    """(kind, total, embedded) to targets and the command that would reach them."""
    wanted, remaining = sync_target(F.col("embedded"), F.col("total"), target)
    planned = by_type.select(kind, "total", "embedded", ratio(F.col("embedded"), F.col("total")).alias("current_ratio"), wanted.alias("target"), remaining.alias("remaining"))
    return planned.withColumn("command", F.when(F.col("remaining") > 0, F.concat_ws(" ", F.lit("sync --limit"), F.col("remaining").cast("string"), F.lit("--types"), F.col(kind))).otherwise(""))
