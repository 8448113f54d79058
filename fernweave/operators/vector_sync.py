"""Keeping a vector store in step with the index: what is missing, claiming it, writing it, and counting how it went."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Table, mark, point_id
from ..storage import materialize
from .relational import balanced

Embed = Callable[[DataFrame], DataFrame]


def open_gate(embedded: Column, total: Column, least: int = 1000, coverage: float = 0.8) -> Column:
    """Whether enough rows have a vector for a vector search to be fair; with nothing asked for it is open."""
    enough = (embedded >= least) if least > 0 else F.lit(True)
    share = (embedded >= total * coverage) if coverage > 0 else F.lit(True)
    return enough & share & ((total > 0) | F.lit(least <= 0 and coverage <= 0))


def point_check(embedded: Column, points: Column) -> Column:
    """Whether a store has as many points as rows are embedded; one that can't be asked (null) is right only if none are."""
    return F.coalesce(points == embedded, embedded == 0)


def waiting(records: DataFrame, kind: str, kinds: list[str], order: list[str], limit: int, even: bool = False) -> DataFrame:
    """The next records without a vector: type after type under one limit, or in even shares."""
    missing = records.where((F.col("vector_status") == "missing") & F.col(kind).isin(kinds))
    if even:
        return balanced(missing, kind, kinds, order, limit).drop("_kind", "_pos")
    rank = F.create_map(*(x for k, v in enumerate(kinds) for x in (F.lit(v), F.lit(k))))
    return missing.orderBy(rank[F.col(kind)], *order).limit(limit)


def claim(records: DataFrame, key: list[str], kind: str, kinds: list[str], order: list[str], limit: int, even: bool = False) -> tuple[DataFrame, DataFrame]:
    """(claimed, records): the next records, and all records with those queued. One driver claims at a time (jobs.Lock)."""
    taken = materialize(waiting(records, kind, kinds, order, limit, even), "claimed")
    marked = records.join(taken.select(*key, F.lit(True).alias("_taken")), key, "left")
    return taken, marked.withColumn("vector_status", F.when(F.col("_taken"), "queued").otherwise(F.col("vector_status"))).drop("_taken")


def outcome_counts(outcomes: DataFrame, kind: str) -> DataFrame:
    """(counter, n) of outcomes (kind, status): each status, and each status of each type."""
    total = outcomes.groupBy(F.col("status").alias("counter")).agg(F.count("*").alias("n"))
    by_type = outcomes.groupBy(F.concat_ws("_", "status", kind).alias("counter")).agg(F.count("*").alias("n"))
    return total.unionByName(by_type)


def retried(work: Callable[[], DataFrame], retries: int = 4, pause: float = 3.0, sleep: Callable[[float], None] = time.sleep, seen: Callable[[Exception], None] = lambda e: None) -> DataFrame:
    """work(), again after an error with waits that grow evenly; seen() is told of each error that is tried again."""
    for attempt in range(1, retries + 1):
        try:
            return work()
        except Exception as e:
            if attempt == retries:
                raise
            seen(e)
            sleep(pause * attempt)
    raise ValueError("retries must be at least 1")


def sync(table: Table, store: Table, embed: Embed, key: str, kind: str, kinds: list[str], order: list[str], limit: int, batch: int = 64, even: bool = False, retries: int = 4, pause: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> dict[str, int | str]:
    """Embed up to `limit` missing records of a table in batches: claim, embed, write points to the store, mark. embed turns
    (key, text) into (key, vector). Embedding and writing are tried again after an error; a batch that fails for good is marked
    failed, and its error's type and stage are counted. Each step merges the batch's records alone into the table. Counters of
    the run: statuses, statuses by type, retries and failures by error and stage, and the text of the last failure."""
    counters: dict[str, int | str] = {}
    done = 0

    def count(name: str, n: int = 1) -> None:
        counters[name] = counters.get(name, 0) + n

    def told(stage: str) -> Callable[[Exception], None]:
        def seen(e: Exception) -> None:
            count("retry_attempts")
            count(f"retry_error_{type(e).__name__}")
            count(f"retry_stage_{stage}")

        return seen

    while done < limit:
        taken = materialize(waiting(table.read(), kind, kinds, order, min(batch, limit - done), even), "claimed")
        n = taken.count()
        if not n:
            break
        done += n
        table.merge(taken.withColumn("vector_status", F.lit("queued")))
        stage = "embedding"
        try:
            vectors = retried(lambda rows=taken: materialize(embed(rows), "vectors"), retries, pause, sleep, told(stage))
            stage = "store"
            points = taken.select(key, kind, point_id(F.col(key)).alias("point_id")).join(vectors, key)
            retried(lambda rows=points: store.merge(rows), retries, pause, sleep, told(stage))
            ok = vectors.select(key).distinct().withColumn("ok", F.lit(True))
        except Exception as e:  # whatever a model or store raises is the batch's outcome
            count(f"failure_error_{type(e).__name__}")
            count(f"failure_stage_{stage}")
            counters["last_failure_error"] = f"{type(e).__name__}: {e}"
            ok = taken.select(key).withColumn("ok", F.lit(False))
        outcome = taken.select(key, kind).join(ok, key, "left").select(key, kind, F.coalesce("ok", F.lit(False)).alias("ok"), point_id(F.col(key)).alias("point_id"))
        outcome = materialize(outcome, "outcome")
        table.merge(mark(taken, outcome, key))
        for r in outcome_counts(outcome.withColumn("status", F.when(F.col("ok"), "embedded").otherwise("failed")), kind).collect():
            count(r.counter, r.n)
    return counters


def existing_ids(points: DataFrame, content_type: str, key: str) -> DataFrame:
    """Ids of one type that a store has."""
    return points.where(F.col("content_type") == content_type).select(key).distinct()
