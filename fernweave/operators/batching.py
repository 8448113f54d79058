"""Greedy batches of ordered rows, exact for groups of any size.

Where a batch begins depends on all rows before, yet no task sees a whole group. A group is cut into blocks of BLOCK rows. What a
block does to the batch that is open when it begins is a step function of the room left in that batch: it breaks at some
row, after which the block alone decides. These functions are small, are joined FAN at a time up a tree, and the
state of each block is then handed down the same tree. A function has at most as many steps as a batch has rows, and chains
that fall together share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .numbering import numbered_within

BLOCK = 4096
FAN = 64

STEPS = "struct<edges:array<bigint>,used:array<bigint>,batches:array<bigint>>"
LISTS = pa.list_(pa.int64())


class Steps:
    """What some rows do to an open batch with `room` left: with room below edges[0] they leave a batch with used[0] taken, batches[0] later,
    and so on; with room for them all, edges[-1], they join the open batch."""

    def __init__(self, edges: np.ndarray, used: np.ndarray, batches: np.ndarray):
        self.edges, self.used, self.batches = edges, used, batches

    @classmethod
    def of(cls, costs: np.ndarray, limit: int) -> Steps:
        upto = np.cumsum(costs)
        n, before = len(costs), upto - costs
        following = np.searchsorted(upto, before + limit, side="right")  # the row that begins the next batch
        used, batches = upto[-1] - before, np.ones(n, np.int64)
        for k in range(n - 1, -1, -1):
            if (j := max(following[k], k + 1)) < n:
                used[k], batches[k] = used[j], batches[j] + 1
        return cls(upto, used, batches).short(limit)

    def short(self, limit: int) -> Steps:
        """Without steps that no room from 0 to limit (or less than 0, after a dear row) reaches, and equal ones as one."""
        reached = np.diff(self.edges, prepend=-1) > 0
        reached &= np.concatenate(([0], self.edges[:-1])) <= limit
        edges, used, batches = self.edges[reached], self.used[reached], self.batches[reached]
        last = np.append((np.diff(used) != 0) | (np.diff(batches) != 0), True)
        edges, used, batches = edges[last], used[last], batches[last]
        if edges[-1] < self.edges[-1]:  # the last edge stays the sum of the costs; its step is out of reach
            edges, used, batches = np.append(edges, self.edges[-1]), np.append(used, 0), np.append(batches, 0)
        return Steps(edges, used, batches)

    def after(self, used: np.ndarray, batches: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """States (cost in the open batch, batches so far) after these rows."""
        at = np.searchsorted(self.edges, limit - used, side="right")
        inside = at < len(self.edges)
        k = np.minimum(at, len(self.edges) - 1)
        return np.where(inside, self.used[k], used + self.edges[-1]), np.where(inside, batches + self.batches[k], batches)

    def then(self, more: Steps, limit: int) -> Steps:
        used, batches = more.after(self.used, self.batches, limit)
        return Steps(np.concatenate([self.edges, more.edges + self.edges[-1]]), np.concatenate([used, more.used]), np.concatenate([batches, more.batches])).short(limit)


def _packed(found: list[Steps]) -> pa.Array:
    fields = [pa.array([getattr(s, name).tolist() for s in found], LISTS) for name in ("edges", "used", "batches")]
    return pa.StructArray.from_arrays(fields, names=["edges", "used", "batches"])


def _unpacked(row: dict) -> Steps:
    return Steps(*(np.array(row[name], np.int64) for name in ("edges", "used", "batches")))


def _mapped(rows: DataFrame, schema: str, column: str, kept: list[str], one, out) -> DataFrame:
    """rows' `kept` columns and a column made by `one` of each row's dict, packed by `out`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = out([one(row) for row in batch.to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), made], names=[*kept, column])

    return rows.mapInArrow(run, schema)


def greedy_batches(rows: DataFrame, group: str, order: str, cost: str, limit: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(group, order, cost, batch): rows of a group in order, in batches whose costs sum to at most the limit; a dearer row is a
    batch alone. A null cost counts as 0 and stays null; rows of a null group are a group; equal places are taken by cost."""
    plain = rows.select(F.col(group).cast("string").alias("g"), F.col(order).cast("long").alias("o"), F.col(cost).cast("long").alias("c"))
    checked = F.when(F.col("c") < 0, F.raise_error(F.lit("a cost is below 0"))).otherwise(F.coalesce("c", F.lit(0)))
    placed = numbered_within(plain, "g", ["o", "c"], "n").withColumn("b", F.floor(F.col("n") / block).cast("long"))
    cut = placed.groupBy("g", "b").agg(F.array_sort(F.collect_list(F.struct("n", "o", "c", checked.alias("w")))).alias("rows"))
    cut = materialize(cut, "blocks")
    steps = cut.select("g", "b", F.col("rows.w").alias("w"))
    made = _mapped(steps, f"g string, b long, steps {STEPS}", "steps", ["g", "b"], lambda r: Steps.of(np.array(r["w"], np.int64), limit), _packed)
    begun = _states(made, limit, fan)
    joined = cut.join(begun, cut.g.eqNullSafe(begun.g2) & (cut.b == begun.b2))

    def number(row: dict) -> list[int]:
        used, batch = row["used"], row["batch"]
        numbers = []
        for c in row["w"]:
            if used + c > limit:
                used, batch = 0, batch + 1
            used += c
            numbers.append(batch)
        return numbers

    asked = joined.select("g", "rows", F.col("rows.w").alias("w"), "used", "batch")
    numbers = _mapped(asked, "g string, rows array<struct<n:long,o:long,c:long,w:long>>, batches array<bigint>", "batches", ["g", "rows"], number, lambda x: pa.array(x, LISTS))
    each = numbers.select("g", F.explode(F.arrays_zip("rows", "batches")).alias("e"))
    return each.select(F.col("g").alias(group), F.col("e.rows.o").alias(order), F.col("e.rows.c").alias(cost), F.col("e.batches").cast("int").alias("batch"))


def _states(made: DataFrame, limit: int, fan: int) -> DataFrame:
    """(g2, b2, used, batch): the open batch when each block begins. `made`: g, b, steps. The first block of a group finds a batch that is
    more than full, numbered -1."""
    levels, most = [made], made.agg(F.max("b")).first()[0] or 0
    while most > 0:
        held = levels[-1] if len(levels) > 1 else materialize(made, "steps")
        levels[-1] = held
        parts = F.array_sort(F.collect_list(F.struct("b", "steps"))).alias("parts")
        families = held.groupBy("g", F.floor(F.col("b") / fan).cast("long").alias("p")).agg(parts).withColumnRenamed("p", "b")

        def join(row: dict) -> Steps:
            whole = _unpacked(row["parts"][0]["steps"])
            for part in row["parts"][1:]:
                whole = whole.then(_unpacked(part["steps"]), limit)
            return whole

        levels.append(materialize(_mapped(families, f"g string, b long, steps {STEPS}", "steps", ["g", "b"], join, _packed), "steps"))
        most //= fan
    state = levels[-1].select(F.col("g").alias("g2"), F.col("b").alias("b2"), F.lit(limit + 1).cast("long").alias("used"), F.lit(-1).cast("long").alias("batch"))
    for held in reversed(levels[:-1]):
        parts = F.array_sort(F.collect_list(F.struct("b", "steps"))).alias("parts")
        families = held.groupBy("g", F.floor(F.col("b") / fan).cast("long").alias("p")).agg(parts)
        asked = families.join(state, families.g.eqNullSafe(state.g2) & (families.p == state.b2)).select("g", "parts", "used", "batch")

        def walk(row: dict) -> list[tuple[int, int, int]]:
            used, batch, found = np.array([row["used"]]), np.array([row["batch"]]), []
            for part in row["parts"]:
                found.append({"b": part["b"], "used": int(used[0]), "batch": int(batch[0])})
                used, batch = _unpacked(part["steps"]).after(used, batch, limit)
            return found

        kind = pa.list_(pa.struct([("b", pa.int64()), ("used", pa.int64()), ("batch", pa.int64())]))
        told = _mapped(asked, "g string, states array<struct<b:bigint,used:bigint,batch:bigint>>", "states", ["g"], walk, lambda x, kind=kind: pa.array(x, kind))
        state = told.select(F.col("g").alias("g2"), F.explode("states").alias("s")).select("g2", F.col("s.b").alias("b2"), "s.used", "s.batch")
    return state
