"""An inverted-file index of vectors for searches by cosine: cells, quantised residuals, exact ranking.

Build: k-means on at most SAMPLE rows (those whose ids hash least) gives the cells; every row is then put into the cell
of its nearest centre with its residual in a byte a dimension, and a cell knows its rows and the largest residual. A
cell of very many rows is cut into pieces, so none is a hot key. How many cells a search must open for a recall is
read off the sample.

Search: a task takes the queries that open a piece of a cell and bounds each score from both sides by what a byte can
be wrong. Rows whose upper bound reaches the k-th best lower bound of their query are ranked by their vectors, so within the
open cells nothing is lost. An exact search opens, in a second pass, every cell that can hold a row as good as the k-th
best found, by its centre and its largest residual.

Scores are rounded to four digits and ties go by id. Zero vectors have score 0; rows without a vector aren't in the index.
Only centres, at most MAX_CELLS, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .retrieval import normal, top_k

SAMPLE, MAX_CELLS = 20_000, 4096
#: Rows of a piece of a cell, and queries that meet it at once.
PIECE_ROWS, QUERY_BLOCK = 65_536, 1024
#: Queries of the sample that measure recall, and the share of their neighbours that must lie in the opened cells.
PROBES, RECALL = 200, 0.97
ROUND = 1e-4  # scores this near may be equal when rounded

CODES = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("cell", pa.int32()), ("code", pa.binary()), ("scale", pa.float32()), ("far", pa.float64())])
CODES_DDL = "id long, kind string, cell int, code binary, scale float, far double"


@dataclass
class VectorIndex:
    """rows: id, kind, v. codes: id, kind, cell, piece, code, scale. cells: cell, pieces, far (a row a cell). probes: how many
    cells a search opens."""

    rows: DataFrame
    codes: DataFrame
    cells: DataFrame
    centres: np.ndarray
    probes: int


def units(column: pa.Array | list) -> np.ndarray:
    """Rows of a list column, of length 1."""
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return normal(np.array(values, np.float64)) if len(values) else np.zeros((0, 1))


def cells_by_nearness(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances (squared, less the query's own length) of rows to centres."""
    return (centres * centres).sum(1) - 2 * unit @ centres.T


def needed(sample: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Cells that hold a share of the neighbours of some of the sample's rows, in the order of nearness to the row."""
    asks = sample[:: max(1, len(sample) // PROBES)][:PROBES]
    home = cells_by_nearness(sample, centres).argmin(1)
    score = asks @ sample.T
    near = np.argsort(-score, axis=1)[:, 1 : k + 1]
    rank = np.argsort(np.argsort(cells_by_nearness(asks, centres), axis=1), axis=1)
    places = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1 if len(places) else len(centres)


def build(rows: DataFrame, key: str, vector: str, kind: str | None = None, cells: int | None = None, k: int = 10, sample: int = SAMPLE) -> VectorIndex | None:
    """The index of all rows with a vector; None if there is none. `cells` is the root of the number of rows unless given."""
    kinds = F.col(kind).cast("string") if kind else F.lit("")
    own = materialize(rows.select(F.col(key).cast("long").alias("id"), kinds.alias("kind"), F.col(vector).cast("array<float>").alias("v")).where(F.col(vector).isNotNull() & (F.size("v") > 0)), "vectors")
    n = own.count()
    if not n:
        return None

    def as_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(units(batch.column(0)).tolist(), pa.list_(pa.float64()))], names=["u"])

    some = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").mapInArrow(as_units, "u array<double>")
    some = materialize(some, "sample")
    points = np.array([r.u for r in some.collect()])  # at most `sample` rows
    cells = min(cells or max(1, round(n**0.5)), MAX_CELLS, len(points))
    if cells > 1:
        centres = np.array(KMeans(k=cells, seed=17, maxIter=12).fit(some.select(array_to_vector("u").alias("features"))).clusterCenters())
    else:
        centres = points.mean(0, keepdims=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = units(batch.column("v"))
            if not len(unit):
                continue
            cell = cells_by_nearness(unit, centres).argmin(1)
            residual = unit - centres[cell]
            scale = np.maximum(np.abs(residual).max(1) / 127, 1e-12).astype(np.float32)
            code = np.round(residual / scale[:, None].astype(np.float64)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code]), pa.array(scale), pa.array(np.linalg.norm(residual, axis=1))], schema=CODES)

    codes = materialize(own.mapInArrow(encode, CODES_DDL), "codes")
    table = codes.groupBy("cell").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"), F.max("far").alias("far"))
    table = materialize(table, "cells")
    codes = codes.join(F.broadcast(table.select("cell", "pieces")), "cell").select("id", "kind", "cell", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "code", "scale")
    return VectorIndex(own, codes, table, centres, needed(points, centres, k))


def scanned(index: VectorIndex, opened: DataFrame, k: int) -> DataFrame:
    """opened: id, kind, v, cells (list) of queries. qid, id, low, high: rows whose score may be among the best k of what their
    query opens."""
    blocks = max(1, -(-opened.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")
    asked = opened.select("id", "kind", "v", block.alias("block"), F.explode("cells").alias("cell")).join(F.broadcast(index.cells.select("cell", "pieces")), "cell")
    asked = asked.select("id", "kind", "v", "block", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    codes = index.codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.codes.withColumn("block", F.lit(0))
    centres = index.centres
    half = 0.5 * np.sqrt(centres.shape[1])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "id": [], "low": [], "high": []})
        cell = int(left.cell.iloc[0])
        scale = right.scale.to_numpy(np.float64)
        residual = np.frombuffer(b"".join(right.code), np.int8).reshape(len(right), -1) * scale[:, None]
        unit = units(left.v.tolist())
        got = (unit @ centres[cell])[:, None] + unit @ residual.T
        got[(left.id.to_numpy()[:, None] == right.id.to_numpy()[None, :]) | (left.kind.to_numpy()[:, None] != right.kind.to_numpy()[None, :])] = -np.inf
        wrong = scale * half
        low, high = got - wrong, got + wrong
        bar = np.full(len(left), -np.inf) if low.shape[1] < k else np.partition(low, -k, axis=1)[:, -k]
        q, r = np.nonzero((high >= bar[:, None] - ROUND) & np.isfinite(got))
        return pd.DataFrame({"qid": left.id.to_numpy()[q], "id": right.id.to_numpy()[r], "low": low[q, r], "high": high[q, r]})

    by = ["cell", "piece", "block"]
    found = asked.groupBy(*by).cogroup(codes.groupBy(*by)).applyInPandas(score, "qid long, id long, low double, high double")
    return materialize(found, "found")


def bars(found: DataFrame, k: int) -> DataFrame:
    """qid, bar: the k-th best lower bound of queries that have so many rows."""
    return top_k(found, "qid", [F.desc("low"), "id"], k).where(F.col("place") == k).select("qid", F.col("low").alias("bar"))


def ranked(index: VectorIndex, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of the rows found, by their vectors."""
    few = found.join(bars(found, k), "qid", "left").where(F.col("high") >= F.coalesce("bar", F.lit(float("-inf"))) - ROUND).select("qid", "id")
    both = few.join(index.rows.select("id", F.col("v").alias("w")), "id").join(queries.select(F.col("id").alias("qid"), "v"), "qid")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = np.round((units(batch.column("v")) * units(batch.column("w"))).sum(1), 4) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("id"), pa.array(value)], names=["qid", "id", "score"])

    scored = both.select("qid", "id", "v", "w").mapInArrow(score, "qid long, id long, score double")
    return top_k(scored, "qid", [F.desc("score"), "id"], k).select("qid", "id", "score")


def search(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int, kind: str | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(qid, id, score) of the k rows of each query's kind that are most like it, itself left out. Opens `probes` cells, by
    default those of the index; an exact search opens all that can matter."""
    kinds = F.col(kind).cast("string") if kind else F.lit("")
    own = materialize(queries.select(F.col(key).cast("long").alias("id"), kinds.alias("kind"), F.col(vector).cast("array<float>").alias("v")).where(F.col(vector).isNotNull() & (F.size("v") > 0)), "queries")
    centres, first = index.centres, min(probes or index.probes, len(index.centres))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(cells_by_nearness(units(batch.column("v")), centres), axis=1, kind="stable")[:, :first]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "kind", "v", "cells"])

    found = scanned(index, own.mapInArrow(nearest, "id long, kind string, v array<float>, cells array<int>"), k)
    if exact and first < len(centres):
        far = np.zeros(len(centres))
        for r in index.cells.collect():  # a row a cell
            far[r.cell] = r.far

        def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    most = units(batch.column("v")) @ centres.T + far
                    open_ = most >= np.array(batch.column("bar").to_pylist(), float)[:, None] - ROUND
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), batch.column("v"), pa.array([np.flatnonzero(o).astype(np.int32).tolist() for o in open_], pa.list_(pa.int32()))], names=["id", "kind", "v", "cells"])

        bar = bars(found, k)
        barred = own.join(bar, F.col("id") == F.col("qid"), "left").select("id", "kind", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
        found = scanned(index, barred.mapInArrow(reaching, "id long, kind string, v array<float>, cells array<int>"), k)
    return ranked(index, found, own, k)
