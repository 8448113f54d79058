"""Operator 11: whitening of embeddings by blockwise TSQR and one-sided Jacobi.

Method:
1. Entries become whole numbers, x = floor(64 c) + 1000000. Distinct x vectors, made so by a map-side combine and one shuffle,
   are the fit list; it is written once. Sums per dimension are exact.
2. Each task centres its rows as (n x - S) / n, from whole numbers, and keeps the triangle R of a QR decomposition of what
   it has seen; triangles of tasks are stacked and decomposed again, FAN at a time, until one is left. Its rows are as
   many as dimensions, however large the input.
3. Plane rotations make the columns of that R orthogonal (one-sided Jacobi, a whole round of disjoint pairs at once). Norms of
   the rotated columns are the singular values, accumulated rotations the components; no product of R with itself
   is formed, so small deviations keep their digits.
4. Every row is projected in one pass over the table. The whitened covariance is summed over the fit list in another.

Defined results: rows whose vector is null or holds null, NaN or infinite entries go, and so do empty ones. Of vectors of several
lengths the most frequent length is whitened (ties: the longest) and the rest go. Components whose deviation isn't above
TINY times the largest aren't returned, as they can't be whitened: a single distinct vector gives no rows. Equal rows each get
theirs; null ids pass; an empty table gives no rows; further columns are ignored. Components have either sign. n*x - S must
fit in 63 bits, and its squares are summed in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1000000
COMPONENTS = 16
#: Rows of a block, and triangles that one task stacks.
BLOCK, FAN = 2048, 32
TINY = 1e-13
TRIANGLE = pa.schema([("k", pa.int64()), ("r", pa.binary())])
TRIANGLE_DDL = "k long, r binary"


def lengths_and_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Length of each vector of a list column, 0 if it is null, empty or holds an entry that isn't a finite number; where it
    begins; all entries)."""
    flat = column.flatten().cast(pa.float64())
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    bad = np.concatenate(([0], np.cumsum(~pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False))))
    return np.where(bad[ends[1:]] == bad[ends[:-1]], sizes, 0), ends[:-1], flat.to_numpy(zero_copy_only=False)


def whole_vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(Rows of a list column with a vector of d finite entries, their x)."""
    sizes, starts, flat = lengths_and_places(column)
    rows = np.flatnonzero(sizes == d)
    return rows, np.floor(flat[starts[rows][:, None] + np.arange(d)] * SCALE).astype(np.int64) + SHIFT


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def merge_in_tree(parts: DataFrame, count: int, merge: Callable[[list[np.ndarray]], np.ndarray], shape: tuple[int, int]) -> np.ndarray | None:
    """One matrix from a matrix (k, r) a task: FAN at a time, in as many steps as it takes. The last is d by d and all that
    reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, r in zip(batch.column("k").to_pylist(), batch.column("r").to_pylist(), strict=True):
                own = np.frombuffer(r).reshape(-1, shape[1])
                held[k] = merge([held[k], own]) if k in held else own
        yield common.to_batch([(k, r.tobytes()) for k, r in sorted(held.items())], TRIANGLE)

    while count > 1:
        count = -(-count // FAN)
        parts = parts.select((F.col("k") % count).alias("k"), "r").repartition(count, "k").mapInArrow(run, TRIANGLE_DDL)
    left = [np.frombuffer(r.r).reshape(-1, shape[1]) for r in parts.collect()]
    return merge(left) if left else None


def jacobi(r: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """(Singular values falling, components as rows) of a matrix by plane rotations of its columns. A sweep takes each pair once,
    in rounds of disjoint pairs, which rotate together; it ends when no pair is off by more than the tolerance."""
    a = np.array(r, np.float64)
    d = a.shape[1]
    v = np.eye(d)
    ring = list(range(d + d % 2))  # the last is a bye if d is odd
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(p, q) for p, q in zip(ring[:half], reversed(ring[half:]), strict=True) if p < d and q < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(x) for x in zip(*pairs, strict=True))
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            scale = np.sqrt(alpha * beta)
            off = np.abs(gamma) > tolerance * scale
            if not off.any():
                continue
            worst = max(worst, float((np.abs(gamma[off]) / scale[off]).max()))
            p, q, left, right, alpha, beta, gamma = p[off], q[off], left[:, off], right[:, off], alpha[off], beta[off], gamma[off]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * left - s * right, s * left + c * right
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if worst <= 4 * d * tolerance:
            break
    sizes = np.linalg.norm(a, axis=0)
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order].T


class Whitening:
    """What a fit knows: n, sums of x, components with their standard deviations, and the trace of the covariance."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, deviations: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.deviations, self.trace = n, sums, components, deviations, trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in whole numbers."""
        return x * self.n - np.array(self.sums, np.int64)

    def project(self, whole: np.ndarray) -> np.ndarray:
        """Whitened components of rows of n x - S."""
        return (whole / self.n) @ self.components.T / self.deviations


def usual_length(vectors: DataFrame) -> int | None:
    """The most frequent length of the vectors that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(lengths_and_places(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], names=["d", "n"])

    top = vectors.mapInArrow(run, "d long, n long").where("d > 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top.d if top else None


def distinct_vectors(vectors: DataFrame, d: int) -> DataFrame:
    """The fit list, written down: each x vector of d entries once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole_vectors(batch.column(0), d)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists], names=["x"])

    return common.materialize(vectors.mapInArrow(run, "x array<long>").distinct(), "fit-list")


def fit(points: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """points: the fit list."""
    place = points.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("x").alias("n"))
    found = sorted((r.k, int(r.s), r.n) for r in place.collect())  # a row a dimension
    n, sums = found[0][2], [s for _, s, _ in found]
    model = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            rows = model.centred(matrix(batch.column("x"), d)) / n
            for at in range(0, len(rows), BLOCK):
                r = triangle(np.vstack([r, rows[at : at + BLOCK]]))
        if len(r):
            yield common.to_batch([(0, r.tobytes())], TRIANGLE)

    parts = points.rdd.getNumPartitions()
    tasks = points.select("x").mapInArrow(run, TRIANGLE_DDL).select(F.spark_partition_id().cast("long").alias("k"), "r")
    r = merge_in_tree(tasks, parts, lambda ms: triangle(np.vstack(ms)), (d, d))
    values, vectors = jacobi(r)
    kept = int((values > TINY * values[0]).sum()) if values[0] > 0 else 0
    kept = min(kept, components)
    return Whitening(n, sums, vectors[:kept], values[:kept] / np.sqrt(n), float((values**2).sum() / n))


def identity_error(points: DataFrame, model: Whitening, d: int) -> float:
    """Largest entry of the fit list's whitened covariance less the identity. Rows of n x - S add up to zero exactly, so they are
    centred before they are multiplied."""
    c = len(model.components)
    if not c:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c, c))
        for batch in batches:
            z = model.project(model.centred(matrix(batch.column("x"), d)))
            total += z.T @ z
        yield common.to_batch([(0, total.tobytes())], TRIANGLE)

    tasks = points.select("x").mapInArrow(run, TRIANGLE_DDL).select(F.spark_partition_id().cast("long").alias("k"), "r")
    total = merge_in_tree(tasks, points.rdd.getNumPartitions(), lambda ms: np.sum(ms, axis=0), (c, c))
    return float(np.abs(total / model.n - np.eye(c)).max())


WHITENED_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def squares(whole: np.ndarray) -> list[int]:
    """Sums of squares of rows, exact: in 64 bits where they fit, else in Python's whole numbers."""
    if not whole.size or int(np.abs(whole).max()) ** 2 * whole.shape[1] < 1 << 62:
        return (whole * whole).sum(1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in whole]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error. A
    deviation that doesn't fit in 63 bits is an error."""
    spark = embeddings.sparkSession
    common.short_batches(spark, BLOCK)
    vectors = embeddings.select(F.col(vector).alias("v"), F.col(id_col).cast("long").alias("vec_id"))
    d = usual_length(vectors.select("v"))
    if d is None:
        return spark.createDataFrame([], WHITENED_DDL)
    points = distinct_vectors(vectors.select("v"), d)
    model = fit(points, d, components)
    error = identity_error(points, model, d)
    share = model.deviations**2 / model.trace if model.trace else model.deviations
    c = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column(0), d)
            m = len(rows)
            if not m or not c:
                continue
            whole = model.centred(x)
            ids = batch.column(1).take(pa.array(np.repeat(rows, c)))
            deviation = pa.array(squares(whole), pa.int64()).take(pa.array(np.repeat(np.arange(m), c)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, model.n)), deviation, pa.array(model.project(whole).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * c, error))],
                schema=WHITENED,
            )

    return vectors.mapInArrow(run, WHITENED_DDL)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `embeddings`, 16 components."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
