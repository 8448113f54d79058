"""The vector index against brute force: recall, exact searches, kinds, hot cells, odd rows."""

import numpy as np
import pytest

from fernweave.operators import vector_index as V


def brute(rows, asks, k):
    unit = {}
    for i, kind, v in rows:
        if v:
            n = np.linalg.norm(np.float32(v).astype(float))
            unit[i] = (kind, np.float32(v).astype(float) / (n or 1.0))
    out = {}
    for i in asks:
        kind, u = unit[i]
        found = sorted((-(round(float(u @ w), 4) + 0.0), j) for j, (other, w) in unit.items() if j != i and other == kind)
        out[i] = [(j, -s) for s, j in found[:k]]
    return out


def results(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.qid, -r.score, r.id)):
        out.setdefault(r.qid, []).append((r.id, r.score))
    return out


def same(got, want):
    assert got.keys() == {q for q, x in want.items() if x}
    for q, x in got.items():
        assert [s for _, s in x] == pytest.approx([s for _, s in want[q]], abs=1.01e-4)
        assert sum(a[0] == b[0] for a, b in zip(x, want[q], strict=True)) >= len(x) - 1  # a score may round either way


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    heads = rng.normal(size=(12, 24))
    out = [(k, "ab"[k % 3 == 0], (heads[k % 12] + rng.normal(size=24) * (0.9 if k % 2 else 0.2)).tolist()) for k in range(1500)]
    return [*out, *((2000 + k, "a", out[7][2]) for k in range(200)), (3000, "a", None), (3001, "a", []), (3002, "a", [0.0] * 24)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, kind string, v array<float>").repartition(5)


def test_recall(frame, rows):
    index = V.build(frame, "id", "v")
    assert index.codes.count() == len(rows) - 2  # every row with a vector
    want = brute([(i, "", v) for i, _, v in rows], [i for i, _, v in rows if v and i % 50 == 0], 10)
    got = results(V.search(index, frame.where("id % 50 = 0"), "id", "v", 10))
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in x}) for q, x in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("probes", [1, None])
def test_exact_searches(frame, rows, monkeypatch, probes):
    monkeypatch.setattr(V, "PIECE_ROWS", 20)  # cells in pieces
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    for kind in (None, "kind"):
        index = V.build(frame, "id", "v", kind)
        asks = [i for i, _, v in rows if v and i % 100 == 0]
        want = brute([(i, k if kind else "", v) for i, k, v in rows], asks, 10)
        same(results(V.search(index, frame.where("id % 100 = 0"), "id", "v", 10, kind, probes, exact=True)), want)


def test_few_rows(spark, frame):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "id long, v array<float>")
    index = V.build(few, "id", "v")
    assert results(V.search(index, few, "id", "v", 10)) == {1: [(2, 0.9939)], 2: [(1, 0.9939)]}
    assert V.build(few.limit(0), "id", "v") is None
    assert V.search(index, few.limit(0), "id", "v", 10).collect() == []
