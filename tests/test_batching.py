import random

import numpy as np
import pytest

from fernweave.operators import batching as B


def plain(costs, limit):
    out, batch, total = [], -1, limit + 1
    for c in costs:
        if total + c > limit:
            batch, total = batch + 1, 0
        total += c
        out.append(batch)
    return out, total, batch


def draws(rnd):
    return rnd.choice([lambda: rnd.randint(0, 9), lambda: 1, lambda: 0, lambda: rnd.choice([0, 0, 1, 50]), lambda: rnd.randint(0, 3)])


@pytest.mark.parametrize("seed", range(200))
def test_steps_are_the_loop(seed):
    rnd = random.Random(seed)
    limit, draw = rnd.randint(1, 30), draws(rnd)
    costs = [draw() for _ in range(rnd.randint(1, 60))]
    cuts = sorted({0, len(costs), *(rnd.randrange(len(costs)) for _ in range(5))})
    parts = [B.Steps.of(np.array(costs[a:b], np.int64), limit) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.then(part, limit)
    for used in [*range(limit + 1), limit + 1, limit + 40]:
        total, batch = used, 0
        for c in costs:
            if total + c > limit:
                total, batch = 0, batch + 1
            total += c
        got_used, got_batch = whole.after(np.array([used]), np.array([0]), limit)
        assert got_batch[0] == batch
        assert got_used[0] == total or min(got_used[0], total) > limit  # more than full is all the same


@pytest.mark.parametrize(("block", "fan"), [(3, 2), (2, 3), (4096, 64)])
def test_one_group_over_many_blocks(spark, block, fan):
    rnd = random.Random(block)
    rows = [("hot", k, rnd.choice([0, 1, 5, 9, 40])) for k in range(150)] + [(None, k, 3) for k in range(9)] + [("a", 7, None), ("a", 8, 30), ("a", 9, None), ("b", 1, 0)]
    want = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        want |= {(*r, b) for r, b in zip(own, plain([r[2] or 0 for r in own], 20)[0], strict=True)}
    rnd.shuffle(rows)
    got = B.greedy_batches(spark.createDataFrame(rows, "source string, doc_id long, n_chars long"), "source", "doc_id", "n_chars", 20, block, fan).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == want


def test_no_rows(spark):
    rows = spark.createDataFrame([], "source string, doc_id long, n_chars long")
    assert B.greedy_batches(rows, "source", "doc_id", "n_chars", 20).count() == 0
