"""Operators 11 to 13 against brute force: odd rows, empty tables, clashing columns, long texts, hot keys, small blocks."""

import hashlib
import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fernweave.llm import common, conversations, earley, line_dedup, whitening

SPACE = " \t\n\v\f\r"

# lines


def brute_lines(rows):
    """Sorted (doc_id, n_lines, n_dropped, sha) of rows of (doc_id, text)."""
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    least = lambda d: (d is not None, d)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)], key=least) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, *map(str, r)))


def line_rows():
    rng = np.random.default_rng(5)
    stock = ["The same line of ten", "  the SAME line of ten\t", "short", "", "äöüäöüäöüä", "ÄÖÜäöüäöüä", "äöüäöüäöü", "\x0bspaces inside  stay here\x0c", "spaces inside stay here", "x" * 5000]
    rows = [(int(k % 37), "\n".join(rng.choice(stock, rng.integers(0, 9)).tolist())) for k in range(60)]
    rows += [(None, "The same line of ten\nof a null id, alone"), (None, None), (100, None), (101, ""), (102, "\n"), (103, "The same line of ten"), (103, "The same line of ten")]
    return rows + [(104, "\n".join(f"a line of a long text, number {k % 900}" for k in range(40_000))), (105, "a line of a long text, number 7\n" * 3 + "end")]


def line_results(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in frame.collect()), key=lambda r: (r[0] is not None, *map(str, r)))


@pytest.mark.parametrize("block", [1, 5000, 32 << 20])
def test_lines(spark, monkeypatch, block):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, mark string, n_lines int").repartition(5)
    keep = line_dedup.keep_bitmaps(docs, block_bytes=block)
    monkeypatch.setattr(line_dedup, "keep_bitmaps", lambda *_: keep)
    assert line_results(line_dedup.deduplicate_lines(docs)) == brute_lines(rows)


def test_line_bitmaps(spark):
    docs = spark.createDataFrame([(1, "one line of text\nshort\none line of text"), (2, "short\nOne line of text \nanother one here")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs).collect()}
    bits = {d: np.unpackbits(np.frombuffer(zstandard.decompress(r.keep), np.uint8), count=r.n_lines).tolist() for d, r in got.items()}
    assert bits == {1: [1, 1, 1], 2: [1, 0, 1]} and got[2].n_dropped == 1
    assert {r.kept_text for r in line_dedup.deduplicate_lines(docs, texts=True).collect()} == {"one line of text\nshort\none line of text", "short\nanother one here"}
    assert line_dedup.deduplicate_lines(docs.limit(0)).collect() == []


def test_a_line_of_every_document_travels_once_a_block(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the line that all hold\nand number "), F.col("id").cast("string"), F.lit(" alone")).alias("text")).repartition(3)
    sent = line_dedup.hashed(docs, 10, 32 << 20).where("n_lines = 0").groupBy("hi", "lo").count().orderBy(F.desc("count")).first()
    assert sent["count"] == 3


# vectors


def brute_whitening(rows, components=16):
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = defaultdict(int)
    for _, x in good:
        lengths[len(x)] += 1
    d = max(lengths, key=lambda k: (lengths[k], k))
    good = [(i, x) for i, x in good if len(x) == d]
    points = sorted({tuple(x) for _, x in good})
    n, sums = len(points), [sum(c) for c in zip(*points)]
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in points], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return good, n, sums, values[order], vectors[:, order].T, values.sum()


def check_whitening(spark, rows, vector="array<float>"):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding {vector}, x string").repartition(7)
    got = whitening.whiten(frame).collect()
    good, n, sums, values, vectors, trace = brute_whitening(rows)
    c = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == c * len(good)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    want = defaultdict(list)
    for i, x in good:
        want[i].append(x)
    sign = {}
    for i, xs in want.items():
        for k in range(c):
            rs = [r for r in by[i] if r.component == k + 1]
            assert len(rs) == len(xs)
            for r in rs:
                assert r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(values[k] / trace, rel=1e-6)
                assert int(r.deviation) in {sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs}
            if len(xs) == 1:
                exact = float(np.array([n * a - s for a, s in zip(xs[0], sums, strict=True)]) @ vectors[k] / n / math.sqrt(values[k]))
                sign.setdefault(k, 1 if exact * rs[0].whitened >= 0 else -1) if abs(exact) > 0.1 else None
                assert rs[0].whitened * sign.get(k, 1) == pytest.approx(exact, abs=1e-6) or k not in sign
    assert len(sign) == c
    return got


def test_whitening(spark):
    rng = np.random.default_rng(7)
    spread = np.linspace(3, 0.3, 20)
    rows = [(k, (rng.normal(size=20) * spread).tolist()) for k in range(400)]
    hot = (rng.normal(size=20) * spread).tolist()
    rows += [(1000 + k, hot) for k in range(200)] + [(5, None), (6, []), (7, [1.0, None] * 10), (8, [float("nan")] * 20), (9, [float("inf")] * 20), (None, hot), (1300, [1.0] * 19)]
    check_whitening(spark, rows)


def test_whitening_of_few_dimensions_and_large_means(spark):
    rng = np.random.default_rng(8)
    check_whitening(spark, [(k, (1000 + rng.normal(size=3) * [2, 1, 0.5]).tolist()) for k in range(300)])
    one = rng.normal(size=(300, 2))
    check_whitening(spark, [(k, [a, b, 0.25]) for k, (a, b) in enumerate(one.tolist())])  # a dimension without spread


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.normal(size=(40, 9)))
    w, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    sizes = 10.0 ** -np.arange(9)
    values, vectors = whitening.jacobi(whitening.triangle((q * sizes) @ w.T))
    assert values == pytest.approx(sizes, rel=1e-7)
    assert np.abs(np.abs((vectors @ w).diagonal()) - 1).max() < 1e-7


def test_squares_beyond_64_bits():
    assert whitening.squares(np.array([[1 << 40, 3], [0, 1 << 41]])) == [(1 << 80) + 9, 1 << 82]


# conversations


def search(signs):
    """Least (cost, audit) by trying every edit, with up to two inserts before a row."""
    best = [None]

    def go(k, place, cost, audit, inserts):
        if best[0] is not None and cost > best[0][0]:
            return
        if k == len(signs) and place in "BA":
            best[0] = min(best[0] or (cost, audit), (cost, audit))
        if inserts < 2:
            go(k, "A" if place == "U" else "U", cost + 2, audit + "I", inserts + 1)
        if k == len(signs):
            return
        sign = signs[k]
        go(k + 1, place, cost + 3, audit + "D", 0)
        if sign == "x":
            return
        cut, letter = sign.isupper(), sign.lower()
        if letter == "s" and place == "B":
            go(k + 1, "S", cost + cut, audit + "K", 0)
        if letter == ("a" if place == "U" else "u"):
            go(k + 1, "A" if place == "U" else "U", cost + cut, audit + "K", 0)
        go(k + 1, "A" if place == "U" else "U", cost + 2 + cut, audit + "R", 0)

    go(0, "B", 0, "", 0)
    return best[0]


def test_parses_are_those_of_a_search():
    for n in range(5):
        for signs in itertools.product("suaxoSUA"[: 8 if n < 4 else 5], repeat=n):
            assert earley.cheapest(earley.parse("".join(signs))) == search(signs)
    rng = np.random.default_rng(4)
    for _ in range(60):
        signs = "".join(rng.choice(list("ssuuaaxoUA"), 7))
        assert earley.cheapest(earley.parse(signs)) == search(signs)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_products_of_stretches_are_parses(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        signs = "".join(rng.choice(list("suuuaaaxoSUA"), 23))
        product = earley.Product()
        for k in range(0, len(signs), size):
            product.put(earley.table(signs[k : k + size]))
        assert earley.cheapest(product.total()["B"]) == earley.cheapest(earley.parse(signs))


def brute_talks(rows):
    """conv_id: result of damaged rows, one conversation after the other."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv]  # noqa: B018
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        talks[conv] += [((turn is not None, turn), "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        turns = [t for (there, t), *_ in talk if there]
        seen, signs, faults = set(), "", []
        for _, role, text in talk:
            bare = text.rstrip(SPACE)
            fault = "b" if not bare.strip(SPACE) else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signs += "x" if fault in ("b", "d") else letter.upper() if fault == "t" else letter
            faults.append(fault)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(talk)]
        cost, audit = search(signs) if len(signs) < 9 else earley.cheapest(earley.parse(signs))
        pieces, place, k = [], "B", 0
        for edit in audit:
            _, role, text = talk[k] if k < len(talk) else (0, "", "")
            k += edit != "I"
            if edit == "D":
                continue
            given = "assistant" if place == "U" else "user"
            if edit == "K" and role[:1] == "s":
                place = "S"
            else:
                place = "A" if place == "U" else "U"
            pieces.append((role if edit == "K" else given) + ":" + ("" if edit == "I" else text))
        counts = tuple(sum(f == x for f in faults) for x in "bdt")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(pieces).encode()).hexdigest())
    return out


def talk_results(frame):
    rows = frame.collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def talk_rows():
    rng = np.random.default_rng(2)
    texts = ["Yes.", "No!", "Is it? \n", "cut off", "", " \t", None, "Long text " * 2000 + ".", "Ünï 日本."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for conv in [None, *range(-3, 60)]:
        n = int(rng.integers(0, 8)) if conv != 7 else 300
        for k in range(n):
            turn = None if rng.random() < 0.05 else int(k + rng.integers(0, 2))
            rows.append((conv, turn, roles[rng.integers(0, len(roles))] if rng.random() < 0.4 else roles[k % 2], texts[rng.integers(0, len(texts))]))
    return rows + rows[:5] + [(90, 1, "user", "Same."), (90, 2, "user", "Same."), (91, None, "user", "A?"), (91, None, "user", "A?")]


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_talks(spark, stretch):
    rows = talk_rows()
    schema = "conv_id long, turn long, role string, text string, at string, copies string, seen int"
    frame = spark.createDataFrame([(*r, "z", "z", 1) for r in rows], schema).repartition(6)
    assert talk_results(conversations.repair(conversations.damage(frame), stretch)) == brute_talks(rows)


def test_a_talk_with_most_rows(spark):
    """One conversation in all partitions; one of its rows stands very often."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"Row {k % 400}.") for k in range(3000)] + [(1, 5000, "user", "Hot.")] * 500 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert talk_results(conversations.repair(conversations.damage(frame))) == brute_talks(rows)


def test_talks_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair(conversations.damage(spark.createDataFrame([], schema))).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = talk_results(conversations.repair(conversations.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_undamaged_talks(spark):
    frame = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "assistant", "Ho."), (2, 1, "assistant", "Ho")], "conv_id long, turn long, role string, text string")
    got = talk_results(conversations.repair(conversations.whole(frame)))
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "KK") and got[2][5:7] == (3, "D")


def test_queries_leave_no_session_change_to_results(spark, sf_dir):
    common.short_batches(spark, 3)
    assert whitening.whiten(common.table(spark, sf_dir, "embeddings")).groupBy("component").count().count() == 16
