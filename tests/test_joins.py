"""Joins that must not form all pairs, against brute force: names that may mean the same, and lexical searches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import graph as G
from fernweave.operators import lexical_index as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near(a, b):
    grams = lambda s: {s[k : k + 2] for k in range(len(s) - 1)}
    if any(c in "0123456789" for g in grams(a) ^ grams(b) for c in g):
        return False
    latin = lambda s: s.isascii() and any(c.isalpha() for c in s)
    if latin(a) and latin(b):
        return distance(a, b) <= min(len(a), len(b)) // 2
    most, both = max(len(set(a)), len(set(b))), len(set(a) & set(b))
    return both > 1 if most < 4 else both / most >= 0.8


def names():
    rng = random.Random(5)
    han = "归脾汤桂枝柴胡当黄芪白术人参甘草生姜大枣半夏陈皮茯苓川芎"
    rows = [("方", "".join(rng.choices(han, k=rng.randint(1, 7)))) for _ in range(250)]
    rows += [("x", "".join(rng.choices("abcdeeeettoo ", k=rng.randint(1, 12)))) for _ in range(250)]
    rows += [("mix", w) for w in ("A1", "A12", "B1", "b1", "aB", "甲a", "甲b", "甲乙", "甲乙a", "12", "123", "1-2", "甲1乙", "乙甲1", "甲1", "x 2024", "y 2024", "é", "ée", "aé")]
    return rows + [("x", ""), ("方", None), (None, "ab"), ("x", "ab"), ("x", "ab")]


def test_name_pairs(spark):
    rows = names()
    got = G.name_pairs(spark.createDataFrame(rows, "label string, name string"), "label", "name").collect()
    assert len(got) == len({tuple(r) for r in got})
    known = {(k, n) for k, n in rows if k and n}
    want = {(k, a, b) for k, a in known for j, b in known if j == k and a < b and near(a, b)}
    assert {tuple(r) for r in got} == want


def test_few_name_pairs_are_judged(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet".replace("sf0.001", "sf0.01"))
    judged = G.judged_pairs(parts, "p_brand", "p_name").count()
    assert judged <= 10 * G.name_pairs(parts, "p_brand", "p_name").count()


def brute_search(questions, docs, k):
    keys = lambda t: [(w, 4) for w in t] + [(a + b, 6) for a, b in zip(t, t[1:])]
    out = []
    for q, text in questions:
        bag = Counter()
        for key, w in keys((text or "").lower().split()):
            bag[key] += w
        found = []
        for d, words in docs:
            own = {key for key, _ in keys((words or "").lower().split())}
            if shared := sum(w for key, w in bag.items() if key in own):
                found.append((-round((1e-9 + shared / 10) / (1e-9 + sum(bag.values()) / 10), 6), d))
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("look", [1, 50, L.LOOK])
def test_lexical_search(spark, look):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(k, " ".join(["the", *rng.sample(words, rng.randint(0, 30))])) for k in range(400)] + [(900, None), (901, ""), (902, "the the the")]
    questions = [(k, " ".join(["the", *rng.sample(words, rng.randint(0, 12)), "the"])) for k in range(30)] + [(50, None), (51, "nowhere"), (52, "the")]
    low = T.whitespace_tokens(F.lower("text"))
    index = L.build(spark.createDataFrame(docs, "id long, text string"), "id", low)
    got = L.search(index, spark.createDataFrame(questions, "qid long, text string"), "qid", low, 5, look)
    assert sorted((r.qid, r.did, r.similarity, r.place) for r in got.collect()) == brute_search(questions, docs, 5)


def test_frequent_keys_are_not_read(spark):
    docs = [(k, f"the of and in x{k}") for k in range(300)] + [(500, "rare pair of words"), (501, "rare pair and more")]
    low = T.whitespace_tokens(F.lower("text"))
    index = L.build(spark.createDataFrame(docs, "id long, text string"), "id", low)
    read = []
    matched, L.matched = L.matched, lambda i, w: read.append({r.token for r in w.collect()}) or matched(i, w)
    try:
        question = spark.createDataFrame([(1, "rare pair of the words and more")], "qid long, text string")
        got = [r.did for r in L.search(index, question, "qid", low, 2, 10).orderBy("place").collect()]
    finally:
        L.matched = matched
    assert got == [500, 501] and "the" not in read[1] and "of" not in read[1] and "pair" in read[1]


def test_index_is_written_once(spark):
    """No row for each document and key is written beside the postings, and those of frequent words are short."""
    docs = [(k, " ".join(f"w{(k * j) % 97}" for j in range(200))) for k in range(500)]
    index = L.build(spark.createDataFrame(docs, "id long, text string"), "id", T.whitespace_tokens(F.lower("text")))
    assert not hasattr(index, "terms") and "Exchange" not in index.docs._jdf.queryExecution().executedPlan().toString()
    want = Counter(key for _, t in docs for key in {*t.split(), *(a + b for a, b in zip(t.split(), t.split()[1:]))})
    got = Counter()
    for r in index.postings.collect():
        assert r.n == len(r.docs) == len(set(r.docs))
        got[r.token] += r.n
    assert got == want


def test_rows_of_one_document(spark):
    """Ids that repeat are one document, keys that two pairs give count once, and keys don't reach over rows."""
    docs = [(1, "ab c a bc abc"), (1, "ab c"), (1, "x"), (2, "c x"), (3, None)]
    low = T.whitespace_tokens(F.lower("text"))
    index = L.build(spark.createDataFrame(docs, "id long, text string"), "id", low)
    question = spark.createDataFrame([(1, "ab c"), (2, "c x")], "qid long, text string")
    got = {(r.qid, r.did): r.similarity for r in L.search(index, question, "qid", low, 5).collect()}
    assert got == {(1, 1): 1.0, (1, 2): round(4 / 14, 6), (2, 1): round(8 / 14, 6), (2, 2): 1.0}
