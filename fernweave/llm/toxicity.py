"""Operator 3: toxicity by compression distance.

Method: one zstandard dictionary is trained on words typical of toxic texts, which are those with an n-gram of 6 to 8
signs, spaces round the word included, that stands much more often there (typical()), and one on all words of ordinary texts. Each window of a text, a run of letters in lower
case, is compressed with either; how many bytes the toxic dictionary saves is the window's distance. A filler that both dictionaries end with follows each window, so that block overhead
is the same and a match at the window's end is found. A text's counts of windows beyond each distance, and their
share of the text, go through a logistic curve; its weights are calibrated on labelled texts that the dictionaries have
not seen: either half of the sample is measured by dictionaries of the other half.

The model is fitted on the whole texts of a bounded sample of labelled rows (SAMPLE), chosen by a hash of the id, so
that counts are calibrated on texts as long as those scored; a task each trains the dictionaries of either half and of
the whole sample. Only the text is an input of a score.

Defined results: a null or empty text has no window and gets the score of zero counts. If the labels lack one class
there is nothing to tell apart, and all scores are the share of toxic labels (0 without labels). Rows that repeat
an id are scored each, equal texts alike; a label that stands twice for an id counts once for each value; a null id is
not held out. A text of any length is scored whole. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenize import Memo
from .words import mix

SAMPLE = {1: 3000, 0: 5000}
TOXIC_BYTES, PLAIN_BYTES = 8192, 24_000
FEW, SHARE, ODDS = 4, 0.015, 3.0  # a typical n-gram: so many toxic texts, such a share of them, such log odds of its places
GRAMS = (6, 7, 8)
TIMES = 8  # of an n-gram's places in a text, so many count
SEGMENT, PART = 64, 6  # bytes of a dictionary's segments and of the parts they are picked by
MERGE = 1_000_000  # n-grams that are counted before they are merged
MOST = 9  # distances are counted up to here
THRESHOLD = 0.7
POSITIVE_WEIGHT = 2.0
WORD = re.compile(r"[^\W\d_]+")
OUT = "doc_id long, score double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Model:
    toxic: bytes
    plain: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]

    def score(self, features: np.ndarray) -> float:
        z = float(((features - self.mean) / self.spread) @ np.array(self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-min(max(z, -60), 60)))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary's content; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PART).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@cache
def filler() -> bytes:
    return bytes(random.Random(5).choices(b"#$%&*+<=>@^_|~0123456789", k=64))


class Distance:
    """Bytes that the toxic dictionary saves on a window, from 0 to MOST - 1; known words are looked up."""

    def __init__(self, toxic: bytes, plain: bytes):
        self.memo = Memo(300_000)
        self.toxic, self.plain = map(self.compressor, (toxic, plain))

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(content + filler(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(
            window_log=16, hash_log=14, chain_log=14, search_log=6, min_match=4, target_length=1, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)

    def window(self, word: str) -> int:
        raw = f" {word} ".encode() + filler()
        return min(max(len(self.plain.compress(raw)) - len(self.toxic.compress(raw)), 0), MOST - 1)

    def features(self, text: str) -> np.ndarray:
        found = words(text)
        memo = self.memo
        got = list(map(memo.young.get, found))
        if None in got:
            for k, d in enumerate(got):
                if d is None:
                    w = found[k]
                    d = memo.young.get(w)
                    if d is None:
                        d = memo.again(w)
                    got[k] = memo.put(w, self.window(w)) if d is None else d
        beyond = np.cumsum(np.bincount(np.array(got, np.int64), minlength=MOST)[::-1])[::-1][2:]
        return np.concatenate([np.log1p(beyond), np.log1p(300 * beyond / max(1, len(got)))])


def gram_hashes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams (GRAMS) of words between spaces, and the number of the word that each is of."""
    signs = np.frombuffer("".join(f" {w} " for w in found).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(w) + 2 for w in found])
    hashes, owners = [], []
    for n in GRAMS:
        m = len(signs) - n + 1
        if m > 0:
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = mix(h + signs[k : k + m])
            inside = owner[:m] == owner[n - 1 :]
            hashes.append(h[inside])
            owners.append(owner[:m][inside])
    return np.concatenate(hashes or [signs]), np.concatenate(owners or [owner])


def text_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of a text's words and how often each stands there, TIMES at most."""
    found = Counter(words(text))
    hashes, owner = gram_hashes(list(found))
    values, which = np.unique(hashes, return_inverse=True)
    times = np.bincount(which.reshape(-1), weights=np.array(list(found.values()), np.float64)[owner], minlength=len(values))
    return values, np.minimum(times, TIMES)


def text_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes, in how many of the texts each stands, and how often, TIMES a text at most."""
    values, docs, times = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for k, t in enumerate(texts):
        held.append(text_grams(t))
        size += len(held[-1][0])
        if size >= MERGE or k == len(texts) - 1:
            flat = np.concatenate([values, *(v for v, _ in held)])
            values, which = np.unique(flat, return_inverse=True)
            add = lambda w: np.bincount(which.reshape(-1), weights=w, minlength=len(values))  # noqa: B023, E731
            docs, times = add(np.concatenate([docs, np.ones(size)])), add(np.concatenate([times, *(c for _, c in held)]))
            held, size = [], 0
    return values, docs, times


def typical(toxic: list[str], plain: list[str]) -> np.ndarray:
    """Hashes of word n-grams that stand much more often in the toxic texts."""
    values, docs, times = text_counts(toxic)
    often = docs >= max(FEW, SHARE * len(toxic))
    values, times = values[often], times[often]
    there = np.zeros(len(values))
    for t in plain if len(values) else ():
        own, count = text_grams(t)
        if len(own):
            place = np.minimum(np.searchsorted(own, values), len(own) - 1)
            there += np.where(own[place] == values, count[place], 0)
    odds = np.log((times + 0.5) / (len(toxic) + 1)) - np.log((there + 0.5) / (len(plain) + 1))
    return values[odds > ODDS]


def typical_words(text: str, good: np.ndarray) -> list[str]:
    """The words of a text, with repeats, that have an n-gram of the lexicon."""
    found = words(text)
    hashes, owner = gram_hashes(found)
    return [found[k] for k in np.unique(owner[np.isin(hashes, good)]).tolist()]


def train(toxic: list[str], plain: list[str]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary."""
    good = typical(toxic, plain)
    windows = [f" {w} ".encode() for t in toxic for w in typical_words(t, good)]
    others = [f" {w} ".encode() for t in plain for w in words(t)]
    random.Random(7).shuffle(others)
    return trained(windows, TOXIC_BYTES), trained(others, PLAIN_BYTES)


FOLDS = (0, 1, None)


def measured(rows: list[tuple[str, int]], fold: int | None) -> tuple[bytes, bytes, np.ndarray]:
    """For a fold the features, with label, of the half of the sample that is not the fold's, by dictionaries of the one that is;
    without one the dictionaries of the whole sample."""
    toxic, plain = [t for t, y in rows if y], [t for t, y in rows if not y]
    if fold is None:
        return *train(toxic, plain), np.zeros((0, 0))
    distance = Distance(*train(toxic[fold::2], plain[fold::2]))
    found = [[*distance.features(t), float(y)] for y, texts in ((1, toxic), (0, plain)) for t in texts[1 - fold :: 2]]
    return b"", b"", np.array(found)


def solved(parts: list[tuple[bytes, bytes, np.ndarray]]) -> Model:
    """The model from what was measured of all folds."""
    toxic, plain = next((t, p) for t, p, x in parts if not x.size)
    rows = np.concatenate([x for *_, x in parts if x.size])
    x, y = rows[:, :-1], rows[:, -1]
    mean, spread = x.mean(0), x.std(0) + 1e-6
    a = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    weight, w = np.where(y > 0, POSITIVE_WEIGHT, 1.0), np.zeros(a.shape[1])
    for _ in range(40):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        hessian = a.T @ (a * (weight * p * (1 - p))[:, None]) + np.eye(len(w))
        w = w + np.linalg.solve(hessian, a.T @ (weight * (y - p)) - w)
    return Model(toxic, plain, tuple(mean.tolist()), tuple(spread.tolist()), tuple(w.tolist()))


def too_few(toxic: int, plain: int) -> bool:
    return toxic < 2 or plain < 2


def fit(rows: list[tuple[str, int]]) -> Model | float:
    """A model from (text, label) rows; where a class is missing the share of toxic ones."""
    toxic = sum(1 for _, y in rows if y)
    if too_few(toxic, len(rows) - toxic):
        return toxic / len(rows) if rows else 0.0
    return solved([measured(rows, fold) for fold in FOLDS])


def fit_sample(sampled: DataFrame) -> Model | float:
    """fit() of a bounded sample (doc_id, toxic, text) on the executors, a task for each fold; dictionaries and features come back."""
    counts = {r.toxic: r.n for r in sampled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, plain = counts.get(1, 0), counts.get(0, 0)
    if too_few(toxic, plain):
        return toxic / (toxic + plain) if counts else 0.0

    def run(key: tuple, group: pa.Table) -> pa.Table:
        common.let_go()
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True), key=lambda r: (hashlib.md5(str(r[0]).encode()).digest(), r[1:]))
        good, bad, x = measured([(t, y) for _, y, t in rows], FOLDS[key[0].as_py()])
        return pa.table({"toxic": [good], "plain": [bad], "width": pa.array([x.shape[1]], pa.int32()), "x": [x.astype("<f8").tobytes()]})

    folds = sampled.withColumn("fold", F.explode(F.array(*map(F.lit, range(len(FOLDS))))))
    parts = folds.groupBy("fold").applyInArrow(run, "toxic binary, plain binary, width int, x binary").collect()
    return solved([(bytes(r.toxic), bytes(r.plain), np.frombuffer(r.x, "<f8").reshape(-1, r.width) if r.width else np.zeros((0, 0))) for r in parts])


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text): at most SAMPLE labelled texts of each class that are not held out; the first by a hash of the id,
    and of rows that repeat an id the first by a hash of the text."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    mixed = F.xxhash64("doc_id")
    some = [known.where(F.col("toxic") == y).orderBy(mixed, "doc_id").limit(n) for y, n in SAMPLE.items()]
    texts = common.whole_text(docs).join(F.broadcast(some[0].union(some[1])), "doc_id")  # SAMPLE bounds the labels
    return common.materialize(texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")


def distance_of(model: Model) -> Distance:
    """The distance of a Python worker, kept between tasks."""
    return common.hold(("toxicity", model), lambda: Distance(model.toxic, model.plain))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score of every row."""
    common.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = [model.score(distance_of(model).features(t)) for t in texts] if isinstance(model, Model) else [model] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], schema=SCHEMA)

    return common.whole_text(docs).mapInArrow(run, OUT)


def keep_ordinary(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold. Nothing is shuffled."""
    common.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not isinstance(model, Model):
                yield batch if model < threshold else batch.slice(0, 0)
                continue
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([model.score(distance_of(model).features(t or "")) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, by a model of `labels` outside the held-out third."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit_sample(sample(docs, common.table(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
