"""An inverted index of token keys, and top-k searches that read few postings.

A question's keys have weights, and a document scores the weights of the keys that it has, as in retrieval.token_similarity.
Each key bounds what it can add, so keys are taken rarest first:

1. The rarest keys, up to LOOK postings a question, give partial scores; the k-th best of these is a floor of the k-th best score.
2. The most frequent keys whose weights add up to less than the floor can't lift a document over it alone. Postings of those
   keys are never read; the other keys give the candidates, with partial scores that raise the floor.
3. Candidates that can still reach the floor are completed from the keys of their own documents.

Results are exact, ties included. Building shuffles nothing: a task turns its documents, a block of some BLOCK_TOKENS tokens at a
time, into rows of a key and the documents of the block that have it, sorted by key. So a key that all documents have is many
rows, and Parquet's bounds of each page leave most of a file unread where few keys are asked for. How frequent a key is gets
counted when a question asks for it, from a column of its own; the keys of a document come from its text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize, new_dir
from .retrieval import SMOOTH, bags, top_k

#: Tokens of a block, in whole documents; keys that go into the scan as literals; rows of questions that go to all tasks.
BLOCK_TOKENS, LITERALS, SENT = 1_000_000, 10, 100_000
#: Postings that a question reads to find its first floor.
LOOK = 4096


@dataclass
class LexicalIndex:
    """postings: token, n, docs, a row for each key and block; n is the length of docs. docs: did and what tokens is made of."""

    path: str
    postings: DataFrame
    docs: DataFrame
    tokens: Column


def block_postings(ids: pa.Array, lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Keys of a block in order, how many documents have each, and these documents one key after the other. Two pairs of tokens may
    give one key, and a pair one that is also a token. Null tokens part what stands round them."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    doc, flat = np.repeat(np.arange(len(ids)), lengths), pc.list_flatten(lists)
    valid = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    coded = pc.fill_null(flat, "").dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    at = np.flatnonzero((doc[:-1] == doc[1:]) & valid[:-1] & valid[1:])
    pairs, of = np.unique(code[at] * max(1, len(words)) + code[at + 1], return_inverse=True)
    joined = pc.binary_join_element_wise(words.take(pa.array(pairs // max(1, len(words)))), words.take(pa.array(pairs % max(1, len(words)))), "")
    every = pa.concat_arrays([words, joined]).dictionary_encode()  # equal keys once
    order = pc.sort_indices(every.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[every.indices.to_numpy(zero_copy_only=False)]
    n = max(1, len(ids))
    both = np.unique(np.concatenate([key[code[valid]] * n + doc[valid], key[len(words) + of] * n + doc[at]]))
    found, counts = np.unique(both // n, return_counts=True)
    return every.dictionary.take(pa.array(order[found])), counts, ids.take(pa.array(both % n))


def build(docs: DataFrame, did: str, tokens: Column) -> LexicalIndex:
    """The index of all documents, below the shared folder. Rows with one id are one document; keys don't reach over rows."""
    spark = docs.sparkSession
    path = new_dir(spark, "lexical")
    rows = docs.select(F.col(did).alias("did"), tokens.alias("tokens"))
    if not docs.groupBy(did).count().where("count > 1").isEmpty():
        rows = rows.groupBy("did").agg(F.flatten(F.collect_list(F.concat("tokens", F.array(F.lit(None).cast("string"))))).alias("tokens"))
    shape = f"token string, n int, docs array<{docs.schema[did].dataType.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("did"), batch.column("tokens")
            block = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_TOKENS
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(ids)]
            for start, end in zip(edges, edges[1:], strict=False):
                keys, counts, found = block_postings(ids.slice(start, end - start), lists.slice(start, end - start))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                for k in range(0, len(keys), 65_536):  # lists of a whole block would be one large batch
                    own = pa.ListArray.from_arrays(offsets.slice(k, min(65_536, len(keys) - k) + 1), found)
                    yield pa.RecordBatch.from_arrays([keys.slice(k, len(own)), pa.array(counts[k : k + len(own)], pa.int32()), own], ["token", "n", "docs"])

    found = rows.mapInArrow(run, shape)
    found.write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path)
    return LexicalIndex(path, spark.read.schema(found.schema).parquet(path), docs.withColumnRenamed(did, "did"), tokens)


def rows_of(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """The postings joined with wanted rows by token. A few tokens are left to the scan; up to SENT rows are sent to all tasks, so
    that postings which nobody asked for aren't shuffled."""
    few = [r.token for r in wanted.select("token").distinct().limit(LITERALS + 1).collect()]
    own = index.postings.where(F.col("token").isin(few)) if len(few) <= LITERALS else index.postings
    return own.join(F.broadcast(wanted) if wanted.limit(SENT + 1).count() <= SENT else wanted, "token")


def matched(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """wanted: qid, token, weight. qid, did, partial: weights of wanted keys by document."""
    hits = rows_of(index, wanted).select("qid", F.explode("docs").alias("did"), "weight")
    return hits.groupBy("qid", "did").agg(F.sum("weight").alias("partial"))


def floors(found: DataFrame, k: int, name: str) -> DataFrame:
    """qid and the k-th best partial score, of questions that have so many."""
    return top_k(found, "qid", [F.desc("partial"), "did"], k).where(F.col("place") == k).select("qid", F.col("partial").alias(name))


def search(index: LexicalIndex, questions: DataFrame, qid: str, tokens: Column, k: int, look: int = LOOK) -> DataFrame:
    """(qid, did, similarity, place) of the k documents most like each question, by similarity rounded to six digits, then id."""
    bag = materialize(bags(questions.withColumnRenamed(qid, "qid"), "qid", tokens), "bags")
    total = bag.groupBy("qid").agg(F.sum("weight").alias("total"))
    rare_first = Window.partitionBy("qid").orderBy("df", "token")
    after = rare_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    frequent = rows_of(index, bag.select("token").distinct()).groupBy("token").agg(F.sum("n").alias("df"))
    ranked = bag.join(frequent, "token").join(total, "qid")
    ranked = ranked.withColumn("read", F.sum("df").over(rare_first.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rest", F.sum("weight").over(after))
    ranked = materialize(ranked, "question-keys")
    first = matched(index, ranked.where(F.coalesce("read", F.lit(0)) < look).select("qid", "token", "weight"))
    marked = ranked.join(floors(first, k, "floor"), "qid", "left")
    # A rounding step of the similarity may make scores equal that differ by this much.
    slack = F.col("total") * 1e-6
    marked = materialize(marked.withColumn("must", F.col("floor").isNull() | (F.col("rest") + slack >= F.col("floor"))), "judged-keys")
    found = materialize(matched(index, marked.where("must").select("qid", "token", "weight")), "candidates")
    spare = marked.groupBy("qid").agg(F.sum(F.when(~F.col("must"), F.col("weight")).otherwise(0)).alias("spare"), F.first("total").alias("total"))
    able = found.join(floors(found, k, "bar"), "qid", "left").join(spare, "qid")
    able = materialize(able.where(F.col("bar").isNull() | (F.col("partial") + F.col("spare") + slack >= F.col("bar"))).select("qid", "did", "partial", "total"), "able")
    unread = marked.where(~F.col("must")).select("qid", "token", "weight")
    texts = index.docs.join(able.select("did").distinct(), "did", "left_semi").select("did", index.tokens.alias("tokens"))
    own = texts.select("did", F.explode(F.transform(T.bag_entries(F.col("tokens")), lambda e: e["key"])).alias("token")).join(unread.select("token").distinct(), "token", "left_semi")
    asked = able.select("qid", "did").join(unread, "qid")
    more = asked.join(own, ["did", "token"], "left_semi").groupBy("qid", "did").agg(F.sum("weight").alias("more"))
    score = (SMOOTH + (F.col("partial") + F.coalesce("more", F.lit(0))) / 10) / (SMOOTH + F.col("total") / 10)
    scored = able.join(more, ["qid", "did"], "left").select("qid", "did", F.round(score, 6).alias("similarity"))
    return top_k(scored, "qid", [F.desc("similarity"), "did"], k)
