"""Filters, look-ups, joins, aggregates and rankings over index tables.

Frames that stand for lists carry their order in a column, so ties fall as they do in a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_TOKENS, MIN_TOKENS
from ..functions import text as T


def contains_any(columns: list[str], words: list[str]) -> Column:
    """Whether one of the columns contains one of the words, without regard to case."""
    out = F.lit(False)
    for c in columns:
        low = F.lower(F.coalesce(F.col(c), F.lit("")))
        for w in words:
            out = out | F.contains(low, F.lit(w.lower()))
    return out


def lexical_candidates(chunks: DataFrame, words: list[str], columns: list[str], order: list[str], limit: int) -> DataFrame:
    """The first chunks, by order, in which a word stands; without words the first chunks."""
    found = chunks.where(contains_any(columns, words)) if words else chunks
    return found.orderBy(*order).limit(limit)


def chunks_with_all(chunks: DataFrame, words: list[str], column: str, key: str, limit: int) -> DataFrame:
    """The shortest chunks in which all words stand."""
    found = chunks
    for w in words:
        found = found.where(contains_any([column], [w]))
    return found.orderBy(F.length(column), key).limit(limit)


def in_requested_order(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """wanted: (pos, key). Rows by key in the order asked for; the first place of a repeated key counts."""
    first = wanted.groupBy(key).agg(F.min("pos").alias("pos"))
    return rows.join(first, key)


def best_by_pair(relations: DataFrame, a: str, b: str, weight: str, key: str) -> DataFrame:
    """Of the relations between two ends, in either direction, the heaviest, then the least key. A pair's rows are
    reduced before the shuffle."""
    pair = relations.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.struct((-F.col(weight)).alias("w"), F.col(key).alias("key")).alias("rank"))
    best = pair.groupBy("low", "high").agg(F.min("rank").alias("rank"))
    return best.select("low", "high", F.col("rank.key").alias(key), (-F.col("rank.w")).alias(weight))


def eligible(tokens: Column, content: Column, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> Column:
    return tokens.between(least, most) & (T.strip(content) != "")


def chunk_counts(chunks: DataFrame, source: str, tokens: Column, content: Column, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    ok = eligible(tokens, content, least, most).cast("int")
    return chunks.groupBy(source).agg(F.count("*").alias("chunks"), F.sum(F.coalesce(ok, F.lit(0))).cast("long").alias("eligible"))


BUCKETS = (("lt_30", None, 30), ("30_127", 30, 128), ("128_256", 128, 257), ("257_512", 257, 513), ("gt_512", 513, None))


def token_buckets(chunks: DataFrame, tokens: Column) -> DataFrame:
    """How many chunks have a length in each range, one row."""
    inside = lambda a, e: (tokens >= a if a is not None else F.lit(True)) & (tokens < e if e is not None else F.lit(True))
    return chunks.agg(*(F.count_if(inside(a, e)).alias(name) for name, a, e in BUCKETS))


def type_samples(entities: DataFrame, kind: str, name: str, most: int = 20) -> DataFrame:
    """Of each type the number of distinct names, and the first of them by name. A name and type count once before
    anything is ranked, and at most `most` names of a type are gathered."""
    names = entities.select(kind, name).distinct()
    counts = names.groupBy(kind).agg(F.count("*").alias("sample_count"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(name))
    top = names.withColumn("_n", place).where(F.col("_n") <= most).groupBy(kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", name))), lambda x: x[name]), "|").alias("samples"))
    return counts.join(top, kind)


def neighbours_in_parent(chunks: DataFrame, seeds: DataFrame, parent: list[str], key: str, order: str, window: int) -> DataFrame:
    """Chunks at most `window` places from a seed in the same parent, each once. The places are exploded, so the join
    is on equal keys."""
    near = seeds.join(chunks.select(*parent, key, order), [*parent, key]) if order not in seeds.columns else seeds
    places = near.select(*parent, F.explode(F.sequence(F.col(order) - window, F.col(order) + window)).alias(order)).distinct()
    return chunks.join(places, [*parent, order], "left_semi")


def merged_candidates(rows: DataFrame, key: list[str], chunk: Column, confidence: Column) -> DataFrame:
    """Candidates of one id merged: distinct chunk ids in order, the highest confidence."""
    return rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(chunk)), ",").alias("chunk_ids"), F.max(confidence).alias("confidence"))


def carried_forward(rows: DataFrame, group: list[str], order: list[str], value: Column, when: Column, name: str) -> DataFrame:
    """Each row with the last value, up to it, of a row for which `when` holds."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(w))


def within_budget(rows: DataFrame, group: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Of each group the first rows that leave something of the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") < budget)


def within_sections(rows: DataFrame, group: str, section: str, sections: list, order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows of each group that fit a budget, section after section: a section keeps its first rows while something of what the
    ones before have left stays over, and passes on what it didn't use."""
    spent = rows.select(group).distinct().withColumn("_spent", F.lit(0).cast("long"))
    kept = None
    for name in sections:
        w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = rows.where(F.col(section) == F.lit(name)).withColumn("_cost", cost).withColumn("_sum", F.sum("_cost").over(w))
        fits = own.join(spent, group).where(F.col("_sum") + F.col("_spent") < budget).withColumn("used", F.col("_sum") + F.col("_spent")).drop("_cost", "_sum", "_spent")
        used = fits.groupBy(group).agg(F.max("used").alias("_used"))
        spent = spent.join(used, group, "left").select(group, F.coalesce("_used", "_spent").alias("_spent"))
        kept = fits if kept is None else kept.unionByName(fits)
    return kept


def balanced(records: DataFrame, kind: str, kinds: list[str], order: list[str], limit: int) -> DataFrame:
    """A limit shared evenly between kinds, the first kinds getting what is over; what a kind lacks is filled from the
    others by kind and order. At most `limit` rows of each kind are ranked together."""
    share, over = divmod(limit, len(kinds))
    rank = F.create_map(*(x for k, v in enumerate(kinds) for x in (F.lit(v), F.lit(k))))
    quota = F.when(F.col("_kind") < over, share + 1).otherwise(share)
    placed = records.where(F.col(kind).isin(kinds)).withColumn("_kind", rank[F.col(kind)])
    placed = placed.withColumn("_pos", F.row_number().over(Window.partitionBy("_kind").orderBy(*order))).where(F.col("_pos") <= limit)
    return placed.orderBy((F.col("_pos") > quota).cast("int"), "_kind", "_pos").limit(limit)


def unseen(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(seen.select(*key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `existing` whose key is not in `new`, and `new`."""
    return unseen(existing, new, key).unionByName(new)


def first_of_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Both lists one after the other, each key once at its first place."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_list", order))
    return both.withColumn("_n", place).where("_n = 1").orderBy("_list", order).drop("_n", "_list")


def index_terms(chunks: DataFrame, key: str, parts: list[tuple[str, Column, float]]) -> DataFrame:
    """(key, term, term_type, weight) of each distinct term of each kind: parts are (kind, array of terms, weight)."""
    out = None
    for kind, terms, weight in parts:
        one = chunks.select(key, F.explode(F.array_distinct(terms)).alias("term"), F.lit(kind).alias("term_type"), F.lit(weight).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out
