"""What a question asks for, as columns: normal form, entities, keywords, answer types, and what a rewriter answered."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import STOP_WORDS, TERMS
from .text import ordered_unique, strip

# Terms that name a kind of thing and no thing, and what questions ask for by these words.
KIND_TERMS = ("证候", "方剂", "症状", "治法", "中药")
ANSWER_WORDS = {"Syndrome": ("证", "辨证"), "Formula": ("方", "汤", "方剂"), "Herb": ("药", "中药", "组成")}
FORMULA_ENDINGS = "汤散丸膏方饮丹煎"
SHARED_WORDS = ("失眠", "不寐", "心脾两虚", "归脾汤", "组成", "方剂", "中药")
MARKS = r"""[ :|\r\n\t,，。？?/`!！&^%()\[\]{}<>*~'"\\]+"""


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-composed form, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normal_form(c: Column) -> Column:
    """Composed, in lower case, with marks as single spaces. Only text beyond ASCII goes to Python."""
    return strip(F.regexp_replace(F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(c)).otherwise(c)), MARKS, " "))


def entity_keywords(words: Column, terms: tuple[str, ...] = TERMS, kinds: tuple[str, ...] = KIND_TERMS, most: int = 5) -> Column:
    """The first known terms among keywords that aren't names of kinds."""
    known = F.array(*(F.lit(t) for t in terms if t not in kinds))
    return F.slice(ordered_unique(F.filter(words, lambda w: F.array_contains(known, w))), 1, most)


def candidate_keywords(words: Column, terms: tuple[str, ...] = TERMS, kinds: tuple[str, ...] = KIND_TERMS, stop: tuple[str, ...] = STOP_WORDS, most: int = 8) -> Column:
    """What to search for: the entities of a question; without any, keywords of 2 to 6 signs that hold no stop word of one
    sign, aren't stop words, and begin no other one."""
    found = entity_keywords(words, terms, kinds, most)
    noise = "|".join(w for w in stop if len(w) == 1)
    stops = F.array(*map(F.lit, stop))
    clean = F.filter(words, lambda w: F.length(w).between(2, 6) & ~F.array_contains(stops, w) & (~w.rlike(noise) if noise else F.lit(True)))
    longest = F.filter(clean, lambda w: ~F.exists(clean, lambda o: F.startswith(o, w) & (o != w)))
    return F.when(F.size(found) > 0, found).otherwise(F.slice(ordered_unique(longest), 1, most))


def answer_types(c: Column, words: dict[str, tuple[str, ...]] = ANSWER_WORDS) -> Column:
    """The kinds of things that a question asks for."""
    return F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(c, w)), F.lit(kind)) for kind, ws in words.items())))


def literal_formulas(c: Column) -> Column:
    """Terms of a question, parted by marks and question words, that end like the name of a formula."""
    parts = F.split(F.regexp_replace(c, r"\s+", ""), r"[，。？?！!、,；;]|有哪些|有什么|是什么|的|和|与")
    return F.filter(ordered_unique(parts), lambda p: p.rlike(f"^.+[{FORMULA_ENDINGS}]$"))


def rewrite(raw: Column, types: Column, entities: Column) -> Column:
    """A rewriter's JSON answer as struct(types, entities, source): at most 3 and 5 words; fences and text round the object
    are passed over, `entities` is taken for `entities_from_query`; without any word the given ones count."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    said = F.from_json(body, "answer_type_keywords array<string>, entities_from_query array<string>, entities array<string>")
    words = lambda c: F.coalesce(ordered_unique(F.transform(c, strip)), F.array().cast("array<string>"))
    kinds = F.slice(words(said["answer_type_keywords"]), 1, 3)
    named = F.slice(words(F.coalesce(said["entities_from_query"], said["entities"])), 1, 5)
    both = (F.size(kinds) > 0) | (F.size(named) > 0)
    return F.struct(F.when(both, kinds).otherwise(types).alias("types"), F.when(both, named).otherwise(entities).alias("entities"), F.when(both, "llm").otherwise("rules").alias("source"))


def question_terms(literal: Column, entities: Column, expanded: Column) -> Column:
    """Terms from the question itself, then those of the rewriter, then further ones; each once."""
    return ordered_unique(F.concat(literal, entities, expanded))


def description_text(c: Column) -> Column:
    """The description in a JSON object, else the text."""
    return F.coalesce(F.get_json_object(c, "$.description"), c)


def report_text(place: Column, title: Column, content: Column) -> Column:
    """A community report as a block of text."""
    return F.concat(F.lit("# "), place.cast("string"), F.lit(". "), title, F.lit("\n"), F.coalesce(F.get_json_object(content, "$.report"), content))


def csv_row(*fields: Column) -> Column:
    """Fields as a row of CSV; those with commas, quotes or line ends are quoted."""
    quoted = [F.when(f.rlike(r"[\",\r\n]"), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(f, F.lit(""))) for f in fields]
    return F.concat_ws(",", *quoted)


def node_id(label: Column, name: Column) -> Column:
    """An id from label and name; where the label says nothing, the name's ending does."""
    by_name = F.when(name.rlike(f"[{FORMULA_ENDINGS}]$"), "formula").otherwise("entity")
    return F.concat_ws(":", F.when(F.coalesce(label, F.lit("")) != "", F.lower(label)).otherwise(by_name), name)


def shared_words(a: Column, b: Column, words: tuple[str, ...] = SHARED_WORDS) -> Column:
    """How many of some words stand in both texts."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(a, w) & F.contains(b, w))).cast("double")


def level_tags(levels: Column) -> Column:
    """`level:community` of a map, by level."""
    entries = F.transform(F.map_entries(levels), lambda e: F.struct(F.expr("0").alias("z"), e["key"].cast("int").alias("level"), e["value"].cast("string").alias("id")))
    return F.transform(F.array_sort(entries), lambda e: F.concat_ws(":", e["level"].cast("string"), e["id"]))


def tag_levels(tags: Column) -> Column:
    """(level, community) structs of such tags; those that aren't two numbers are passed over."""
    parts = F.transform(tags, lambda t: F.struct(F.split_part(t, F.lit(":"), F.lit(1)).try_cast("int").alias("level"), F.split_part(t, F.lit(":"), F.lit(2)).try_cast("int").alias("community")))
    return F.filter(parts, lambda p: p["level"].isNotNull() & p["community"].isNotNull())


def embedding_text(name: Column, label: Column, description: Column, synonyms: dict[str, str] | None = None) -> Column:
    """What is embedded of a node, with other words for it where there are some."""
    table = F.create_map(*(F.lit(x) for kv in (synonyms or {"": ""}).items() for x in kv))
    return F.concat_ws(" ", name, label, F.when(description != "", description), F.try_element_at(table, name))
