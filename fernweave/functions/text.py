"""Text as columns: normalising, tokens, similarity, estimates. All of it stays in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PAIR_WEIGHT, STOP_WORDS, TERM_ALIASES, TERMS, UNIGRAM_WEIGHT

SEGMENT = r"[一-鿿]+|[a-z0-9][a-z0-9_\-.+#]*"


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, r"^[\s\u0085   -     　]+|[\s\u0085   -     　]+$", "")


def normalize_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\r\n?", "\n"))


def ordered_unique(c: Column) -> Column:
    """An array's distinct values that aren't null or empty, in order of first place."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def keywords(c: Column) -> Column:
    """Trimmed, non-empty, distinct, in order."""
    return ordered_unique(F.transform(c, strip))


def once(c: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it: an array from an array of one element."""
    return F.flatten(F.transform(F.array(c), f))


def ngrams(segment: Column, n: int) -> Column:
    """All substrings of n code points in order; none of a shorter segment."""

    def cut(s: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda k: F.substring(s, k, F.lit(n)))
        return F.when(F.length(s) >= n, every).otherwise(F.array().cast("array<string>"))

    return once(segment, cut)


def segments(c: Column) -> Column:
    """Chinese runs and ASCII words of lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({SEGMENT})"), F.lit(1))


def query_tokens(c: Column, most: int = 256) -> Column:
    """Search tokens: the first target of each everyday word, domain terms from long to short, further targets, then
    segments with their 2- to 4-grams. The text must be in compatibility-composed form."""
    low = F.lower(c)
    stop = F.array(*map(F.lit, STOP_WORDS))
    firsts = [F.when(low.contains(k), F.lit(v[0])) for k, v in TERM_ALIASES.items()]
    rest = [F.when(low.contains(k), F.lit(x)) for k, v in TERM_ALIASES.items() for x in v[1:]]
    terms = [F.when(low.contains(t), F.lit(t)) for t in sorted(TERMS, key=len, reverse=True)]

    def parts(s: Column) -> Column:
        word = s.rlike("^[a-z0-9]")
        own = F.when(word | (F.length(s) <= 4), F.array(s)).otherwise(F.array().cast("array<string>"))
        return F.when(word, own).otherwise(F.concat(own, *(ngrams(s, n) for n in (2, 3, 4))))

    found = F.flatten(F.transform(F.filter(segments(c), lambda s: ~F.array_contains(stop, s)), parts))
    every = F.concat(F.array_compact(F.array(*firsts, *terms, *rest)), found)
    return F.slice(F.filter(ordered_unique(every), lambda t: ~F.array_contains(stop, t)), 1, most)


def whitespace_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def bag_entries(tokens: Column) -> Column:
    """(key, weight in tenths) of each token and of each two neighbours joined; equal keys are to be added up."""

    def entries(t: Column) -> Column:
        ones = F.transform(t, lambda x: F.struct(x.alias("key"), F.lit(UNIGRAM_WEIGHT).alias("weight")))
        joined = F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda x, y: F.concat(x, y))
        pairs = F.transform(F.filter(joined, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("key"), F.lit(PAIR_WEIGHT).alias("weight")))
        return F.concat(ones, pairs)

    return once(tokens, entries)


def literal_bonus(words: Column, text: Column) -> Column:
    """0.1 for each keyword, without its spaces, that the text without spaces contains; repeats count."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.when((w != "") & F.contains(plain, F.replace(w, F.lit(" "), F.lit(""))), 0.1).otherwise(0.0))


def token_estimate(c: Column) -> Column:
    """Chinese signs and words between white space."""
    return F.length(F.regexp_replace(c, r"[^一-鿿]", "")) + F.size(whitespace_tokens(c))


def weighted_content(title: Column, path: Column, important: Column, content: Column) -> Column:
    parts = F.concat(F.array(title), path, important, F.array(content))
    return F.concat_ws(" ", F.filter(F.transform(parts, strip), lambda x: x != ""))


def sentence_pieces(c: Column) -> Column:
    """Paragraphs between blank lines, cut after sentence marks; stripped, none empty."""
    cut = F.flatten(F.transform(F.split(c, r"\n{2,}"), lambda p: F.split(p, r"(?<=[。！？；;])")))
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def hard_wrap(c: Column, most: int) -> Column:
    cut = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s), F.lit(most)), lambda k: F.substring(s, k, F.lit(most)))).otherwise(F.array().cast("array<string>"))
    return once(c, cut)


def intent(c: Column) -> Column:
    """formula, herb or general, by words of the question."""
    has = lambda *ws: F.greatest(*(F.contains(c, F.lit(w)) for w in (*ws, ws[0])))
    return F.when(has("汤", "方", "方剂"), "formula").when(has("药", "中药", "功效", "归经"), "herb").otherwise("general")


def ratio(part: Column, total: Column) -> Column:
    """Share to 6 decimals, 0 of nothing."""
    return F.when(total > 0, F.round(part / total, 6)).otherwise(F.lit(0.0))


def evidence_id(c: Column) -> Column:
    return F.regexp_replace(c, "^chunk:", "evidence:")


def source_group(c: Column) -> Column:
    """The source part of a chunk or evidence id."""
    parts = F.split(c, ":")
    return F.when(F.size(parts) >= 3, F.concat_ws(":", F.slice(parts, 2, F.size(parts) - 2))).otherwise(c)


def stable_edge_id(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha1(F.concat_ws("\t", source, relation, target)), 1, 16))
