"""Queries of index, audit, look-up, text and ranking operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import numbering as N
from ..operators import relational as R
from ..sources.tables import Table
from ..storage import new_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TOKENS_SQL = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))"
tokens = lambda: F.size(T.whitespace_tokens(F.col("text")))


@query(f"""SELECT count(*) FILTER (WHERE n < 30) AS lt_30, count(*) FILTER (WHERE n >= 30 AND n < 128) AS "30_127",
count(*) FILTER (WHERE n >= 128 AND n < 257) AS "128_256", count(*) FILTER (WHERE n >= 257 AND n < 513) AS "257_512",
count(*) FILTER (WHERE n >= 513) AS gt_512 FROM (SELECT {TOKENS_SQL} AS n FROM documents)""")
def chunk_token_buckets(spark, sf_dir):
    return R.token_buckets(table(spark, sf_dir, "documents"), tokens())


@query(f"""SELECT source, count(*) AS chunks, CAST(sum(CASE WHEN n BETWEEN 8 AND 900 AND trim(text) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS eligible
FROM (SELECT *, {TOKENS_SQL} AS n FROM documents) GROUP BY source""")
def chunk_counts_by_source(spark, sf_dir):
    return R.chunk_counts(table(spark, sf_dir, "documents"), "source", tokens(), F.col("text"))


def labelled(spark, sf_dir):
    """Documents as chunks: labelled ones count as embedded, those of quality 0 as failed."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def counters(spark, sf_dir):
    return A.audit(labelled(spark, sf_dir), tokens(), F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False)), F.col("toxic").isNotNull())


AUDIT_SQL = f"""SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS embedded, count(*) FILTER (WHERE quality = 0) AS failed,
count(*) FILTER (WHERE quality IS NULL) AS missing, count(*) FILTER (WHERE toxic IS NOT NULL) AS with_evidence,
count(*) FILTER (WHERE n < 30) AS short, count(*) FILTER (WHERE n > 512) AS long
FROM (SELECT d.*, l.quality, l.toxic, {TOKENS_SQL} AS n FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(AUDIT_SQL)
def audit_counters(spark, sf_dir):
    return counters(spark, sf_dir)


@query(f"""WITH a AS ({AUDIT_SQL}), r AS (SELECT round(embedded / total, 6) AS v, round(with_evidence / total, 6) AS e, round(short / total, 6) AS s, round(long / total, 6) AS g FROM a)
SELECT v AS vector_ratio, e AS evidence_ratio, s AS short_ratio, g AS long_ratio,
concat_ws(',', CASE WHEN v < 0.8 THEN 'vector_coverage' END, CASE WHEN e < 0.8 THEN 'evidence_coverage' END) AS blockers,
concat_ws(',', CASE WHEN s > 0.2 THEN 'short_chunks' END, CASE WHEN g > 0.2 THEN 'long_chunks' END) AS warnings, v >= 0.8 AND e >= 0.8 AS ready FROM r""")
def readiness_report(spark, sf_dir):
    return A.readiness(counters(spark, sf_dir))


def by_type(spark, sf_dir):
    docs = labelled(spark, sf_dir).select(F.concat(F.lit("chunk_"), "lang").alias("content_type"), (F.col("quality") == 1).alias("ok"))
    parts = table(spark, sf_dir, "part").select(F.lit("entity").alias("content_type"), (F.col("p_size") > 10).alias("ok"))
    return docs.unionByName(parts).groupBy("content_type").agg(F.count("*").alias("total"), F.count_if(F.coalesce("ok", F.lit(False))).alias("embedded"))


@query("""WITH t AS (SELECT content_type, count(*) AS total, count(*) FILTER (WHERE ok) AS embedded FROM (
SELECT 'chunk_' || lang AS content_type, quality = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'entity', p_size > 10 FROM part) GROUP BY content_type),
p AS (SELECT *, CAST(least(total, ceil(total * CAST(0.8 AS DOUBLE))) AS BIGINT) AS target FROM t), q AS (SELECT *, CAST(greatest(0, target - embedded) AS BIGINT) AS remaining FROM p)
SELECT content_type, total, embedded, round(embedded / total, 6) AS current_ratio, target, remaining,
CASE WHEN remaining > 0 THEN concat_ws(' ', 'sync --limit', CAST(remaining AS VARCHAR), '--types', content_type) ELSE '' END AS command FROM q""")
def vector_sync_plan(spark, sf_dir):
    return A.sync_plan(by_type(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT p_type, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS k FROM n)
SELECT p_type, count(*) AS sample_count, string_agg(p_name, '|' ORDER BY k) FILTER (WHERE k <= 20) AS samples FROM r GROUP BY p_type""")
def type_samples(spark, sf_dir):
    return R.type_samples(table(spark, sf_dir, "part"), "p_type", "p_name")


@query("""SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tionention') OR contains(lower(text), 'loser') ORDER BY source, doc_id LIMIT 80""")
def lexical_candidates(spark, sf_dir):
    return R.lexical_candidates(table(spark, sf_dir, "documents"), ["tionention", "loser"], ["text"], ["source", "doc_id"], 80).select("doc_id", "source")


@query("""SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'that') ORDER BY length(text), doc_id LIMIT 20""")
def keyword_and_finder(spark, sf_dir):
    return R.chunks_with_all(table(spark, sf_dir, "documents"), ["the", "that"], "text", "doc_id", 20).select("doc_id", "n_chars")


@query("""SELECT low, high, l_orderkey, l_quantity FROM (SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, l_orderkey, l_quantity,
row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_quantity DESC, l_orderkey) AS k FROM lineitem) WHERE k = 1""")
def pair_lookup_best(spark, sf_dir):
    return R.best_by_pair(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", "l_orderkey")


@query("""WITH w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, min(item_id) AS pos FROM (SELECT item_id, (item_id * 7) % 200 AS doc_id FROM benchmark) GROUP BY 1) SELECT doc_id, pos, lang, n_chars FROM documents JOIN w USING (doc_id)""")
def ordered_id_fetch(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), (F.col("item_id") * 7 % 200).alias("doc_id"))
    return R.in_requested_order(table(spark, sf_dir, "documents"), "doc_id", wanted).select("doc_id", "pos", "lang", "n_chars")


def records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("chunk").alias("content_type"), F.col("doc_id").cast("string").alias("id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("rank"))
    parts = table(spark, sf_dir, "part").select(F.lit("entity").alias("content_type"), F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("rank"))
    sup = table(spark, sf_dir, "supplier").select(F.lit("relation").alias("content_type"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("rank"))
    return docs.unionByName(parts).unionByName(sup)


@query("""WITH r AS (SELECT 'chunk' AS content_type, 0 AS k, CAST(doc_id AS VARCHAR) AS id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS rank FROM documents
UNION ALL SELECT 'entity', 1, CAST(p_partkey AS VARCHAR), p_name || lpad(CAST(p_partkey AS VARCHAR), 12, '0') FROM part
UNION ALL SELECT 'relation', 2, CAST(s_suppkey AS VARCHAR), s_name FROM supplier),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank) AS pos FROM r)
SELECT content_type, id FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN pos > CASE WHEN k < 1 THEN 22 ELSE 21 END THEN 1 ELSE 0 END, k, pos) AS n FROM p WHERE pos <= 64) WHERE n <= 64""")
def missing_records_balanced(spark, sf_dir):
    return R.balanced(records(spark, sf_dir), "content_type", ["chunk", "entity", "relation"], ["rank"], 64).select("content_type", "id")


@query("""SELECT content_type, id FROM (SELECT *, row_number() OVER (ORDER BY k, rank) AS n FROM (SELECT 'chunk' AS content_type, 0 AS k, CAST(doc_id AS VARCHAR) AS id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS rank FROM documents
UNION ALL SELECT 'entity', 1, CAST(p_partkey AS VARCHAR), p_name || lpad(CAST(p_partkey AS VARCHAR), 12, '0') FROM part)) WHERE n <= 100""")
def missing_records_in_order(spark, sf_dir):
    kept = records(spark, sf_dir).where("content_type <> 'relation'")
    return kept.orderBy("content_type", "rank").limit(100).select("content_type", "id")


@query(r"""WITH s AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9][a-z0-9_\-.+#]*')) AS t FROM benchmark)
SELECT item_id, CAST(len(t) AS INTEGER) AS tokens, list_aggregate(list_sort(t), 'string_agg', '|') AS sorted_tokens FROM s""")
def token_ngrams(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", T.query_tokens(F.col("text"), 1 << 20).alias("t"))
    return items.select("item_id", F.size("t").alias("tokens"), F.array_join(F.array_sort("t"), "|").alias("sorted_tokens"))


@query(f"""WITH d AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM documents), t AS (SELECT DISTINCT doc_id, term FROM d WHERE term <> '')
SELECT doc_id, term, 'content' AS term_type, CAST(1.0 AS DOUBLE) AS weight FROM t UNION ALL SELECT doc_id, source, 'title', CAST(2.0 AS DOUBLE) FROM documents UNION ALL SELECT doc_id, lang, 'important', CAST(3.0 AS DOUBLE) FROM documents""")
def chunk_terms_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.index_terms(docs, "doc_id", [("content", T.whitespace_tokens(F.lower("text")), 1.0), ("title", F.array("source"), 2.0), ("important", F.array("lang"), 3.0)])


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\n{2,}')) AS para FROM documents), s AS (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(para, '([。！？；;])', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') AS piece FROM p)
SELECT doc_id, count(*) AS pieces, CAST(sum(length(piece)) AS BIGINT) AS chars, max(length(piece)) AS longest FROM s WHERE piece <> '' GROUP BY doc_id""")
def sentence_pieces(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select("doc_id", T.sentence_pieces(F.col("text")).alias("p")).where("size(p) > 0")
    return pieces.select("doc_id", F.size("p").cast("long").alias("pieces"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), F.array_max(F.transform("p", F.length)).cast("long").alias("longest"))


@query("""WITH k(w) AS (VALUES ('the'), ('that'), ('of the'), ('the')), s AS (SELECT doc_id, CAST(sum(CASE WHEN contains(replace(text, ' ', ''), replace(w, ' ', '')) THEN 1 ELSE 0 END) AS INTEGER) AS n FROM documents, k GROUP BY doc_id)
SELECT doc_id, round(n * CAST(0.1 AS DOUBLE), 6) AS bonus FROM (SELECT *, row_number() OVER (ORDER BY n DESC, doc_id) AS r FROM s WHERE n > 0) WHERE r <= 100""")
def literal_bonus_rank(spark, sf_dir):
    words = F.array(*map(F.lit, ["the", "that", "of the", "the"]))
    scored = table(spark, sf_dir, "documents").select("doc_id", F.round(T.literal_bonus(words, F.col("text")), 6).alias("bonus"))
    return scored.where("bonus > 0").orderBy(F.desc("bonus"), "doc_id").limit(100)


@query("""WITH s AS (SELECT DISTINCT conv_id, turn + d AS turn FROM (SELECT conv_id, turn FROM conversations WHERE contains(text, 'the')), (VALUES (-1), (0), (1)) v(d))
SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN (SELECT conv_id, turn FROM s)""")
def context_window(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    seeds = conv.where(F.contains("text", F.lit("the"))).select("conv_id", "turn")
    return R.neighbours_in_parent(conv, seeds, ["conv_id"], "turn", "turn", 1).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, used FROM (SELECT conv_id, turn, role, text, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used < 400""")
def context_budget_cut(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return R.within_budget(conv, ["conv_id"], ["turn", "role", "text"], F.length("text"), 400).select("conv_id", "turn", "used")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def carry_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return R.carried_forward(events, ["user_id"], ["ts", "event_id"], F.col("event_id"), F.col("event_type") == "purchase", "last_purchase").select("event_id", "user_id", "last_purchase")


@query("""SELECT user_id, event_type, string_agg(DISTINCT CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) AS chunk_ids, max(round(value, 4)) AS confidence FROM events GROUP BY user_id, event_type""")
def candidate_merge(spark, sf_dir):
    return R.merged_candidates(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("event_id").cast("string"), F.round("value", 4))


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def incremental_anti(spark, sf_dir):
    return R.unseen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query("""SELECT conv_id, turn, CASE WHEN contains(text, 'formula') OR contains(text, '方') OR contains(text, '汤') THEN 'formula' WHEN contains(text, '药') OR contains(text, '功效') OR contains(text, '归经') THEN 'herb' ELSE 'general' END AS intent FROM conversations""")
def intent_rules(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.contains("text", F.lit("formula")), "formula").otherwise(T.intent(F.col("text"))).alias("intent"))


@query("""WITH a AS (SELECT 0 AS l, doc_id, source FROM documents WHERE contains(text, 'the')), b AS (SELECT 1 AS l, doc_id, source FROM documents WHERE n_chars > 1000),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l, doc_id) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT doc_id, source FROM u WHERE k = 1""")
def candidate_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    out = R.first_of_union(docs.where(F.contains("text", F.lit("the"))).select("doc_id", "source"), docs.where("n_chars > 1000").select("doc_id", "source"), "doc_id", "doc_id")
    return out


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, 'evidence:' || CAST(user_id AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) AS evidence, CAST(user_id AS VARCHAR) AS source FROM events""")
def evidence_ids(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.concat_ws(":", F.lit("chunk"), "user_id", "event_id").alias("c"))
    return raw.select("event_id", T.evidence_id(F.col("c")).alias("evidence"), T.source_group(F.col("c")).alias("source"))


@query("""SELECT p_partkey, 'edge:' || substr(sha1(concat_ws(chr(9), p_brand, 'INCLUDES', p_name)), 1, 16) AS edge_id FROM part""")
def stable_edge_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.stable_edge_id(F.col("p_brand"), F.lit("INCLUDES"), F.col("p_name")).alias("edge_id"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def merged_events(spark, sf_dir):
    """All events in ten merges by user, the tenth part of them in each: what a later merge brings replaces what was there."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    users = Table(spark, new_dir(spark, "users"), ["user_id"], 8)
    for step in range(10):
        last = events.where(F.col("event_id") % 10 == step).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("e"))
        users.merge(last.select("user_id", "e.*"))
    return users.read()


@query("SELECT doc_id, source, number, CAST(number // 64 AS BIGINT) AS batch, place FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS number, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents)")
def numbered_batches(spark, sf_dir):
    """Every document's number, its batch of 64, and its place inside its source."""
    docs = N.fixed_batches(N.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"]), ["number"], 64)
    return N.numbered_within(docs, "source", ["doc_id"], "place")


@query("""WITH c AS (SELECT *, sum(n_chars) OVER (PARTITION BY lang, doc_id % 3 ORDER BY doc_id) AS own FROM documents),
a AS (SELECT *, CAST(own AS BIGINT) AS used FROM c WHERE doc_id % 3 = 0 AND own < 20000), sa AS (SELECT l.lang, coalesce(max(used), 0) AS spent FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN a USING (lang) GROUP BY 1),
b AS (SELECT c.*, CAST(own + spent AS BIGINT) AS used FROM c JOIN sa USING (lang) WHERE doc_id % 3 = 1 AND own + spent < 20000), sb AS (SELECT sa.lang, coalesce(max(used), any_value(spent)) AS spent FROM sa LEFT JOIN b USING (lang) GROUP BY 1),
d AS (SELECT c.*, CAST(own + spent AS BIGINT) AS used FROM c JOIN sb USING (lang) WHERE doc_id % 3 = 2 AND own + spent < 20000)
SELECT lang, doc_id, used FROM a UNION ALL SELECT lang, doc_id, used FROM b UNION ALL SELECT lang, doc_id, used FROM d""")
def context_budget_sections(spark, sf_dir):
    """A budget for each language, spent on three sections of its documents one after the other."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", (F.col("doc_id") % 3).alias("section"))
    return R.within_sections(docs, "lang", "section", [0, 1, 2], ["doc_id"], F.col("n_chars"), 20_000).select("lang", "doc_id", "used")
