"""Retrieval, embedding, chunking and extraction queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching, candidates
from ..operators import chunking as C
from ..operators import lexical_index as L
from ..operators import retrieval as R
from ..operators import vector_index as V
from .relational import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


SPLIT = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')"
BAG_SQL = f"""bt AS (SELECT item_id, {SPLIT} AS t FROM benchmark), q AS (SELECT item_id, token, sum(w) AS w FROM (SELECT item_id, unnest(t) AS token, 4 AS w FROM bt
UNION ALL SELECT item_id, unnest([t[i] || t[i + 1] FOR i IN range(1, len(t))]), 6 FROM bt) GROUP BY 1, 2), tot AS (SELECT item_id, sum(w) AS total FROM q GROUP BY 1),
dt AS (SELECT doc_id, {SPLIT} AS t FROM documents), d AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(t) AS token FROM dt UNION ALL SELECT doc_id, unnest([t[i] || t[i + 1] FOR i IN range(1, len(t))]) FROM dt)),
sim AS (SELECT item_id, doc_id, (1e-9 + sum(w)::DOUBLE / 10) / (1e-9 + any_value(total)::DOUBLE / 10) AS similarity FROM d JOIN q USING (token) JOIN tot USING (item_id) GROUP BY 1, 2)"""


def similarities(spark, sf_dir, docs, *carry):
    """Of the best 8 of each question, among documents with equal carried columns."""
    low = T.whitespace_tokens(F.lower("text"))
    return R.token_similarity(table(spark, sf_dir, "benchmark"), "item_id", low, docs, "doc_id", low, carry, 8)


@query(f"WITH {BAG_SQL} SELECT item_id, doc_id, similarity, CAST(place AS INTEGER) AS place FROM (SELECT item_id, doc_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 6) DESC, doc_id) AS place FROM sim) WHERE place <= 8")
def token_similarity_topk(spark, sf_dir):
    return R.top_k(similarities(spark, sf_dir, table(spark, sf_dir, "documents")).withColumn("similarity", F.round("similarity", 6)), "item_id", [F.desc("similarity"), "doc_id"], 8)


@query(SQL["token_similarity_topk"])
def lexical_index_topk(spark, sf_dir):
    """The same by an index, without forming all pairs."""
    low = T.whitespace_tokens(F.lower("text"))
    index = L.build(table(spark, sf_dir, "documents"), "doc_id", low)
    return L.search(index, table(spark, sf_dir, "benchmark"), "item_id", low, 8).withColumnsRenamed({"qid": "item_id", "did": "doc_id"})


@query(f"""WITH {BAG_SQL}, s AS (SELECT item_id, doc_id, round(CAST(0.3 AS DOUBLE) * similarity + CAST(0.7 AS DOUBLE) * CASE WHEN quality = 1 THEN CAST(0.5 AS DOUBLE) ELSE 0 END, 6) AS score FROM sim LEFT JOIN labels USING (doc_id))
SELECT item_id, doc_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 8""")
def hybrid_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    scored = similarities(spark, sf_dir, docs, "quality")
    vector = R.vector_score(F.lit(None).cast("double"), F.when(F.col("quality") == 1, "embedded"), F.lit(0.5))
    return R.top_k(scored.select("item_id", "doc_id", F.round(R.hybrid(F.col("similarity"), vector), 6).alias("score")), "item_id", [F.desc("score"), "doc_id"], 8)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id, round(list_cosine_similarity(a.e, b.e), 4) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT qid, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 10""")
def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return R.cosine_top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)


def indexed(spark, sf_dir, exact, kind=None):
    """The ten rows most like each row whose id is divisible by 50, by an index of all rows."""
    rows = table(spark, sf_dir, "embeddings")
    index = V.build(rows, "vec_id", "embedding", kind)
    found = V.search(index, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, kind, exact=exact)
    return found.withColumnRenamed("id", "vec_id")


@query()
def vector_index_topk(spark, sf_dir):
    """Recall against brute force is measured in tests/test_vector_index.py."""
    return indexed(spark, sf_dir, False)


@query(SQL["cosine_topk"])
def vector_index_topk_exact(spark, sf_dir):
    return indexed(spark, sf_dir, True)


@query(SQL["cosine_topk"].replace("SELECT vec_id, CAST", "SELECT label, vec_id, CAST").replace("a.vec_id <> b.vec_id", "a.vec_id <> b.vec_id AND a.label = b.label"))
def vector_index_topk_by_type(spark, sf_dir):
    """Only rows of the query's type (label)."""
    return indexed(spark, sf_dir, True, "label")


@query("""WITH p AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM benchmark), k AS (SELECT item_id, unnest([t[i:i + 1] FOR i IN range(1, length(t))]) AS g FROM p UNION ALL SELECT item_id, unnest([t[i:i] FOR i IN range(1, length(t) + 1)]) FROM p),
h AS (SELECT item_id, sha256(g) AS x, count(*) AS n FROM k GROUP BY 1, 2), v AS (SELECT item_id, CAST(CAST('0x' || substr(x, 1, 8) AS BIGINT) % 64 AS INTEGER) AS dim, sum(CASE WHEN CAST('0x' || substr(x, 9, 2) AS BIGINT) % 2 = 0 THEN n ELSE -n END) AS v FROM h GROUP BY 1, 2),
z AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1) SELECT item_id, dim, round(v / norm, 6) AS value FROM v JOIN z USING (item_id) WHERE v <> 0""")
def hash_embedding(spark, sf_dir):
    return R.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), 64)


@query(f"""WITH t AS (SELECT conv_id, turn, text, {SPLIT} AS w FROM conversations), q AS (SELECT conv_id, w AS qw FROM t WHERE turn = 0)
SELECT conv_id, turn, round(len(list_intersect(list_distinct(qw), w)) / greatest(1, len(list_distinct(qw))) + least(length(text) / 500, CAST(0.25 AS DOUBLE)), 6) AS score FROM t JOIN q USING (conv_id) WHERE turn > 0""")
def demo_rerank(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", T.whitespace_tokens(F.lower("text")).alias("w"))
    q = conv.where("turn = 0").select("conv_id", F.col("w").alias("qw"))
    return conv.where("turn > 0").join(q, "conv_id").select("conv_id", "turn", R.overlap_rerank(F.col("qw"), F.col("w"), F.col("text")).alias("score"))


@query("""WITH c AS (SELECT 0 AS list, event_id AS ord, 0 AS pos, 'evidence:' || user_id || ':' || (event_id % 500) AS id, event_type AS snippet FROM events WHERE event_type = 'click'
UNION ALL SELECT 1, event_id, i, 'evidence:' || user_id || ':' || (event_id % 500 + i), NULL FROM events, (VALUES (0), (1)) v(i) WHERE event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list, ord, pos) AS k FROM c) SELECT id, list, ord, pos, snippet FROM r WHERE k = 1""")
def evidence_cards(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    chunk = lambda k: F.concat_ws(":", F.lit("chunk"), F.col("user_id").cast("string"), (F.col("event_id") % 500 + k).cast("string"))
    hits = events.where("event_type = 'click'").select(F.col("event_id").alias("ord"), chunk(0).alias("chunk_id"), F.col("event_type").alias("snippet"))
    edges = events.where("event_type = 'purchase'").select(F.col("event_id").alias("ord"), F.array(chunk(0), chunk(1)).alias("evidence"))
    return R.evidence_cards(hits, edges)


@query()
def semantic_chunks(spark, sf_dir):
    return C.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
b(source, k, doc_id, n_chars, batch, total) AS (SELECT source, k, doc_id, n_chars, 0, n_chars FROM o WHERE k = 1
UNION ALL SELECT o.source, o.k, o.doc_id, o.n_chars, CASE WHEN b.total + o.n_chars > 20000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.total + o.n_chars > 20000 THEN o.n_chars ELSE b.total + o.n_chars END FROM b JOIN o ON o.source = b.source AND o.k = b.k + 1)
SELECT source, doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(batch AS INTEGER) AS batch FROM b""")
def greedy_batches(spark, sf_dir):
    return batching.greedy_batches(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20_000)


@query("""WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
b(k, doc_id, n_chars, batch, total) AS (SELECT k, doc_id, n_chars, 0, n_chars FROM o WHERE k = 1
UNION ALL SELECT o.k, o.doc_id, o.n_chars, CASE WHEN b.total + o.n_chars > 20000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.total + o.n_chars > 20000 THEN o.n_chars ELSE b.total + o.n_chars END FROM b JOIN o ON o.k = b.k + 1)
SELECT 'all' AS owner, doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(batch AS INTEGER) AS batch FROM b""")
def greedy_batches_one_source(spark, sf_dir):
    """All documents as one source, which spreads over tasks in blocks."""
    docs = table(spark, sf_dir, "documents").select(F.lit("all").alias("owner"), "doc_id", "n_chars")
    return batching.greedy_batches(docs, "owner", "doc_id", "n_chars", 20_000)


TERMS = {"the": "Symptom", "that": "Syndrome", "of": "Formula", "loser": "Herb"}
RULES = {("Symptom", "Syndrome"): "MANIFESTS_AS", ("Formula", "Symptom"): "TREATS", ("Formula", "Syndrome"): "TREATS", ("Formula", "Herb"): "COMPOSED_OF"}
HITS_SQL = """h AS (SELECT doc_id, name, label, row_number() OVER (PARTITION BY doc_id ORDER BY strpos(text, name), -length(name), name) - 1 AS pos
FROM documents, (VALUES ('the', 'Symptom'), ('that', 'Syndrome'), ('of', 'Formula'), ('loser', 'Herb')) t(name, label) WHERE strpos(text, name) > 0)"""


@query(f"WITH {HITS_SQL} SELECT doc_id, name, label, CAST(pos AS INTEGER) AS pos FROM h")
def ner_extract(spark, sf_dir):
    return C.dictionary_hits(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


@query(f"""WITH {HITS_SQL}, r(a, b, relation) AS (VALUES ('Symptom', 'Syndrome', 'MANIFESTS_AS'), ('Formula', 'Symptom', 'TREATS'), ('Formula', 'Syndrome', 'TREATS'), ('Formula', 'Herb', 'COMPOSED_OF'))
SELECT x.doc_id, x.name AS source, y.name AS target, relation FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.name <> y.name JOIN r ON r.a = x.label AND r.b = y.label""")
def ner_relations(spark, sf_dir):
    return C.rule_relations(C.dictionary_hits(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS), "doc_id", RULES)


@query(f"""WITH {HITS_SQL}, rules(a, b, relation) AS (VALUES ('Symptom', 'Syndrome', 'MANIFESTS_AS'), ('Formula', 'Symptom', 'TREATS'), ('Formula', 'Syndrome', 'TREATS'), ('Formula', 'Herb', 'COMPOSED_OF')),
i AS (SELECT h.*, 'entity:' || lower(label) || ':' || name AS id, d.source AS source_id FROM h JOIN documents d USING (doc_id)),
r AS (SELECT x.doc_id, x.source_id, x.id AS source, rules.relation, y.id AS target FROM i x JOIN i y ON x.doc_id = y.doc_id AND x.name <> y.name JOIN rules ON rules.a = x.label AND rules.b = y.label),
last AS (SELECT source, relation, target, max(source_id) AS source_id FROM r GROUP BY source, relation, target)
SELECT 'relation:' || source || ':' || relation || ':' || target AS id, source, target, relation, source_id, count(DISTINCT doc_id) AS n_evidence, min('evidence:' || doc_id) AS least FROM r JOIN last USING (source, relation, target, source_id) GROUP BY source, relation, target, source_id""")
def published_relations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("chunk_id", F.concat(F.lit("chunk:"), "doc_id"))
    hits = C.dictionary_hits(docs, "chunk_id", "text", TERMS)
    found = candidates.candidates(hits, C.rule_relations(hits, "chunk_id", RULES), docs.select("chunk_id", F.col("source").alias("source_id")))
    chunks = docs.select("chunk_id", F.col("source").alias("source_id"), F.concat(F.lit("unit:"), "doc_id").alias("unit_id"), F.col("text").alias("content"))
    _, edges, evidence = candidates.publication(*found, chunks)
    cited = evidence.groupBy(F.col("owner").alias("id")).agg(F.countDistinct("id").alias("n_evidence"), F.min("id").alias("least"))
    return edges.join(cited, "id").select("id", "source", "target", "relation", "source_id", "n_evidence", "least")


@query(r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS title FROM pages) SELECT page_id, count(*) AS blocks, min(trim(regexp_replace(title, '<[^>]*>', '', 'g'))) AS least_title FROM b GROUP BY page_id""")
def page_blocks(spark, sf_dir):
    titles = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))).alias("title"))
    return titles.groupBy("page_id").agg(F.count("*").alias("blocks"), F.min(F.trim(F.regexp_replace("title", "<[^>]*>", ""))).alias("least_title"))


def flagship(spark, sf_dir):
    """Questions from `benchmark` to their best documents with evidence ids: the smallest whole retrieval."""
    hits = token_similarity_topk(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return hits.select("item_id", "place", "doc_id", "similarity", F.concat_ws(":", F.lit("evidence"), "source", F.format_string("%04d", "doc_id")).alias("evidence_id"), F.substring("text", 1, 120).alias("snippet"))
