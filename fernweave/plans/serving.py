"""Queries of what is served and stored around the index: anchors, reports, payloads, bundles, file choice and checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..operators import anchors as A
from ..operators import community as C
from ..operators import graph as G
from ..operators import index_rows as I
from ..operators import publish as P
from ..operators import relational as R
from ..operators import reports as S
from ..operators import retrieval as V
from ..operators import vector_sync as Y
from ..sources import files, tables
from .graph import spelled, star, star_sql
from .relational import by_type, labelled, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def number(c: str) -> F.Column:
    return F.split_part(F.col(c), F.lit(":"), F.lit(2)).cast("long")


ANCHOR_TERMS = ["bolt", "widget"]


@query(f"""WITH {star_sql()}, n AS (SELECT label, id, CAST(split_part(id, ':', 2) AS BIGINT) AS ord, CASE WHEN contains(name, 'bolt') THEN 0 WHEN contains(name, 'widget') THEN 1 END AS term FROM nodes),
c AS (SELECT label, 0 AS how, term, ord, id FROM n WHERE term IS NOT NULL UNION ALL SELECT label, 1, 0, ord, id FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY how, term, ord, id) AS k FROM c)
SELECT CAST(place AS INTEGER) AS place, id FROM r JOIN (VALUES ('Symptom', 0), ('Syndrome', 1), ('Formula', 2), ('Herb', 3)) l(label, place) USING (label) WHERE k = 1""")
def anchor_nodes(spark, sf_dir):
    nodes = star(spark, sf_dir)[0].withColumn("ord", number("id"))
    return A.anchors(nodes, nodes.withColumn("place", F.col("ord")), ANCHOR_TERMS, "general", 4)


@query("""SELECT id, score FROM (SELECT 'part:' || p_partkey AS id, CASE WHEN p_size > 25 THEN p_retailprice END AS score, p_partkey FROM part) ORDER BY score DESC NULLS LAST, p_partkey LIMIT 50""")
def reranked_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_partkey").alias("ord"), "p_size", F.col("p_retailprice").alias("price"))
    scores = nodes.where("p_size > 25").select("id", F.col("price").alias("score"))
    return A.reranked(nodes, scores).limit(50).select("id", "score")


@query("""WITH a AS (SELECT n_nationkey AS id, 0 AS l, n_nationkey AS p FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, 1, n_nationkey FROM nation),
f AS (SELECT id, min(l * 1000000 + p) AS p FROM a JOIN nation ON n_nationkey = id WHERE n_regionkey >= 1 GROUP BY id)
SELECT CAST(id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS place FROM f""")
def seed_nodes(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").alias("place"), "n_regionkey")
    return A.seeds(nations.where("n_regionkey = 2"), nations, nations.where("n_regionkey >= 1"))


@query("""SELECT 'evidence:' || conv_id AS id, min_by(text, turn) AS snippet, CAST(min(turn) AS BIGINT) AS place FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 3) GROUP BY conv_id""")
def chunk_cards(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    hits = conv.select(F.concat(F.lit("chunk:"), "conv_id").alias("chunk_id"), F.col("text").alias("content"), F.col("turn").alias("place"))
    return A.chunk_cards(hits, conv.where("turn >= 3").select(F.concat(F.lit("evidence:"), "conv_id").alias("id")))


@query(f"WITH {star_sql()}, e AS (SELECT source, target FROM edges WHERE relation = 'INCLUDES' ORDER BY source, target LIMIT 6) SELECT source AS id FROM e UNION SELECT target FROM e")
def highlighted_nodes(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    return A.highlighted(nodes.withColumn("ord", F.struct("id")), edges.where("relation = 'INCLUDES'").withColumn("ord", F.struct("source", "target"))).select("id")


@query(f"""WITH {star_sql()}, kept AS (SELECT id FROM nodes WHERE label <> 'Symptom') SELECT source, target, relation, weight FROM weighted WHERE source IN (FROM kept) AND target IN (FROM kept) ORDER BY weight DESC, relation, source, target LIMIT 9000""")
def overview_edges(spark, sf_dir):
    nodes, edges = star(spark, sf_dir, numbers=True)
    return G.induced_edges(edges, nodes.where("label <> 'Symptom'"), 9000, spelled)


@query("""WITH n AS (SELECT 'nation:' || c_nationkey AS s, 'customer:' || c_custkey AS id, c_mktsegment AS g FROM customer), a AS (SELECT s, count(*) AS nodes, CAST(to_json(list(id ORDER BY id)) AS VARCHAR) AS node_json,
CAST(to_json(list({'source': id, 'relation': 'IN', 'target': g} ORDER BY id, g)) AS VARCHAR) AS edge_json FROM n GROUP BY s) SELECT 'subgraph:' || s AS artifact_id, 'subgraph' AS kind, s AS source_id, nodes, nodes AS edges, node_json, edge_json FROM a""")
def subgraph_artifacts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("source_id"), F.concat(F.lit("customer:"), "c_custkey").alias("id"), "c_mktsegment")
    edges = rows.select("source_id", F.col("id").alias("source"), F.lit("IN").alias("relation"), F.col("c_mktsegment").alias("target"))
    return I.artifacts(rows.select("source_id", "id"), edges)


@query("""SELECT 'subgraph:nation:7' AS artifact_id, count(*) AS nodes FROM customer WHERE c_nationkey = 7 HAVING count(*) > 0""")
def artifact_lookup(spark, sf_dir):
    return I.artifact_of(subgraph_artifacts(spark, sf_dir), "nation:7").select("artifact_id", "nodes")


@query("""SELECT p_type, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM part WHERE p_size < 3 GROUP BY p_type""")
def type_pool(spark, sf_dir):
    samples = table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set(F.when(F.col("p_size") < 3, F.col("p_name")))).alias("names"))
    return I.type_pool(samples, "p_type", "names").select("p_type", F.array_join("names", "|").alias("names"))


@query("""SELECT 'documents' AS kind, count(*) AS total FROM documents UNION ALL SELECT 'turns', count(*) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'items', count(*) FROM benchmark""")
def job_totals(spark, sf_dir):
    names = {"documents": "documents", "turns": "conversations", "pages": "pages", "items": "benchmark"}
    return P.job_totals(**{kind: table(spark, sf_dir, name) for kind, name in names.items()})


@query("""SELECT 'suppliers' AS kind, count(*) AS total FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT 'customers', count(*) FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'nations', count(*) FROM nation WHERE n_nationkey = 7""")
def source_bundle(spark, sf_dir):
    parts = {f"{t}s": table(spark, sf_dir, t).withColumn("source_id", F.concat(F.lit("nation:"), f"{t[0]}_nationkey")) for t in ("supplier", "customer", "nation")}
    return P.job_totals(**P.bundle("nation:7", **parts))


@query("""SELECT DISTINCT source AS source_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1""")
def published_sources(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.col("source").alias("source_id"), F.when(F.col("quality") == 1, "published").otherwise("parsed").alias("status"))
    return P.published_ids(rows)


PAYLOAD_SQL = """SELECT 'part:' || p_partkey AS id, 'entity' AS content_type, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part UNION ALL SELECT 'evidence:' || item_id, 'evidence', text FROM benchmark"""


@query(PAYLOAD_SQL)
def vector_payloads(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("label"), F.col("p_type").alias("description"))
    return P.vector_payloads(nodes, table(spark, sf_dir, "benchmark").select(F.concat(F.lit("evidence:"), "item_id").alias("id"), F.col("text").alias("snippet")))


@query(f"SELECT content_type, count(*) AS n FROM ({PAYLOAD_SQL}) GROUP BY content_type")
def payload_counts(spark, sf_dir):
    return P.counts_by_type(vector_payloads(spark, sf_dir))


@query("""SELECT 'e' || p_partkey AS id, p_type AS title, 'Formula「' || p_name || '」of' || 'Brand「' || p_brand || '」' AS snippet FROM part""")
def structured_cards(spark, sf_dir):
    edges = table(spark, sf_dir, "part").select(F.concat(F.lit("e"), "p_partkey").alias("id"), F.col("p_type").alias("file"), F.lit("Formula").alias("source_type"), F.col("p_name").alias("source_name"), F.lit("of").alias("display"), F.lit("Brand").alias("target_type"), F.col("p_brand").alias("target_name"))
    return P.structured_cards(edges)


@query(r"""WITH d AS (SELECT p_partkey, sha1('\x6B\xA7\xB8\x11\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::BLOB || encode('part:' || p_partkey)) AS d FROM part)
SELECT p_partkey, concat_ws('-', d[1:8], d[9:12], '5' || d[14:16], translate(d[17], '0123456789abcdef', '89ab89ab89ab89ab') || d[18:20], d[21:32]) AS point_id FROM d""")
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tables.point_id(F.concat(F.lit("part:"), "p_partkey")).alias("point_id"))


@query("""WITH f AS (SELECT CASE WHEN p_size < 5 THEN '.' ELSE '' END || p_partkey || '.' || ['json', 'md', 'png', 'bin'][1 + p_size % 4] AS name, CAST(p_retailprice * 22000 AS BIGINT) AS length FROM part),
r AS (SELECT CASE WHEN name LIKE '.%' THEN 'hidden' WHEN name LIKE '%.json' AND length > 20971520 THEN 'large_json' WHEN name LIKE '%.bin' THEN 'unsupported' END AS reason FROM f)
SELECT reason, count(*) AS count FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def skipped_files(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, ("json", "md", "png", "bin"))), F.col("p_size") % 4 + 1)
    name = F.concat(F.when(F.col("p_size") < 5, ".").otherwise(""), F.col("p_partkey").cast("string"), F.lit("."), ending)
    listed = table(spark, sf_dir, "part").select(F.concat(F.lit("/in/"), name).alias("path"), F.round(F.col("p_retailprice") * 22000).cast("long").alias("length"))
    return files.skip_counts(listed)


@query("""WITH p AS (SELECT doc_id, text, least(nullif(strpos(text, 'that'), 0), nullif(strpos(text, 'ment'), 0)) AS spot FROM documents),
w AS (SELECT doc_id, CASE WHEN spot IS NULL THEN substr(text, 1, 3000) ELSE substr(text, greatest(1, spot - 700), spot + 700 - greatest(1, spot - 700)) END AS w FROM p) SELECT doc_id, length(w) AS n, md5(w) AS digest FROM w""")
def focus_windows(spark, sf_dir):
    cut = S.focus_window(F.col("text"), ["that", "ment"])
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("w")).select("doc_id", F.length("w").cast("long").alias("n"), F.md5("w").alias("digest"))


@query("""SELECT p_partkey, '# ' || p_partkey || '. ' || p_name || chr(10) || CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS block FROM part""")
def report_texts(spark, sf_dir):
    content = F.when(F.col("p_size") > 25, F.to_json(F.struct(F.col("p_type").alias("report")))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", Q.report_text(F.col("p_partkey"), F.col("p_name"), content).alias("block"))


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN lower(p_type) ELSE 'entity' END || ':' || p_name AS node_id, CAST(contains(p_name, 'cold')::INT + contains(p_name, 'bolt')::INT AS DOUBLE) AS shared,
concat_ws(' ', p_name, p_type, CASE WHEN p_size > 25 THEN p_brand END, CASE WHEN p_name = 'cold bolt' THEN 'chilly pin' END) AS text FROM part""")
def node_texts(spark, sf_dir):
    label, name = F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(""), F.col("p_name")
    embedded = Q.embedding_text(name, F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), {"cold bolt": "chilly pin"})
    return table(spark, sf_dir, "part").select("p_partkey", Q.node_id(label, name).alias("node_id"), Q.shared_words(name, F.lit("bolt cold"), ("cold", "bolt", "rod")).alias("shared"), embedded.alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '>' || p_type ELSE p_brand || '>' || p_type || '>' || p_name END AS path FROM part""")
def section_paths(spark, sf_dir):
    title = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.section_path(F.col("p_brand"), F.col("p_type"), title), ">").alias("path"))


@query("""WITH c AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS unit, conv_id || ':' || turn AS chunk FROM conversations), u AS (SELECT unit, chunk, row_number() OVER (PARTITION BY unit ORDER BY chunk) AS k FROM c),
r AS (SELECT chunk AS ref, 0 AS sub, chunk FROM c UNION ALL SELECT unit, k, chunk FROM u WHERE k <= 3), e AS (SELECT item_id, 0 AS pos, CAST(item_id AS VARCHAR) AS ref FROM benchmark UNION ALL SELECT item_id, 1, item_id || ':1' FROM benchmark)
SELECT item_id AS owner, chunk AS chunk_id, CAST(min(pos * 10 + sub) // 10 AS INTEGER) AS pos FROM e JOIN r USING (ref) GROUP BY 1, 2""")
def unit_evidence(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("unit_id")).distinct()
    refs = F.array(F.col("item_id").cast("string"), F.concat(F.col("item_id").cast("string"), F.lit(":1")))
    evidence = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("owner"), F.posexplode(refs).alias("pos", "ref"))
    return S.resolved_evidence(evidence, chunks).select("owner", "chunk_id", "place.pos")


@query("""SELECT p_partkey, CASE WHEN p_name IN ('cold bolt', 'small widget') THEN 2 * p_retailprice ELSE p_retailprice END AS similarity FROM part""")
def double_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("similarity"))
    return C.double_hits(rows, "p_name", "similarity", ["cold bolt", "small widget"]).select("p_partkey", "similarity")


@query("""WITH s AS (SELECT p_partkey, p_retailprice, contains(p_name, 'cold')::INT + contains(p_name, 'bolt')::INT AS n FROM part)
SELECT p_partkey, round(n * CAST(0.1 AS DOUBLE), 6) AS bonus FROM s WHERE n > 0 ORDER BY n DESC, p_retailprice DESC, p_partkey LIMIT 224""")
def relation_prefilter(spark, sf_dir):
    return C.prefiltered(table(spark, sf_dir, "part"), F.col("p_name"), ["cold", "bolt"], [F.desc("p_retailprice"), "p_partkey"], 224).select("p_partkey", "bonus")


REPORT_SQL = """n AS (SELECT p_partkey AS id, CAST(substr(p_brand, 7) AS BIGINT) AS c, p_name AS name, p_retailprice AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_type, p_name, 'part:' || p_partkey) AS k FROM part),
top AS (SELECT c, name, row_number() OVER (PARTITION BY c ORDER BY min(k)) AS k FROM n WHERE k <= 6 GROUP BY c, name), names AS (SELECT c, string_agg(name, '、' ORDER BY k) FILTER (WHERE k <= 3) AS title, string_agg(name, '|' ORDER BY k) AS entities FROM top GROUP BY c),
size AS (SELECT c, count(*) AS size, round(sum(w), 6) AS weight FROM n GROUP BY c), inside AS (SELECT a.c, count(*) AS relations FROM n a JOIN n b ON b.id = a.id + 1 AND a.c = b.c GROUP BY a.c),
reports AS (SELECT c AS report_id, title, entities, size, weight, coalesce(relations, 0) AS relations FROM size JOIN names USING (c) LEFT JOIN inside USING (c))"""


def brand_reports(spark, sf_dir):
    """Parts of a brand as a community; each part has an edge to the next."""
    part = table(spark, sf_dir, "part")
    node = lambda k: F.concat(F.lit("part:"), k.cast("string"))
    nodes = part.select(node(F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("label"), F.col("p_retailprice").alias("visual_weight"), F.substring("p_brand", 7, 9).cast("long").alias("community"))
    edges = part.select(node(F.col("p_partkey")).alias("source"), node(F.col("p_partkey") + 1).alias("target"))
    return S.reports(nodes, edges, "community")


@query(f"WITH {REPORT_SQL} SELECT * FROM reports")
def community_reports(spark, sf_dir):
    return brand_reports(spark, sf_dir)


@query(f"""WITH {REPORT_SQL}, s AS (SELECT *, len(list_filter(['cold bolt', 'small widget', 'large bolt'], lambda x: list_contains(string_split(entities, '|'), x))) AS shared FROM reports)
SELECT report_id, CAST(shared AS INTEGER) AS shared FROM s WHERE shared > 0 ORDER BY shared DESC, weight DESC, title DESC LIMIT 5""")
def report_search(spark, sf_dir):
    found = brand_reports(spark, sf_dir)
    return S.report_search(found, F.split("entities", r"\|"), ["cold bolt", "small widget", "large bolt"], 5).select("report_id", "shared")


@query("""WITH t AS (SELECT 'chunk_' || lang AS content_type, quality = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'entity', p_size > 10 FROM part),
c AS (SELECT content_type, count(*) FILTER (WHERE ok) AS embedded FROM t GROUP BY content_type) SELECT content_type, embedded, content_type = 'entity' OR embedded = 0 AS consistent FROM c""")
def store_check(spark, sf_dir):
    points = F.when(F.col("content_type") == "entity", F.col("embedded"))  # a store that holds entities and can't be asked for chunks
    return by_type(spark, sf_dir).select("content_type", "embedded", Y.point_check(F.col("embedded"), points).alias("consistent"))


@query("""SELECT lang, CASE quality WHEN 1 THEN 'embedded' ELSE 'missing' END AS vector_status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def reset_statuses(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "embedded").when(F.col("quality") == 0, "failed").otherwise("missing")
    rows = labelled(spark, sf_dir).select("lang", status.alias("vector_status"))
    return tables.reset_failed(rows).groupBy("lang", "vector_status").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, CAST(least(n_chars, 1000) AS DOUBLE) / 1000 AS own, CAST(quality AS DOUBLE) AS model FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, round(0.5 * own + 0.5 * coalesce(model, own), 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 80""")
def rerank_fusion(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", (F.least("n_chars", F.lit(1000)) / 1000).alias("own"), F.col("quality").cast("double").alias("model"))
    return rows.select("doc_id", F.round(V.fused_rerank(F.col("own"), F.col("model")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(80)


@query("""SELECT conv_id || ':' || turn AS chunk_id, CAST(conv_id AS VARCHAR) AS source_id, turn AS chunk_index, length(text) AS token_count FROM conversations""")
def unit_chunks(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("unit_id"), F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("unit_index"), F.col("text").alias("content"))
    return P.units_as_chunks(units).select("chunk_id", "source_id", "chunk_index", F.col("token_count").cast("long").alias("token_count"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def missing_points(spark, sf_dir):
    points = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "chunk").otherwise("entity").alias("content_type"))
    return R.unseen(table(spark, sf_dir, "documents").select("doc_id"), Y.existing_ids(points, "chunk", "doc_id"), ["doc_id"])


@query(r"""SELECT page_id, 'sources/' || substr(sha1(url), 1, 12) || '/' || regexp_replace(url, '[^0-9A-Za-z一-鿿._-]+', '_', 'g') AS object_key FROM pages""")
def object_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.object_key(F.sha1("url"), F.col("url")).alias("object_key"))


@query("""SELECT p_partkey, p_brand || ',' || p_type AS chunks FROM part""")
def listed_chunks(spark, sf_dir):
    joined = F.concat_ws(" , ", "p_brand", F.lit(""), "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(I.source_chunks(joined), ",").alias("chunks"))
