"""Queries of index rows, query understanding, publishing and vector sync on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query as Q
from ..operators import anchors as A
from ..operators import graph as G
from ..operators import index_rows as I
from ..operators import kg, publish
from ..operators import relational as R
from ..operators import resolution as S
from ..operators import vector_sync as V
from .graph import PAIR_SQL, number, once, spelled, star, star_sql, unspelled
from .relational import TOKENS_SQL, by_type, labelled, table, tokens

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def text_of(c: str) -> F.Column:
    return F.col(c).cast("string")


def ids(c: str) -> F.Column:
    """Ids of a group in order, joined."""
    return F.array_join(F.array_sort(F.collect_list(c)), ",")


@query(f"""WITH s AS (SELECT DISTINCT source FROM documents), c AS (SELECT source, count(*) AS chunks, count(*) FILTER (WHERE n BETWEEN 8 AND 900 AND trim(text) <> '') AS eligible FROM (SELECT d.*, {TOKENS_SQL} AS n FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1) GROUP BY source)
SELECT source AS doc_id, 'parsed' AS status, coalesce(chunks, 0) AS chunk_count, coalesce(eligible, 0) AS eligible_chunk_count FROM s LEFT JOIN c USING (source)""")
def document_rows(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().select("source_id", F.lit("").alias("filename"), F.lit("").alias("checksum"), F.lit("parsed").alias("status"), F.lit("").alias("object_key"))
    counts = R.chunk_counts(labelled(spark, sf_dir).where("quality = 1 AND toxic = 1"), "source", tokens(), F.col("text")).withColumnRenamed("source", "source_id")
    return I.document_rows(sources, counts).select("doc_id", "status", "chunk_count", "eligible_chunk_count")


def event_entities(spark, sf_dir):
    """Users of a type of event as candidates of the type's source; chunks are the events."""
    events = table(spark, sf_dir, "events")
    one = events.groupBy("event_type", "user_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("chunk:"), text_of("event_id")))).alias("chunk_ids"), F.max("value").alias("confidence"))
    return one.select(F.col("event_type").alias("source_id"), text_of("user_id").alias("entity_id"), F.concat(F.lit("user "), text_of("user_id")).alias("name"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("normalized_name"), F.when(F.col("user_id") % 2 == 0, "Herb").otherwise("Formula").alias("label"), "confidence", "chunk_ids", F.xxhash64("event_type").alias("ord"))


@query("""WITH e AS (SELECT event_type, user_id, max(value) AS c, string_agg(DISTINCT 'chunk:' || event_id, ',' ORDER BY 'chunk:' || event_id) AS evidence FROM events GROUP BY 1, 2)
SELECT event_type || ':' || user_id AS entity_id, 'user ' || user_id AS entity_name, CASE WHEN user_id % 2 = 0 THEN 'Herb' ELSE 'Formula' END AS entity_type, round(greatest(c, 0.01), 4) AS rank, 'u' || (user_id % 10) || '|user ' || user_id AS aliases, evidence FROM e""")
def entity_rows(spark, sf_dir):
    rows = I.entity_rows(event_entities(spark, sf_dir))
    return rows.select("entity_id", "entity_name", "entity_type", F.round("rank", 4).alias("rank"), F.array_join("aliases", "|").alias("aliases"), F.array_join("evidence", ",").alias("evidence"))


@query("""SELECT 'user ' || user_id AS name, label, count(DISTINCT event_id) AS chunks, min('chunk:' || event_id) AS least FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'Herb' ELSE 'Formula' END AS label FROM events UNION ALL SELECT *, '' FROM events) GROUP BY 1, 2""")
def candidate_evidence(spark, sf_dir):
    entities = event_entities(spark, sf_dir)
    none = spark.createDataFrame([], "source_id string, source_entity_id string, target_entity_id string, relation string, ord long, chunk_ids array<string>")
    return I.candidate_evidence(entities, none)[0].select("name", "label", F.size("chunk_ids").cast("long").alias("chunks"), F.array_min("chunk_ids").alias("least"))


@query("""WITH c AS (SELECT c_mktsegment AS source_id, c_custkey, c_name FROM customer)
SELECT c_mktsegment || ':' || o_orderkey AS relation_id, c_name AS from_name, 'status ' || o_orderstatus AS to_name, c_name || ' ORDERED status ' || o_orderstatus AS content_with_weight, CAST(greatest(1, round_even(o_totalprice / 100000, 0)) AS INTEGER) AS weight FROM orders JOIN customer ON c_custkey = o_custkey""")
def relation_rows(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    entities = customers.select(F.col("c_mktsegment").alias("source_id"), text_of("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    relations = orders.select(F.col("c_mktsegment").alias("source_id"), text_of("o_orderkey").alias("relation_id"), text_of("o_custkey").alias("source_entity_id"), F.concat(F.lit("status "), "o_orderstatus").alias("target_entity_id"), F.lit("ORDERED").alias("relation"), F.lit("").alias("display"), (F.col("o_totalprice") / 100000).alias("confidence"), I.none().alias("chunk_ids"))
    return I.relation_rows(relations, entities).select("relation_id", "from_name", "to_name", "content_with_weight", "weight")


@query(f"""WITH {star_sql()} SELECT w.source || '>' || w.target AS relation_id, x.name AS from_name, y.name AS to_name, relation AS relation_type, CAST(greatest(1, round_even(CAST(retrieval_weight AS DECIMAL(10, 4)) * 10, 0)) AS INTEGER) AS weight,
CASE WHEN relation = 'INCLUDES' THEN 'chunk:' || w.source ELSE '' END AS evidence FROM weighted w JOIN nodes x ON x.id = w.source JOIN nodes y ON y.id = w.target""")
def graph_relation_rows(spark, sf_dir):
    nodes, edges = star(spark, sf_dir, numbers=True)
    cited = F.when(F.col("relation") == "INCLUDES", F.array(F.concat(F.lit("evidence:"), spelled("source")), F.lit("other"))).otherwise(I.none())
    rows = edges.select(F.struct("source", "target").alias("id"), "source", "target", "relation", F.col("relation").alias("display"), cited.alias("evidence_ids"))
    ident = F.concat_ws(">", spelled("relation_id.source"), spelled("relation_id.target"))
    return I.graph_relation_rows(rows, nodes, I.no_evidence(spark), spelled).select(ident.alias("relation_id"), "from_name", "to_name", "relation_type", "weight", F.array_join("evidence", ",").alias("evidence"))


@query("""WITH n AS (SELECT 'supplier:' || s_suppkey AS id, 'n' || s_nationkey AS source_id FROM supplier), e AS (SELECT DISTINCT l_suppkey, l_partkey, l_partkey % 3 AS k FROM lineitem)
SELECT source_id, count(*) AS edges FROM (SELECT DISTINCT source_id, l_suppkey, l_partkey FROM (SELECT 'm' || k AS source_id, l_suppkey, l_partkey FROM e WHERE k > 0 UNION ALL SELECT n.source_id, l_suppkey, l_partkey FROM e JOIN n ON n.id = 'supplier:' || l_suppkey WHERE k = 0)) GROUP BY source_id""")
def subgraph_groups(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(number("supplier", "s_suppkey").alias("id"), F.array(F.concat(F.lit("chunk:n"), "s_nationkey", F.lit(":1"))).alias("refs"))
    k = F.col("l_partkey") % 3
    edges = table(spark, sf_dir, "lineitem").select(number("supplier", "l_suppkey").alias("source"), number("part", "l_partkey").alias("target"), F.lit("R").alias("relation"), F.when(k > 0, F.array(F.concat(F.lit("evidence:m"), k, F.lit(":7")))).otherwise(I.none()).alias("refs"))
    return I.subgraph_groups(nodes, edges)[1].groupBy("source_id").agg(F.count("*").alias("edges"))


def sync_records(spark, sf_dir):
    docs = labelled(spark, sf_dir).select(F.lit("chunk").alias("content_type"), text_of("doc_id").alias("id"), F.lpad(text_of("doc_id"), 12, "0").alias("rank"), F.when(F.col("quality") == 1, "embedded").when(F.col("quality") == 0, "failed").otherwise("missing").alias("vector_status"))
    parts = table(spark, sf_dir, "part").select(F.lit("entity"), text_of("p_partkey"), F.lpad(text_of("p_partkey"), 12, "0"), F.when(F.col("p_size") > 10, "embedded").otherwise("missing"))
    return docs.union(parts)


RECORDS_SQL = """r AS (SELECT 'chunk' AS content_type, CAST(doc_id AS VARCHAR) AS id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS rank, CASE WHEN quality = 1 THEN 'embedded' WHEN quality = 0 THEN 'failed' ELSE 'missing' END AS vector_status FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'entity', CAST(p_partkey AS VARCHAR), lpad(CAST(p_partkey AS VARCHAR), 12, '0'), CASE WHEN p_size > 10 THEN 'embedded' ELSE 'missing' END FROM part)"""


@query(f"""WITH {RECORDS_SQL}, c AS (SELECT * FROM r WHERE vector_status = 'missing' ORDER BY content_type <> 'entity', rank LIMIT 500)
SELECT r.content_type, CASE WHEN c.id IS NOT NULL THEN 'queued' ELSE r.vector_status END AS vector_status, count(*) AS n, min(r.id) AS least FROM r LEFT JOIN c ON c.id = r.id AND c.content_type = r.content_type GROUP BY 1, 2""")
def claim_missing(spark, sf_dir):
    marked = V.claim(sync_records(spark, sf_dir), ["content_type", "id"], "content_type", ["entity", "chunk"], ["rank"], 500)[1]
    return marked.groupBy("content_type", "vector_status").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@query(f"""WITH {RECORDS_SQL} SELECT vector_status AS counter, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT vector_status || '_' || content_type, count(*) FROM r GROUP BY 1""")
def sync_counters(spark, sf_dir):
    return V.outcome_counts(sync_records(spark, sf_dir).withColumnRenamed("vector_status", "status"), "content_type")


@query("""WITH t AS (SELECT content_type, count(*) AS total, count(*) FILTER (WHERE ok) AS embedded FROM (
SELECT 'chunk_' || lang AS content_type, quality = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'entity', p_size > 10 FROM part) GROUP BY content_type)
SELECT content_type, embedded >= 100 AND embedded >= total * 0.5 AS gate, embedded = 0 AS unknown_points_fit FROM t""")
def vector_gate(spark, sf_dir):
    fit = V.point_check(F.col("embedded"), F.lit(None).cast("long"))
    return by_type(spark, sf_dir).select("content_type", V.open_gate(F.col("embedded"), F.col("total"), 100, 0.5).alias("gate"), fit.alias("unknown_points_fit"))


@query("""WITH s AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS all_t, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS t FROM benchmark),
k AS (SELECT item_id, list_filter(list_distinct(list_filter(t, lambda x: length(x) BETWEEN 2 AND 6 AND x NOT IN ('the', 'and', 'of'))), lambda x: true) AS c FROM s)
SELECT item_id, CAST(len(list_filter(c, lambda w: len(list_filter(c, lambda o: starts_with(o, w) AND o <> w)) = 0)) AS INTEGER) AS words, list_aggregate(list_sort(list_filter(c, lambda w: len(list_filter(c, lambda o: starts_with(o, w) AND o <> w)) = 0)), 'string_agg', '|') AS keywords FROM k""")
def candidate_keywords(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    found = table(spark, sf_dir, "benchmark").select("item_id", Q.candidate_keywords(words, ("no such term",), (), ("the", "and", "of"), 1 << 20).alias("k"))
    return found.select("item_id", F.size("k").alias("words"), F.nullif(F.array_join(F.array_sort("k"), "|"), F.lit("")).alias("keywords"))


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(text, 'the') OR contains(text, 'that') THEN 'Syndrome' END, CASE WHEN contains(text, 'of') THEN 'Formula' END, CASE WHEN contains(text, 'ing') THEN 'Herb' END) AS types FROM conversations""")
def answer_types(spark, sf_dir):
    kinds = {"Syndrome": ("the", "that"), "Formula": ("of",), "Herb": ("ing",)}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(Q.answer_types(F.col("text"), kinds), ",").alias("types"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'Herb' END AS types, CASE WHEN event_id % 3 = 0 THEN 'user ' || user_id ELSE 'x' END AS entities, CASE WHEN event_id % 3 = 0 THEN 'llm' ELSE 'rules' END AS source FROM events""")
def rewrite_parse(spark, sf_dir):
    said = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.array("event_type", "event_type").alias("answer_type_keywords"), F.array(F.concat(F.lit(" user "), "user_id")).alias("entities"))), F.lit(" ok"))
    raw = F.when(F.col("event_id") % 3 == 0, said).when(F.col("event_id") % 3 == 1, "{}").otherwise("nothing")
    rows = table(spark, sf_dir, "events").select("event_id", Q.rewrite(raw, F.array(F.lit("Herb")), F.array(F.lit("x"))).alias("r"))
    return rows.select("event_id", F.array_join("r.types", ",").alias("types"), F.array_join("r.entities", ",").alias("entities"), F.col("r.source").alias("source"))


@query("""SELECT level, community, count(*) AS n FROM (SELECT 0 AS level, CAST(l_suppkey AS INTEGER) AS community FROM lineitem UNION ALL SELECT 1, CAST(l_suppkey % 7 AS INTEGER) FROM lineitem) GROUP BY 1, 2""")
def community_levels(spark, sf_dir):
    tags = F.array(F.concat(F.lit("0:"), "l_suppkey"), F.concat(F.lit("1:"), F.col("l_suppkey") % 7), F.lit("bad"), F.lit("x:y"))
    return I.level_counts(table(spark, sf_dir, "lineitem").select(tags.alias("tags")))


@query("""WITH e AS (SELECT 'e' || l_partkey AS id, max(l_suppkey) AS last FROM lineitem GROUP BY 1), r AS (SELECT DISTINCT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, 'e' || l_partkey AS source FROM lineitem)
SELECT r.id, r.source, 'e' || (CAST(substr(r.source, 2) AS BIGINT) % 5 + 1) AS target, 'evidence:' || r.id AS evidence FROM r JOIN e ON e.id = r.source JOIN e t ON t.id = 'e' || (CAST(substr(r.source, 2) AS BIGINT) % 5 + 1)""")
def published_edges(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    ident = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    entities = items.select(text_of("l_suppkey").alias("source_id"), F.concat(F.lit("e"), "l_partkey").alias("entity_id"), F.lit("Herb").alias("label"), text_of("l_partkey").alias("name"), F.col("l_suppkey").alias("ord"))
    relations = items.select(text_of("l_suppkey").alias("source_id"), ident.alias("relation_id"), F.concat(F.lit("e"), "l_partkey").alias("source_entity_id"), F.concat(F.lit("e"), F.col("l_partkey") % 5 + 1).alias("target_entity_id"), F.lit("R").alias("relation"), F.lit("").alias("display"), F.array(F.concat(F.lit("chunk:"), ident)).alias("chunk_ids"), F.col("l_linenumber").alias("ord"))
    chunks = items.select(F.concat(F.lit("chunk:"), ident).alias("chunk_id"), text_of("l_suppkey").alias("source_id"), F.lit("").alias("unit_id"), F.lit("").alias("content"))
    return publish.published_graph(entities, relations, chunks)[1].select("id", "source", "target", F.array_join("evidence_ids", ",").alias("evidence"))


@query("""SELECT 0 AS list, 'nation:' || n_nationkey AS id, 'MERGE (n:Meridian {id: $id}) SET n += $properties' AS statement, CAST(json_object('id', 'nation:' || n_nationkey, 'name', n_name) AS VARCHAR) AS parameters FROM nation
UNION ALL SELECT 1, 'n' || n_nationkey, 'MATCH (a {id: $source}), (b {id: $target}) MERGE (a)-[r:INCLUDES {id: $id}]->(b) SET r += $properties', CAST(json_object('id', 'n' || n_nationkey, 'source', 'nation:' || n_nationkey, 'target', 'region:' || n_regionkey) AS VARCHAR) FROM nation""")
def merge_statements(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.lit("Meridian").alias("label"), F.col("n_name").alias("name"))
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("nation:"), "n_nationkey").alias("source"), F.concat(F.lit("region:"), "n_regionkey").alias("target"), F.lit("INCLUDES").alias("relation"))
    return publish.merge_statements(nodes, edges)


@query("""SELECT 'u' || user_id AS id, arg_max(event_type, event_id) AS status FROM events WHERE event_id % 10 <> 0 GROUP BY 1""")
def progress_log(spark, sf_dir):
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("id"), F.col("event_type").alias("status"))))
    return publish.progress(table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), line.alias("value")), "id")


@query("""SELECT source AS source_id, 'unit:' || source || ':' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS unit_id, CAST(k AS INTEGER) AS unit_index, 'chunk:' || doc_id AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE doc_id % 2 = 0""")
def fallback_units(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.concat(F.lit("chunk:"), "doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 1, "unit").alias("unit_id"), F.col("doc_id").alias("chunk_index"), F.lit("").alias("content"))
    return publish.units_of_chunks(chunks).select("source_id", "unit_id", "unit_index", "chunk_id")


@query(f"WITH {PAIR_SQL} SELECT p_brand, a, b FROM near WHERE contains(a, b) OR contains(b, a)")
def decided_pairs(spark, sf_dir):
    return S.decide(G.name_pairs(table(spark, sf_dir, "part"), "p_brand", "p_name"), "p_brand")


@query(f"""WITH {star_sql()}, o AS (SELECT s.name AS a, relation, t.name AS b, row_number() OVER (ORDER BY w.source, w.target) AS ord FROM weighted w JOIN nodes s ON s.id = w.source JOIN nodes t ON t.id = w.target WHERE relation = 'INCLUDES') SELECT a || ' -' || relation || '-> ' || b AS path FROM o WHERE ord <= 12""")
def path_strings(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    return A.path_strings(nodes, edges.where("relation = 'INCLUDES'").withColumn("ord", F.struct("source", "target"))).select("path")


@query("SELECT p_partkey, chr(34) || p_name || ',' || repeat(chr(34), 4) || ',' || p_brand || chr(34) || ',' || p_type AS row FROM part")
def context_rows(spark, sf_dir):
    joined = F.concat(F.col("p_name"), F.lit(',"",'), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", Q.csv_row(joined, F.col("p_type")).alias("row"))


@query()
def kg_retrieve(spark, sf_dir):
    """Suppliers, parts and nations as entities: what is found for a nation, with the types of parts."""
    nodes, edges = star(spark, sf_dir, numbers=True, repeats=True)
    edges = once(edges)
    none = spark.createDataFrame([], "name string, label string, chunk_ids array<string>").where(F.lit(False))
    plain = nodes.select(spelled("id").alias("id"), "label", "name", F.lit("").alias("description"), F.lit(None).cast("double").alias("pagerank"), F.lit(None).cast("double").alias("rank"), F.lit("").alias("source_chunks"))
    named = F.lower("entity_name")
    entities = I.graph_entity_rows(plain, None, none).withColumn("description", named)
    rows = edges.select(F.struct("source", "target").alias("id"), "source", "target", "relation", F.col("relation").alias("display"), F.array(F.concat(F.lit("chunk:"), spelled("source"))).alias("evidence_ids"))
    ident = F.concat_ws(">", spelled("relation_id.source"), spelled("relation_id.target"))
    relations = I.graph_relation_rows(rows, nodes, I.no_evidence(spark), spelled).withColumn("relation_id", ident).withColumn("content_with_weight", F.lower("content_with_weight"))
    reports = nodes.where("label = 'Category'").select(F.col("name").alias("title"), F.array("name").alias("names"), F.lit(1.0).alias("weight"))
    paths = lambda hits: G.n_hop_paths(edges, nodes, starts=hits.select(unspelled("id").alias("id"))).withColumn("id", spelled("id"))
    found = kg.retrieve(entities, relations, reports, ["asia"], ["asia"], ["Meridian"], paths=paths)
    return found.edges.select("id", "source", "target", "relation", F.array_join("evidence", ",").alias("evidence"))
