"""Graph queries on the star schema as a property graph: regions, nations, suppliers, parts and customers are nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LABEL_WEIGHTS, RELATION_WEIGHTS
from ..operators import graph as G
from ..operators import modularity as M
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


NODES = (("region", "r_regionkey", "r_name", "Category"), ("nation", "n_nationkey", "n_name", "Meridian"), ("supplier", "s_suppkey", "s_name", "Herb"), ("part", "p_partkey", "p_name", "Formula"), ("customer", "c_custkey", "c_name", "Symptom"))
EDGES = (("nation", "nation:n_nationkey", "region:n_regionkey", "INCLUDES"), ("supplier", "supplier:s_suppkey", "nation:s_nationkey", "DISTRIBUTED_IN"), ("customer", "customer:c_custkey", "nation:c_nationkey", "ENTERS_MERIDIAN"), ("lineitem", "part:l_partkey", "supplier:l_suppkey", "COMPOSED_OF"))


def number(t: str, key: str):
    """The number of a node by its table and key."""
    return F.col(key).cast("long") * len(NODES) + next(k for k, (name, *_) in enumerate(NODES) if name == t)


def spelled(c: str):
    """The id that a number of star() stands for."""
    kind = F.element_at(F.array(*(F.lit(t) for t, *_ in NODES)), F.expr(f"CAST(pmod({c}, {len(NODES)}) AS INT) + 1"))
    return F.concat(kind, F.lit(":"), F.expr(f"CAST(({c} - pmod({c}, {len(NODES)})) div {len(NODES)} AS STRING)"))


def unspelled(c: str):
    """The number of star() that an id as text stands for."""
    kind = F.array_position(F.array(*(F.lit(t) for t, *_ in NODES)), F.split_part(F.col(c), F.lit(":"), F.lit(1))) - 1
    return F.split_part(F.col(c), F.lit(":"), F.lit(2)).cast("long") * len(NODES) + kind


def star(spark, sf_dir, tables=("region", "nation", "supplier", "part", "customer"), numbers=False, repeats=False):
    """(nodes, edges) of the tables named; parts are linked with the suppliers of their line items. With numbers, an id is a number,
    which spelled() turns into the text; shuffles of numbers are much smaller. With repeats, an edge stands once for each row."""
    ident = number if numbers else (lambda t, key: F.concat_ws(":", F.lit(t), key))
    nodes = edges = None
    for t, key, name, label in NODES:
        if t in tables:
            one = table(spark, sf_dir, t).select(ident(t, key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))
            nodes = one if nodes is None else nodes.unionByName(one)
    for t, a, b, relation in EDGES:
        (x, p), (y, q) = a.split(":"), b.split(":")
        if x in tables and y in tables:
            keys = table(spark, sf_dir, t).select(p, q)
            keys = keys if repeats else keys.distinct()  # numbers are shorter than ids
            one = keys.select(ident(x, p).alias("source"), ident(y, q).alias("target"), F.lit(relation).alias("relation"))
            edges = one if edges is None else edges.unionByName(one)
    return nodes, edges.withColumn("ord", F.xxhash64("source", "target", "relation"))


def star_sql(tables=("region", "nation", "supplier", "part", "customer")):
    nodes = " UNION ALL ".join(f"SELECT '{t}:' || {k} AS id, '{label}' AS label, {n} AS name FROM {t}" for t, k, n, label in NODES if t in tables)
    edges = []
    for t, a, b, relation in EDGES:
        (x, p), (y, q) = a.split(":"), b.split(":")
        if x in tables and y in tables:
            edges.append(f"SELECT DISTINCT '{x}:' || {p} AS source, '{y}:' || {q} AS target, '{relation}' AS relation FROM {t}")
    case = lambda c, d: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in d.items()) + " ELSE 1.0 END"
    return f"""nodes AS MATERIALIZED ({nodes}), edges AS ({' UNION ALL '.join(edges)}),
weighted AS MATERIALIZED (SELECT e.*, {case('relation', RELATION_WEIGHTS)} AS retrieval_weight, round(greatest(0.01, sqrt({case('s.label', LABEL_WEIGHTS)} * {case('t.label', LABEL_WEIGHTS)}) * {case('relation', RELATION_WEIGHTS)}), 6) AS weight FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target),
arcs AS MATERIALIZED (SELECT source AS a, target AS b, weight FROM weighted UNION ALL SELECT target, source, weight FROM weighted)"""


def once(edges):
    """Edges that repeat once, dealt by their source, by which they are joined next."""
    return edges.repartition("source").select("source", "target", "relation").distinct()


def pairs_of(spark, sf_dir, nodes, edges):
    return G.weighted_pairs(edges, nodes)


@query(f"WITH {star_sql()} SELECT source, target, relation, weight, retrieval_weight FROM weighted")
def edge_weights(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    return G.edge_weights(edges, nodes).select("source", "target", "relation", "weight", "retrieval_weight")


@query(f"WITH {star_sql()} SELECT id, count(b) AS rank FROM nodes LEFT JOIN arcs ON a = id GROUP BY id")
def degree_rank(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    return G.edge_counts(nodes, edges)


ROUNDS = 5


def pagerank_sql():
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM nodes) AS pr FROM nodes)"]
    for k in range(1, ROUNDS + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT n.id, 0.85 * (coalesce(i.x, 0) + (SELECT coalesce(sum(pr), 0) FROM r{k - 1} WHERE id NOT IN (SELECT a FROM arcs)) / (SELECT count(*) FROM nodes)) + CAST(0.15 AS DOUBLE) / (SELECT count(*) FROM nodes) AS pr FROM nodes n LEFT JOIN (SELECT s.b AS id, sum(s.share * r.pr) AS x FROM shares s JOIN r{k - 1} r ON r.id = s.a GROUP BY 1) i ON i.id = n.id)")
    return f"WITH {star_sql()}, shares AS MATERIALIZED (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share FROM arcs), {', '.join(steps)} SELECT id, round(pr, 8) AS pagerank FROM r{ROUNDS}"


@query(pagerank_sql())
def pagerank_k(spark, sf_dir):
    nodes, edges = star(spark, sf_dir, numbers=True, repeats=True)
    return G.pagerank(nodes, pairs_of(spark, sf_dir, nodes, edges), ROUNDS, None).select(spelled("id").alias("id"), F.round("pagerank", 8).alias("pagerank"))


@query()
def node_analytics(spark, sf_dir):
    nodes, edges = star(spark, sf_dir, numbers=True, repeats=True)
    pairs = G.materialize(pairs_of(spark, sf_dir, nodes, edges), "pairs")
    return G.visual_weights(nodes, G.degrees(nodes, pairs), G.pagerank(nodes, pairs)).withColumn("id", spelled("id"))


@query()
def communities_by_level(spark, sf_dir):
    """Node, level and community of the whole star graph: a heuristic, held against greedy modularity in tests/test_modularity.py."""
    nodes, edges = star(spark, sf_dir, numbers=True, repeats=True)
    pairs = G.materialize(pairs_of(spark, sf_dir, nodes, edges), "pairs")
    return M.communities(G.component_ids(G.components(nodes, pairs)), pairs).withColumn("id", spelled("id"))


SPREAD = 12  # rounds in which the SQL passes least ids on to neighbours; more than the graph's diameter


def components_sql():
    rounds = ["l0 AS MATERIALIZED (SELECT id, id AS root FROM nodes)"]
    for k in range(1, SPREAD + 1):
        rounds.append(f"l{k} AS MATERIALIZED (SELECT l.id, least(any_value(l.root), coalesce(min(o.root), any_value(l.root))) AS root FROM l{k - 1} l LEFT JOIN arcs ON arcs.a = l.id LEFT JOIN l{k - 1} o ON o.id = arcs.b GROUP BY l.id)")
    return f"""{star_sql()}, {', '.join(rounds)}, sizes AS (SELECT root, count(*) AS size FROM l{SPREAD} GROUP BY root),
numbered AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) - 1 AS component FROM sizes), comp AS (SELECT id, CAST(component AS INTEGER) AS component, size FROM l{SPREAD} JOIN numbered USING (root))"""


COMPONENTS_SQL = components_sql()


def component_frame(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    return nodes, edges, G.component_ids(G.components(nodes, pairs_of(spark, sf_dir, nodes, edges)))


@query(f"WITH {COMPONENTS_SQL} SELECT id, component, size FROM comp")
def components(spark, sf_dir):
    return component_frame(spark, sf_dir)[2]


@query(f"WITH {COMPONENTS_SQL}, c AS (SELECT component, label, count(*) AS n FROM comp JOIN nodes USING (id) GROUP BY 1, 2) SELECT component, string_agg(label || ':' || n, ',' ORDER BY n DESC, label) AS labels, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY component")
def community_summary(spark, sf_dir):
    nodes, _, comp = component_frame(spark, sf_dir)
    return G.label_counts(nodes.join(comp.select("id", "component"), "id"), "component")


BFS_SQL = f"""WITH {star_sql()}, d0 AS (SELECT id, label, 0 AS depth FROM nodes WHERE id IN ('supplier:1', 'customer:7')),
d1 AS (SELECT DISTINCT n.id, n.label, 1 AS depth FROM d0 JOIN arcs ON a = d0.id JOIN nodes n ON n.id = b WHERE n.id NOT IN (SELECT id FROM d0)),
d2 AS (SELECT DISTINCT n.id, n.label, 2 AS depth FROM d1 JOIN arcs ON a = d1.id JOIN nodes n ON n.id = b WHERE n.id NOT IN (SELECT id FROM d0 UNION ALL SELECT id FROM d1))
SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2"""


@query(BFS_SQL)
def bfs_neighborhood(spark, sf_dir):
    nodes, edges = star(spark, sf_dir, numbers=True, repeats=True)  # a repeated edge reaches no further node
    seeds = nodes.where(spelled("id").isin("supplier:1", "customer:7"))
    return G.neighborhood(nodes, edges, seeds, 2, max_nodes=1_000_000, max_edges=1_000_000)[0].withColumn("id", spelled("id"))


PATHS_SQL = f"""{star_sql()}, steps AS (SELECT source AS a, target AS b, retrieval_weight AS w FROM weighted UNION ALL SELECT target, source, retrieval_weight FROM weighted),
seconds AS (SELECT steps.*, row_number() OVER (PARTITION BY a ORDER BY w DESC, name, b) AS k FROM steps JOIN nodes ON nodes.id = b),
paths AS (SELECT s.a AS id, x.name || '|' || y.name AS path, 2 AS n, w AS total, [w] AS ws FROM steps s JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b
UNION ALL SELECT s.a, x.name || '|' || y.name || '|' || z.name, 3, s.w + t.w, [s.w, t.w] FROM steps s JOIN seconds t ON t.a = s.b AND t.b <> s.a AND t.k <= 41 JOIN nodes x ON x.id = s.a JOIN nodes y ON y.id = s.b JOIN nodes z ON z.id = t.b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(total, 6) DESC, n, path) AS place FROM paths)"""


@query(f"WITH {PATHS_SQL} SELECT id, path, round(total, 6) AS total, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 40")
def nhop_paths_top40(spark, sf_dir):
    nodes, edges = star(spark, sf_dir, numbers=True, repeats=True)
    return G.n_hop_paths(once(edges), nodes).select(spelled("id").alias("id"), F.array_join("path", "|").alias("path"), "total", "place")


SCORES_SQL = f"""{PATHS_SQL}, top AS (SELECT string_split(path, '|') AS p, ws FROM ranked WHERE place <= 40),
hops AS (SELECT p[1] AS from_name, p[2] AS to_name, CAST(0.9 AS DOUBLE) / 2 AS sim, ws[1] AS weight FROM top UNION ALL SELECT p[2], p[3], CAST(0.9 AS DOUBLE) / 3, ws[2] FROM top WHERE len(p) = 3),
scores AS (SELECT from_name, to_name, sum(sim) AS sim, max(weight) AS weight FROM hops GROUP BY 1, 2)"""


def scores(spark, sf_dir):
    nodes, edges = star(spark, sf_dir, numbers=True, repeats=True)
    edges = once(edges)
    return nodes, edges, G.path_scores(G.n_hop_paths(edges, nodes).withColumn("sim", F.lit(0.9)))


@query(f"WITH {SCORES_SQL} SELECT from_name, to_name, round(sim, 6) AS sim, weight FROM scores")
def nhop_edge_scores(spark, sf_dir):
    return scores(spark, sf_dir)[2].withColumn("sim", F.round("sim", 6))


@query(f"""WITH {SCORES_SQL}, rel AS (SELECT x.name AS from_name, y.name AS to_name, CAST(0.5 AS DOUBLE) AS sim, retrieval_weight AS weight FROM weighted JOIN nodes x ON x.id = source JOIN nodes y ON y.id = target WHERE relation = 'INCLUDES'),
f AS (SELECT r.from_name, r.to_name, r.sim * (1 + coalesce(s.sim, 0) + CASE WHEN r.from_name IN ('ASIA') THEN 1 ELSE 0 END + CASE WHEN r.to_name IN ('ASIA') THEN 1 ELSE 0 END) AS sim, r.weight FROM rel r LEFT JOIN scores s USING (from_name, to_name)
UNION ALL SELECT s.from_name, s.to_name, s.sim * (1 + CASE WHEN s.from_name IN ('ASIA') THEN 1 ELSE 0 END + CASE WHEN s.to_name IN ('ASIA') THEN 1 ELSE 0 END), s.weight FROM scores s ANTI JOIN rel USING (from_name, to_name)) SELECT from_name, to_name, round(sim, 6) AS sim, weight FROM f""")
def relation_fusion(spark, sf_dir):
    nodes, edges, s = scores(spark, sf_dir)
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    rel = G.edge_weights(edges.where("relation = 'INCLUDES'"), nodes).join(name("source"), "source").join(name("target"), "target")
    rel = rel.select(F.col("source_name").alias("from_name"), F.col("target_name").alias("to_name"), F.lit(0.5).alias("sim"), F.col("retrieval_weight").alias("weight"))
    return G.fused_relations(rel, ["ASIA"], s).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {COMPONENTS_SQL}, v AS (SELECT id, component AS community, round(CAST(length(name) AS DOUBLE), 6) AS visual_weight FROM comp JOIN nodes USING (id)),
p AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY visual_weight DESC, id) AS pos FROM v), h AS (SELECT community, row_number() OVER (ORDER BY sum(visual_weight) DESC, community) AS turn FROM p WHERE pos <= 8 GROUP BY community)
SELECT id, community, CAST(pos AS INTEGER) AS pos, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (ORDER BY pos, turn) AS k FROM p JOIN h USING (community)) WHERE k <= 60""")
def overview_round_robin(spark, sf_dir):
    nodes, _, comp = component_frame(spark, sf_dir)
    weighted = nodes.join(comp, "id").select("id", F.col("component").alias("community"), F.length("name").cast("double").alias("visual_weight"))
    return G.round_robin(weighted, 60)


@query("""WITH n AS (SELECT 'supplier:' || s_suppkey AS id, 'Herb' AS label, 'nation ' || s_nationkey AS name FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'Alias', 'nation ' || (c_nationkey + c_custkey % 3) FROM customer),
e AS (SELECT 'customer:' || c_custkey AS id, 'supplier:' || (1 + c_custkey % 50) AS by_edge FROM customer WHERE c_custkey % 4 = 0),
s AS (SELECT name, min(id) AS by_name FROM n WHERE label <> 'Alias' GROUP BY name HAVING count(*) = 1)
SELECT n.id, coalesce(by_edge, CASE WHEN label = 'Alias' THEN by_name END, n.id) AS canonical, coalesce(by_edge, CASE WHEN label = 'Alias' THEN by_name END, n.id) <> n.id OR label = 'Alias' AS is_alias FROM n LEFT JOIN e ON e.id = n.id LEFT JOIN s ON s.name = n.name""")
def alias_resolution(spark, sf_dir):
    herbs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.lit("Herb").alias("label"), F.concat(F.lit("nation "), "s_nationkey").alias("name"))
    cust = table(spark, sf_dir, "customer")
    nodes = herbs.unionByName(cust.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.lit("Alias").alias("label"), F.concat(F.lit("nation "), F.col("c_nationkey") + F.col("c_custkey") % 3).alias("name")))
    edges = cust.where("c_custkey % 4 = 0").select(F.concat(F.lit("supplier:"), 1 + F.col("c_custkey") % 50).alias("source"), F.concat(F.lit("customer:"), "c_custkey").alias("target"), F.lit("HAS_ALIAS").alias("relation"), F.col("c_custkey").alias("ord"))
    return G.resolved_aliases(nodes, edges)


PAIR_SQL = r"""names AS (SELECT DISTINCT p_brand, p_name AS n FROM part),
pairs AS (SELECT x.p_brand, x.n AS a, y.n AS b FROM names x JOIN names y ON x.p_brand = y.p_brand AND x.n < y.n),
g AS (SELECT *, [a[i:i+1] FOR i IN range(1, length(a))] AS ga, [b[i:i+1] FOR i IN range(1, length(b))] AS gb FROM pairs),
near AS (SELECT p_brand, a, b FROM g WHERE levenshtein(a, b) <= least(length(a), length(b)) // 2 AND len(list_filter(list_concat(list_filter(ga, lambda x: NOT list_contains(gb, x)), list_filter(gb, lambda x: NOT list_contains(ga, x))), lambda x: regexp_matches(x, '[0-9]'))) = 0)"""


@query(f"WITH {PAIR_SQL} SELECT p_brand, a, b FROM near")
def candidate_pairs(spark, sf_dir):
    return G.name_pairs(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query("""WITH RECURSIVE links AS (SELECT DISTINCT 'u' || user_id AS a, 'v' || (user_id % 17) AS b FROM events), arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r(id, root) AS (SELECT a, a FROM arcs UNION SELECT arcs.b, r.root FROM r JOIN arcs ON arcs.a = r.id), l AS (SELECT id, min(root) AS root FROM r GROUP BY id),
c AS (SELECT root, arg_min(id, (length(id), id)) AS canonical FROM l GROUP BY root) SELECT id AS name, canonical FROM l JOIN c USING (root)""")
def entity_merge(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("a"), F.concat(F.lit("v"), F.col("user_id") % 17).alias("b")).distinct()
    return G.merged_names(pairs, pairs)


@query("""WITH p AS (SELECT c_nationkey AS part, 'segment:' || c_mktsegment AS id, c_mktsegment AS name, 'nation ' || c_nationkey AS d, min(c_acctbal) AS conf FROM customer GROUP BY 1, 2, 3)
SELECT id, 'Category' AS label, arg_min(name, part) AS name, string_agg(d, '<SEP>' ORDER BY part) AS description, string_agg('doc:' || part, ',' ORDER BY part) AS source_ids, string_agg('chunk:' || part || ':1', ',' ORDER BY part) AS chunk_ids, max(conf) AS confidence FROM p GROUP BY id""")
def subgraph_merge(spark, sf_dir):
    part = F.col("c_nationkey")
    parts = table(spark, sf_dir, "customer").groupBy(part.alias("part"), F.col("c_mktsegment").alias("name")).agg(F.min("c_acctbal").alias("confidence"))
    parts = parts.select("part", F.concat(F.lit("segment:"), "name").alias("id"), F.lit("Category").alias("label"), "name", F.concat(F.lit("nation "), "part").alias("description"), "confidence", F.array(F.concat(F.lit("doc:"), "part")).alias("source_ids"), F.array(F.concat(F.lit("chunk:"), "part", F.lit(":1"))).alias("chunk_ids"))
    return G.merged_nodes(parts)


@query("""WITH e AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, l_returnflag AS relation, l_linenumber AS n FROM lineitem)
SELECT low, high, relation, string_agg(CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS evidence FROM e GROUP BY 1, 2, 3""")
def edge_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("part"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), F.array(F.col("l_linenumber").cast("string")).alias("evidence"))
    return G.merged_edges(parts).select(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"), "relation", "evidence")


@query(f"WITH {COMPONENTS_SQL} SELECT id FROM comp WHERE component = (SELECT component FROM comp WHERE id = 'region:2')")
def reachable_nodes(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    return G.reachable(nodes, pairs_of(spark, sf_dir, nodes, edges), spark.createDataFrame([("region:2",)], "id string"))
