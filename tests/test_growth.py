"""Steps that must not shuffle or broadcast more than they need, on small tables."""

from fernweave.operators import graph as G
from fernweave.storage import Buckets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_arcs_in_buckets_are_not_shuffled(spark):
    stored = Buckets(spark.range(1000).selectExpr("id % 10 AS a", "id AS b"), "a", "arcs")
    ranks = spark.range(10).selectExpr("id AS a", "0.1D AS rank").hint("shuffle_hash")
    joined = stored.rows.join(ranks, "a")
    assert plan(joined).count("Exchange hashpartitioning") <= 1  # that of the ranks
    assert joined.count() == 1000
    stored.drop()


def test_weighted_pairs(spark):
    nodes = spark.createDataFrame([("a", "Herb"), ("b", "Formula"), ("c", "odd")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "COMPOSED_OF", 1), ("b", "a", "INCLUDES", 2), ("a", "a", "INCLUDES", 1), ("c", "b", "odd", 5), ("c", "zz", "odd", 6)], "source string, target string, relation string, ord long")
    want = sorted(tuple(r) for r in G.undirected(G.edge_weights(edges, nodes)).collect())
    assert len(want) == 3 and sorted(tuple(r) for r in G.weighted_pairs(edges, nodes).collect()) == want


def test_neighborhood_joins_only_what_is_near(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "R", 3), ("b", "c", "R", 1), ("c", "d", "R", 2), ("a", "zz", "R", 0)], "source string, target string, relation string, ord long")
    seeds = spark.createDataFrame([("a",), ("gone",)], "id string")
    reached, own = G.neighborhood(nodes, edges, seeds, 2)
    assert sorted(tuple(r) for r in reached.collect()) == [("a", "x", 0), ("b", "x", 1), ("c", "x", 2)]
    assert [(r.source, r.target) for r in own.collect()] == [("b", "c"), ("a", "b")]
    assert "_label" not in plan(own)  # no join of all edges with all nodes


def test_similarity_in_blocks_is_that_of_the_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    from fernweave.functions import text as T
    from fernweave.operators import retrieval as R

    q = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c")], "q long, t string")
    d = spark.createDataFrame([(1, "b a"), (2, "a b a c"), (3, None), (4, "zz")], "d long, t string")
    got = lambda: sorted(tuple(r) for r in R.token_similarity(q, "q", T.whitespace_tokens(F.col("t")), d, "d", T.whitespace_tokens(F.col("t"))).collect())
    blocks = got()
    monkeypatch.setattr(R, "FEW_KEYS", 0)
    assert len(blocks) == 3 and blocks == got()


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    from pyspark.sql import functions as F

    from fernweave.storage import materialize

    rows = materialize(spark.range(1_000_000).select("id", F.concat(F.lit("node:"), "id").alias("name")), "many")
    assert "BroadcastHashJoin" not in plan(rows.join(rows.withColumnRenamed("name", "other"), "id"))


def published(spark):
    """A small candidate graph with odd rows, and what is to be published of it: edges and evidence."""
    from fernweave.operators import publish

    entities = [("s1", "a", "Herb", "A", 1), ("s2", "a", "Herb", "A2", 2), ("s1", "b", "Herb", "B", 1), ("s1", None, "Herb", "N", 1)]
    chunks = [("chunk:1", "s1", "u1", "t1"), ("chunk:2", "s1", "u1", "t2"), ("chunk:3", "s1", "u1", "t3"), ("chunk:4", "s1", "u1", "t4"), ("chunk:5", "s1", "", "t5"), ("u2", "s1", None, "t6"), ("chunk:0", "s1", "u2", "t0")]
    relations = [
        ("s1", "r1", "a", "b", "R", "", ["chunk:4", "u1", "chunk:4", "gone", None, ""], 1),
        ("s1", "r2", "a", "b", "R", "old", ["u1"], 1),
        ("s2", "r2", "b", "a", "Q", "new", ["chunk:5"], 2),
        ("s1", "r3", "a", "zz", "R", "", ["chunk:1"], 1),
        ("s1", "r4", "zz", "a", "R", "", ["chunk:1"], 1),
        ("s1", "r5", None, "a", "R", "", ["chunk:1"], 1),
        ("s1", "r6", "b", "b", "R", "", ["u2", "chunk:0"], 1),
        ("s1", "r7", "b", "a", "R", "", None, 1),
        ("s1", "r8", "b", "a", "R", "", ["gone"], 1),
        ("s1", "r9", "zz", "a", "R", "", ["chunk:1"], 1),
        ("s1", "r9", "a", "a", "R", "", [], 2),
    ]
    e = spark.createDataFrame(entities, "source_id string, entity_id string, label string, name string, ord long")
    r = spark.createDataFrame(relations, "source_id string, relation_id string, source_entity_id string, target_entity_id string, relation string, display string, chunk_ids array<string>, ord long")
    c = spark.createDataFrame(chunks, "chunk_id string, source_id string, unit_id string, content string")
    return publish.published_graph(e, r, c)


def test_published_edges_of_odd_candidates(spark):
    nodes, edges, evidence = published(spark)
    got = {r.id: (r.source, r.target, r.relation, r.display, r.evidence_ids) for r in edges.collect()}
    assert got == {
        "r1": ("a", "b", "R", "R", ["evidence:4", "evidence:1", "evidence:2", "evidence:3"]),  # "" is no unit
        "r2": ("b", "a", "Q", "new", ["evidence:5"]),
        "r6": ("b", "b", "R", "R", ["u2", "evidence:0"]),  # a chunk and a unit
        "r7": ("b", "a", "R", "R", []),
        "r8": ("b", "a", "R", "R", []),
        "r9": ("a", "a", "R", "R", []),
    }
    assert sorted(r.snippet for r in evidence.collect()) == ["t0", "t1", "t2", "t3", "t4", "t5", "t6"]
    assert {(r.id, r.name) for r in nodes.collect()} == {("a", "A2"), ("b", "B"), (None, "N")}


def test_published_edges_when_nothing_is_broadcast(spark):
    want = sorted(map(str, published(spark)[1].collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, published(spark)[1].collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_published_relations_are_dealt_once(spark, sf_dir):
    from fernweave.plans import index

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "100k")  # the table counts as large
    try:
        steps = plan(index.published_edges(spark, sf_dir))
    finally:
        spark.conf.unset(threshold)
    # by their id, sorted once and not before that; the other exchange is that of the refs to be replaced
    assert steps.count("Exchange hashpartitioning(id") == 1 and steps.count("Exchange hashpartitioning") <= 2 and steps.count("Sort [") <= 1
    assert "FileScan parquet [l_orderkey" in steps and steps.count("FileScan parquet [l_") == 1


def kept_plans(monkeypatch):
    """Plans of what is written, by label."""
    plans, kept = {}, G.materialize
    monkeypatch.setattr(G, "materialize", lambda d, label: plans.setdefault(label, (plan(d), dict(d.dtypes))) and kept(d, label))
    return plans


def test_paths_of_a_node_are_weighed_where_its_arcs_are(spark, sf_dir, monkeypatch):
    from fernweave.plans import graph

    threshold, plans = "spark.sql.autoBroadcastJoinThreshold", kept_plans(monkeypatch)
    spark.conf.set(threshold, "-1")
    try:
        graph.nhop_paths_top40(spark, sf_dir)
    finally:
        spark.conf.unset(threshold)
    groups, types = plans["groups"]
    assert "Window" in groups and groups.count("Exchange hashpartitioning") <= 1  # of the nodes' names: a row for each node
    assert plans["ends"][1] == {"source": "bigint", "target": "bigint", "w": "double"} and types["id"] == "bigint"


def test_paths_with_ends_that_are_no_nodes(spark):
    """Edges both ways between two nodes, ends that aren't nodes and a name that is null, against all paths, also from some nodes only."""
    names = {k: None if k == 7 else f"name {k % 5}" for k in range(12)}
    edges = [(a, b, r, 100 * a + b) for a in range(14) for b in range(14) for r in ("TREATS", "HAS_DOSE") if (a * 7 + b * 5 + len(r)) % 4 == 0]
    weight, arcs = {"TREATS": 1.0, "HAS_DOSE": 0.08}, {}
    for a, b, r, _ in edges:
        if a != b and a in names and b in names:
            arcs.setdefault(a, []).append((b, weight[r]))
            arcs.setdefault(b, []).append((a, weight[r]))
    nodes, frame = spark.createDataFrame(list(names.items()), "id long, name string"), spark.createDataFrame(edges, "source long, target long, relation string, ord long")
    for starts in (None, [3, 7, 99]):
        few = None if starts is None else spark.createDataFrame([(k,) for k in starts], "id long")
        got = G.n_hop_paths(frame, nodes, most=10_000, starts=few).collect()
        assert {r.id for r in got} == ({3, 7} if starts else set(arcs))
        for i in {r.id for r in got}:
            want = [([names[i], names[b]], [w]) for b, w in arcs[i]] + [([names[i], names[b], names[c]], [w, x]) for b, w in arcs[i] for c, x in arcs[b] if c != i]
            assert sorted((r.path, r.weights) for r in got if r.id == i) == sorted(([n for n in p if n is not None], w) for p, w in want)


def test_scored_edges_are_numbers(spark, sf_dir, monkeypatch):
    from fernweave.plans import graph

    plans = kept_plans(monkeypatch)
    graph.nhop_edge_scores(spark, sf_dir)
    assert {c: t for c, t in plans["second"][1].items() if c in ("b", "c")} == {"b": "bigint", "c": "bigint"}
