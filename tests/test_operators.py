"""Operators on small frames."""

import pytest
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import chunking as C
from fernweave.operators import graph as G
from fernweave.operators import relational as R
from fernweave.operators import retrieval as V
from fernweave.operators.batching import greedy_batches
from fernweave.plans import graph as graphs
from fernweave.plans import relational as plans


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_query_tokens(spark):
    got = value(spark, T.query_tokens(F.lit("睡不着怎么辨证 GPT-4")))
    assert got[0] == "失眠" and "不寐" in got and "gpt-4" in got and "怎么" not in got
    assert len(set(got)) == len(got)


@pytest.mark.parametrize(("text", "want"), [("", []), ("a。b；\n\nc", ["a。", "b；", "c"]), (" \n\n ", [])])
def test_sentence_pieces(spark, text, want):
    assert value(spark, T.sentence_pieces(F.lit(text))) == want == C.pieces_of(text)


def test_split_text_covers_and_bounds():
    text = "一" * 50 + "。" + "二" * 30 + "。" + "三" * 200
    parts = C.split_text(text, 60, 90)
    assert "".join(p for p, _, _ in parts) == text
    assert all(text[a:b] == p for p, a, b in parts)
    assert C.split_text("", 5, 9) == [] and C.split_text(" ab ", 5, 9) == [("ab", 0, 2)]


def test_hard_wrap(spark):
    assert value(spark, T.hard_wrap(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]
    assert value(spark, T.hard_wrap(F.lit(""), 3)) == []


def test_similarity_of_itself_is_one(spark):
    q = spark.createDataFrame([(1, "失眠 心脾两虚 归脾汤")], "q long, t string")
    d = spark.createDataFrame([(1, "失眠 心脾两虚 归脾汤"), (2, "柴胡 桂枝 干姜")], "d long, t string")
    rows = V.token_similarity(q, "q", T.whitespace_tokens(F.col("t")), d, "d", T.whitespace_tokens(F.col("t"))).collect()
    assert [(r.d, r.similarity) for r in rows] == [(1, 1.0)]


def test_path_scores(spark):
    rows = [(0.9, ["失眠", "心脾两虚", "归脾汤"], [3.0, 5.0]), (0.9, ["失眠", "心脾两虚"], [4.0])]
    got = {(r.from_name, r.to_name): (round(r.sim, 6), r.weight) for r in G.path_scores(spark.createDataFrame(rows, "sim double, path array<string>, weights array<double>")).collect()}
    assert got == {("失眠", "心脾两虚"): (0.9, 4.0), ("心脾两虚", "归脾汤"): (0.3, 5.0)}


@pytest.fixture
def small_graph(spark):
    nodes = spark.createDataFrame([("a", "Formula", "A"), ("b", "Herb", "B"), ("c", "Source", "C"), ("d", "Formula", "D"), ("e", "Herb", "E")], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "COMPOSED_OF", 0), ("a", "c", "FROM_SOURCE", 1), ("d", "c", "FROM_SOURCE", 2)], "source string, target string, relation string, ord long")
    return nodes, edges


def test_terminal_nodes_are_not_passed(spark, small_graph):
    nodes, edges = small_graph
    seeds = spark.createDataFrame([("a",)], "id string")
    got, own = G.neighborhood(nodes, edges, seeds, 2, ["FROM_SOURCE"], ["Source"])
    assert {r.id for r in got.collect()} == {"a", "c"} and own.count() == 1


def test_components_and_pagerank(small_graph):
    nodes, edges = small_graph
    pairs = G.undirected(G.edge_weights(edges, nodes))
    comp = {r.id: r.component for r in G.component_ids(G.components(nodes, pairs)).collect()}
    assert comp == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 1}
    ranks = {r.id: r.pagerank for r in G.pagerank(nodes, pairs).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["a"] > ranks["e"] > 0


def test_digits_keep_names_apart(spark):
    nodes = spark.createDataFrame([("F", "tang 1"), ("F", "tang 2"), ("F", "tang one"), ("F", "tang ones")], "kind string, name string")
    assert {(r.a, r.b) for r in G.name_pairs(nodes, "kind", "name").collect()} == {("tang one", "tang ones")}


def test_upsert_and_balanced(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(tuple(r) for r in R.upsert(old, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    records = spark.createDataFrame([("chunk", k) for k in range(5)] + [("entity", 0)], "kind string, k long")
    got = R.balanced(records, "kind", ["chunk", "entity", "relation"], ["k"], 4).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"chunk": 3, "entity": 1}


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("s", k, c) for k, c in enumerate([5, 5, 6, 20, 1])], "source string, doc_id long, n_chars long")
    assert [r.batch for r in greedy_batches(rows, "source", "doc_id", "n_chars", 10).orderBy("doc_id").collect()] == [0, 0, 1, 2, 3]


def test_names_without_a_shared_word_meet(spark):
    names = spark.createDataFrame([("k", n) for n in ("cold rod", "old bolt", "当归片", "当归丸", "zzz")], "kind string, name string")
    assert {(r.a, r.b) for r in G.name_pairs(names, "kind", "name").collect()} == {("cold rod", "old bolt"), ("当归丸", "当归片")}


def test_token_ngrams_keeps_long_items(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(300))
    spark.createDataFrame([(1, "one two"), (2, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.item_id: r.tokens for r in plans.token_ngrams(spark, str(tmp_path)).collect()} == {1: 2, 2: 300}


def test_balanced_records_of_all_suppliers(spark, sf_dir):
    types = [r.content_type for r in plans.missing_records_balanced(spark, sf_dir).collect()]
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert len(types) == 64 and types.count("relation") == min(21, suppliers) > 6


def test_graph_queries_have_parts(spark, sf_dir):
    parts = {f"part:{r.l_partkey}" for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey = 1").collect()}
    near = {r.id for r in graphs.bfs_neighborhood(spark, sf_dir).where("depth = 1").collect()}
    assert parts and parts <= near
    nodes, edges = graphs.star(spark, sf_dir)
    ids, arcs = [r.id for r in nodes.collect()], {}
    for r in G.both_ways(G.undirected(G.edge_weights(edges, nodes))).collect():
        arcs.setdefault(r[0], []).append((r[1], r[2]))
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(graphs.ROUNDS):
        lost = sum(rank[i] for i in ids if i not in arcs)
        new = dict.fromkeys(ids, (0.15 + 0.85 * lost) / len(ids))
        for a, out in arcs.items():
            total = sum(w for _, w in out)
            for b, w in out:
                new[b] += 0.85 * rank[a] * w / total
        rank = new
    got = {r.id: r.pagerank for r in graphs.pagerank_k(spark, sf_dir).collect()}
    assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-7 for i in ids)
    assert {r.id for r in graphs.node_analytics(spark, sf_dir).collect()} == set(ids)


def test_paths_over_hubs(spark):
    """A hub with more arcs than are kept, parallel edges and a loop, against all paths."""
    relations = ["TREATS", "COMPOSED_OF", "HAS_DOSE", "INCLUDES"]
    nodes = [(f"n{k}", "Herb", f"name {k % 13}") for k in range(40)]
    edges = [("n0", f"n{k}", relations[k % 4], k) for k in range(1, 30)] + [("n0", f"n{k}", relations[(k + 1) % 4], 100 + k) for k in range(1, 30, 3)] + [("n5", "n6", "TREATS", 200), ("n6", "n6", "TREATS", 201), ("n30", "n31", "HAS_DOSE", 202)]
    got = G.n_hop_paths(spark.createDataFrame(edges, "source string, target string, relation string, ord long"), spark.createDataFrame(nodes, "id string, label string, name string"), most=5).collect()
    weight, name, arcs = {"TREATS": 1.0, "COMPOSED_OF": 1.25, "HAS_DOSE": 0.08, "INCLUDES": 0.05}, {i: n for i, _, n in nodes}, {}
    for a, b, r, _ in edges:
        if a != b:
            arcs.setdefault(a, []).append((b, weight[r]))
            arcs.setdefault(b, []).append((a, weight[r]))
    for i, _, _ in nodes:
        paths = [([name[i], name[b]], [w]) for b, w in arcs.get(i, [])]
        paths += [([name[i], name[b], name[c]], [w, x]) for b, w in arcs.get(i, []) for c, x in arcs[b] if c != i]
        want = sorted((-round(sum(w), 6), len(p), "|".join(p)) for p, w in paths)[:5]
        assert sorted((-r.total, len(r.path), "|".join(r.path)) for r in got if r.id == i) == want


def test_cosine_ties_and_blocks(spark, monkeypatch):
    rows = [(9, [1.0, 0.48434]), (8, [1.0, 0.48432]), (1, [1.0, 0.4843]), (50, [1.0, 0.0]), (100, [0.0, 0.0]), (7, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    for block in (1024, 1):
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        got = V.cosine_top_k(frame.where("vec_id % 50 = 0"), frame, "vec_id", "v", 2).collect()
        by = {q: sorted((r.vec_id, r.score) for r in got if r.qid == q) for q in (50, 100)}
        assert by[50] == [(1, 0.9), (8, 0.9)] and by[100] == [(1, 0.0), (7, 0.0)]
    assert V.cosine_top_k(frame.limit(0), frame, "vec_id", "v", 2).count() == 0


def test_few_second_steps_are_joined(spark, monkeypatch):
    """A node with many neighbours joins the second steps of those only that its best paths can go over."""
    nodes = [(f"{k}", "Herb", f"name {k:03}") for k in range(60)]
    edges = [(f"{a}", f"{b}", "TREATS", a * 100 + b) for a in range(60) for b in range(a)]
    rows, kept = {}, G.materialize
    monkeypatch.setattr(G, "materialize", lambda d, label: rows.setdefault(label, kept(d, label)))
    got = G.n_hop_paths(spark.createDataFrame(edges, "source string, target string, relation string, ord long"), spark.createDataFrame(nodes, "id string, label string, name string"), most=5)
    assert got.count() == 300 and rows["groups"].count() <= 3 * 60
    assert sorted(r.path for r in got.where("id = '7'").collect()) == [["name 007", "name 000", f"name {k:03}"] for k in range(1, 6)]


def test_paths_of_names_with_bars(spark):
    """Names that are the beginning of others up to a bar interleave."""
    names = {"a": "a", "x": "X", "y": "X|c", "p": "b", "q": "d", "r": "a1", "s": "z"}
    nodes = spark.createDataFrame([(k, "Herb", v) for k, v in names.items()], "id string, label string, name string")
    edges = [("a", "x", "TREATS", 0), ("a", "y", "TREATS", 1), ("x", "p", "TREATS", 2), ("x", "q", "TREATS", 3), ("y", "r", "TREATS", 4), ("y", "s", "TREATS", 5)]
    got = G.n_hop_paths(spark.createDataFrame(edges, "source string, target string, relation string, ord long"), nodes, most=3).where("id = 'a'").orderBy("place").collect()
    assert ["|".join(r.path) for r in got] == ["a|X|b", "a|X|c|a1", "a|X|c|z"]


def test_components_of_hubs(spark, monkeypatch):
    """Hubs that are least, greatest and between their neighbours, joined without bringing their edges together."""
    monkeypatch.setattr(G, "HOT", 3)
    links = [("a", f"b{k}") for k in range(9)] + [("z", f"c{k}") for k in range(9)] + [("m", x) for x in ("d0", "d1", "d2", "d3", "n0", "n1", "n2", "n3")] + [("c0", "e"), ("f", "g")]
    ids = sorted({x for p in links for x in p} | {"alone"})
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    labels = G.components(nodes, spark.createDataFrame(links, "a string, b string"))
    assert {r.id: r.root for r in labels.collect()} == root
    sizes = {r.id: r["size"] for r in G.component_ids(labels).collect()}
    assert sizes == {i: sum(root[j] == root[i] for j in ids) for i in ids}
