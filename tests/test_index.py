"""Query understanding, index rows, retrieval over the graph, resolution, publishing, vector sync and anchors on small frames."""

import pytest
from pyspark.sql import functions as F

from fernweave import models
from fernweave.functions import query as Q
from fernweave.functions import text as T
from fernweave.operators import anchors as A
from fernweave.operators import index_rows as I
from fernweave.operators import kg, publish, resolution
from fernweave.operators import vector_sync as V
from fernweave.operators.graph import n_hop_paths
from fernweave.sources.tables import Table
from fernweave.storage import new_dir


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_query_words(spark):
    assert value(spark, Q.normal_form(F.lit("Ａ，b (C)\n"))) == "a b c" and value(spark, Q.normal_form(F.lit(None).cast("string"))) is None
    words = F.array(*map(F.lit, ["方剂", "归脾汤", "失眠", "归脾汤"]))
    assert value(spark, Q.entity_keywords(words)) == ["归脾汤", "失眠"]
    plain = F.array(*map(F.lit, ["头", "头晕", "头晕目", "的药", "如何", "一二三四五六七"]))
    assert value(spark, Q.candidate_keywords(plain)) == ["头晕目"]
    assert value(spark, Q.answer_types(F.lit("辨什么证，用什么药"))) == ["Syndrome", "Herb"]
    assert value(spark, Q.literal_formulas(F.lit("四君子汤的组成是什么，六味丸"))) == ["四君子汤", "六味丸"]


def test_rewrites(spark):
    types, names = F.array(F.lit("Herb")), F.array(F.lit("x"))
    got = value(spark, Q.rewrite(F.lit('```json\n{"answer_type_keywords": ["a", "b", "c", "d"], "entities": ["e", " e ", ""]}\n```'), types, names))
    assert (got.types, got.entities, got.source) == (["a", "b", "c"], ["e"], "llm")
    for raw in ("", "{}", "no json", '{"entities": []}'):
        assert value(spark, Q.rewrite(F.lit(raw), types, names)).asDict() == {"types": ["Herb"], "entities": ["x"], "source": "rules"}


def test_small_texts(spark):
    assert value(spark, Q.description_text(F.lit('{"description": "d"}'))) == "d" and value(spark, Q.description_text(F.lit("plain"))) == "plain"
    assert value(spark, Q.csv_row(F.lit('a"b'), F.lit("c"), F.lit("d,e"))) == '"a""b",c,"d,e"'
    assert value(spark, Q.level_tags(F.create_map(F.lit("10"), F.lit(2), F.lit("1"), F.lit(5)))) == ["1:5", "10:2"]
    assert [tuple(x) for x in value(spark, Q.tag_levels(F.array(F.lit("1:5"), F.lit("x:1"), F.lit("2"))))] == [(1, 5)]
    assert value(spark, Q.node_id(F.lit(""), F.lit("四君子汤"))) == "formula:四君子汤" and value(spark, Q.node_id(F.lit("Herb"), F.lit("甘草"))) == "herb:甘草"
    assert value(spark, Q.report_text(F.lit(1), F.lit("t"), F.lit('{"report": "r"}'))) == "# 1. t\nr"
    assert value(spark, Q.shared_words(F.lit("失眠不寐"), F.lit("失眠"))) == 1.0
    assert value(spark, Q.embedding_text(F.lit("n"), F.lit("l"), F.lit(""), {"n": "s"})) == "n l s"
    assert value(spark, Q.question_terms(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a")), F.array(F.lit("")))) == ["a", "b"]


@pytest.fixture(scope="module")
def candidates(spark):
    entities = spark.createDataFrame([("s1", "e1", "失眠", "失眠", "Symptom", 0.9, ["c1", "c2"], 0), ("s1", "e2", "安神丸", "安神丸", "Formula", 0.0, ["c2"], 1), ("s2", "e1", "失眠", "不眠", "Symptom", 0.5, ["c9", "c1"], 2)], "source_id string, entity_id string, name string, normalized_name string, label string, confidence double, chunk_ids array<string>, ord long")
    relations = spark.createDataFrame([("s1", "r1", "e2", "e1", "TREATS", "主治", 0.8, ["u1", "c9"], 0), ("s2", "r2", "e1", "e7", "TREATS", "", 2.5, ["c9"], 1)], "source_id string, relation_id string, source_entity_id string, target_entity_id string, relation string, display string, confidence double, chunk_ids array<string>, ord long")
    return entities, relations


def test_candidate_rows(candidates):
    entities, relations = candidates
    rows = {r.entity_id: r for r in I.entity_rows(entities).collect()}
    assert rows["s1:e2"]["rank"] == 0.01 and rows["s2:e1"].aliases == ["不眠", "失眠"] and rows["s1:e1"].content_with_weight == '{"description":"失眠 Symptom","source":"s1"}'
    rels = {r.relation_id: r for r in I.relation_rows(relations, entities).collect()}
    assert rels["s1:r1"].content_with_weight == "安神丸 主治 失眠" and rels["s1:r1"].weight == 1
    assert (rels["s2:r2"].to_name, rels["s2:r2"].display, rels["s2:r2"].weight) == ("e7", "TREATS", 2)
    by_name, by_ends = I.candidate_evidence(entities, relations)
    assert {(r.name, r.label): r.chunk_ids for r in by_name.collect()}[("失眠", "")] == ["c1", "c2", "c9"]
    assert [(r.from_name, r.to_name, r.chunk_ids) for r in by_ends.collect()] == [("安神丸", "失眠", ["u1", "c9"])]


def test_chunk_and_document_rows(spark):
    chunks = spark.createDataFrame([("c1", "s", "p1", "", 1, "", ["书", "篇"], "患者失眠多梦。", 0), ("c2", "s", "p2", "u1", 2, "题", None, "x" * 20, 20)], "chunk_id string, source_id string, page_id string, unit_id string, chunk_index int, section_title string, section_path array<string>, content string, token_count int")
    pages = spark.createDataFrame([("p1", 7)], "page_id string, page_number int")
    rows = {r.chunk_id: r for r in I.chunk_rows(chunks, pages).collect()}
    assert (rows["c1"].page_number, rows["c1"].title, rows["c1"].parent_unit_id, rows["c1"].available) == (7, "篇", "c1", 0)
    assert "失眠" in rows["c1"].important and rows["c1"].token_count == 7 and (rows["c2"].page_number, rows["c2"].available) == (1, 1)
    sources = spark.createDataFrame([("s", "f", "h", "parsed", "k"), ("t", "g", "i", "parsed", "")], "source_id string, filename string, checksum string, status string, object_key string")
    counts = spark.createDataFrame([("s", 2, 1)], "source_id string, chunks long, eligible long")
    assert {(r.doc_id, r.chunk_count, r.eligible_chunk_count) for r in I.document_rows(sources, counts).collect()} == {("s", 2, 1), ("t", 0, 0)}
    assert [r.source_id for r in publish.rebuildable(sources).collect()] == ["s"]


def test_graph_rows(spark, candidates):
    by_name, by_ends = I.candidate_evidence(*candidates)
    nodes = spark.createDataFrame([("n1", "Symptom", "失眠", "", None, 2.0, "c5, c1"), ("n2", "Formula", "安神丸", "d", 0.5, None, "")], "id string, label string, name string, description string, pagerank double, rank double, source_chunks string")
    edges = spark.createDataFrame([("x", "n1", "n2", "TREATS", "治", ["evidence:s:1", "other"], 0)], "id string, source string, target string, relation string, display string, evidence_ids array<string>, ord long")
    ents = {r.entity_id: r for r in I.graph_entity_rows(nodes, n_hop_paths(edges, nodes), by_name).collect()}
    assert ents["n1"].evidence == ["c5", "c1", "c2", "c9"] and ents["n1"]["rank"] == 2.0 and ents["n2"]["rank"] == 0.5
    assert ents["n1"].n_hop[0].path == ["失眠", "安神丸"] and ents["n1"].description == "失眠 Symptom"
    rel = I.graph_relation_rows(edges, nodes, by_ends).first()
    assert rel.evidence == ["chunk:s:1", "u1", "c9"] and rel.weight == 10  # candidates go the other way
    own, links = I.subgraph_groups(spark.createDataFrame([("a", ["chunk:s:1", "evidence:t:2"]), ("b", None)], "id string, refs array<string>"), spark.createDataFrame([("a", "b", "R", None)], "source string, target string, relation string, refs array<string>"))
    assert {(r.source_id, r.id) for r in own.collect()} == {("s", "a"), ("t", "a")} and links.count() == 2
    made = I.artifacts(own, links)
    assert I.artifact_of(made, "t").first().node_json == '["a"]' and made.count() == 2


def test_retrieval_over_the_graph(spark):
    hop = [(["失眠", "安神丸", "甘草"], [1.0, 1.25])]
    entities = spark.createDataFrame([("n1", "失眠", "Symptom", "失眠", 0.5, hop), ("n2", "安神丸", "Formula", "安神丸", 0.3, []), ("n3", "头痛", "Symptom", "头痛", 0.9, [])], "entity_id string, entity_name string, entity_type string, description string, rank double, n_hop array<struct<path: array<string>, weights: array<double>>>")
    relations = spark.createDataFrame([("r1", "失眠", "安神丸", "TREATS", "治", "失眠 治 安神丸", 10, ["c1"]), ("r2", "头痛", "川芎", "TREATS", "治", "头痛 治 川芎", 10, [])], "relation_id string, from_name string, to_name string, relation_type string, display string, content_with_weight string, weight int, evidence array<string>")
    reports = spark.createDataFrame([("a", ["失眠", "x"], 1.0), ("b", ["y"], 9.0)], "title string, names array<string>, weight double")
    found = kg.retrieve(entities, relations, reports, ["失眠"], ["失眠"], ["Symptom"])
    ents = found.entities.collect()
    assert [r.entity_name for r in ents] == ["失眠"] and ents[0].score == pytest.approx(0.3 * 2 * 0.5, abs=1e-6)
    rels = {(r.from_name, r.to_name): r for r in found.relations.collect()}
    assert set(rels) == {("失眠", "安神丸"), ("安神丸", "甘草")}
    sim = 0.3 * (1e-9 + 0.4) / (1e-9 + 0.4)
    own = {r.sim for r in found.relations.where("relation_id = 'r1'").collect()}
    assert len(own) == 1 and own.pop() > sim * (1 + 0.15 + 1) * 0.5
    assert rels[("安神丸", "甘草")].sim == pytest.approx(0.3 / 3, abs=1e-6)
    nodes = {r.name: r for r in found.nodes.collect()}
    assert nodes["失眠"].score is None and nodes["甘草"].label == "ExternalSource" and nodes["安神丸"].id == "n2"
    assert [r.title for r in found.reports.collect()] == ["a"]
    edges = found.edges.collect()
    assert [e.id for e in edges] == ["r1", "edge:安神丸:甘草"] and edges[1].relation == "RELATED_TO"


def test_resolution(spark):
    nodes = spark.createDataFrame([("1", "F", "桂枝加芍药汤"), ("2", "F", "桂枝加芍药"), ("3", "F", "其他"), ("4", "G", "桂枝加芍药")], "id string, label string, name string")
    edges = spark.createDataFrame([("1", "3", "R", 0), ("2", "3", "R", 1), ("1", "2", "R", 2)], "source string, target string, relation string, ord long")
    table = Table(spark, new_dir(spark, "decided"), ["key"])
    for _ in range(2):
        kept, moved = resolution.resolve(nodes, edges, table=table)
        assert {r.id for r in kept.collect()} == {"2", "3", "4"} and [(r.source, r.target) for r in moved.collect()] == [("2", "3")]
    liar = lambda pairs: pairs.select("label", "a", F.lit("其他").alias("b"))
    assert resolution.resolve(nodes, edges, decider=liar)[0].count() == 4  # pairs that weren't asked for don't count


def test_publishing(spark, candidates):
    entities, relations = candidates
    chunks = spark.createDataFrame([("c9", "s2", "", 1, "t9"), ("c4", "s1", "u1", 1, "t4"), ("c5", "s1", "u1", 2, "t5")], "chunk_id string, source_id string, unit_id string, chunk_index int, content string")
    nodes, edges, evidence = publish.published_graph(entities, relations, chunks)
    assert {(r.id, r.source_id) for r in nodes.collect()} == {("e1", "s2"), ("e2", "s1")}
    assert [(r.id, r.evidence_ids) for r in edges.collect()] == [("r1", ["c4", "c5", "c9"])]
    assert {r.snippet for r in evidence.collect()} == {"t4", "t5", "t9"}
    assert {r.content_type: r.n for r in publish.counts_by_type(publish.vector_payloads(nodes, evidence)).collect()} == {"entity": 2, "evidence": 3}
    said = publish.merge_statements(nodes, edges).orderBy("list", "id").collect()
    assert said[0].statement == "MERGE (n:Symptom {id: $id}) SET n += $properties" and len(said) == 3
    with pytest.raises(Exception, match="not an identifier"):
        publish.merge_statements(nodes.withColumn("label", F.lit("a b")), edges).collect()
    units = publish.units_of_chunks(chunks).collect()
    assert [(u.unit_id, u.chunk_id) for u in units] == [("unit:s2:0001", "c9")]
    assert {r.kind: r.total for r in publish.job_totals(chunks=chunks, entities=entities).collect()} == {"chunks": 3, "entities": 3}
    log = spark.createDataFrame([(0, '{"id": "a", "status": "completed"}'), (1, "not json"), (2, '{"id": "b", "status": "failed"}'), (3, '{"id": "a", "status": "failed"}'), (4, '{"id": "c", "status": "completed"}')], "ord long, value string")
    assert {r.id for r in publish.to_do(spark.createDataFrame([(x,) for x in "abcd"], "id string"), log, "id").collect()} == {"a", "b", "d"}
    assert value(spark, publish.publishable(F.lit(0))) is False and value(spark, publish.publishable(F.lit(0), True)) is True
    assert value(spark, publish.section_path(F.lit("t"), F.lit("d"), F.lit("t"))) == ["t", "d"]


def test_vector_sync(spark):
    rows = spark.createDataFrame([(f"{k}{n}", k, n, "missing" if n else "embedded", "") for k in ("chunk", "entity") for n in range(4)], "id string, kind string, n long, vector_status string, vector_point_id string")
    taken, marked = V.claim(rows, ["id"], "kind", ["entity", "chunk"], ["n"], 4)
    assert [r.id for r in taken.orderBy(F.desc("kind"), "n").collect()] == ["entity1", "entity2", "entity3", "chunk1"] and marked.where("vector_status = 'queued'").count() == 4
    assert V.claim(rows, ["id"], "kind", ["entity", "chunk"], ["n"], 4, True)[0].groupBy("kind").count().where("count = 2").count() == 2
    table, store = Table(spark, new_dir(spark, "records"), ["id"]), Table(spark, new_dir(spark, "points"), ["id"])
    table.replace(rows)
    counters = V.sync(table, store, lambda r: r.where("id <> 'chunk2'").select("id", F.array(F.lit(0.5)).alias("vector")), "id", "kind", ["chunk", "entity"], ["n"], 10, 4)
    assert counters == {"embedded": 5, "failed": 1, "embedded_chunk": 2, "failed_chunk": 1, "embedded_entity": 3} and store.read().count() == 5
    assert table.read().where("vector_status = 'failed'").first().id == "chunk2"
    table.replace(rows)
    assert V.sync(table, store, lambda r: r.select("id", F.array(F.lit(0.5)).alias("vector")), "id", "kind", ["chunk", "entity"], ["n"], 3, 2)["embedded"] == 3
    assert table.read().where("vector_status = 'embedded'").count() == 5  # the limit holds across batches
    waits, tries = [], []

    def broken(r):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError("no answer")
        if len(tries) > 3:
            raise KeyError("gone")
        return r.select("id", F.array(F.lit(0.5)).alias("vector"))

    table.replace(rows)
    counters = V.sync(table, store, broken, "id", "kind", ["chunk"], ["n"], 3, 2, retries=3, pause=2.0, sleep=waits.append)
    assert waits == [2.0, 4.0, 2.0, 4.0]
    assert counters == {"retry_attempts": 4, "retry_error_TimeoutError": 2, "retry_error_KeyError": 2, "retry_stage_embedding": 4, "embedded": 2, "embedded_chunk": 2,
                        "failure_error_KeyError": 1, "failure_stage_embedding": 1, "last_failure_error": "KeyError: 'gone'", "failed": 1, "failed_chunk": 1}
    gate = lambda e, t, **o: value(spark, V.open_gate(F.lit(e), F.lit(t), **o))
    assert not gate(900, 900) and not gate(1000, 2000) and gate(1600, 2000) and gate(0, 0, least=0, coverage=0.0)
    assert value(spark, V.point_check(F.lit(0), F.lit(None).cast("int"))) and not value(spark, V.point_check(F.lit(3), F.lit(None).cast("int")))


def test_anchors(spark):
    nodes = spark.createDataFrame([("1", "Formula", "归脾汤", 0), ("2", "Formula", "安神丸", 1), ("3", "Symptom", "失眠", 2)], "id string, label string, name string, ord long")
    ranked = spark.createDataFrame([("3", "Symptom", 1), ("1", "Formula", 2)], "id string, label string, place long")
    got = A.anchors(nodes, ranked, ["安神", "归脾"], "formula", 3).collect()
    assert [(r.place, r.id) for r in got] == [(0, "2"), (2, "3")]
    assert [r.id for r in A.seeds(A.anchors(nodes, ranked, ["安神"], "formula", 3), ranked, nodes.where("id <> '3'")).orderBy("place").collect()] == ["2", "1"]
    edges = spark.createDataFrame([("1", "3", "TREATS", 0)], "source string, target string, relation string, ord long")
    assert [r.path for r in A.path_strings(nodes, edges).collect()] == ["归脾汤 -TREATS-> 失眠"]
    assert [r.id for r in A.highlighted(nodes, edges).orderBy("place").collect()] == ["1", "3"]
    assert [r.id for r in A.highlighted(nodes, edges.limit(0)).orderBy("place").collect()] == ["1", "2", "3"]
    assert [r.id for r in A.reranked(nodes, spark.createDataFrame([("3", 1.0)], "id string, score double")).collect()] == ["3", "1", "2"]
    hits = spark.createDataFrame([("chunk:a", "x", 1), ("chunk:b", "y", 2)], "chunk_id string, content string, place long")
    assert [r.id for r in A.chunk_cards(hits, spark.createDataFrame([("evidence:a",)], "id string")).collect()] == ["evidence:b"]


def test_models(spark):
    rows = spark.createDataFrame([("c1", "失眠，心脾两虚，用归脾汤。")], "chunk_id string, content string")
    for mode in ("light", "general", "ner"):
        entities, relations = models.extraction(rows, mode, models.Models())
        assert {r.name for r in entities.collect()} == {"失眠", "心脾两虚", "归脾汤"}
    assert value(spark, models.rule_rewrite(F.lit("失眠用什么药"))).asDict() == {"types": ["Herb"], "entities": ["失眠"], "source": "rules"}
    assert models.outlined(spark.createDataFrame([(["a", "b"], ["a r b"])], "names array<string>, relation_texts array<string>")).first().title == "a、b"
    with pytest.raises(ValueError):
        models.extraction(rows, "other", models.Models())
    assert T is not None


def test_retrieval_reads_all_edges(spark, tmp_path):
    """A supplier that is asked for is found with the parts of its line items."""
    from fernweave.plans import index

    tables = {
        "region": ([(0, "AFRICA")], "r_regionkey int, r_name string"),
        "nation": ([(3, "KENYA", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(1, "Asia herbs", 3), (2, "other", 3)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(7, "bolt"), (8, "rod")], "p_partkey long, p_name string"),
        "customer": ([(5, "someone", 3)], "c_custkey long, c_name string, c_nationkey int"),
        "lineitem": ([(7, 1), (7, 1), (8, 2), (8, 1)], "l_partkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.id, r.source, r.target, r.relation, r.evidence) for r in index.kg_retrieve(spark, str(tmp_path)).collect()}
    for part in (7, 8):
        assert (f"part:{part}>supplier:1", f"part:{part}", "supplier:1", "COMPOSED_OF", f"chunk:part:{part}") in got
