import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fernweave import jobs
from fernweave.engine import Engine
from fernweave.models import Models
from fernweave.operators import answers, reports
from fernweave.storage import new_dir


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_engine(spark):
    engine = Engine(spark, new_dir(spark, "engine"), buckets=2)
    assert engine.health() == {"status": "ok", "tables": []}
    docs = spark.createDataFrame([(1, "患者失眠，辨为心脾两虚。治以补益心脾，方用归脾汤。"), (2, "归脾汤由党参等组成，党参补气健脾。"), (3, "short")], "doc_id long, text string")
    assert engine.rebuild_index(docs) == 3
    bare = engine.answer("失眠怎么辨证？")  # without graph and vectors
    assert bare["nodes"] == [] and bare["context"] == "" and bare["evidence"] and bare["trace"]["graph"]["entities"] == []
    assert all(h["vector"] is None for h in bare["trace"]["fulltext"]["hits"])
    built = engine.build_graph()
    assert built["nodes"] == 5 and built["edges"] == 5
    answer = engine.query("睡不着怎么辨证？归脾汤有哪些组成")
    assert answer["hits"][0]["evidence_id"].startswith("evidence:") and "entity:formula:归脾汤" in answer["nodes"]
    assert ("entity:formula:归脾汤", "COMPOSED_OF", "entity:herb:党参") in answer["edges"]
    assert engine.status()["total"] == 3 and not engine.status()["ready"]
    assert engine.sync_vectors(10).select("chunk_id").distinct().count() == 2
    assert engine.audit()["embedded"] == 2
    engine.reset_failed()
    nodes, edges = engine.graph_overview(3)
    assert nodes.count() == 3 and edges.count() <= 9 and len(engine.runs()) == 1
    assert engine.table("reports").where("level = 0").count() == 1
    assert engine.run(built["run_id"])["status"] == "completed"
    got = engine.answer("失眠用什么方？归脾汤的组成")
    hits = got["trace"]["fulltext"]["hits"]
    assert hits and all(h["vector"] is not None for h in hits) and [h["final"] for h in hits] == sorted((h["final"] for h in hits), reverse=True)
    assert {"Formula", "Herb"} & set(got["trace"]["rewrite"]["types"]) and got["trace"]["rewrite"]["source"] == "rules"
    assert "entity:formula:归脾汤" in [n["id"] for n in got["nodes"]] and got["edges"] and got["highlighted"]
    assert any("归脾汤" in p and " -> " in p for p in got["paths"])
    ids = [c["id"] for c in got["evidence"]]
    assert len(ids) == len(set(ids)) and all(c["content"] for c in got["evidence"])
    assert "---- Entities ----\nEntity,Score,Description\n" in got["context"] and "---- Relations ----" in got["context"]
    assert got["trace"]["context"] == {"budget": answers.MOST_TOKENS, "length": len(got["context"]), "sections": ["Entities", "Relations", "Community Report"]}
    assert got["answer"].startswith("# 失眠") and "[graph]" in got["answer"]
    assert engine.answer("失眠用什么方？", budget=0)["context"] == ""
    asked = []  # a real rewriter and a model of one's own
    said = F.struct(F.array(F.lit("Herb")).alias("types"), F.array(F.lit("党参")).alias("entities"), F.lit("llm").alias("source"))
    engine.models = replace(Models(), rewrite=lambda q: said, answer=lambda q, e: asked.append((q, e)) or "said")
    got = engine.answer("有什么？")
    assert got["answer"] == "said" and got["trace"]["rewrite"]["source"] == "llm" and "党参" in got["entities"]
    assert asked[0][0] == "有什么？" and asked[0][1][-1]["evidence_id"] == "graph"


def test_builds_ask_only_for_new_chunks(spark):
    asked = []

    def extract(rows):
        asked.append(sorted(r.chunk_id for r in rows.collect()))
        named = lambda name, label: rows.where(F.contains("content", F.lit(name))).select("chunk_id", F.lit(name).alias("name"), F.lit(label).alias("label"))
        ents = named("甘草", "Herb").unionByName(named("甘草干姜汤", "Formula")).unionByName(named("甘草干姜汤方", "Formula")).unionByName(rows.where("content like '%咽痛%'").select("chunk_id", F.lit("甘草").alias("name"), F.lit("Symptom").alias("label")))
        links = rows.where("content like '%甘草干姜汤%'").select("chunk_id", F.lit("甘草干姜汤").alias("source"), F.lit("甘草").alias("target"), F.lit("COMPOSED_OF").alias("relation"))
        gone = rows.select("chunk_id", F.lit("甘草干姜汤").alias("source"), F.lit("无").alias("target"), F.lit("TREATS").alias("relation"))
        return ents, links.unionByName(gone)

    engine = Engine(spark, new_dir(spark, "engine"), replace(Models(), extract=extract), 2)
    docs = spark.createDataFrame([(1, "甘草干姜汤由甘草组成，主治咽痛，水煎服，日二次。"), (2, "甘草干姜汤方见于古书，用甘草一味，水煎温服之。")], "doc_id long, text string")
    engine.rebuild_index(docs)
    first = engine.build_graph()
    nodes = {r.id: r for r in engine.table("nodes").collect()}
    assert set(nodes) == {"entity:herb:甘草", "entity:symptom:甘草", "entity:formula:甘草干姜汤"}  # the longer name has become the shorter one
    assert nodes["entity:formula:甘草干姜汤"].aliases == ["甘草干姜汤方"] and len(nodes["entity:formula:甘草干姜汤"].chunk_ids) == 2
    edges = engine.table("edges").collect()  # one for each pair of name and label, not for each label of a name
    assert [(r.source, r.target, len(r.evidence)) for r in edges] == [("entity:formula:甘草干姜汤", "entity:herb:甘草", 2)]
    assert first["edges"] == 1 and len(asked) == 1
    engine.rebuild_index(spark.createDataFrame([(3, "甘草干姜汤又一条，内容不同，也用甘草，水煎服之。")], "doc_id long, text string"))
    engine.build_graph()
    assert len(asked) == 2 and len(asked[1]) == 1 and len(engine.table("edges").first().evidence) == 3


def test_runs_in_the_background(spark):
    """A build that would take minutes and fills all task slots is cancelled within seconds."""

    def slow(rows):
        rows.sparkSession.range(16).select(F.expr("java_method('java.lang.Thread', 'sleep', id * 0 + 100000L)")).collect()
        return Models().extract(rows)

    engine = Engine(spark, new_dir(spark, "engine"), replace(Models(), extract=slow), 2)
    engine.rebuild_index(spark.createDataFrame([(1, "患者失眠，辨为心脾两虚。治以补益心脾，方用归脾汤。")], "doc_id long, text string"))
    run = engine.start_build()
    for _ in range(300):
        if spark.sparkContext.statusTracker().getJobIdsForGroup(run):
            break
        time.sleep(0.1)
    time.sleep(8)
    start = time.time()
    assert engine.cancel(run)
    while engine.run(run)["status"] == "running" and time.time() - start < 60:
        time.sleep(0.3)
    assert engine.run(run)["status"] == "cancelled" and time.time() - start < 30
    assert not engine.cancel(run)
    with jobs.Lock(spark, f"{engine.path}/build.lock", "next"):  # the lock is free again
        with pytest.raises(BlockingIOError):
            engine.build_graph()
    assert engine.runs(1)[0]["status"] == "failed"
    with pytest.raises(LookupError):
        Engine(spark, new_dir(spark, "engine")).build_graph()


def test_question_terms(spark):
    assert value(spark, reports.question_term(F.lit(" 归脾汤 有哪些组成？"))) == "归脾汤"
    assert value(spark, reports.question_term(F.lit("是什么"))) == "是什么"


def test_focus_window(spark):
    text = "x" * 50 + "hint" + "y" * 50
    assert value(spark, reports.focus_window(F.lit(text), ["hint"], 5)).startswith("xxxxxhint"[:5])
    assert value(spark, reports.focus_window(F.lit(text), ["none"], 5, 10)) == "x" * 10


def test_evidence_of_units(spark):
    chunks = spark.createDataFrame([(f"c{k}", "u1") for k in range(5)], "chunk_id string, unit_id string")
    refs = spark.createDataFrame([("e", 0, "u1"), ("e", 1, "c1"), ("e", 2, "c4"), ("e", 3, "none")], "owner string, pos int, ref string")
    got = reports.resolved_evidence(refs, chunks).orderBy("place").collect()
    assert [r.chunk_id for r in got] == ["c0", "c1", "c2", "c4"]
