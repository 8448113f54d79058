import pytest

from fernweave.ingestion import Ingestion, summary_text
from fernweave.models import Models
from fernweave.operators import candidates as C

ONE = "心悸失眠，辨为心脾两虚，方用归脾汤。"


@pytest.fixture()
def folder(tmp_path):
    tmp_path = tmp_path / "files"
    tmp_path.mkdir()
    (tmp_path / "a.txt").write_text(f"{ONE}\n\n" + "归脾汤治心脾两虚，见失眠。" * 400)
    (tmp_path / "b.txt").write_text(ONE)
    (tmp_path / "same.txt").write_text(ONE)
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "scan.png").write_bytes(b"\x89PNG")
    (tmp_path / "x.zip").write_bytes(b"PK")
    return str(tmp_path)


def files(spark, root):
    return spark.read.format("binaryFile").load(root).select("path", "content").where("path NOT LIKE '%zip'")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upload_job_publish(spark, tmp_path, folder):
    engine = Ingestion(spark, str(tmp_path / "index"), buckets=1)
    with pytest.raises(LookupError):
        engine.listing("sources")
    new = engine.upload(files(spark, folder))
    assert sorted(r.filename for r in new.collect()) == ["a.txt", "b.txt", "c.csv", "scan.png"]  # equal files are one
    assert {r.status for r in engine.listing("sources").collect()} == {"registered"}
    with pytest.raises(LookupError):
        engine.create_job(spark.createDataFrame([("source:none",)], "source_id string"))
    job = engine.create_job(new)
    said = engine.run_job(job)
    assert said["status"] == "completed" and said["unit_count"] > 3 and said["chunk_count"] >= said["unit_count"] and said["relation_count"] > 0
    assert {(r.filename, r.status) for r in engine.listing("sources").collect()} == {("a.txt", "parsed"), ("b.txt", "parsed"), ("c.csv", "parsed"), ("scan.png", "requires_ocr")}
    before = {n: rows(engine.listing(n)) for n in ("pages", "units", "chunks", "entities", "relations")}
    assert engine.run_job(job) == said  # nothing is left to do

    for name, order in (("chunks", ("source_id", "chunk_index")), ("entities", ("source_id", "name", "entity_id"))):
        got = [tuple(r[c] for c in order) for r in engine.listing(name).collect()]
        assert got == sorted(got)

    def broken(*_):
        raise ConnectionError("away")

    seen = []
    batch = engine.publish(new.select("source_id"), {"graph": broken, "points": lambda n, e, v: seen.append((n.count(), e.count()))})
    assert batch["source_count"] == 2 and batch["stores"] == {"graph": "ConnectionError: away", "points": "stored"}
    assert seen == [(batch["node_count"], batch["edge_count"])]
    assert {(r.filename, r.status) for r in engine.listing("sources").collect() if r.status == "published"} == {("a.txt", "published"), ("b.txt", "published")}
    assert [r.batch_id for r in engine.listing("batches").collect()] == [batch["batch_id"]]
    nodes, edges, evidence = engine.restore()
    assert rows(nodes) == rows(engine.listing("nodes").select(nodes.columns)) and rows(edges) == rows(engine.listing("edges").select(edges.columns))
    assert rows(evidence) == rows(engine.listing("evidence").select(evidence.columns))
    ids = {r.id for r in nodes.collect()}
    assert all(r.source in ids and r.target in ids for r in edges.collect())
    assert {r.owner for r in evidence.collect()} == {r.id for r in edges.collect()}
    assert engine.rechunk(dry_run=True)["sources"] == 4
    engine.rechunk()
    assert {n: rows(engine.listing(n)) for n in before} == before  # a source that comes again is replaced
    assert engine.listing("sources").where("status = 'published'").count() == 2


def test_import_passes_over_published(spark, tmp_path, folder):
    engine = Ingestion(spark, str(tmp_path / "index"), buckets=1)
    said = engine.import_files(folder)
    assert said["skipped"] == {"unsupported": 1} and said["sources"] == 4 and said["published"]["source_count"] == 2
    assert engine.import_files(folder)["sources"] == 2  # what has no relations comes again
    assert {k: v.count() for k, v in engine.bundle(engine.listing("sources").where("filename = 'b.txt'").first().source_id).items()}["pages"] == 1
    assert summary_text({"b": 1, "a": {"y": 2, "x": 3}}) == "a.x=3\na.y=2\nb=1"


def test_source_without_finds_loses_old_ones(spark, tmp_path, folder):
    engine = Ingestion(spark, str(tmp_path / "index"), buckets=1)
    new = engine.upload(files(spark, folder))
    engine.run_job(engine.create_job(new))
    assert engine.listing("entities").count() > 0
    nothing = lambda r: (r.selectExpr("chunk_id", "'' AS name", "'' AS label").where("false"), r.selectExpr("chunk_id", "'' AS source", "'' AS target", "'' AS relation").where("false"))
    engine.models = Models(extract=nothing)
    engine.run_job(engine.create_job(new))
    assert engine.listing("entities").count() == engine.listing("citations").count() == 0


def test_candidates(spark):
    found = spark.createDataFrame([("u1", "x", "Herb", 0.2), ("u1", "x", "Herb", 0.9), ("u1", "y", "Formula", None), ("u2", "x", "Herb", 0.5), ("u2", None, "Herb", 0.5), ("u2", "y", "Formula", 0.1), ("u9", "x", "Herb", 0.1)], "chunk_id string, name string, label string, confidence double")
    links = spark.createDataFrame([("u1", "y", "x", "HAS"), ("u2", "y", "x", "HAS"), ("u1", "y", "z", "HAS"), ("u2", "y", "x", None)], "chunk_id string, source string, target string, relation string")
    units = spark.createDataFrame([("u1", "s1"), ("u2", "s2")], "chunk_id string, source_id string")
    entities, relations, cited = C.candidates(found, links, units)
    assert rows(entities.select("source_id", "name", "confidence")) == [("s1", "x", 0.9), ("s1", "y", 0.8), ("s2", "x", 0.5), ("s2", "y", 0.1)]
    assert rows(relations.select("source_id", "relation_id", "confidence")) == [(s, "relation:entity:formula:y:HAS:entity:herb:x", 0.78) for s in ("s1", "s2")]
    chunks = spark.createDataFrame([(f"chunk:{u}:{k}", s, u, "t") for u, s in (("u1", "s1"), ("u2", "s2")) for k in range(5)], "chunk_id string, source_id string, unit_id string, content string")
    nodes, edges, evidence = C.publication(entities, relations, cited, chunks)
    assert rows(nodes.select("name", "source_id")) == [("x", "s2"), ("y", "s2")] and edges.count() == 1
    assert rows(evidence.select("id")) == [(f"evidence:u2:{k}",) for k in range(3)]  # of the last source, three chunks of the unit
