import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from fernweave.sources import files, structured, tables
from fernweave.storage import new_dir
from fernweave.streaming import ingest


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, raw in {"a.txt": "一\r\n二".encode("gb18030"), "b.csv": b'x,"y\nz"\n1,2\n', "c.json": b'{"a":1}', "d.docx": docx(["p", "q"]), "e.png": b"\x89", ".f.txt": b"x", "g.exe": b"x", "h.json": b"{"}.items():
        (tmp_path / "in" / name).write_bytes(raw)
    found = files.list_files(spark, str(tmp_path / "in"))
    rows = {r.path.rpartition("/")[2]: r for r in files.parse_files(files.importable(found)).collect()}
    assert rows["a.txt"].text == "一\n二" and rows["b.csv"].text == "x | y\nz\n1 | 2" and rows["b.csv"].content_type == "table"
    assert json.loads(rows["c.json"].text) == {"a": 1} and rows["d.docx"].text == "p\nq"
    assert rows["e.png"].status == "requires_ocr" and rows["h.json"].status == "failed" and len(rows) == 6
    assert {r.reason: r["count"] for r in files.skip_counts(found).collect()} == {"unsupported": 1}  # hidden files are not listed
    assert {r.status for r in files.parse_files(found.where(F.col("path").endswith("e.png")), lambda raw, kind: "seen").collect()} == {"parsed"}
    src = files.sources(found).orderBy("filename").collect()
    assert all(r.source_id == f"source:uploaded:{r.checksum[:12]}" for r in src)


def test_structured_graph(spark):
    lines = spark.createDataFrame([("归经\t肺",), ("别名\t",), ("未知\t ",), ("no tab",), ("功能\ta\tb ",)], "value string")
    rel = [("中药名\t薄荷", "Another Name", "别名\t银丹草"), ("处方\t甲方_2", "functions", "功能\t清热"), ("中药名\t薄荷", "five flavors", "五味\t辛"), ("中药名\t薄荷", "dose", "剂量\t一钱"), ("方名\t甲方", "prescription type", "处方\t甲方_2"), ("中药名\t连翘", "dose", "剂量\t二钱"), ("中药名\t薄荷", "no such relation", "五味\t辛")]
    frame = spark.createDataFrame([("g", k, a, b, c) for k, (a, b, c) in enumerate(rel)], "file string, ord long, node_1 string, relation string, node_2 string")
    nodes, edges = structured.structured_graph(lines, frame)
    assert {(r.source, r.relation, r.target) for r in edges.collect()} == {
        ("herb:薄荷", "HAS_ALIAS", "alias:银丹草"),
        ("prescription:甲方_2", "TREATS", "function:清热"),
        ("herb:薄荷", "HAS_FLAVOR", "flavor:辛"),
        ("herb:薄荷", "HAS_DOSE", "dose:一钱"),  # no prescription came before it
        ("formula:甲方", "HAS_PRESCRIPTION", "prescription:甲方_2"),
        ("prescription:甲方_2", "HAS_DOSE", "dose:二钱"),
    }
    assert {r.id for r in nodes.collect()} == {"meridian:肺", "function:a\tb", "herb:薄荷", "alias:银丹草", "prescription:甲方_2", "function:清热", "flavor:辛", "dose:一钱", "formula:甲方", "herb:连翘", "dose:二钱"}


def test_unknown_node_types_are_errors(spark):
    from pyspark.errors import PySparkException

    lines = spark.createDataFrame([("未知\t某",)], "value string")
    none = spark.createDataFrame([], "file string, ord long, node_1 string, relation string, node_2 string")
    with pytest.raises(PySparkException, match="unsupported node type"):
        structured.structured_graph(lines, none)[0].collect()


def test_tables_append_and_keep_what_readers_have(spark):
    t = tables.Table(spark, new_dir(spark, "table"), ["id"])
    one = spark.range(3).select(F.col("id").cast("string").alias("id"))
    t.append(one)
    old = t.read()
    t.append(one)
    assert old.count() == 3 and t.read().count() == 6
    t.replace(one)
    assert old.count() == 3 and t.read().count() == 3
    t.clear()
    assert t.read().count() == 0 and t.read().columns == ["id"]


def folders_of(t):
    return {b: set(f) for b, f in t.version()[1]["folders"].items()}


def test_merges_write_the_buckets_they_touch(spark):
    t = tables.Table(spark, new_dir(spark, "table"), ["id", "part"], 8)
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 3).cast("string").alias("part"), F.lit("old").alias("x"))
    t.merge(rows)
    before = folders_of(t)
    t.merge(spark.createDataFrame([(5, "2", "new"), (500, "0", "new")], rows.schema))
    after = folders_of(t)
    changed = {b for b in before if after[b] != before[b]}
    assert 1 <= len(changed) <= 2 and all(len(f) == 1 for f in after.values())
    got = {(r.id, r.part): r.x for r in t.read().collect()}
    assert len(got) == 201 and got[5, "2"] == got[500, "0"] == "new" and list(got.values()).count("old") == 199
    assert [r.x for r in t.read_keys(spark.createDataFrame([(5, "2")], "id long, part string")).collect()] == ["new"]
    t.merge(rows.limit(0))
    assert folders_of(t) == after
    t.replace_of("part", spark.createDataFrame([(1, "1", "only")], rows.schema))
    assert t.read().where("part = '1'").count() == 1 and t.read().count() == 201 - 67 + 1


def test_compaction_and_vacuum(spark):
    t = tables.Table(spark, new_dir(spark, "table"), ["id"], 2)
    for k in range(6):
        t.append(spark.range(10 * k, 10 * k + 10))
    old = t.read()
    assert max(map(len, folders_of(t).values())) == 6
    t.compact()
    assert all(len(f) == 1 for f in folders_of(t).values()) and t.vacuum(2) == 0 and old.count() == 60
    assert t.compact() == t.version()[0] == 7 and t.vacuum(1) > 0 and t.read().count() == 60
    assert t._numbers() == [7]


def test_of_two_writers_one_fails(spark):
    path = new_dir(spark, "table")
    one, two = (tables.Table(spark, path, ["id"], 2) for _ in range(2))
    one.replace(spark.range(3))
    number, content = two.version()
    one.merge(spark.range(2, 5))
    with pytest.raises(tables.Conflict):
        two._commit(number, content)
    assert sorted(r.id for r in two.read().collect()) == [0, 1, 2, 3, 4]
    two.merge(spark.range(5, 6))
    assert one.read().count() == 6


def test_half_written_versions_are_passed_over(spark, monkeypatch):
    t = tables.Table(spark, new_dir(spark, "table"), ["id"], 2)
    t.replace(spark.range(3))
    path, fs = t._place("versions/000000000002")
    out = fs.create(path, False)
    out.write(bytearray(b'{"buckets"'))
    out.close()
    assert t.read().count() == 3
    with pytest.raises(tables.Conflict):  # it may still be written
        t.merge(spark.range(3, 4))
    monkeypatch.setattr(tables, "LEASE_MS", 0)
    assert t.merge(spark.range(3, 4)) == 3 and t.read().count() == 4


def test_tables_and_states(spark):
    t = tables.Table(spark, new_dir(spark, "table"), ["id"])
    assert t.read() is None
    rows = spark.createDataFrame([("a", "missing", ""), ("b", "failed", "x")], "id string, vector_status string, vector_point_id string")
    t.replace(rows)
    t.merge(spark.createDataFrame([("b", "missing", ""), ("c", "missing", "")], rows.schema))
    assert sorted(r.id for r in t.read().collect()) == ["a", "b", "c"]
    outcome = spark.createDataFrame([("a", True, "p"), ("b", False, None)], "id string, ok boolean, point_id string")
    marked = tables.mark(t.read(), outcome, "id")
    assert {(r.id, r.vector_status, r.vector_point_id) for r in marked.collect()} == {("a", "embedded", "p"), ("b", "failed", ""), ("c", "missing", "")}
    assert tables.reset_failed(marked).where("vector_status = 'missing'").count() == 2
    t.clear()
    assert t.read().count() == 0


def test_point_id(spark):
    got = spark.createDataFrame([("chunk:1",), ("二",)], "v string").select("v", tables.point_id(F.col("v")).alias("p")).collect()
    assert all(r.p == str(uuid.uuid5(uuid.NAMESPACE_URL, r.v)) for r in got)


def test_stream(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = tables.Table(spark, new_dir(spark, "chunks"), ["chunk_id"])
    for batch in ([(1, "a。b"), (2, "")], [(1, "c")]):
        spark.createDataFrame(batch, "doc_id long, text string").write.mode("append").parquet(source)
        ingest.chunk_stream(spark, source, "doc_id long, text string", table, state).awaitTermination()
    assert [(r.doc_id, r.content) for r in table.read().collect()] == [(1, "c")]


def test_event_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = ingest.event_windows(events, "ts", "event_type")
    assert got.agg(F.sum("n")).first()[0] == events.count()
