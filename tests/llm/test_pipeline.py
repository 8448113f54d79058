"""The pipeline's stages against brute force, on the smallest tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fernweave.llm import common, secrets, stages  # noqa: E402

from .test_ops import brute_components, brute_repeats, brute_secrets, texts  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[9]], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "secret scans", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copies(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d for d, (_, c) in brute_components(rows, 5, 80, 100).items() if d == c}
    got = stages.without_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_repeats(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = stages.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    for r in got.collect():
        _, gone, sha = brute_repeats(rows)[r.doc_id]
        before = next(t for d, t in rows if d == r.doc_id)
        assert hashlib.sha256(r.text.encode()).hexdigest() == sha if gone else r.text == before
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_secrets(spark, docs):
    got = stages.without_secrets(docs, secrets.BlobLedger(spark, common.new_dir(spark, "ledger")))
    assert got.columns == docs.columns and got.count() == docs.count()
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        found = brute_secrets(before[r.doc_id] or "")
        assert ("[secret]" in (r.text or "")) == bool(found)
        assert not found or "hunter22x" not in r.text


def test_private_keys(spark):
    lines = ["MIIEpAIBAAKCAQEA" + c * 48 for c in "uvwx"] + ["Qz9+short"]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"
    body = "\n".join(lines)
    keys = [f"{begin}\n{body}\n{end}", f"{begin}\n{fields}{body}\n{end}", f"{begin}\n{body}\n", f"{begin}\n{fields}{body}\n", " ".join([begin, *lines, end]), " ".join([begin, *lines]), "\\n".join([begin, *lines, end]), f"{begin}\n{body}\n{begin}\n{body}\n{end}"]
    rows = [(k, f"before {key} after it") for k, key in enumerate(keys)]
    got = stages.without_secrets(spark.createDataFrame(rows, "doc_id long, text string"), secrets.BlobLedger(spark, common.new_dir(spark, "ledger"))).collect()
    assert len(got) == len(keys)
    for r in got:
        assert r.text.startswith("before [secret]") and r.text.endswith("after it")
        assert not any(x in r.text for x in (*lines, "MIIE", "short", "PRIVATE", "DEK-Info"))


def test_whole_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0.6 * docs.count() < len(ids) < docs.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
