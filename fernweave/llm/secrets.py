"""Operator 5: secret scans with an incremental blob ledger.

Method: every version of a text is content-addressed by SHA-256. The ledger holds a row per blob and rule
version with its findings; only pairs that it lacks are scanned, each blob once however many paths it has, and
findings are joined back to all paths. Copies meet in a map-side aggregate before anything is shuffled.

Defined results: a null text is the empty one; a text of any length is scanned whole; findings that start at one place
are ordered by kind as listed; rows that repeat an id, null ids included, each get their findings; an empty table
gives no rows; further columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULE_VERSION = "2"
#: Base kinds in the order that breaks ties, then the added ones.
BASE = ("assign", "access", "hex")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A private key to its END line; without one before the next marker, its header fields, base64 lines and a last shorter one.
PEM = re.compile(
    r"""-----BEGIN\x20([A-Z ]{0,40}PRIVATE\x20KEY)-----
    (?:(?:(?!-----(?:BEGIN|END)\x20).)*-----END\x20\1-----
    |(?:(?:\s|\\[nr])+(?:Proc-Type|DEK-Info):\s?\S+)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*
    (?:(?:\s|\\[nr])+(?:[A-Za-z0-9+/]+={1,2}|(?=[A-Za-z]*[0-9+/])[A-Za-z0-9+/]+|[A-Za-z]+(?=[^\S\n]*(?:\n|\Z)))(?![A-Za-z0-9+/=]))?)""",
    re.VERBOSE | re.DOTALL,
)
ADDED = (
    ("pem", "-----BEGIN", PEM),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)
KINDS = (*BASE, *(name for name, _, _ in ADDED))
FINDINGS = "sha string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
FINDINGS_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in FINDINGS.split(", "))])


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (_, hint, rule) in enumerate(ADDED):
        if hint in text:
            out += [(m.start(), 3 + k, m.end()) for m in rule.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def parse(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def redact(text: str, spans: str, mask: str = "[secret]") -> str:
    """The text with each finding, or run of findings that overlap, replaced by the mask."""
    out, at = [], 0
    for _, a, b in sorted(parse(spans), key=lambda x: x[1:]):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


class BlobLedger:
    """Findings by blob and rule version, as Parquet in one folder. scan() appends what is unseen."""

    def __init__(self, spark: SparkSession, path: str, rule_version: str = RULE_VERSION):
        self.spark, self.path, self.rule_version = spark, path, rule_version

    def known(self) -> DataFrame | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(FINDINGS).parquet(self.path) if there else None

    def scan(self, versions: DataFrame) -> DataFrame:
        """versions: (sha, text) with repeats. The findings of all blobs, of which only the unseen are scanned."""
        common.short_batches(self.spark)
        blobs = versions.dropDuplicates(["sha"])
        if (known := self.known()) is not None:
            seen = known.where(F.col("rule_version") == self.rule_version).select("sha")
            blobs = versions.join(seen, "sha", "left_anti").dropDuplicates(["sha"])
        version = self.rule_version

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for sha, text in zip(batch.column("sha").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    found = find(text)
                    base = [x for x in found if x[2] in BASE]
                    rows.append((sha, version, *(sum(x[2] == k for x in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
                yield common.to_batch(rows, FINDINGS_SCHEMA)

        blobs.select("sha", "text").mapInArrow(run, FINDINGS).write.mode("append").option("compression", "zstd").parquet(self.path)
        return self.known().where(F.col("rule_version") == self.rule_version).dropDuplicates(["sha"])


def addressed(docs: DataFrame, text_col: str = "text", name: str = "sha") -> DataFrame:
    """docs with the content address of the text under a name."""
    return docs.withColumn(name, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def scan_documents(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """Findings of each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, sha. Only blobs with findings are
    joined back, read as a plain table, so the paths of a blob with very many can be split over tasks."""
    paths = addressed(common.whole_text(docs))
    hits = common.materialize(ledger.scan(paths.select("sha", "text")).where("spans <> ''").drop("rule_version"), "hits")
    joined = paths.select("doc_id", "sha").join(hits, "sha", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("doc_id", *counts, F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "sha")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` against a new ledger."""
    return scan_documents(common.table(spark, sf_dir, "documents"), BlobLedger(spark, common.new_dir(spark, "ledger")))
