"""Files to a published graph: upload, jobs, publishing, and lists of what there is.

Each step works on all its sources at once, as joins over keyed tables (sources.tables.Table); a job that was cut off goes on with the
sources that aren't done. Only counters reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .models import Models, extraction
from .operators import candidates as C
from .operators import chunking
from .operators import publish as P
from .sources import files as S
from .sources.tables import BUCKETS, Table
from .storage import materialize

KEYS = {
    "sources": ["source_id"], "objects": ["object_key"], "jobs": ["job_id", "source_id"], "pages": ["page_id"], "units": ["unit_id"], "chunks": ["chunk_id"],
    "entities": ["source_id", "entity_id"], "relations": ["source_id", "relation_id"], "citations": ["source_id", "owner", "unit_id"],
    "nodes": ["id"], "edges": ["id"], "evidence": ["owner", "id"], "batches": ["batch_id"],
}
# What lists are sorted by.
ORDER = {
    "sources": ["source_id"], "pages": ["source_id", "page_number"], "units": ["source_id", "unit_index"], "chunks": ["source_id", "chunk_index", "chunk_id"],
    "entities": ["source_id", "name", "entity_id"], "relations": ["source_id", "source_entity_id", "target_entity_id", "relation_id"], "citations": ["source_id", "owner", "unit_id"],
    "nodes": ["name", "id"], "edges": ["source", "target", "id"], "evidence": ["owner", "id"], "batches": ["batch_id"], "jobs": ["job_id", "source_id"],
}
OF_SOURCE = ("pages", "units", "chunks", "entities", "relations", "citations")
Store = Callable[[DataFrame, DataFrame, DataFrame], None]


class Ingestion:
    def __init__(self, spark: SparkSession, path: str, models: Models | None = None, mode: str = "light", recognize: S.Recognizer | None = None, buckets: int = BUCKETS):
        self.spark, self.models, self.mode, self.recognize = spark, models or Models(), mode, recognize
        self.tables = {name: Table(spark, f"{path.rstrip('/')}/{name}", key, buckets) for name, key in KEYS.items()}

    def _read(self, name: str) -> DataFrame:
        rows = self.tables[name].read()
        if rows is None:
            raise LookupError(f"{name}: nothing was ingested yet")
        return rows

    def upload(self, files: DataFrame) -> DataFrame:
        """Store the files (path, content) by their content and register them; the rows of their sources. Files that are equal are one
        source, under the least name."""
        objects = files.select(F.sha2("content", 256).alias("checksum"), "content").where("checksum IS NOT NULL").dropDuplicates(["checksum"])
        rows = materialize(S.sources(files.where("content IS NOT NULL")).withColumn("status", F.lit("registered")), "sources")
        self.tables["objects"].merge(objects.join(rows.select("checksum", "object_key"), "checksum").select("object_key", "content"))
        self.tables["sources"].merge(rows)
        return rows

    def create_job(self, sources: DataFrame) -> str:
        """A job for some sources (source_id). Ids that aren't registered are an error."""
        job, ids = f"job:{uuid.uuid4().hex}", sources.select("source_id").distinct()
        unknown = ids.join(self._read("sources"), "source_id", "left_anti").first()
        if unknown:
            raise LookupError(f"unknown source {unknown.source_id}")
        self.tables["jobs"].merge(ids.select(F.lit(job).alias("job_id"), "source_id", F.lit("pending").alias("status")))
        return job

    def run_job(self, job: str) -> dict:
        """Parse, split and extract the sources of a job that aren't done; totals of all its sources."""
        rows = self._read("jobs").where(F.col("job_id") == job)
        if rows.isEmpty():
            raise LookupError(f"unknown job {job}")
        self._ingest(rows.where("status <> 'completed'").select("source_id"))
        self.tables["jobs"].merge(rows.select("job_id", "source_id", F.lit("completed").alias("status")))
        totals = {f"{kind.rstrip('s')}_count": self._read(table).join(rows.select("source_id"), "source_id", "left_semi").count() for kind, table in (("units", "units"), ("chunks", "chunks"))}
        totals |= {f"{kind}_count": self._read(table).join(rows.select("source_id"), "source_id", "left_semi").count() for kind, table in (("entity", "entities"), ("relation", "relations"))}
        return {"job_id": job, "status": "completed", **totals}

    def _ingest(self, ids: DataFrame, keep_published: bool = False) -> None:
        """Everything that is known of some sources becomes what their files hold now."""
        sources = materialize(P.rebuildable(self._read("sources")).join(ids.distinct(), "source_id", "left_semi"), "ingested")
        if sources.isEmpty():
            return
        stored = self.tables["objects"].read_keys(sources.select("object_key"))
        read = S.parse_files(stored.select(F.col("object_key").alias("path"), "content"), self.recognize).withColumnRenamed("path", "object_key").withColumnRenamed("status", "parsed")
        read = materialize(read.join(sources.select("object_key", "source_id"), "object_key"), "parsed")
        page = F.concat(F.lit("page:"), "source_id", F.lit(":0001")).alias("page_id")
        pages = read.select(page, "source_id", F.lit(1).alias("page_number"), F.col("text").alias("content"), "content_type")
        units = materialize(chunking.unit_documents(read, "source_id", "text"), "units")
        chunks = chunking.chunk_documents(read, "source_id", "text", out="source_id").withColumn("page_id", F.concat(F.lit("page:"), "source_id", F.lit(":0001"))).withColumn("token_count", T.token_estimate(F.col("content")))
        entities, relations = extraction(P.units_as_chunks(units), self.mode, self.models)
        found = C.candidates(entities, relations, units.select(F.col("unit_id").alias("chunk_id"), "source_id"))
        for name, rows in zip(OF_SOURCE, (pages, units, chunks, *found), strict=True):
            self._replace(name, sources, rows)
        stays = F.lit(keep_published) & (F.col("status") == "published") & (F.col("parsed") == "parsed")
        status = F.when(stays, "published").otherwise(F.coalesce("parsed", F.lit("missing")))
        self.tables["sources"].merge(sources.join(read.select("source_id", "parsed"), "source_id", "left").withColumn("status", status).drop("parsed"))

    def _replace(self, name: str, sources: DataFrame, rows: DataFrame) -> None:
        """The rows of some sources become `rows`; of a source without any, none is left."""
        old = self.tables[name].read()
        if old is not None:
            self.tables[name].remove(old.join(sources.select("source_id"), "source_id", "left_semi"))
        self.tables[name].merge(rows)

    def publish(self, sources: DataFrame, stores: dict[str, Store] | None = None, force: bool = False) -> dict:
        """Publish some sources (source_id), by force also those without relations; the record of the batch. Stores get (nodes, edges,
        evidence), such as rows for a graph database or points for vectors; one that fails is named with its error and stops nothing."""
        ids = sources.select("source_id").distinct().join(self._read("sources"), "source_id", "left_semi")
        if not force:
            ids = ids.join(self._read("relations").select("source_id").distinct(), "source_id", "left_semi")
        ids = materialize(ids, "published")
        own = {name: self._read(name).join(ids, "source_id", "left_semi") for name in ("entities", "relations", "citations", "chunks")}
        made = [materialize(rows, "artifact") for rows in C.publication(**own)]
        self.tables["nodes"].merge(made[0])
        old = self.tables["evidence"].read()
        if old is not None:
            self.tables["evidence"].remove(old.join(made[1].select(F.col("id").alias("owner")), "owner", "left_semi"))
        self.tables["edges"].merge(made[1])
        self.tables["evidence"].merge(made[2])
        counts = {"node_count": made[0].count(), "edge_count": made[1].count(), "evidence_count": made[2].select("id").distinct().count(), "chunk_count": own["chunks"].count(), "source_count": ids.count()}
        batch = {"batch_id": f"publish:{uuid.uuid4().hex}", "status": "published", **counts}
        self.tables["batches"].merge(self.spark.createDataFrame([batch], "batch_id string, status string, node_count long, edge_count long, evidence_count long, chunk_count long, source_count long"))
        self.tables["sources"].merge(self._read("sources").join(ids, "source_id", "left_semi").withColumn("status", F.lit("published")))
        return batch | {"stores": {name: _stored(store, made) for name, store in (stores or {}).items()}}

    def restore(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, evidence) of all published sources, from their candidates."""
        ids = P.published_ids(self._read("sources"))
        return C.publication(*(self._read(name).join(ids, "source_id", "left_semi") for name in ("entities", "relations", "citations", "chunks")))

    def rechunk(self, ids: list[str] | None = None, dry_run: bool = False) -> dict:
        """Split and extract stored sources anew, all or some; published ones stay published. A dry run only counts them."""
        rows = P.rebuildable(self._read("sources"), ids).select("source_id")
        n = rows.count()
        if not dry_run:
            self._ingest(rows, keep_published=True)
        return {"sources": n, "dry_run": dry_run}

    def import_files(self, root: str, force: bool = False, images: bool = True) -> dict:
        """All files below a folder that can be read, from upload to publishing; a summary. Sources that are published already are passed
        over."""
        files = S.list_files(self.spark, root)
        skipped = {r.reason: r["count"] for r in S.skip_counts(files, images=images).collect()}  # a row a reason
        fit = files.where(S.skip_reason(F.col("path"), F.col("length"), images=images).isNull())
        known = self.tables["sources"].read()
        if known is not None:
            fit = fit.withColumn("checksum", F.sha2("content", 256)).join(known.where("status = 'published'").select("checksum"), "checksum", "left_anti")
        new = self.upload(fit)
        if new.isEmpty():
            return {"skipped": skipped, "sources": 0}
        totals = self.run_job(self.create_job(new))
        return {"skipped": skipped, "sources": new.count(), **totals, "published": self.publish(new, force=force)}

    def bundle(self, source_id: str) -> dict[str, DataFrame]:
        return P.bundle(source_id, **{name: self._read(name) for name in ("sources", *OF_SOURCE)})

    def listing(self, name: str, source_id: str | None = None) -> DataFrame:
        """Rows of a table in their order, all or those of a source."""
        rows = self._read(name)
        return (rows.where(F.col("source_id") == source_id) if source_id else rows).orderBy(*ORDER[name])


def _stored(store: Store, made: list[DataFrame]) -> str:
    try:
        store(*made)
    except Exception as e:  # a store is outside; the graph is published without it
        return f"{type(e).__name__}: {e}"[:500]
    return "stored"


def summary_text(values: dict) -> str:
    """A summary as lines of key=value in order of the keys, nested keys joined by a dot."""
    flat = {}
    for k, v in values.items():
        flat |= {f"{k}.{i}": x for i, x in v.items()} if isinstance(v, dict) else {k: v}
    return "\n".join(f"{k}={flat[k]}" for k in sorted(flat))
