"""The engine as one object: build an index from documents, query it, look at its state.

Tables live in one folder (sources.tables.Table). Only short results reach the driver: the hits of one question, the
counters of an audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from . import jobs
from .functions import query as Q
from .functions import text as T
from .jobs import Lock
from .models import Models, extraction
from .operators import answers, chunking, graph, kg, relational, reports, resolution, retrieval
from .operators import audit as A
from .operators import index_rows as I
from .operators import modularity as M
from .sources.tables import BUCKETS, Table, mark, point_id, reset_failed
from .storage import materialize

KEYS = {
    "chunks": ["chunk_id"], "vectors": ["chunk_id"], "extracted": ["chunk_id"], "decided": ["key"], "nodes": ["id"], "edges": ["source", "target", "relation"],
    "levels": ["id", "level"], "entities": ["entity_id"], "relations": ["relation_id"], "reports": ["report_id"], "runs": ["run_id"],
}
ENTITIES, RELATIONS = "array<struct<name:string,label:string>>", "array<struct<source:string,target:string,relation:string>>"


class Engine:
    def __init__(self, spark: SparkSession, path: str, models: Models | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.models = spark, path.rstrip("/"), models or Models()
        self.tables = {name: Table(spark, f"{path.rstrip('/')}/{name}", key, 1 if name == "runs" else buckets) for name, key in KEYS.items()}

    def table(self, name: str) -> DataFrame:
        rows = self.tables[name].read()
        if rows is None:
            raise LookupError(f"{name} is empty; build the index first")
        return rows

    def health(self) -> dict:
        return {"status": "ok", "tables": [n for n, t in self.tables.items() if t.read() is not None]}

    def rebuild_index(self, docs: DataFrame) -> int:
        """Chunk documents (doc_id, text) that are new or changed and index their chunks; how many chunks there are."""
        chunks = chunking.chunk_documents(docs, "doc_id", "text")
        rows = chunks.withColumn("available_int", relational.eligible(T.token_estimate(F.col("content")), F.col("content")).cast("int")).withColumn("vector_status", F.lit("missing")).withColumn("vector_point_id", F.lit(""))
        self.tables["chunks"].replace_of("doc_id", materialize(rows, "chunks"))
        return self.table("chunks").count()

    def build_graph(self, mode: str = "light", force: bool = False) -> dict:
        """Build the graph of all chunks and return the run's row. One build at a time: BlockingIOError where another one runs."""
        run = jobs.new_run(self.spark, self.tables["runs"])
        run.set("running")
        try:
            counts = self._build(run, mode, force)
        except BaseException as e:
            if not isinstance(e, jobs.Cancelled):
                run.set("failed", f"{type(e).__name__}: {e}"[:500])
            raise
        run.set("completed", **counts)
        return {"run_id": run.run_id, "status": "completed", **counts}

    def start_build(self, mode: str = "light", force: bool = False) -> str:
        """build_graph() in the background; the run's id, for run() and cancel()."""
        run = jobs.new_run(self.spark, self.tables["runs"])
        run.start(lambda r: self._build(r, mode, force))
        return run.run_id

    def cancel(self, run_id: str) -> bool:
        """Stop a run and the Spark jobs that it has begun; False if it isn't running."""
        return jobs.Run(self.spark, self.tables["runs"], run_id).cancel()

    def run(self, run_id: str) -> dict | None:
        rows = self.tables["runs"].read()
        found = rows.where(F.col("run_id") == run_id).first() if rows is not None else None
        return found.asDict() if found else None

    def _build(self, run: jobs.Run, mode: str, force: bool) -> dict[str, int]:
        with Lock(self.spark, f"{self.path}/build.lock", run.run_id):
            found = self._extract(run, mode, force)
            run.check()
            nodes, edges = self._resolved(*self._merged(found))
            run.check()
            pairs = materialize(graph.undirected(graph.edge_weights(edges, nodes)), "pairs")
            components = materialize(graph.component_ids(graph.components(nodes, pairs)), "components")
            levels = materialize(M.communities(components, pairs), "levels")
            top = levels.where("level = 0").select("id", "community")
            ranked = graph.visual_weights(nodes, graph.degrees(nodes, pairs), graph.pagerank(nodes, pairs)).join(components, "id").join(top, "id")
            ranked = materialize(ranked, "ranked")
            run.check()
            self.tables["nodes"].replace(ranked)
            self.tables["edges"].replace(edges)
            self.tables["levels"].replace(levels)
            self.tables["reports"].replace(self._reports(ranked, edges, levels))
            self._index_rows(ranked, edges)
            return {"nodes": ranked.count(), "edges": edges.count()}

    def _extract(self, run: jobs.Run, mode: str, force: bool) -> DataFrame:
        """What each chunk holds, from the table of what was extracted; chunks that are new or changed are asked for, and their
        answers kept, so a build that was cut off goes on where it stopped."""
        chunks = self.table("chunks").select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "content", F.xxhash64("content").alias("mark"))
        known = self.tables["extracted"].read()
        same = ["chunk_id", "mark"]
        new = chunks if known is None or force else chunks.join(known.where(F.col("mode") == mode).select(same), same, "left_anti")
        new = materialize(new, "new")
        if not new.isEmpty():
            entities, relations = extraction(new, mode, self.models)
            own = entities.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("name", "label"))).alias("entities"))
            links = relations.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("source", "target", "relation"))).alias("relations"))
            rows = new.join(own, "chunk_id", "left").join(links, "chunk_id", "left")
            none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
            rows = rows.select("chunk_id", "doc_id", "mark", F.lit(mode).alias("mode"), none("entities", ENTITIES), none("relations", RELATIONS))
            self.tables["extracted"].merge(rows)
        run.check()
        return self.table("extracted").join(chunks.select(same), same, "left_semi")

    def _merged(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes by name and label, and edges between them. The ends of a relation are entities of its own chunk, of several with the
        name the one with the least label; a relation without both ends goes."""
        ident = lambda e: F.concat_ws(":", F.lit("entity"), F.lower(e["label"]), e["name"])
        each = found.select("chunk_id", F.explode("entities").alias("e"))
        nodes = each.groupBy(ident(F.col("e")).alias("id"), F.col("e.label").alias("label"), F.col("e.name").alias("name")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
        links = found.select("chunk_id", "entities", F.explode("relations").alias("r"))
        end = lambda side: F.array_min(F.transform(F.filter("entities", lambda e: e["name"] == F.col(f"r.{side}")), ident))
        ends = links.select("chunk_id", end("source").alias("source"), end("target").alias("target"), F.col("r.relation").alias("relation")).where("source IS NOT NULL AND target IS NOT NULL AND source <> target")
        edges = ends.groupBy("source", "target", "relation").agg(F.array_sort(F.collect_set("chunk_id")).alias("evidence"))
        return materialize(nodes, "nodes"), materialize(edges, "edges")

    def _resolved(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes that mean the same become one, with the chunks of all; edges follow with their evidence. Decisions are kept."""
        gone = materialize(resolution.moves(nodes, "label", self.models.decide, self.tables["decided"]), "moves")
        moved = nodes.join(gone, "id", "left").withColumn("to", F.coalesce("canonical", "id"))
        chunks = moved.groupBy("to").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("all_chunks"), F.array_sort(F.collect_set(F.when(F.col("canonical").isNotNull(), F.col("name")))).alias("aliases"))
        kept = nodes.join(gone.select("id"), "id", "left_anti").join(chunks, F.col("id") == F.col("to")).select("id", "label", "name", F.col("all_chunks").alias("chunk_ids"), "aliases")
        edges = graph.retargeted(edges, gone).drop("id").withColumn("ord", F.xxhash64("source", "target", "relation"))
        return materialize(kept, "nodes"), materialize(edges, "edges")

    def _reports(self, nodes: DataFrame, edges: DataFrame, levels: DataFrame) -> DataFrame:
        """Reports of the communities of every level, worded by the model of their names and of at most 12 relations inside."""
        out = None
        for level in [r.level for r in levels.select("level").distinct().orderBy("level").collect()]:  # a row a level
            own = nodes.drop("community").join(levels.where(F.col("level") == level).select("id", "community"), "id")
            made = reports.reports(own, edges, "community", level).withColumn("level", F.lit(level))
            side = lambda e, own=own: own.select(F.col("id").alias(e), F.col("name").alias(f"{e}_name"), F.col("community").alias(f"{e}_of"))
            inside = edges.join(side("source"), "source").join(side("target"), "target").where("source_of = target_of")
            told = inside.select(F.col("source_of").alias("community"), F.concat_ws(" ", "source_name", "relation", "target_name").alias("text"))
            texts = retrieval.top_k(told.distinct(), "community", ["text"], 12).groupBy("community").agg(F.array_sort(F.collect_list("text")).alias("relation_texts"))
            rows = made.join(texts.select((F.col("community") + level * reports.LEVEL_STEP).alias("report_id"), "relation_texts"), "report_id", "left")
            rows = rows.withColumn("relation_texts", F.coalesce("relation_texts", F.array().cast("array<string>"))).withColumn("names", F.split("entities", r"\|"))
            rows = self.models.report(rows.drop("title")).select("report_id", "level", "title", "entities", "names", "size", "weight", "relations", "summary", F.col("rating").cast("double").alias("rating"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], "report_id long, level int, title string, entities string, names array<string>, size long, weight double, relations long, summary string, rating double")
        return materialize(out, "reports")

    def _index_rows(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Entities with their best paths, and relations, as a question searches them."""
        none = self.spark.createDataFrame([], "name string, label string, chunk_ids array<string>")
        plain = nodes.select("id", "label", "name", F.concat_ws(" ", "name", "label", F.array_join("aliases", " ")).alias("description"), "pagerank", F.lit(None).cast("double").alias("rank"), F.array_join("chunk_ids", ",").alias("source_chunks"))
        self.tables["entities"].replace(I.graph_entity_rows(plain, graph.n_hop_paths(edges, nodes), none))
        rows = edges.select(F.concat_ws(":", F.lit("edge"), "source", "relation", "target").alias("id"), "source", "target", "relation", F.col("relation").alias("display"), F.col("evidence").alias("evidence_ids"))
        self.tables["relations"].replace(I.graph_relation_rows(rows, nodes, self.spark.createDataFrame([], "from_name string, to_name string, relation string, chunk_ids array<string>")))

    def runs(self, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in self.table("runs").orderBy(F.desc("started"), F.desc("run_id")).limit(min(max(limit, 1), 100)).collect()]

    def audit(self) -> dict:
        state = F.col("vector_status")
        return A.audit(self.table("chunks"), T.token_estimate(F.col("content")), state == "embedded", state == "failed", F.col("unit_id") != "").first().asDict()

    def status(self) -> dict:
        counters = self.spark.createDataFrame([self.audit()])
        return {**counters.first().asDict(), **A.readiness(counters).first().asDict()}

    def sync_vectors(self, limit: int, embed=None) -> DataFrame:
        """Embed the next missing chunks and mark them; the vectors are returned for the caller's store. embed turns
        (chunk_id, content) into rows (chunk_id, dim, value); without it the hash embedding is used."""
        chunks = self.table("chunks")
        next_ = materialize(chunks.where("vector_status = 'missing' AND available_int = 1").orderBy("doc_id", "chunk_index").limit(limit), "missing")
        vectors = embed(next_) if embed else retrieval.hash_embedding(next_, "chunk_id", F.col("content"), 1024)
        vectors = materialize(vectors, "vectors")
        done = vectors.select("chunk_id").distinct().withColumn("_done", F.lit(True))
        outcome = next_.select("chunk_id").join(done, "chunk_id", "left").select("chunk_id", F.col("_done").isNotNull().alias("ok"), point_id(F.col("chunk_id")).alias("point_id"))
        self.tables["vectors"].merge(dense(vectors))
        self.tables["chunks"].merge(mark(next_, outcome, "chunk_id"))
        return vectors

    def reset_failed(self) -> None:
        self.tables["chunks"].merge(reset_failed(self.table("chunks").where("vector_status = 'failed'")))

    def graph_overview(self, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges for a picture: all, or a balanced choice of nodes and the edges between them."""
        nodes, edges = self.table("nodes"), self.table("edges")
        if limit is None:
            return nodes, edges
        limit = min(max(limit, 1), 3000)
        kept = graph.round_robin(nodes.select("id", F.col("component").alias("community"), "visual_weight"), limit)
        for e in ("source", "target"):
            edges = edges.join(kept.select(F.col("id").alias(e)), e, "left_semi")
        heavy = graph.edge_weights(edges, nodes).orderBy(F.desc("weight"), "relation", "source", "target").limit(3 * limit)
        return kept, heavy.select(edges.columns)

    def query(self, question: str, top_k: int = K.CHUNK_TOP_K) -> dict:
        """Best chunks with evidence ids, matching nodes with their neighbourhood, and the intent."""
        asked = self.spark.createDataFrame([(0, question)], "qid int, text string").withColumn("t", T.query_tokens(Q.normal_form(F.col("text"))))
        tokens = asked.select("t", T.intent(F.col("text")).alias("intent"), Q.candidate_keywords(F.col("t")).alias("words")).first()
        chunks = self.table("chunks").where("available_int = 1")
        found = relational.lexical_candidates(chunks, tokens.words, ["content"], ["chunk_id"], K.LEXICAL_CANDIDATES)
        similar = retrieval.token_similarity(asked, "qid", F.col("t"), found, "chunk_id", T.query_tokens(F.col("content")))
        words = F.array(*map(F.lit, tokens.t)).cast("array<string>")
        scored = found.join(similar, "chunk_id", "left").withColumn("score", F.round(retrieval.hybrid(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)) + T.literal_bonus(words, F.col("content")), 6))
        hits = [r.asDict() for r in scored.where("score > 0.000001").orderBy(F.desc("score"), "chunk_id").limit(top_k).select("chunk_id", T.evidence_id(F.col("chunk_id")).alias("evidence_id"), "score", "content").collect()]
        nodes = self.tables["nodes"].read()
        if nodes is None:
            return {"intent": tokens.intent, "tokens": tokens.t, "hits": hits, "nodes": [], "edges": []}
        seeds = nodes.where(F.col("name").isin(tokens.t)).select("id")
        around, edges = graph.neighborhood(nodes, self.table("edges"), seeds, 2, terminal=["Source"])
        return {"intent": tokens.intent, "tokens": tokens.t, "hits": hits, "nodes": [r.id for r in around.orderBy("depth", "id").collect()], "edges": [(r.source, r.relation, r.target) for r in edges.collect()]}

    def answer(self, question: str, chunk_topn: int = K.CHUNK_TOP_K, entity_topn: int = 6, relation_topn: int = 6, report_topn: int = 1, budget: int = answers.MOST_TOKENS) -> dict:
        """A question's answer by the model, with what it rests on: chunks by words and vectors, reranked, entities and relations of the
        graph, reports of communities, evidence, a context of at most `budget` tokens, and a trace of it all."""
        asked = self.spark.createDataFrame([(0, question)], "qid int, text string").withColumn("t", T.query_tokens(Q.normal_form(F.col("text"))))
        said = self.models.rewrite(F.col("text"))
        row = asked.select("t", T.intent(F.col("text")).alias("intent"), Q.candidate_keywords(F.col("t")).alias("words"), Q.answer_types(F.col("text")).alias("types"), Q.entity_keywords(F.col("t")).alias("names"), said.alias("said")).first()
        types, names = row.said.types or row.types, row.said.entities or row.names
        vectors = self.tables["vectors"].read()
        if vectors is not None:
            own = dense(self.models.embed(asked.select(F.lit("question").alias("chunk_id"), F.col("text").alias("content"))))
            asked = asked.withColumn("chunk_id", F.lit("question")).join(own, "chunk_id", "left").drop("chunk_id")
        else:
            asked = asked.withColumn("v", F.lit(None).cast("array<double>"))
        chunks = self.table("chunks").where("available_int = 1")
        hits = answers.chunk_hits(asked, chunks, row.words, vectors, 2 * chunk_topn)
        scored = self.models.rerank(hits.withColumn("question", F.lit(question)))
        final = F.round(retrieval.fused_rerank(F.col("score"), F.col("rerank")), 6)
        scored = scored.withColumn("final", final).orderBy(F.desc("final"), "chunk_id").limit(chunk_topn)
        hits = [r.asDict() for r in scored.select("chunk_id", T.evidence_id(F.col("chunk_id")).alias("evidence_id"), "content", "token", "vector", "score", "rerank", "final").collect()]
        found, told, text = self._graph_hits(row, types, names, entity_topn, relation_topn, report_topn, budget)
        edges = [r.asDict() for r in found.edges.collect()] if found else []
        nodes = [r.asDict() for r in found.nodes.orderBy(F.desc_nulls_last("score"), "id").collect()] if found else []
        cards = self._cards(hits, edges)
        by_id = {n["id"]: n["name"] for n in nodes}
        paths = [f"{by_id.get(e['source'], e['source'])} -> {e['display']} -> {by_id.get(e['target'], e['target'])}" for e in edges[:12]]
        entities = list(dict.fromkeys([*(e["entity_name"] for e in told["entities"]), *names]))
        evidence = [{"evidence_id": c["id"], "content": c["content"]} for c in cards] + ([{"evidence_id": "graph", "content": text}] if text else [])
        ends = list(dict.fromkeys(x for e in edges[:6] for x in (e["source"], e["target"]))) or [n["id"] for n in nodes[:5]]
        trace = {
            "question": question,
            "rewrite": {"source": row.said.source, "fallback_types": row.types, "fallback_entities": row.names, "types": types, "entities": names},
            "fulltext": {"keywords": row.words, "hits": [{k: h[k] for k in ("chunk_id", "token", "vector", "score", "rerank", "final")} for h in hits]},
            "graph": {"parameters": {"entities": entity_topn, "relations": relation_topn, "reports": report_topn}, **told, "nodes": len(nodes), "edges": len(edges)},
            "context": {"budget": budget, "length": len(text), "sections": [s for s in answers.HEADS if f"---- {s} ----" in text]},
        }
        return {"question": question, "answer": self.models.answer(question, evidence), "intent": row.intent, "entities": entities, "nodes": nodes, "edges": edges, "paths": paths, "highlighted": ends, "evidence": cards, "context": text, "trace": trace}

    def _graph_hits(self, row, types: list[str], names: list[str], entity_topn: int, relation_topn: int, report_topn: int, budget: int) -> tuple[kg.Found | None, dict, str]:
        """What the graph holds for a question, in short and as text."""
        if self.tables["entities"].read() is None:
            return None, {"entities": [], "relations": [], "reports": []}, ""
        found = kg.retrieve(self.table("entities"), self.table("relations"), self.table("reports"), row.t, names or row.words, types, entity_topn, relation_topn, report_topn)
        place = lambda *order: F.row_number().over(relational.Window.orderBy(*order))
        ents = found.entities.withColumn("place", place(F.desc("score"), "entity_name"))  # at most entity_topn rows, as are the others
        rels = found.relations.withColumn("place", place(F.desc("score"), "from_name", "to_name")).withColumn("description", F.concat_ws(" ", "source_name", F.coalesce("display", F.lit("")), "target_name"))
        told = found.reports.withColumn("place", place(F.desc("shared"), F.desc("weight"), F.desc("title"))).withColumn("content", F.col("summary"))
        text = answers.context(answers.context_lines(ents, rels, told), budget)
        short = {
            "entities": [r.asDict() for r in ents.orderBy("place").select("entity_name", F.round("score", 6).alias("score")).collect()],
            "relations": [r.asDict() for r in rels.orderBy("place").select("source_name", "target_name", F.round("score", 6).alias("score")).collect()],
            "reports": [r.title for r in told.orderBy("place").collect()],
        }
        return found, short, text

    def _cards(self, hits: list[dict], edges: list[dict]) -> list[dict]:
        """Evidence of the hits, then of the edges, each once, with the text of its chunk."""
        own = self.spark.createDataFrame([(k, h["chunk_id"], h["content"]) for k, h in enumerate(hits)], "ord int, chunk_id string, snippet string")
        cited = self.spark.createDataFrame([(k, e["evidence"]) for k, e in enumerate(edges)], "ord int, evidence array<string>")
        cards = retrieval.evidence_cards(own, cited)
        texts = self.table("chunks").select(T.evidence_id(F.col("chunk_id")).alias("id"), "content")
        rows = cards.join(texts, "id", "left").orderBy("list", "ord", "pos").select("id", F.coalesce("snippet", "content", F.lit("")).alias("content"))
        return [r.asDict() for r in rows.collect()]


def dense(vectors: DataFrame) -> DataFrame:
    """(chunk_id, v), a vector, of (chunk_id, dim, value); rows that have v pass."""
    if "v" in vectors.columns:
        return vectors.select("chunk_id", F.col("v").cast("array<double>").alias("v"))
    size = F.max("dim") + 1
    entries = F.map_from_entries(F.collect_list(F.struct("dim", "value")))
    rows = vectors.groupBy("chunk_id").agg(size.alias("n"), entries.alias("m"))
    return rows.select("chunk_id", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("v"))
