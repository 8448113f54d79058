"""python -m fernweave.cli INDEX COMMAND [...]: rebuild DOCS | graph | vectors N | query QUESTION | answer QUESTION | cancel RUN | status | overview N."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> object:
    parser = argparse.ArgumentParser(prog="fernweave", description=__doc__)
    parser.add_argument("index")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("rebuild").add_argument("docs", help="Parquet of doc_id, text")
    commands.add_parser("graph")
    commands.add_parser("query").add_argument("question")
    commands.add_parser("answer").add_argument("question")
    commands.add_parser("vectors").add_argument("limit", type=int)
    commands.add_parser("cancel").add_argument("run")
    commands.add_parser("status")
    commands.add_parser("overview").add_argument("limit", type=int)
    said = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    engine = Engine(spark, said.index)
    if said.command == "rebuild":
        out: object = {"chunks": engine.rebuild_index(spark.read.parquet(said.docs))}
    elif said.command == "graph":
        out = engine.build_graph()
    elif said.command == "query":
        out = engine.query(said.question)
    elif said.command == "answer":
        out = engine.answer(said.question)
    elif said.command == "vectors":
        out = {"chunks": engine.sync_vectors(said.limit).select("chunk_id").distinct().count()}
    elif said.command == "cancel":
        out = {"cancelled": engine.cancel(said.run)}
    elif said.command == "status":
        out = engine.status()
    else:
        nodes, edges = engine.graph_overview(said.limit)
        out = {"nodes": nodes.count(), "edges": edges.count()}
    print(json.dumps(out, ensure_ascii=False, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
