"""Documents that arrive as files, chunked as they come, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents
from ..sources.tables import Table


def chunk_stream(spark: SparkSession, path: str, schema: str, table: Table, state: str, once: bool = True) -> StreamingQuery:
    """Each new Parquet file of (doc_id, text) below path is chunked; the chunks of a document replace its former
    ones. The state folder remembers which files are done, so a run that was stopped goes on where it was."""

    def write(batch: DataFrame, _: int) -> None:
        chunks = chunk_documents(batch.dropDuplicates(["doc_id"]), "doc_id", "text")
        if not chunks.isEmpty():
            table.replace_of("doc_id", chunks)

    stream = spark.readStream.schema(schema).parquet(path)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def event_windows(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each kind in tumbling windows. Late ones count until the watermark has passed their window; on a
    stream repeats of an event_id are dropped while the watermark remembers them."""
    rows = events.withWatermark(time, late)
    if events.isStreaming:
        rows = rows.dropDuplicatesWithinWatermark(["event_id"])
    return rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
