"""What the operators share: tables, the shared folder, and reading and writing of raw files there."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Rounds, materialize, new_dir, shared_root  # noqa: F401

#: Rows of an Arrow batch; texts may be long, so batches stay short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches hold at most `rows` rows, which bounds a Python worker's memory by the longest texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def whole_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; further columns go."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a URI or a plain path."""
    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return pafs.LocalFileSystem(), uri
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.split("://", 1)[1]
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name when it is complete: each attempt of a task writes its own file and
    moves it, so a lost executor leaves no half file and a repeated task puts the same bytes in place."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def __enter__(self) -> AtomicFile:
        return self

    def __exit__(self, error: object, *_: object) -> None:
        """Put the file in place, or delete what was written of it when the task failed."""
        self.out.close()
        if error is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)


def open_input(uri: str) -> pa.NativeFile:
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches of tuples."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield to_batch(part, schema)
            part = []
    if part:
        yield to_batch(part, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer used, now instead of at some later time."""
    gc.collect()
    spark._jvm.System.gc()


_held: dict = {}


def hold(key: object, make: Callable[[], object]):
    """What a Python worker keeps between tasks, such as an encoder with its memo: only the last thing asked for, so that
    workers that serve one operator after the other don't add up their memories."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what hold() keeps; tasks that need memory of their own begin with it."""
    if _held:
        _held.clear()
        gc.collect()
