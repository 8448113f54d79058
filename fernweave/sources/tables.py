"""Keyed tables as Parquet folders, in hash buckets of the key: replace, append, merge by key, and replace of single sources.

What a table consists of is a list of folders for each bucket, in a numbered version file. A write adds folders, for the
buckets that it touches only, and then the next version; the highest version that is complete counts, so readers see the
table before or after a write. A version file is created only if there is none of its number, which is atomic on HDFS and
local disks and, with fs.s3a.create.conditional.enabled, on S3: of two drivers that write at once one fails with Conflict, has
changed nothing, and may read and write again. A version that a dead driver left half written is passed over after LEASE_MS.
Old versions stay until vacuum(), for readers that have begun.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import upsert
from ..storage import materialize

BUCKETS = 16
LEASE_MS = 600_000
END = "\nend"


class Conflict(RuntimeError):
    """Another driver has written the table since it was read."""


class Table:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        """`buckets` counts for a new table; an old one keeps its number."""
        self.spark, self.path, self.key, self.new_buckets = spark, path.rstrip("/"), key, buckets

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder, fs = self._place("versions")
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())

    def _load(self, number: int) -> dict | None:
        """A version; None if it isn't complete."""
        path, fs = self._place(f"versions/{number:012d}")
        stream = fs.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text.removesuffix(END)) if text.endswith(END) else None

    def version(self) -> tuple[int, dict]:
        """(Number, content) of the version that counts; number 0 for a table that isn't there."""
        for number in reversed(self._numbers()):
            if (found := self._load(number)) is not None:
                return number, found
        return 0, {"buckets": self.new_buckets, "schema": None, "folders": {}}

    def _commit(self, after: int, content: dict) -> int:
        """Make content the version that follows `after`."""
        number = after + 1
        for left in self._numbers():
            path, fs = self._place(f"versions/{left:012d}")
            if left > after and (self._load(left) is not None or time.time() * 1000 - fs.getFileStatus(path).getModificationTime() < LEASE_MS):
                raise Conflict(f"{self.path} has version {left}, this write is based on {after}")
            number = max(number, left + 1)
        path, fs = self._place(f"versions/{number:012d}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            raise Conflict(f"{self.path} has version {number}") from e
        out.write(bytearray((json.dumps(content) + END).encode()))
        out.close()
        return number

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.key)), F.lit(n)).cast("int")

    def _read(self, content: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, fs in sorted(content["folders"].items()) if buckets is None or int(b) in buckets for f in fs]
        schema = StructType.fromJson(content["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        number, content = self.version()
        return self._read(content) if number else None

    def read_keys(self, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys, from their buckets alone."""
        number, content = self.version()
        if not number:
            return None
        touched = [r.b for r in keys.select(self._bucket(content["buckets"]).alias("b")).distinct().collect()]  # at most the buckets
        return self._read(content, touched).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _write(self, rows: DataFrame, n: int) -> dict[str, list[str]]:
        """Write rows by bucket; the new folder of each bucket that has any."""
        part = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(n)).repartition(n, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{part}")
        folder, fs = self._place(part)
        names = [f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory()]
        return {name.removeprefix("_bucket="): [f"{part}/{name}"] for name in names if name.startswith("_bucket=")}

    def replace(self, rows: DataFrame) -> int:
        number, content = self.version()
        return self._commit(number, {"buckets": content["buckets"], "schema": rows.schema.jsonValue(), "folders": self._write(rows, content["buckets"])})

    def append(self, rows: DataFrame) -> int:
        """Adds rows without reading any."""
        number, content = self.version()
        if not number:
            return self.replace(rows)
        rows = rows.select([f["name"] for f in content["schema"]["fields"]])
        new = self._write(rows, content["buckets"])
        return self._commit(number, content | {"folders": content["folders"] | {b: content["folders"].get(b, []) + f for b, f in new.items()}})

    def _rewrite(self, number: int, content: dict, touched: list[int], kept: DataFrame) -> int:
        """The touched buckets become what `kept` holds."""
        folders = {b: f for b, f in content["folders"].items() if int(b) not in touched}
        return self._commit(number, content | {"folders": folders | self._write(kept, content["buckets"])})

    def merge(self, rows: DataFrame) -> int:
        """Rows replace those with the same key. Of a table of any size only the buckets of these keys are read and written."""
        number, content = self.version()
        if not number:
            return self.replace(rows)
        rows = materialize(rows.select([f["name"] for f in content["schema"]["fields"]]), "merged")
        touched = [r.b for r in rows.select(self._bucket(content["buckets"]).alias("b")).distinct().collect()]  # at most the buckets
        return self._rewrite(number, content, touched, upsert(self._read(content, touched), rows, self.key)) if touched else number

    def replace_of(self, column: str, rows: DataFrame) -> int:
        """Rows replace all rows with the same value of a column, such as a source. Buckets without any stay as they are."""
        number, content = self.version()
        if not number:
            return self.replace(rows)
        rows = materialize(rows.select([f["name"] for f in content["schema"]["fields"]]), "replaced")
        values, bucket = rows.select(column).distinct(), self._bucket(content["buckets"]).alias("b")
        touched = [r.b for r in self._read(content).join(values, column, "left_semi").select(bucket).union(rows.select(bucket)).distinct().collect()]
        kept = self._read(content, touched).join(values, column, "left_anti").select(rows.columns).unionByName(rows)
        return self._rewrite(number, content, touched, kept) if touched else number

    def remove(self, keys: DataFrame) -> int:
        """The rows of some keys go; only the buckets that hold some are written."""
        number, content = self.version()
        if not number:
            return 0
        keys = materialize(keys.select(self.key).distinct(), "removed")
        touched = [r.b for r in keys.select(self._bucket(content["buckets"]).alias("b")).distinct().collect()]  # at most the buckets
        return self._rewrite(number, content, touched, self._read(content, touched).join(keys, self.key, "left_anti")) if touched else number

    def clear(self) -> None:
        number, content = self.version()
        if number:
            self._commit(number, content | {"folders": {}})

    def compact(self, most: int = 4) -> int:
        """Buckets of more than `most` folders, as appends leave them, are written into one each."""
        number, content = self.version()
        many = [int(b) for b, f in content["folders"].items() if len(f) > most]
        return self._rewrite(number, content, many, self._read(content, many)) if many else number

    def vacuum(self, keep: int = 2) -> int:
        """Delete all versions but the last `keep`, and the folders that no kept version names; how many folders went. Not while
        another driver writes."""
        numbers = self._numbers()
        named = set()
        for number in numbers[-keep:]:
            content = self._load(number) or {"folders": {}}
            named |= {f for fs in content["folders"].values() for f in fs}
        for old in numbers[:-keep]:
            path, fs = self._place(f"versions/{old:012d}")
            fs.delete(path, False)
        folder, fs = self._place("data")
        gone = 0
        for write in fs.listStatus(folder) if fs.exists(folder) else []:
            own = [f.getPath() for f in fs.listStatus(write.getPath()) if f.isDirectory()]
            unnamed = [p for p in own if f"data/{write.getPath().getName()}/{p.getName()}" not in named]
            for p in [write.getPath()] if len(unnamed) == len(own) else unnamed:
                fs.delete(p, True)
            gone += len(unnamed)
        return gone


def mark(rows: DataFrame, outcome: DataFrame, key: str) -> DataFrame:
    """Vector states after a run. outcome: (key, ok, point_id). Rows that succeeded are embedded, others failed and
    lose their point."""
    joined = rows.join(outcome.select(key, F.col("ok"), F.col("point_id").alias("_point")), key, "left")
    status = F.when(F.col("ok").isNull(), F.col("vector_status")).when(F.col("ok"), "embedded").otherwise("failed")
    point = F.when(F.col("ok").isNull(), F.col("vector_point_id")).when(F.col("ok"), F.col("_point")).otherwise("")
    return joined.withColumn("vector_status", status).withColumn("vector_point_id", point).drop("ok", "_point")


def reset_failed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector_status", F.when(F.col("vector_status") == "failed", "missing").otherwise(F.col("vector_status")))


def point_id(value: F.Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> F.Column:
    """The name-based UUID (version 5) of a string in a namespace, the public one of URLs by default."""
    digest = F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), F.encode(value, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
