"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and all tasks run in this process, as in tests, a temporary one
    is made and set; on a cluster that would scatter the data over local disks, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fernweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A path for a new folder below the shared one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: How much larger than its file a table is taken to be. A row of ids takes 3 to 8 bytes in a zstandard Parquet file and about 100 in a
#: broadcast, which is built in the driver.
FILE_FACTOR = 16


def read_back(spark: SparkSession, schema, path: str) -> DataFrame:
    """A table of this folder. From here on the session takes files for FILE_FACTOR times as large as they are, unless it was told
    something else, so that a table with a row for each node isn't broadcast because its file is small."""
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor", "1.0")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(FILE_FACTOR)))
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    path = new_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return read_back(df.sparkSession, df.schema, path)


class Rounds:
    """Tables of a loop: put() writes the next one and deletes the one before the last, which nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, []

    def put(self, df: DataFrame) -> DataFrame:
        path = new_dir(self.spark, self.label)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            delete_dir(self.spark, self.paths.pop(0))
        return read_back(self.spark, df.schema, path)


class Buckets:
    """A table of a loop that is joined by one key each round: dealt by the key once and stored so, hence no round shuffles it."""

    def __init__(self, df: DataFrame, key: str, label: str):
        self.spark, self.name, self.path = df.sparkSession, f"{label}_{uuid.uuid4().hex}", new_dir(df.sparkSession, label)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").option("path", self.path).saveAsTable(self.name, format="parquet")
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete_dir(self.spark, self.path)


def delete_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, with what is in it."""
    if not path.startswith(shared_root(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
