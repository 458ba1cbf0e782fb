"""Tables in the folder that driver and executors share, to cut lineage and to compute a costly result once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary one.

    Raises ValueError on a cluster that names none, because a machine-local folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-lithos-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables written to the shared folder, to cut lineage and to keep a costly result from being computed twice.

    A table outlives the executor that wrote it. The result of an operator may read the last tables, so only those
    that nothing reads any more are dropped; the rest goes with the folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lithos-{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        """Write `df` as Parquet, compressed with `codec` if one is named, and return a DataFrame that reads it back."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of save() that nothing reads any more."""
        path = self.paths.pop(id(df), None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
