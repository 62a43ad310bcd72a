"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Only a local master may run without that setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault("base", tempfile.mkdtemp(prefix="spark-framelake-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on a batch that Spark hands to Python holds at most 8 MB, however long its texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and go on from the files: lost executors cost no recomputation
    of what lies before, and what is used more than once is computed once. The shuffle files of what was
    written are removed at once."""
    spark = df.sparkSession
    small_batches(spark)
    path, before = path or shared_path(spark, name), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in the shared folder between the steps of an operator; those that no later step reads are removed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, shared_path(spark, name)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return cut(df, name, f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Nothing that is still to be computed may read these tables."""
        for name in names:
            remove(self.spark, f"{self.base}/{name}")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_hash(docs: DataFrame) -> Column:
    """Of all columns that can be hashed."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
