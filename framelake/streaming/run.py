"""Streams over the given tables, and their results as tables in shared storage."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.adapters import VIEWS, Views
from framelake.sources.storage import scratch

#: Files that a batch of a replay takes at most.
TAKEN = 16


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def view_stream(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view that maps rows to rows of one table, as a stream."""
    (table,), sql = VIEWS[view]
    name = f"{table}_stream"
    table_stream(spark, sf_dir, table).createOrReplaceTempView(name)
    return spark.sql(re.sub(rf"\bFROM {table}\b", f"FROM {name}", sql))


def replay(spark: SparkSession, sf_dir: str, view: str, change: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """A view with ordered parts, written first and read as a stream."""
    path = scratch(spark, view)
    change(Views(spark, sf_dir)(view)).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def replay_in_order(spark: SparkSession, sf_dir: str, view: str, order: str, change: Callable[[DataFrame], DataFrame] = lambda d: d, width: int = 250_000, key: str | None = None, files: int | None = 1) -> DataFrame:
    """As replay, in parts of `width` of the order: a batch takes the files of a part, so it holds at most that many rows of a key.

    A part is `files` files, dealt out by key; None, for many keys: so many that they hold some `width` rows each if one part has all rows, and a batch
    takes TAKEN of them at most. The times of files are set by their parts, and a stream takes files by time; the folder's file system has to
    keep times that are set. If a part has fewer files, a batch may take the first of the next parts too (rows of a key: up to a part's for each file).
    """
    path = scratch(spark, view)
    d = change(Views(spark, sf_dir)(view))
    if files is None:
        files = max(1, -(-d.count() // width))
    dealt = F.pmod(F.xxhash64(key), F.lit(files)) if key else F.pmod(F.xxhash64(*d.columns), F.lit(files))
    parted = d.withColumns({"__part": F.floor(F.col(order) / width).cast("long"), "__file": dealt if files > 1 else F.lit(0).cast("long")})
    parted.repartition("__part", "__file").write.partitionBy("__part", "__file").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.isDirectory())  # a folder per part
    first = jvm.java.lang.System.currentTimeMillis() - 1000 * len(parts)
    for k, part in enumerate(parts):
        found = fs.listFiles(jvm.org.apache.hadoop.fs.Path(at, f"__part={part}"), True)
        while found.hasNext():
            fs.setTimes(found.next().getPath(), first + 1000 * k, -1)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", min(files, TAKEN)).option("maxFileAge", "36500d").option("recursiveFileLookup", "true")
    return stream.parquet(path)


def batch_sink(path: str, pick: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a folder by its number, written anew if the batch is tried again, so no row is there twice."""

    def put(df: DataFrame, batch: int) -> None:
        pick(df).write.mode("overwrite").parquet(f"{path}/__batch={batch}")

    return put


def written(spark: SparkSession, path: str) -> DataFrame:
    """What batch_sink() has written."""
    return spark.read.parquet(path).drop("__batch")


def finish(stream: DataFrame, mode: str = "append", pick: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Run a stream over all there is and return what it has put out; in complete mode what it put out last."""
    spark = stream.sparkSession
    path, last = scratch(spark, "stream"), [-1]
    put = batch_sink(f"{path}/out", pick)

    def latest(df: DataFrame, batch: int) -> None:
        put(df, batch)
        last[0] = batch

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(latest).trigger(availableNow=True).start().awaitTermination()
    if last[0] < 0:
        return pick(spark.createDataFrame([], stream.schema))
    return written(spark, f"{path}/out") if mode == "append" else spark.read.parquet(f"{path}/out/__batch={last[0]}")
