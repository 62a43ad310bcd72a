"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one leader per digest
(partial aggregation first, so a group of copies of any size becomes one row per task before the shuffle).
Leaders whose digest the index lacks are found by a sort-merge anti-join and appended as new; those that it has are
appended as sightings, in the same write. Neither join moves the index: it is read by buckets. The index's view of
a digest merges its rows: its leader and the size of its group. A call takes its documents in `batches` parts through
the index, so that every part but the first meets the digests of others.

Rows find their leader by their digest. Groups with over a thousandth of all rows are fewer than a thousand, so
their leaders are broadcast and their rows stay where they are; all others are joined by a shuffle.
Only DataFrame functions are used.

Defined cases: a null text counts as empty; all empty texts are one group. Of equal texts the longest
original (code points) stays, then the smallest doc_id; a null doc_id comes after all others. Rows that
repeat a doc_id and its text are the same document: each gets the row of that document. Texts that an
earlier run has published stay with that run's keep_id. A part of a run that the index has already is not added
again, so a run can be repeated under its number. Other columns are ignored by the operator.
keep_first() decides by row: one row of each group of equal texts stays whatever the ids are, those with a null or a
repeated doc_id too; of rows that agree in length and id, that with the smallest hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm._shared import SPACE, Scratch, remove, row_hash, shared_path, text_or_empty

BATCHES, HOT_SHARE = 2, 1000


def normalised_digest(text_col: str = "text") -> Column:
    """SHA-256 of the text without white space, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), f"{SPACE}+", ""), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_chars (of the original), row (hash of the row)."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        normalised_digest(text_col).alias("digest"),
        F.length(text_or_empty(text_col)).cast("long").alias("n_chars"),
        row_hash(docs).alias("row"),
    )


def leaders(digested: DataFrame) -> DataFrame:
    """One row per digest: the document that stays and the size of its group."""
    first = F.min(F.struct((-F.col("n_chars")).alias("o"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    return digested.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.o")).alias("n_chars"), "group_size", F.col("first.row").alias("row")
    )


class DigestIndex:
    """A persistent set of digests.

    Rows: digest; keep_id, n_chars, group_size, row (the leader of a part and the size of its group there); run and part;
    new (the first row of its digest).
    """

    COLUMNS = "digest BINARY, keep_id BIGINT, n_chars BIGINT, group_size BIGINT, row BIGINT, run BIGINT, part BIGINT, new BOOLEAN"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, name: str | None = None):
        """path: a folder in shared storage, new or holding an index. buckets: fixed when the index is made."""
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"digest_index_{uuid.uuid4().hex}"

    def attach(self) -> DigestIndex:
        """Make the index, new or of an earlier session, known to this one."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self

    def detach(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def next_run(self) -> int:
        last = self.spark.table(self.name).agg(F.max("run")).first()[0]
        return 0 if last is None else last + 1

    def append(self, batch: DataFrame, run: int = 0, part: int = 0) -> None:
        """batch: leaders(), added in one write unless the index has this part of this run already."""
        known = self.spark.table(self.name)
        if not known.where((F.col("run") == run) & (F.col("part") == part)).isEmpty():
            return
        held = known.where("new").select("digest").hint("merge")
        added = batch.join(held, "digest", "left_anti").withColumn("new", F.lit(True)).unionByName(batch.join(held, "digest", "left_semi").withColumn("new", F.lit(False)))
        rows = added.withColumns({"run": F.lit(run).cast("long"), "part": F.lit(part).cast("long")}).select(*known.columns)
        # Rows of a batch are one file per bucket.
        rows.repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        """digest, keep_id, n_chars, group_size, row: a row per digest. The leader is of the earliest run, there of the longest text."""
        first = F.min(F.struct("run", (-F.col("n_chars")).alias("o"), F.col("keep_id").isNull().alias("u"), F.col("keep_id").alias("keep_id"), F.col("row").alias("row")))
        return self.spark.table(self.name).groupBy("digest").agg(first.alias("first"), F.sum("group_size").alias("group_size")).select(
            "digest", F.col("first.keep_id").alias("keep_id"), (-F.col("first.o")).alias("n_chars"), "group_size", F.col("first.row").alias("row")
        )


def publish(docs: DataFrame, index: DigestIndex | None = None, run: int | None = None, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Takes docs through the index (a new one if none is given). digests() of docs, and the index's rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    own = index is None
    index = (index or DigestIndex(spark, shared_path(spark, "digest-index"))).attach()
    rows = scratch.cut(digests(docs, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(batches))), "digests")
    number = index.next_run() if run is None else run
    for part in range(batches):
        index.append(scratch.cut(leaders(rows.where(F.col("part") == part)), f"batch-{part}"), number, part)
        scratch.drop(f"batch-{part}")
    known = scratch.cut(index.read(), "leaders")
    if own:
        index.detach()
        remove(spark, index.path)
    return rows, known


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, run: int | None = None, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; new texts go into the index."""
    rows, known = publish(docs, index, run, batches, id_col, text_col)
    total = known.agg(F.sum("group_size")).first()[0] or 0
    found = known.select("digest", "keep_id", "group_size")
    hot = F.broadcast(found.where(F.col("group_size") * HOT_SHARE > total))  # fewer than HOT_SHARE rows
    others = rows.join(hot.select("digest"), "digest", "left_anti").join(found.where(F.col("group_size") * HOT_SHARE <= total), "digest")
    return rows.join(hot, "digest").select(*others.columns).unionByName(others).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns: one of each group of equal texts."""
    _, known = publish(docs)
    # Joined by digest and row: the copies of a text, which differ in their ids, are spread over the tasks.
    keyed = docs.withColumns({"__digest": normalised_digest(), "__row": row_hash(docs)})
    stays = known.select(F.col("digest").alias("__digest"), F.col("row").alias("__row"))
    return keyed.join(stays, ["__digest", "__row"], "left_semi").dropDuplicates(["__digest", "__row"]).select(*docs.columns)
