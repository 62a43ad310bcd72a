"""The corpus pipeline: stages over documents, each over what the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents;
between stages the documents are written to the shared folder and read again. The last returns the pieces that
packing places. Defined cases are those of the operators: see each module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import exact_dedup, packing, quality_fm, simhash, substring_dedup
from framelake.llm._shared import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores as good."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    return substring_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("substring_dedup", substrings),
    ("packing", pack),
]

#: Four of the stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), ()
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = (name,)
    return STAGES[-1][1](spark, docs, sf_dir)
