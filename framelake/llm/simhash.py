"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of m equal segments. If two fingerprints differ in at most t bits, some
segment starts a chain whose first l segments differ in at most l * t / m bits for every l (Qin and Xiao,
"Pigeonring: A Principle for Faster Thresholded Similarity Search", 2018). While l * t / m < 1 the chain must
be equal, which gives the key of an equi-join, one key per start; the longer prefixes of the chain prune the
pairs in the join condition, and the full Hamming check comes last.

Fingerprints are first made distinct, so copies never form pairs. A key with more than `bucket` distinct
fingerprints isn't paired at all: its fingerprints are linked exactly by common neighbours (two of them differ
in at most 2 bits if and only if flipping at most one bit of each gives a common value), 65 rows each and at
most 65 to a value. That needs t <= 2, which is checked.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other. One
or two words are one shingle. Equal doc_ids are one document if their fingerprints agree; rows with a null
doc_id link like any other and get a component_id if a linked document has one. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._shared import cut, row_hash, text_or_empty
from framelake.llm.components import connected_components

BITS = 64


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text as an unsigned number."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the columns to keep."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("fp"), *keep).schema

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *batch.columns[2:]], names=schema.names)

    return rows.mapInArrow(run, schema)


def _chains(fps: DataFrame, segments: int, distance: int) -> DataFrame:
    """A row per fingerprint and start: key (start and the segments that must be equal), fp, rot (the ring read from the start)."""
    step = BITS // segments
    equal = -(-segments // distance) - 1
    starts = []
    for r in range(segments):
        rot = F.col("fp") if r == 0 else F.shiftleft("fp", r * step).bitwiseOR(F.shiftrightunsigned("fp", BITS - r * step))
        starts.append(F.struct(F.lit(r).alias("r"), rot.alias("rot")))
    each = fps.select("fp", "node", F.explode(F.array(*starts)).alias("s"))
    key = F.shiftrightunsigned("s.rot", BITS - equal * step).bitwiseXOR(F.shiftleft(F.col("s.r").cast("long"), equal * step))
    return each.select(key.alias("key"), "node", F.col("s.rot").alias("rot"))


def _within(a: Column, b: Column, segments: int, distance: int) -> Column:
    """The chain condition for every length, shortest first, then the full check."""
    step, diff, ok = BITS // segments, a.bitwiseXOR(b), F.lit(True)
    for quota in range(distance):
        longest = max(n for n in range(1, segments + 1) if n * distance // segments == quota)
        ok = ok & (F.bit_count(F.shiftrightunsigned(diff, BITS - longest * step)) <= quota)
    return ok & (F.bit_count(diff) <= distance)


def links(fps: DataFrame, distance: int = 2, segments: int = 8, bucket: int = 512) -> DataFrame:
    """fps: fp (distinct), node. Returns u, v: enough of the pairs within distance to connect all that such pairs connect."""
    if not 1 <= distance <= 2 or BITS % segments or -(-segments // distance) - 1 < 1:
        raise ValueError("1 or 2 differing bits, and segments that divide 64 and outnumber them")
    keys = _chains(fps, segments, distance)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keys.join(sizes, "key"), "chains")
    few = shared.where(F.col("n") <= bucket)
    a, b = few.select("key", F.col("node").alias("u"), F.col("rot").alias("ru")), few.select("key", F.col("node").alias("v"), F.col("rot").alias("rv"))
    pairs = a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & _within(F.col("ru"), F.col("rv"), segments, distance)).select("u", "v")
    many = fps.join(shared.where(F.col("n") > bucket).select("node").distinct(), "node", "left_semi")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)])
    stars = many.select("node", F.explode(flips).alias("value")).groupBy("value").agg(F.collect_set("node").alias("all")).where(F.size("all") > 1)
    near = stars.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u <> v")
    return pairs.union(near)


def components_of(rows: DataFrame, distance: int, segments: int, bucket: int) -> DataFrame:
    """rows: doc_id, fp. fp, group (the smallest fingerprint that links reach) and component_id (the smallest doc_id) for each fingerprint."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    merged = connected_components(links(distinct.select("fp", F.col("fp").alias("node")), distance, segments, bucket)).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    members = distinct.join(merged, "fp")
    linked = members.select("fp", "group").join(members.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    alone = distinct.join(merged.select("fp"), "fp", "left_anti")
    return linked.select("fp", "group", "component_id").unionByName(alone.select("fp", F.col("fp").alias("group"), F.col("least").alias("component_id")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, segments: int = 8, bucket: int = 512, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) for every row of docs."""
    rows = cut(fingerprints(docs, id_col, text_col, width), "fingerprints")
    by_fp = components_of(rows, distance, segments, bucket).select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: of those with the smallest doc_id the longest text, then the smallest hash.

    Decided by row: rows that share a doc_id with another text stay or go with their own group, and a group without
    any doc_id keeps one row as well.
    """
    rows = fingerprints(docs.withColumns({"__row": row_hash(docs), "__n": F.length(text_or_empty()).cast("long")}), keep=("__row", "__n"))
    rows = cut(rows, "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"), (-F.col("__n")).alias("n"), F.col("__row").alias("row")))
    # A row per fingerprint first: only those of a group meet.
    leaders = rows.groupBy("fp").agg(best.alias("b")).join(components_of(rows, 2, 8, 512), "fp").groupBy("group").agg(F.min("b").alias("b"))
    stays = leaders.select(F.col("b.row").alias("__row"))
    return docs.withColumn("__row", row_hash(docs)).join(stays, "__row", "left_semi").dropDuplicates(["__row", "doc_id"]).select(*docs.columns)
