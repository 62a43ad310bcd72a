"""Prefix trie of conversations, with count-min screening of prefix digests.

A conversation's prefixes get digests: two 64-bit sums (exclusive or) of the hashes of (position, turn), so a
prefix's digest follows from the one before and no text is carried on. A count-min sketch of all digests is filled part
by part and merged; what is kept of it is a bit per cell, whether two prefixes or more fell into it. A prefix with a cell of
its own is proven to belong to one conversation, and so do all that extend it: this tail's nodes are emitted where
they are. Only prefixes that the sketch can't prove single are shuffled and grouped exactly. A sketch that is too
small for the data proves less; it never changes a result.

Sums over subtrees need no walk through the trie: each node gives what it adds to its smallest member, at its depth. A member
row of a node then takes what its own conversation was given at the node's depth or below, and one more
aggregation over the members of each node adds these up. Both aggregations are partial before they shuffle. The ids of
conversations that end at a node are joined in order in chunks of neighbouring ids; a node of several chunks is
hashed chunk by chunk as they stream by in order.

Defined cases: rows with a null conv_id take no part. Null roles and texts are empty. Turns are ordered by number, null
first; rows of equal number by the hash of role and text, so repeated rows stay repeated turns. A conversation whose
turns are all taken off is a member of the root alone. An empty table has no rows; any other has one root. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm._shared import WORD, Scratch

#: Rows of the sketch, cells of each (a power of two, four for each prefix within these bounds: 12 MB of bits at most), cells of a block.
HASHES, LEAST_CELLS, MOST_CELLS, PIECE = 3, 1 << 16, 1 << 25, 1 << 16
#: Neighbouring conversation ids that are joined at once.
CHUNK = 1024


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv, place (from 1), t1, t2 (hashes of role and text), words of each turn: all that is needed of the texts."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    slim = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    return slim.withColumn("place", F.row_number().over(order)).drop("turn")


def rebuilt(numbered: DataFrame, shared: int = 20, heads: int = 4) -> DataFrame:
    """numbered: numbered_turns(). conv, depth, t1, t2, words: conversation c begins with the first h turns of conversation c - c % shared and goes on
    with its own after its first h, h = crc32(c) % heads. Depth 0 stands for the conversation itself."""
    base, taken = F.col("conv") - F.col("conv") % shared, (F.crc32(F.col("conv").cast("string")) % heads).cast("int")
    own = numbered.where((base == F.col("conv")) | (F.col("place") > taken)).select("conv", F.lit(1).alias("source"), "place", "t1", "t2", "words")
    convs = numbered.where("place = 1").select("conv", base.alias("base"), taken.alias("taken"))
    first = numbered.where(F.col("place") < heads).select(F.col("conv").alias("base"), "place", "t1", "t2", "words")
    borrowed = convs.where("taken > 0 AND base <> conv").join(first, "base").where("place <= taken").select("conv", F.lit(0).alias("source"), "place", "t1", "t2", "words")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", F.lit(-1).alias("source"), F.lit(0).alias("place"), zero.alias("t1"), zero.alias("t2"), zero.alias("words"))
    order = Window.partitionBy("conv").orderBy("source", "place")
    return own.unionByName(borrowed).unionByName(roots).select("conv", (F.row_number().over(order) - 1).alias("depth"), "t1", "t2", "words")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns: rebuilt(). conv, depth, size (depth of the whole conversation), d1, d2 (digest), p1, p2 (digest of the prefix before), words (of the last turn)."""
    so_far = Window.partitionBy("conv").orderBy("depth")
    tags = [F.when(F.col("depth") > 0, F.xxhash64("depth", t)).otherwise(F.lit(0)) for t in ("t1", "t2")]
    d = turns.withColumns({"x1": tags[0], "x2": tags[1]})
    d = d.withColumns({"d1": F.bit_xor("x1").over(so_far), "d2": F.bit_xor("x2").over(so_far), "size": F.max("depth").over(Window.partitionBy("conv"))})
    before = lambda k: F.col(f"d{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}")
    return d.select("conv", "depth", "size", "d1", "d2", before(1), before(2), "words")


def _cells(d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
    """A cell in each row of the sketch (rows follow each other)."""
    a, b = d1.view(np.uint64), d2.view(np.uint64) | np.uint64(1)
    return np.array([((a + np.uint64(k) * b) >> np.uint64(20)) % np.uint64(cells) + np.uint64(k * cells) for k in range(HASHES)]).astype(np.int64)


def sketch(digests: DataFrame, cells: int, tasks: int = 64) -> np.ndarray:
    """digests: d1, d2. Whether two or more of them fell into each cell, as packed bits."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(HASHES * cells, np.uint8)
        for batch in batches:
            for row in _cells(*(batch.column(k).to_numpy() for k in (0, 1)), cells):
                found, n = np.unique(row, return_counts=True)
                counts[found] = np.minimum(counts[found] + np.minimum(n, 2), 2)
        for at in range(0, len(counts), PIECE):
            some = counts[at : at + PIECE]
            if some.any():
                yield packed(at // PIECE, some > 0, some > 1)

    def packed(piece: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        import zstandard

        both = zstandard.ZstdCompressor(level=1).compress(np.packbits(once).tobytes() + np.packbits(twice).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([both], pa.binary())], names=["piece", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, now, once, twice = zstandard.ZstdDecompressor().decompress, None, None, None
        for batch in batches:
            for piece, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some = np.frombuffer(unpack(bits), np.uint8).reshape(2, -1)
                if piece == now:
                    twice |= some[1] | (once & some[0])
                    once |= some[0]
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([twice.tobytes()], pa.binary())], names=["piece", "bits"])
                now, (once, twice) = piece, some.copy()
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([twice.tobytes()], pa.binary())], names=["piece", "bits"])

    pieces = digests.coalesce(tasks).mapInArrow(fill, "piece long, bits binary")
    merged = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece long, bits binary")
    out = np.zeros((HASHES * cells // PIECE, PIECE // 8), np.uint8)
    for row in merged.collect():  # HASHES * MOST_CELLS / 8 bytes at most
        out[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def screened(rows: DataFrame, twice: np.ndarray, cells: int) -> DataFrame:
    """rows: prefixes(). With single and before (whether the prefix, and the one before it, are proven to belong to one conversation)."""
    names = [*rows.columns, "single", "before"]
    places = [rows.columns.index(c) for c in ("d1", "d2", "p1", "p2")]

    def proven(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        at = _cells(d1, d2, cells)
        return (((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1) == 0).any(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, p1, p2 = (batch.column(k).to_numpy() for k in places)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proven(d1, d2)), pa.array(proven(p1, p2))], names=names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", single boolean, before boolean")


def ends(rows: DataFrame) -> DataFrame:
    """rows: depth, d1, d2, conv of conversations that end at a node. depth, d1, d2, hash: of their ids in order, joined by commas."""
    key = ["depth", "d1", "d2"]
    chunk = F.floor(F.col("conv") / CHUNK).cast("long")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = rows.groupBy(*key, chunk.alias("chunk")).agg(joined.alias("ids"))
    counted = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"), F.min("chunk").alias("least"))
    alone = counted.where("n = 1").select(*key, F.sha2("ids", 256).alias("hash"))
    many = chunks.join(counted.where("n > 1").select(*key), key, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        out = lambda: pa.RecordBatch.from_pylist([dict(zip((*key, "hash"), (*now, digest.hexdigest()), strict=True))], pa.schema([("depth", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("hash", pa.string())]))
        for batch in batches:
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    yield out()
                now, digest = node, hashlib.sha256(ids.encode())
        if now:
            yield out()

    ordered = many.repartition(*key).sortWithinPartitions(*key, "chunk").select(*key, "ids")
    return alone.unionByName(ordered.mapInArrow(run, "depth int, d1 long, d2 long, hash string"))


def prefix_trie(rows: DataFrame, shared: int = 20, heads: int = 4, most_cells: int = MOST_CELLS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    rows: conv_id, turn, role, text. Conversations are rebuilt first, see rebuilt().
    """
    scratch, key, zero = Scratch(rows.sparkSession, "trie"), ["depth", "d1", "d2"], F.lit(0).cast("long")
    turns = scratch.cut(numbered_turns(rows), "turns")
    every = scratch.cut(prefixes(rebuilt(turns, shared, heads)), "prefixes")
    scratch.drop("turns")
    n = every.count()
    cells = min(max(1 << (4 * n).bit_length(), LEAST_CELLS), max(most_cells, LEAST_CELLS))
    told = scratch.cut(screened(every, sketch(every.select("d1", "d2"), cells), cells), "screened")
    scratch.drop("prefixes")
    shuffled, tails = told.where("NOT single"), told.where("single")
    # A digest belongs to one depth, since positions are hashed; the root alone has depth 0.
    nodes = shuffled.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("words").alias("words"), F.max("size").alias("deepest"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("before").alias("before")
    )
    nodes = scratch.cut(nodes, "nodes")
    leaf, cost = (F.col("deepest") == F.col("depth")).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    gives = nodes.select(F.col("conv_id").alias("conv"), "depth", leaf.alias("leaf"), cost.alias("cost")).where("leaf > 0 OR cost > 0")
    gives = gives.unionByName(tails.where("depth = size").select("conv", "depth", F.lit(1).cast("long").alias("leaf"), zero.alias("cost")))
    # What a conversation was given at a depth comes before its own row of that depth, so that the running sums hold it.
    nothing = F.lit(None).cast("long")
    both = gives.select("conv", "depth", F.lit(0).alias("kind"), "leaf", "cost", nothing.alias("d1"), nothing.alias("d2")).unionByName(
        shuffled.select("conv", "depth", F.lit(1).alias("kind"), zero.alias("leaf"), zero.alias("cost"), "d1", "d2")
    )
    below = Window.partitionBy("conv").orderBy(F.col("depth").desc(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.withColumns({"leaves": F.sum("leaf").over(below), "saved": F.sum("cost").over(below)}).where("kind = 1").select(*key, "leaves", "saved", zero.alias("children"))
    above = lambda df: df.where("depth > 0 AND NOT before").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    children = above(nodes).unionByName(above(tails)).select("*", zero.alias("leaves"), zero.alias("saved"), F.lit(1).cast("long").alias("children"))
    totals = sums.unionByName(children).groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("leaves", "saved", "children")))
    ended = ends(shuffled.where("depth = size").select(*key, "conv"))
    nobody = hashlib.sha256(b"").hexdigest()
    full = nodes.join(totals, key).join(ended, key, "left").select(
        "conv_id", *key, "p1", "p2", "before", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("hash", F.lit(nobody)).alias("ends_sha256")
    )
    last, one = F.col("depth") == F.col("size"), F.lit(1).cast("long")
    local = tails.select(
        F.col("conv").alias("conv_id"), *key, "p1", "p2", "before", one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(nobody)).alias("ends_sha256"),
    )
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # Below a single prefix, and at the root, the parent is known where the node is.
    alone = F.col("before") | (F.col("depth") == 0)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    known = [df.where(alone).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))) for df in (full, local)]
    asked = full.where(~alone).unionByName(local.where(~alone)).join(parents, ["depth", "p1", "p2"])
    out = [df.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *measures) for df in (*known, asked)]
    return out[0].unionByName(out[1]).unionByName(out[2])
