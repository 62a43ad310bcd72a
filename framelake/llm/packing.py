"""Packing by shortest-pack-first over the length histogram
(Krell et al., "Efficient Sequence Packing without Cross-contamination", 2021).

Documents become token ids plus an end id and are cut into whole sequences and a rest. Only the histogram of
piece lengths (at most `size` rows) goes to the driver. There lengths are placed longest first into the open
packs with the fewest tokens, whole counts at a time, which gives packing patterns with counts. Each pattern
takes a range of ranks of each of its lengths; pieces find theirs by their rank among pieces of equal length.
Ranks are counted within parts of each length, of at most about PART pieces, and added up, so a length that a
third of all documents share is spread over many tasks. The pattern table is small by construction: a length
adds at most three patterns.

Defined cases: a null or empty text is the end id alone. Documents with equal ids are packed one by one. A
null doc_id is packed like any other.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm._shared import cut
from framelake.llm.bpe import encoder, vocabulary

PART = 250_000


def pieces(docs: DataFrame, tokenizer: str, ranks: str, size: int = 1024, end: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [rows.schema["doc_id"], *(T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens"))]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] * with_ids)
    tail, long = end.to_bytes(4, "little"), pa.int64()

    def run(batches):
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            which, start, length, crc, total, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "") + tail
                n = len(data) // 4
                for at in range(0, n, size):
                    part = data[4 * at : 4 * (at + size)]
                    which.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(memoryview(part).cast("I").tolist())
            out = [batch.column(0).take(pa.array(which, long)), *(pa.array(x, long) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=schema.names)

    return rows.mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how often each is used; together they hold every piece of the histogram."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            used = min((u for u, kept in packs.items() if kept and u + length <= size), default=None)
            if used is None:
                each = min(size // length, left)
                pattern, n = (length,) * each, left // each
                packs[each * length].append((pattern, n))
                left -= n * each
                continue
            pattern, n = packs[used].pop()
            room = min((size - used) // length, left)  # as many as the shortest pack takes
            n_now = min(n, left // room)
            if n > n_now:
                packs[used].append((pattern, n - n_now))
            packs[used + room * length].append((pattern + (length,) * room, n_now))
            left -= n_now * room
    return [x for used in sorted(packs, reverse=True) for x in packs[used]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first rank, end of ranks, pieces to a sequence, first sequence, first offset: one row for each length of each pattern."""
    out, rank, sequence = [], defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            out.append((length, rank[length], rank[length] + n * each, each, sequence, offset))
            rank[length] += n * each
            offset += each * length
        sequence += n
    return out


def pack(parts: DataFrame, size: int = 1024) -> DataFrame:
    """parts: pieces(), written before. Adds sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(slots(pack_histogram(counts, size)), "l long, lo long, hi long, each long, s0 long, o0 long")
    n_parts = max(1, -(-sum(counts.values()) // PART))
    keyed = parts.withColumn("__part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_parts)))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n")).select("length", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__part").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.join(base, ["length", "__part"]).withColumn("__rank", F.col("__base") + F.row_number().over(within) - 1)
    at = F.col("__rank") - F.col("lo")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("l")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    return placed.select(*parts.columns, (F.col("s0") + F.floor(at / F.col("each")).cast("long")).alias("sequence_id"), (F.col("o0") + (at % F.col("each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, size: int = 1024, end: int = 0, with_ids: bool = False, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids), sequence_id, offset: a row per piece."""
    parts = pieces(docs, tokenizer or vocabulary("byte_bpe_50k.json"), ranks or vocabulary("byte_bpe_50k.tiktoken"), size, end, with_ids)
    return pack(cut(parts, "pieces"), size)
