"""Vectors as rows of integers: what takes part, exact products, and a stated query set that streams by parts of an index.

Products are computed by BLAS in the narrowest type in which all partial sums are exact integers.

Defined cases: rows with a null id, a null vector, or a null, non-finite or (scaled) beyond 2 ** 26 component take no
part. Rows that repeat an id count once, with the smallest of their values. Shorter vectors are as if zeros followed.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 26
#: Rows that give first floors of the queries (a bound on what is sent to the driver), queries of a block, rows of a part.
SAMPLE, BLOCK, PART = 4096, 512, 1 << 16


def scaled(rows: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """id, label (if asked for; never null), v (components times scale, rounded down), n2 (squared length)."""
    x = F.col(vec_col)
    fits = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double") * scale) < LARGEST, F.lit(False)))
    named = [F.col(label_col).cast("long").alias("label")] if label_col else []
    whole = rows.select(F.col(id_col).cast("long").alias("id"), *named, F.when(fits, F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int"))).alias("v")).dropna()
    names = [c for c in whole.columns if c != "id"]
    once = whole.groupBy("id").agg(F.min(F.struct(*names)).alias("s")).select("id", *(f"s.{c}" for c in names))
    return once.withColumn("n2", F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e.cast("long") * e.cast("long")))


class Shape:
    """What a table of scaled() is like: rows, components, and the type in which products of its rows are exact."""

    def __init__(self, items: DataFrame):
        n, width, most = items.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("n2")).first()
        self.rows, self.width = n, width or 0
        self.kind = np.float32 if (most or 0) < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def parts(self, part: int = PART) -> int:
        """Parts of an index: of `part` rows at most on average, and some for every core of a small table."""
        return max(-(-self.rows // part), min(-(-self.rows // 1024), 32), 1)

    def matrix(self, column: pa.ListArray) -> np.ndarray:
        sizes = np.diff(column.offsets.to_numpy())
        values, out = column.flatten().to_numpy(), np.zeros((len(sizes), self.width), self.kind)
        if (sizes == self.width).all():
            return values.reshape(len(sizes), self.width).astype(self.kind)
        out[np.arange(self.width) < sizes[:, None]] = values
        return out


def dump(**arrays: np.ndarray) -> bytes:
    import zstandard

    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def load(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    return dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))))


class Best:
    """The k best (score, smaller id first) of each query of a block, and floors below which a score is of no use."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float64)
        self.lists: list[list[np.ndarray]] = [[], [], []]
        self.size = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for column, x in zip(self.lists, (query, ids, score), strict=True):
            column.append(x)
        self.size += len(query)
        if self.size > 1 << 17:
            self.settle()

    def raise_to(self, query: np.ndarray, kth: np.ndarray) -> None:
        kth = kth.astype(np.float64)
        kth = np.where(np.abs(kth) < 2.0**53, kth, np.nextafter(kth, -np.inf))  # beyond, a double may be more than the score was
        self.floor[query] = np.maximum(self.floor[query], kth)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in self.lists)
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        last = place == self.k - 1
        self.raise_to(query[last], score[last])
        kept = place < self.k
        query, ids, score = query[kept], ids[kept], score[kept]
        self.lists, self.size = [[query], [ids], [score]], 0  # what is kept is small
        return query, ids, score


def blocks(queries: DataFrame, keys: Sequence[str], shape: Shape, floors: Callable[[dict], np.ndarray], n: int, about: int, block: int = BLOCK) -> DataFrame:
    """queries: keys (long; id is one), label, v, low, high. A row (part, kind 1, data) for each block of queries and each of n parts of an index.

    floors(block) -> a floor for each of its queries. about: how many queries there are.
    """
    rows = queries.select(*keys, "label", "v", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                one = {k: some.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "label", "low", "high")} | {"q": shape.matrix(some.column("v"))}
                one["floor"] = np.maximum(one["low"], floors(one))
                yield pa.RecordBatch.from_arrays([pa.array([dump(**one)], pa.binary())], names=["data"])

    packed = rows.repartition(max(1, -(-about // block)), *keys).sortWithinPartitions("label", *keys).mapInArrow(run, "data binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return packed.select("data", every.alias("part")).select("part", F.lit(1).alias("kind"), "data")


def streamed(index: DataFrame, asked: DataFrame, n: int, keys: Sequence[str], search: Callable[[list, dict], Best], read: Callable[[dict], object]) -> DataFrame:
    """index: part, data; asked: blocks(). keys, other, score of what search(pieces of the part, block) finds. A part is held once, and all blocks stream by it."""
    names = [*keys, "other", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == 0:
                    if part != now:
                        now, held = part, []
                    held.append(read(load(data.as_py())))
                elif part == now:
                    block = load(data.as_py())
                    query, ids, score = search(held, block).settle()
                    yield pa.RecordBatch.from_arrays([*(pa.array(block[k][query]) for k in keys), pa.array(ids.astype(np.int64)), pa.array(score.astype(np.int64))], names=names)

    both = index.select("part", F.lit(0).alias("kind"), "data").union(asked)
    return both.repartition(n, "part").sortWithinPartitions("part", "kind").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def sample(items: DataFrame, most: int = SAMPLE) -> pa.Table:
    """At most `most` rows, chosen by the hashes of their ids. They only give floors: all rows are searched."""
    return items.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()


def ranked(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """found: keys, other, score. With rank (int, from 1) of the k best of each query."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
