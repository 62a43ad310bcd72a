"""Exact top-k search by inner product: columnar branch and bound over a vertical layout
(after de Vries et al., "Efficient k-NN search on vertically decomposed data", 2002).

An index part holds its rows by blocks of dimensions, with each block's squared lengths. A block of queries
accumulates scores one block of dimensions after another, those with the most mass first. After each, what is left can
add at most the product of the remaining lengths of query and row (Cauchy-Schwarz); pairs that can't reach the
query's floor any more are dropped, and once few are left, the survivors are compacted to a list of pairs, so later
blocks of dimensions are read for them alone. The floor is the k-th best score seen so far, first of a bounded sample.

Every query meets every part; parts are read once, blocks of queries stream by.

Defined cases: see vectors.py. A query's own row is no candidate. Of equal scores the smaller id comes first.
With fewer than k candidates all are returned; a table without queries gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import vectors
from framelake.llm._shared import Scratch
from framelake.llm.vectors import Best, Shape

#: Dimensions of a block, queries that advance together, share of pairs alive below which they are compacted.
DIMENSIONS, TOGETHER, COMPACT = 8, 64, 0.25


class Vertical:
    """Rows by blocks of dimensions: ids, blocks (dimensions x rows) and what each block adds to a row's squared length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, starts = ids, range(0, max(x.shape[1], 1), DIMENSIONS)
        self.blocks = [np.ascontiguousarray(x[:, a : a + DIMENSIONS].T) for a in starts]
        self.mass = np.array([np.einsum("dn,dn->n", b, b, dtype=np.float64) for b in self.blocks])


def _answer(part: Vertical, best: Best, own: np.ndarray, q: np.ndarray, at: np.ndarray) -> None:
    """Adds what the queries at `at` (places in the block; q: their vectors) find in a part."""
    cuts = [q[:, a : a + DIMENSIONS] for a in range(0, max(q.shape[1], 1), DIMENSIONS)]
    asked = np.array([np.einsum("qd,qd->q", c, c, dtype=np.float64) for c in cuts])
    order = np.argsort(-(asked.sum(axis=1) * part.mass.mean(axis=1)), kind="stable")
    left_x, left_q = part.mass.sum(axis=0), asked.sum(axis=0)
    slack = 1e-6 * (1 + np.sqrt(left_q.max(initial=0) * left_x.max(initial=0)))
    floor = best.floor[at] - slack
    score = np.zeros((len(q), len(part.ids)), q.dtype)
    for done, k in enumerate(order):
        score += cuts[k] @ part.blocks[k]
        left_x, left_q = np.maximum(left_x - part.mass[k], 0), np.maximum(left_q - asked[k], 0)
        alive = score + np.sqrt(left_q)[:, None] * np.sqrt(left_x) >= floor[:, None]
        if alive.mean() <= COMPACT:
            break
    i, j = np.nonzero(alive & (own[:, None] != part.ids))
    some = score[i, j]
    for k in order[done + 1 :]:
        some = some + np.einsum("pd,pd->p", cuts[k][i], part.blocks[k].T[j])
        left_x, left_q = np.maximum(left_x - part.mass[k], 0), np.maximum(left_q - asked[k], 0)
        kept = some + np.sqrt(left_q[i] * left_x[j]) >= floor[i]
        i, j, some = i[kept], j[kept], some[kept]
    best.add(at[i], part.ids[j], some)


def search(parts: list[Vertical], block: dict, k: int) -> Best:
    best, q = Best(k, block["floor"]), block["q"]
    for part in parts:
        if len(part.ids):
            for a in range(0, len(q), TOGETHER):
                at = np.arange(a, min(a + TOGETHER, len(q)))
                _answer(part, best, block["id"][at], q[at], at)
            best.settle()
    return best


def build(items: DataFrame, shape: Shape, n: int) -> DataFrame:
    """part, data: the vertical layout of each part, in pieces of 8,192 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, size = None, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([vectors.dump(ids=np.concatenate(ids), x=np.concatenate(rows))], pa.binary())], names=["part", "data"])

        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
                if size and (part[a] != now or size >= 8192):
                    yield out()
                    ids, rows, size = [], [], 0
                now = int(part[a])
                ids.append(batch.column(1).to_numpy()[a:b])
                rows.append(shape.matrix(batch.column(2).slice(a, b - a)))
                size += b - a
        if size:
            yield out()

    dealt = items.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("long").alias("part"), "id", "v")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "id").mapInArrow(run, "part long, data binary")


def top_k(rows: DataFrame, every: int = 100, scale: int = 1024, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id is divisible by `every`."""
    scratch = Scratch(rows.sparkSession, "top-k")
    items = scratch.cut(vectors.scaled(rows, scale, id_col, vec_col), "items")
    shape = Shape(items)
    n = shape.parts()
    index = scratch.cut(build(items, shape, n), "index")
    seen = vectors.sample(items.select("id", "v"))
    read = lambda x: Vertical(x["ids"], x["x"])
    first = [Vertical(seen.column("id").to_numpy(), shape.matrix(seen.column("v").combine_chunks()))] if len(seen) else []

    def floors(block: dict) -> np.ndarray:
        best = search(first, block | {"floor": block["low"]}, k)
        best.settle()
        return best.floor

    lowest, highest = (F.lit(x).cast("double") for x in ("-Infinity", "Infinity"))
    queries = items.where(F.col("id") % every == 0).select("id", F.lit(0).cast("long").alias("label"), "v", lowest.alias("low"), highest.alias("high"))
    found = vectors.streamed(index, vectors.blocks(queries, ["id"], shape, floors, n, shape.rows // every + 1), n, ["id"], lambda parts, block: search(parts, block, k), read)
    return vectors.ranked(found, ["id"], k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")
