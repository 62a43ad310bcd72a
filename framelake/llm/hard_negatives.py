"""Hard negatives by cover trees over norm-augmented rows
(Beygelzimer et al., "Cover trees for nearest neighbor", 2006; augmentation after Bachrach et al., 2014).

A component that completes every row of a tree to the same length M makes inner products a function of distance: for a
query q (its own extra component is 0) the product is (|q|^2 + M^2 - d^2) / 2. Each part of the table holds trees of
at most `TREE` rows of neighbouring labels. Their levels halve the radius: below a node, centres that are farther apart
than the radius cover all its rows within it; groups of few rows aren't divided. A node keeps the radius that its rows
really need and the labels below it, so the products of everything below lie between two bounds.

Search is best first over all trees of a part, for a block of queries at once: the node with the greatest upper bound is
expanded, its centres are scored exactly, and it goes on with the queries whose window [low, high], floor (the k-th
best product so far, first of a bounded sample) and labels the children's bounds reach.

Positives are a search of the same label; each gives a window for a second search of other labels.

Defined cases: see vectors.py; rows with a null label take no part either. A row is never its own positive. Equal
scores are ordered by id. A positive below 0 has an empty window, a positive of 0 the window [0, 0]. Without
anchors, positives or rows in a window there are no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import vectors
from framelake.llm._shared import Scratch
from framelake.llm.vectors import Best, Shape

#: Rows of a tree, and of a group that isn't divided further.
TREE, FEW = 2048, 32


class CoverTree:
    """Nodes (centre, radius, labels below, where its children are listed) and children (row, its node or -1; a centre is its own first child)."""

    def __init__(self, ids, labels, x, nodes, children, longest):
        self.ids, self.labels, self.x, self.nodes, self.children, self.longest = ids, labels, x, nodes, children, longest

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> CoverTree:
        wide = x.astype(np.float64)
        product = wide @ wide.T
        length = np.diagonal(product).copy()
        longest = length.max()
        extra = np.sqrt(longest - length)
        distance = np.sqrt(np.maximum(2 * (longest - product - np.outer(extra, extra)), 0))
        nodes: list[tuple] = []
        children: list[tuple[int, int]] = []
        todo = [(0, np.arange(1, len(ids)), float(distance[0].max()), -1)]  # centre, other rows below, radius of the level, entry to fill in
        while todo:
            centre, below, radius, entry = todo.pop()
            if entry >= 0:
                children[entry] = (centre, len(nodes))
            under = np.append(below, centre)
            nodes.append((centre, float(distance[centre, below].max(initial=0)), int(labels[under].min()), int(labels[under].max()), len(children)))
            rest, about, half = below, centre, radius / 2
            while True:
                near = distance[about, rest] <= half
                mine, rest = rest[near], rest[~near]
                if len(mine) > FEW and half > 1e-6 * radius and nodes[-1][1] > 0:
                    todo.append((about, mine, half, len(children)))
                    children.append((about, -2))
                else:
                    children += [(about, -1), *((int(m), -1) for m in mine)]
                if not len(rest):
                    break
                about, rest = int(rest[0]), rest[1:]
            nodes[-1] = (*nodes[-1], len(children))
        return cls(ids, labels, x, np.array(nodes, np.float64), np.array(children, np.int64), float(longest))

    def dump(self) -> bytes:
        return vectors.dump(ids=self.ids, labels=self.labels, x=self.x, nodes=self.nodes, children=self.children, longest=np.float64(self.longest))

    @classmethod
    def load(cls, x: dict) -> CoverTree:
        return cls(x["ids"], x["labels"], x["x"], x["nodes"], x["children"], float(x["longest"]))

    def bounds(self, score: np.ndarray, length: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product with what lies within radius of centres; score: of the centres, length: squared, of the queries."""
        both = length[:, None] + self.longest
        distance = np.sqrt(np.maximum(both - 2 * score.astype(np.float64), 0))
        slack = 1e-6 * both + 1e-6
        near, far = np.maximum(distance - radius, 0), distance + radius
        return (both - far * far) / 2 - slack, (both - near * near) / 2 + slack


def search(trees: list[CoverTree], block: dict, k: int, same: bool, count: list[int] | None = None) -> Best:
    """The k best rows of each query's window with its label (same) or another one. count: gets the number of products."""
    q, own, asked, high = block["q"], block["id"], block["label"], block["high"]
    length, best, heap, turn = np.einsum("qd,qd->q", q, q, dtype=np.float64), Best(k, block["floor"]), [], 0

    def verify(tree: CoverTree, at: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        good = (score >= best.floor[at][:, None]) & (score <= high[at][:, None]) & ((asked[at][:, None] == tree.labels[rows]) == same) & (own[at][:, None] != tree.ids[rows])
        if good.sum() > 8 * k * len(at):  # raise floors before all these are listed
            best.raise_to(at, np.partition(np.where(good, score, -np.inf), -k, axis=1)[:, -k])
            good &= score >= best.floor[at][:, None]
        i, j = np.nonzero(good)
        best.add(at[i], tree.ids[rows[j]], score[i, j])

    def push(tree: CoverTree, at: np.ndarray, numbers: np.ndarray, score: np.ndarray) -> None:
        nonlocal turn
        radius, least, most = tree.nodes[numbers, 1], tree.nodes[numbers, 2], tree.nodes[numbers, 3]
        low, top = tree.bounds(score, length[at], radius)
        label = asked[at][:, None]
        fits = (label >= least) & (label <= most) if same else ~((label == least) & (label == most))
        fits &= (top >= best.floor[at][:, None]) & (low <= high[at][:, None])
        for c in np.flatnonzero(fits.any(axis=0)).tolist():
            mine, turn = np.flatnonzero(fits[:, c]), turn + 1
            heapq.heappush(heap, (-top[mine, c].max(), turn, tree, int(numbers[c]), at[mine], top[mine, c]))

    everyone = np.arange(len(q))
    for tree in trees:
        root = np.zeros(1, np.int64)
        score = q @ tree.x[root].T
        verify(tree, everyone, root, score)
        if len(tree.ids) > 1:
            push(tree, everyone, root, score)
    while heap:
        _, _, tree, node, at, top = heapq.heappop(heap)
        at = at[top >= best.floor[at]]
        if not len(at):
            continue
        centre, first, end = (int(tree.nodes[node, c]) for c in (0, 4, 5))
        rows, below = tree.children[first:end].T
        score = q[at] @ tree.x[rows].T
        if count is not None:
            count[0] += score.size
        new = rows != centre  # the centre itself was scored with its parent
        verify(tree, at, rows[new], score[:, new])
        inner = np.flatnonzero(below >= 0)
        if len(inner):
            push(tree, at, below[inner], score[:, inner])
        if best.size > k * len(q) or len(best.lists[0]) > 256:  # floors rise
            best.settle()
    return best


def build(items: DataFrame, shape: Shape, n: int) -> DataFrame:
    """part, data: the trees of each part, over rows of neighbouring labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            tree = CoverTree.build(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([tree.dump()], pa.binary())], names=["part", "data"])

        for batch in batches:
            part, ids, labels = (batch.column(k).to_numpy() for k in range(3))
            at = 0
            while at < len(part):
                if size and (part[at] != now or size == TREE):
                    yield out()
                    held, size = [], 0
                now = int(part[at])
                end = min(int(np.searchsorted(part, now, side="right")), at + TREE - size)
                held.append((ids[at:end], labels[at:end], shape.matrix(batch.column(3).slice(at, end - at))))
                size, at = size + end - at, end
        if size:
            yield out()

    dealt = items.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("long").alias("part"), "id", "label", "v")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "label", "id").mapInArrow(run, "part long, data binary")


def mine(rows: DataFrame, label: Column, every: int = 50, scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`. Negatives have least to most hundredths of the positive's score.
    """
    scratch = Scratch(rows.sparkSession, "hard-negatives")
    items = scratch.cut(vectors.scaled(rows.withColumn("__label", label), scale, id_col, vec_col, "__label"), "items")
    shape = Shape(items)
    n = shape.parts()
    trees = scratch.cut(build(items, shape, n), "trees")
    seen = vectors.sample(items.select("id", "label", "v"))
    order = np.argsort(seen.column("label").to_numpy(), kind="stable")
    seen = seen.take(pa.array(order))
    columns = seen.column("id").to_numpy(), seen.column("label").to_numpy(), shape.matrix(seen.column("v").combine_chunks())
    first = [CoverTree.build(*(c[a : a + TREE] for c in columns)) for a in range(0, len(seen), TREE)]

    def run(queries: DataFrame, keys: list[str], k: int, same: bool) -> DataFrame:
        def floors(block: dict) -> np.ndarray:
            best = search(first, block | {"floor": block["low"]}, k, same)
            best.settle()
            return best.floor

        asked = vectors.blocks(queries, keys, shape, floors, n, (shape.rows // every + 1) * (1 if same else positives))
        return vectors.ranked(vectors.streamed(trees, asked, n, keys, lambda part, block: search(part, block, k, same), CoverTree.load), keys, k)

    anchors = items.where(F.col("id") % every == 0).select("id", "label", "v")
    lowest, highest = (F.lit(x).cast("double") for x in ("-Infinity", "Infinity"))
    near = run(anchors.withColumns({"low": lowest, "high": highest}), ["id"], positives, True)
    near = scratch.cut(near.select("id", F.col("other").alias("positive"), F.col("score").alias("reached")), "positives")
    # least * p <= 100 * n <= most * p, rounded to whole n
    low, high = F.expr(f"({least} * reached + 99) div 100"), F.expr(f"{most} * reached div 100")
    windows = near.where("reached >= 0").join(anchors, "id").withColumns({"low": low.cast("double"), "high": high.cast("double")})
    far = run(windows, ["id", "positive", "reached"], negatives, False)
    return far.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("reached").alias("positive_score"), F.col("score").alias("negative_score"))
