"""Exact nearest neighbours by indexes: Voronoi cells, pivot tables and segments of bits.

A query set is stated; all rows are searched. No row of the searched side is copied to the queries: queries go to the
parts that can hold an answer.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.storage import cut

#: Pivots (rows of a bounded sample), rows of a part of a cell, pivots of a table.
PIVOTS, PART, TABLE = 128, 20_000, 8
#: Rows that are compared with all pivots at once, rows sent on at once, distances held at once.
STEP, SENT, HELD = 2048, 4096, 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of STEP rows at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def _rows(df: DataFrame, vec: str) -> DataFrame:
    """id, v. Rows without a vector take no part."""
    return df.where(F.col(vec).isNotNull() & F.col("id").isNotNull()).select("id", F.col(vec).cast("array<double>").alias("v"))


def sample_rows(rows: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, by the hashes of their ids."""
    found = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    return np.array(found, float) if found else np.zeros((0, 0))


# Voronoi cells


class Cells:
    """Pivots, how many rows their cells have, and how near and far these are from their pivot."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.between = np.sqrt(np.maximum(self._squared(pivots), 0))
        self.rows, self.near, self.far = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def _squared(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,nd->n", x, x)[:, None] + np.einsum("nd,nd->n", self.pivots, self.pivots) - 2 * x @ self.pivots.T

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self._squared(x), 0))

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """Of distances to all pivots: the nearest cells that together have more than k rows."""
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (held - self.rows[order] <= k) & (self.rows[order] > 0), axis=1)
        return out

    def reached(self, d: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Cells that can hold rows within radius, by the triangle inequality and the hyperplanes between pivots."""
        own = d.argmin(axis=1)
        gap = self.between[own]
        plane = np.divide(d * d - (d.min(axis=1) ** 2)[:, None], 2 * gap, out=np.zeros_like(d), where=gap > 0)
        least = np.maximum(np.maximum(d - self.far, self.near - d), plane)
        return (least <= radius[:, None] + 1e-6) & (self.rows > 0)


def _assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """id, v, cell, d: each row with its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            d = cells.distances(_matrix(batch.column(1)))
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], names=["id", "v", "cell", "d"])

    return rows.mapInArrow(run, "id long, v array<double>, cell int, d double")


def _sent(queries: DataFrame, cells: Cells, k: int, again: bool) -> DataFrame:
    """queries: id, v, radius. id, v, radius, cell, d: a row for each cell that a query goes to, first or (again) after its radius is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            d = cells.distances(_matrix(batch.column(1)))
            goes = cells.first(d, k)
            if again:
                goes = cells.reached(d, batch.column(2).to_numpy()) & ~goes
            to, at = np.nonzero(goes)
            for start in range(0, len(to), SENT):  # a query may go to every cell with its vector
                i, j = to[start : start + SENT], at[start : start + SENT]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns), pa.array(j.astype(np.int32)), pa.array(d[i, j])], names=["id", "v", "radius", "cell", "d"])

    return queries.select("id", "v", "radius").mapInArrow(run, "id long, v array<double>, radius double, cell int, d double")


def _best(q: np.ndarray, own: np.ndarray, at: np.ndarray, radius: np.ndarray, x: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and squared distances of the k nearest rows within radius; rows are sorted by their distance d from the pivot, `at` is the queries'."""
    low, high = np.searchsorted(d, at - radius - 1e-6), np.searchsorted(d, at + radius + 1e-6, side="right")
    a, b = int(low.min(initial=len(d))), int(high.max(initial=0))
    if a >= b:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x, ids, place = x[a:b], ids[a:b], np.arange(a, b)
    square = np.einsum("nd,nd->n", q, q)[:, None] + np.einsum("nd,nd->n", x, x) - 2 * q @ x.T
    square[(place < low[:, None]) | (place >= high[:, None]) | (own[:, None] == ids)] = np.inf
    kth = np.partition(square, min(k, b - a) - 1, axis=1)[:, min(k, b - a) - 1]
    i, j = np.nonzero((square <= np.minimum(kth, radius * radius)[:, None] + 1e-6) & np.isfinite(square))
    exact = np.zeros(len(i))
    for c in range(x.shape[1]):
        exact += (q[i, c] - x[j, c]) ** 2
    exact = exact.round(digits)
    order = np.lexsort((ids[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], ids[j[kept]], exact[kept]


def _searched(asked: DataFrame, rows: DataFrame, k: int, digits: int) -> DataFrame:
    """asked: id, v, radius, cell, part, d; rows: id, v, cell, part, d. q, t, d2: the k nearest of each part that a query goes to. A part is held, its queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            cell, part, kind = (batch.column(c).to_numpy() for c in range(3))
            edge = np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) if len(cell) else np.zeros(0, bool)
            cuts = np.flatnonzero(edge).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                if (cell[a], part[a]) != now:
                    now, held, table = (cell[a], part[a]), [], None
                ids, v, d, radius = (batch.column(c).slice(a, b - a) for c in range(3, 7))
                if kind[a] == 0:
                    held.append((_matrix(v), ids.to_numpy(), d.to_numpy()))
                    continue
                if table is None and held:
                    table, held = tuple(np.concatenate(c) for c in zip(*held, strict=True)), []
                if table is None:
                    continue
                some = max(1, HELD // len(table[1]))
                q, own, at, reach = _matrix(v), ids.to_numpy(), d.to_numpy(), radius.to_numpy()
                for c in range(0, len(q), some):
                    here = slice(c, c + some)
                    i, t, d2 = _best(q[here], own[here], at[here], reach[here], *table, k, digits)
                    yield pa.RecordBatch.from_arrays([pa.array(own[here][i]), pa.array(t), pa.array(d2)], names=["q", "t", "d2"])

    columns = lambda df, kind, radius: df.select("cell", "part", F.lit(kind).alias("kind"), "id", "v", "d", radius.alias("radius"))
    both = columns(rows, 0, F.lit(None).cast("double")).union(columns(asked, 1, F.col("radius")))
    return both.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "d").mapInArrow(run, "q long, t long, d2 double")


class VoronoiIndex:
    """rows: id and a vector. Each row is written with its nearest pivot of a bounded sample; cells of many rows are dealt into parts."""

    def __init__(self, rows: DataFrame, vec: str, pivots: int = PIVOTS, part: int = PART):
        rows = _rows(rows, vec)
        self.cells = Cells(sample_rows(rows, pivots))
        if not len(self.cells.pivots):
            self.table = None
            return
        table = cut(_assigned(rows, self.cells), "cells")
        stats = table.groupBy("cell").agg(F.count(F.lit(1)), F.min("d"), F.max("d")).collect()  # a row for a pivot
        for cell, n, near, far in stats:
            self.cells.rows[cell], self.cells.near[cell], self.cells.far[cell] = n, near, far
        self.parts = F.array(*(F.lit(max(1, -(-int(n) // part))) for n in self.cells.rows))
        deal = F.pmod(F.xxhash64("id"), F.get(self.parts, F.col("cell")).cast("long")).cast("int")
        self.table = table.withColumn("part", deal)

    def sent(self, queries: DataFrame, k: int, again: bool) -> DataFrame:
        sent = _sent(queries, self.cells, k, again)
        return sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(self.parts, F.col("cell")) - 1)))

    def nearest(self, query: DataFrame, vec: str, k: int, digits: int = 9) -> DataFrame:
        """q, t, d2 (rounded), r: the k nearest other rows of each query, ties by id.

        A first round over the nearest cells bounds the distance of the k-th; a second goes to the cells within it.
        """
        queries = _rows(query, vec)
        if self.table is None:
            return query.sparkSession.createDataFrame([], "q long, t long, d2 double, r int")
        first = cut(_searched(self.sent(queries.withColumn("radius", F.lit(float("inf"))), k, False), self.table, k, digits), "first")
        order = Window.partitionBy("q").orderBy("d2", "t")
        kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("q").alias("id"), F.sqrt("d2").alias("radius"))
        bounded = queries.join(kth, "id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
        second = _searched(self.sent(bounded, k, True), self.table, k, digits)
        return first.union(second).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


# Pivot tables


def _spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of a sample that are far apart in L1, the first one first."""
    chosen = [0] if len(sample) else []
    least = np.full(len(sample), np.inf)
    while chosen and len(chosen) < min(most, len(sample)):
        least = np.minimum(least, np.abs(sample - sample[chosen[-1]]).sum(axis=1))
        chosen.append(int(least.argmax()))
    return sample[chosen]


def _tabled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows: id, v. With d0, d1, ...: the L1 distances to the pivots."""
    names = ["id", "v", *(f"d{k}" for k in range(len(pivots)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.abs(x - p).sum(axis=1)) for p in pivots)], names=names)

    return rows.mapInArrow(run, "id long, v array<double>, " + ", ".join(f"{n} double" for n in names[2:]))


def _l1_tables(query: DataFrame, train: DataFrame, max_dist: float, vec: str, pivots: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with their distances to pivots (the names), queries with their reach: max_dist, or the distance of the nearest pivot (pivots are rows) if that is less."""
    q, t = _rows(query, vec), _rows(train, vec)
    chosen = _spread(sample_rows(t, 512), pivots)
    names = [f"d{k}" for k in range(len(chosen))]
    if not names:
        return q, t, names
    # A pivot at distance 0 may be the query's own row, so it bounds nothing.
    near = F.array_min(F.filter(F.array(*names), lambda d: d > 1e-9))
    return _tabled(q, chosen).withColumn("reach", F.least(F.lit(float(max_dist)), near) + 1e-6), _tabled(t, chosen), names


def l1_candidates(query: DataFrame, train: DataFrame, max_dist: float, vec: str, pivots: int = TABLE, bands: int = 4) -> DataFrame:
    """q, t, qv, tv, reach: pairs that the table of pivots can't rule out as nearest within max_dist.

    Both sides meet by the band of their distance to the first pivot, of max_dist / bands; in the join's condition all distances
    to pivots differ by no more than the reach.
    """
    q, t, names = _l1_tables(query, train, max_dist, vec, pivots)
    if not names:
        return query.sparkSession.createDataFrame([], "q long, t long, qv array<double>, tv array<double>, reach double")
    width = max(max_dist, 1e-9) / bands
    band = lambda x: F.floor(x / width).cast("long")
    asked = q.select(F.col("id").alias("q"), F.col("v").alias("qv"), "reach", *(F.col(n).alias(f"q{n}") for n in names), F.explode(F.sequence(band(F.col("d0") - F.col("reach")), band(F.col("d0") + F.col("reach")))).alias("band"))
    rows = t.select(F.col("id").alias("t"), F.col("v").alias("tv"), *names, band(F.col("d0")).alias("band"))
    fits = (asked["band"] == rows["band"]) & (F.col("q") != F.col("t"))
    for n in names:
        fits = fits & (F.abs(F.col(f"q{n}") - F.col(n)) <= F.col("reach"))
    return asked.join(rows, fits).select("q", "t", "qv", "tv", "reach")


def _least_l1(q: np.ndarray, at: np.ndarray, x: np.ndarray, d: np.ndarray, other: np.ndarray, reach: float, slack: float, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the rows nearest to q within reach, and of those no more than slack farther. x and d (distances to pivots) have
    a column for a row; sums go component by component, so they are those of a plain loop."""
    best, places, found = reach, [], []
    for b in range(0, x.shape[1], block):
        may = other[b : b + block] & (np.abs(d[:, b : b + block] - at[:, None]).max(axis=0) <= best + slack)
        j = np.flatnonzero(may)
        if len(j):
            part = x[:, b : b + block] if len(j) > 0.7 * len(may) else x[:, b + j]
            total = np.abs(part - q[:, None]).sum(axis=0)
            total = total[j] if len(total) > len(j) else total
            near = total <= best + slack
            if near.any():
                best = min(best, total[near].min())
                places.append(b + j[near]), found.append(total[near])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0)
    places, found = np.concatenate(places), np.concatenate(found)
    return places[found <= best + slack], found[found <= best + slack]


def l1_nearest(query: DataFrame, train: DataFrame, max_dist: float, vec: str, digits: int, pivots: int = TABLE, part: int = PART) -> DataFrame:
    """q, t, dist: of each part of the rows, those that may be nearest to a query within max_dist: its nearest and all that are as near to `digits` digits.

    Parts lie between quantiles of the distance to the first pivot, and are dealt out where many rows are alike. A query goes to the parts
    within its reach; a part is held, its queries stream by. The table of pivots rules out rows before their distance is computed.
    """
    spark = query.sparkSession
    q, t, names = _l1_tables(query, train, max_dist, vec, pivots)
    if not names:
        return spark.createDataFrame([], "q long, t long, dist double")
    t = cut(t, "tabled")
    count = t.count()
    part = min(part, max(1024, count // 64))
    shares = [k * part / count for k in range(1, -(-count // part))]
    edges = sorted(set(t.agg(F.percentile_approx("d0", shares, 10_000)).first()[0])) if shares else []  # a number for `part` rows

    # A bounded literal is searched by bisection, as `part` rows have one edge.
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))))
    bounds = F.lit(None).cast("array<double>") if not edges else F.array(*map(F.lit, edges))

    def place(x: Column) -> Column:
        if not edges:
            return F.lit(0)
        return F.aggregate(steps, F.lit(0), lambda i, step: F.when((i + step <= len(edges)) & (F.get(bounds, i + step - 1) <= x), i + step).otherwise(i))

    t = t.withColumn("cell", place(F.col("d0")))
    held = {r["cell"]: r["count"] for r in t.groupBy("cell").count().collect()}  # a row for a part
    deals = [max(1, -(-held.get(k, 0) // (2 * part))) for k in range(len(edges) + 1)]
    dealt = F.get(F.array(*map(F.lit, deals)), F.col("cell"))
    columns = lambda df, kind, reach: df.select("cell", "part", F.lit(kind).alias("kind"), "id", "v", F.array(*names).alias("d"), reach.alias("reach"))
    rows = columns(t.withColumn("part", F.pmod(F.xxhash64("id"), dealt.cast("long")).cast("int")), 0, F.lit(None).cast("double"))
    asked = q.withColumn("cell", F.explode(F.sequence(place(F.col("d0") - F.col("reach")), place(F.col("d0") + F.col("reach")))))
    asked = columns(asked.withColumn("part", F.explode(F.sequence(F.lit(0), dealt - 1))), 1, F.col("reach"))
    slack = 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            cell, part, kind = (batch.column(c).to_numpy() for c in range(3))
            edge = np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) if len(cell) else np.zeros(0, bool)
            cuts = np.flatnonzero(edge).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                if (cell[a], part[a]) != now:
                    now, held, table = (cell[a], part[a]), [], None
                ids, v, d, reach = (batch.column(c).slice(a, b - a) for c in range(3, 7))
                if kind[a] == 0:
                    held.append((_matrix(v), _matrix(d), ids.to_numpy()))
                    continue
                if table is None and held:
                    x, far, own = (np.concatenate(c) for c in zip(*held, strict=True))
                    table, held = (np.ascontiguousarray(x.T), np.ascontiguousarray(far.T), own), []
                if table is None:
                    continue
                for i, y, at, r in zip(ids.to_numpy(), _matrix(v), _matrix(d), reach.to_numpy(), strict=True):
                    j, dist = _least_l1(y, at, table[0], table[1], table[2] != i, r, slack)
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(table[2][j]), pa.array(dist)], names=["q", "t", "dist"])

    return rows.union(asked).repartition(min(2 * sum(deals), 4096), "cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(run, "q long, t long, dist double")


# Segments of bits


def _segments(bits: str, count: int) -> list[Column]:
    """Parts of 64 bits, the lower first, as even as possible."""
    cuts = [64 * k // count for k in range(count + 1)]
    return [F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in itertools.pairwise(cuts)]


def hamming_nearest(query: DataFrame, train: DataFrame, max_dist: int, bits: str, tie: tuple[str, ...] = (), max_octaves: int | None = None, segments: int | None = None) -> DataFrame:
    """q, best (struct of dist, d_<tie>, t): the nearest other row within max_dist (and max_octaves), ties by the tie columns' differences, then the smaller t.

    Multi-index hashing with growing radius: rows are listed under each of their segments. In round s a query looks
    up all values that differ from its own in s bits of a segment. What is within segments * (s + 1) - 1 bits differs in no more
    than s bits somewhere, so a query whose best is within that is done; only the others go on.
    """
    spark = query.sparkSession
    keep = list(dict.fromkeys([*tie, *(["octave"] if max_octaves is not None else [])]))
    sided = lambda df, side: df.where(F.col("id").isNotNull() & F.col(bits).isNotNull()).select(F.col("id").alias(side), F.col(bits).cast("long").alias(f"{side}b"), *(F.col(c).cast("double").alias(f"{side}_{c}") for c in keep))
    # Of rows alike in all that counts the two smallest ids do: one of them may be the query's own.
    alike = Window.partitionBy("tb", *(f"t_{c}" for c in keep)).orderBy("t")
    rows = sided(train, "t").withColumn("__r", F.row_number().over(alike)).where("__r <= 2").drop("__r")
    if segments is None:
        segments = min(max(64 // max(rows.count().bit_length(), 1), 4), 8)
    listed = cut(rows.select("*", F.posexplode(F.array(*_segments("tb", segments))).alias("segment", "value")), "segments")
    off = {c: F.abs(F.col(f"q_{c}") - F.col(f"t_{c}")) for c in keep}
    best = F.struct(F.bit_count(F.col("qb").bitwiseXOR(F.col("tb"))).cast("int").alias("dist"), *(off[c].alias(f"d_{c}") for c in tie), F.col("t"))
    fits = (F.col("q") != F.col("t")) & (F.bit_count(F.col("qb").bitwiseXOR(F.col("tb"))) <= max_dist)
    if max_octaves is not None:
        fits = fits & (off["octave"] <= max_octaves)
    kind = rows.select(F.lit(0).alias("q"), F.lit(0).cast("long").alias("qb"), *(F.lit(0.0).alias(f"q_{c}") for c in keep), "*").select(best.alias("b")).schema["b"].dataType
    going, ended = sided(query, "q").withColumn("best", F.lit(None).cast(kind)), None
    cuts = [64 * k // segments for k in range(segments + 1)]
    for flips in range(max(b - a for a, b in itertools.pairwise(cuts)) + 1):
        masks = [(k, sum(1 << i for i in some)) for k, (a, b) in enumerate(itertools.pairwise(cuts)) for some in itertools.combinations(range(b - a), flips)]
        flipped = F.broadcast(spark.createDataFrame(masks, "segment int, mask long"))  # bounded by segments and max_dist, not by data
        asked = going.select("q", "qb", *(f"q_{c}" for c in keep), F.posexplode(F.array(*_segments("qb", segments))).alias("segment", "own")).join(flipped, "segment")
        pairs = asked.withColumn("value", F.col("own").bitwiseXOR(F.col("mask"))).join(listed, ["segment", "value"]).where(fits)
        found = pairs.select("q", best.alias("new")).groupBy("q").agg(F.min("new").alias("new"))
        covered = segments * (flips + 1) - 1
        over = F.lit(True) if covered >= max_dist else F.coalesce(F.col("best.dist") <= covered, F.lit(False))
        state = going.join(found, "q", "left").withColumn("best", F.least("best", "new")).drop("new").withColumn("over", over)
        state = cut(state, "radius")
        done = state.where("over AND best IS NOT NULL").select("q", "best")
        ended = done if ended is None else ended.unionByName(done)
        going = state.where("NOT over").drop("over")
        if covered >= max_dist or going.isEmpty():
            break
    return ended
