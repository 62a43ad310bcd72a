"""Geodesic morphology: reconstruction over tiles, joined from small to large and filled in from large to small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.ordered import along, morph
from framelake.sources.storage import cut

#: Cells of a tile's side; tiles along the side of the next larger one.
TILE, JOINED = 128, 8


def _groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (by, gy, gx: the first columns, groups in one piece) of some `least` rows, with the place of each row's group."""
    held, n, enough = [], 0, least

    def numbered() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy()]
        return t, np.cumsum(np.append(0, np.any([k[1:] != k[:-1] for k in keys], axis=0)))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            t, g = numbered()
            last = int(np.searchsorted(g, g[-1]))
            if last:
                yield t.slice(0, last), g[:last]
            held, n = t.slice(last).to_batches(), len(g) - last
            enough = max(least, 2 * n)
    if held:
        yield numbered()


def _spread(marker: np.ndarray, u: np.ndarray, v: np.ndarray, width: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """The marker spread along ways u-v up to their widths, and ways that are as wide between ends as all of these together (a forest).

    Ways join components from the widest on; a component holds the highest of its markers, which reaches all of it up to the width that joined it.
    """
    n, order = len(marker), np.argsort(-width, kind="stable")
    root, up, most, end = list(range(n)), [-1] * n, marker.tolist(), np.where(ends, np.arange(n), -1).tolist()
    joined, forest = [], []
    for a, b, w in zip(u[order].tolist(), v[order].tolist(), width[order].tolist(), strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a == b:
            continue
        k, p, q = len(root), end[a], end[b]
        root[a] = root[b] = up[a] = up[b] = k
        root.append(k)
        up.append(-1)
        most.append(max(most[a], most[b]))
        joined.append(w)
        end.append(q if p < 0 else p)
        if p >= 0 and q >= 0:
            forest.append((p, q, w))
    level = [-np.inf] * (len(root) + 1)  # the last: above all
    for k in range(len(root) - 1, n - 1, -1):
        level[k] = max(min(joined[k - n], most[k]), level[up[k]])
    return np.maximum(marker, np.array(level)[up[:n]]), forest


def reconstruct(cells: DataFrame, eight: bool = False, tile: int = TILE, by: str = "frame") -> DataFrame:
    """cells: by, y, x, marker, limit (marker <= limit). by, y, x, limit, marker: the marker spread over 4 or 8 neighbours below the limit.

    What a tile is to others are the cells along its sides, with what reaches them in the tile, and a forest of ways between them that are as
    wide as those through the tile. JOINED x JOINED tiles make a larger one from these alone, until one holds a frame; then what reaches
    the sides of tiles goes back from larger to smaller ones. Steps grow with the logarithm of a frame's side, whatever way a marker takes.
    Cells without a limit let nothing through.
    """
    base = cut(cells.select(by, "y", "x", F.col("marker").cast("double").alias("marker"), F.col("limit").cast("double").alias("limit")), "spread")
    y0, y1, x0, x1 = base.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if y0 is None:
        return base.select(by, "y", "x", "limit", "marker")
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    # Kind 0: a cell with its limit and marker. 1: a way and its width. 2: a cell with what reaches it in the end.
    columns = {by: kinds[by], "kind": "int", "y": kinds["y"], "x": kinds["x"], "y2": kinds["y"], "x2": kinds["x"], "limit": "double", "marker": "double"}
    schema = ", ".join(f"`{n}` {t}" for n, t in columns.items())
    steps = ((0, 1), (1, 0), *(((1, 1), (1, -1)) if eight else ()))

    def solve(rows: DataFrame, side: int, up: bool) -> DataFrame:
        """Tiles of a side: the cells and ways that a larger tile is made from, or (not up) all cells with what reaches them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, g in _groups(batches):
                kind = t.column("kind").to_numpy()
                of = lambda name, at: t.column(name).take(pa.array(at)).to_numpy()  # noqa: E731, B023
                place = lambda at, y, x: (g[at] * (side + 2) + of(y, at) - y0 - of("gy", at) * side + 1) * (side + 2) + of(x, at) - x0 - of("gx", at) * side + 1  # noqa: E731, B023
                cell, way, known = (np.flatnonzero(kind == k) for k in range(3))
                codes = place(cell, "y", "x")
                order = np.argsort(codes, kind="stable")
                cell, codes = cell[order], codes[order]
                limit, marker = of("limit", cell), of("marker", cell)
                lost = np.isnan(marker)
                marker = np.where(lost, -np.inf, marker)
                find = lambda c: np.minimum(np.searchsorted(codes, c), len(codes) - 1)  # noqa: E731, B023
                at = find(place(known, "y", "x"))
                marker[at] = np.maximum(marker[at], of("marker", known))
                u, v, width = [find(place(way, "y", "x"))], [find(place(way, "y2", "x2"))], [of("limit", way)]
                for dy, dx in steps:
                    near = codes + dy * (side + 2) + dx
                    there = find(near)
                    hit = np.flatnonzero(codes[there] == near)
                    u.append(hit)
                    v.append(there[hit])
                    width.append(np.minimum(limit[hit], limit[there[hit]]))
                u, v, width = (np.concatenate(c) for c in (u, v, width))
                open_ = ~np.isnan(width)
                y, x = of("y", cell) - y0, of("x", cell) - x0
                outer = lambda c, top: ((c % side == 0) & (c > 0)) | ((c % side == side - 1) & (c < top))
                ends = outer(y, y1 - y0) | outer(x, x1 - x0) if up else np.zeros(len(cell), bool)
                marker, forest = _spread(marker, u[open_], v[open_], width[open_], ends)
                marker[lost & np.isneginf(marker)] = np.nan
                kept = np.flatnonzero(ends) if up else np.arange(len(cell))
                yield table(t, 0 if up else 2, cell[kept], None, limit[kept], marker[kept])
                if forest:
                    p, q, w = zip(*forest, strict=True)
                    yield table(t, 1, cell[list(p)], cell[list(q)], np.array(w), None)

        def table(t: pa.Table, kind: int, at: np.ndarray, to: np.ndarray | None, limit: np.ndarray, marker: np.ndarray | None) -> pa.RecordBatch:
            first, second = pa.array(at), pa.array(np.zeros(0, np.int64) if to is None else to)
            take = lambda name, i: t.column(name).take(i).combine_chunks()
            empty = lambda name: pa.nulls(len(at), t.schema.field(name).type)
            sides = [empty("y2"), empty("x2")] if to is None else [take("y", second), take("x", second)]
            values = [pa.array(limit, from_pandas=True), pa.nulls(len(at), pa.float64()) if marker is None else pa.array(marker, from_pandas=True)]
            return pa.RecordBatch.from_arrays([take(by, first), pa.array(np.full(len(at), kind, np.int32)), take("y", first), take("x", first), *sides, *values], names=list(columns))

        inside = lambda c, start: F.floor((F.col(c) - start) / side).cast("long")
        dealt = rows.select(by, inside("y", y0).alias("gy"), inside("x", x0).alias("gx"), *list(columns)[1:]).repartition(by, "gy", "gx").sortWithinPartitions(by, "gy", "gx")
        return dealt.mapInArrow(run, schema)

    side, levels = tile, [base.select(*(F.lit(0).alias("kind") if c == "kind" else F.lit(None).cast(columns[c]).alias(c) if c in ("y2", "x2") else c for c in columns))]
    while max(y1 - y0, x1 - x0) >= side:
        levels.append(cut(solve(levels[-1], side, True), "tiles"))
        side *= JOINED
    done = solve(levels.pop(), side, False)
    while levels:
        side //= JOINED
        done = solve(levels.pop().unionByName(cut(done, "sides")), side, False)
    return done.select(by, "y", "x", "limit", "marker")


def geo_open(cells: DataFrame, r: int = 1, eight: bool = False, close: bool = False, tile: int = TILE) -> DataFrame:
    """cells: frame, y, x, v. m: what of v the eroded image still reaches (closing: the same of -v)."""
    sign = -1 if close else 1
    d = cells.select("frame", "y", "x", (F.col("v").cast("double") * sign).alias("v"))
    eroded = morph(d, "erode", r, (along("x"), along("y")), "v", "marker")
    out = reconstruct(eroded.select("frame", "y", "x", "marker", F.col("v").alias("limit")), eight, tile)
    return out.select("frame", "y", "x", (F.col("marker") * sign).alias("m"))


def geo_fill_holes(cells: DataFrame, eight: bool = False, tile: int = TILE) -> DataFrame:
    """cells: frame, y, x, v. m: v with what no way below it leads to from the frame's edge filled up."""
    edge = cells.groupBy("frame").agg(F.max(F.col("v").cast("double")).alias("__top"), *(f(c).alias(f"__{f.__name__}_{c}") for c in ("y", "x") for f in (F.min, F.max)))
    d = cells.select("frame", "y", "x", F.col("v").cast("double").alias("v")).join(edge, "frame")
    turned = F.col("__top") - F.col("v")
    outer = (F.col("y") == F.col("__min_y")) | (F.col("y") == F.col("__max_y")) | (F.col("x") == F.col("__min_x")) | (F.col("x") == F.col("__max_x"))
    spread = reconstruct(d.select("frame", "y", "x", F.when(outer, turned).otherwise(0.0).alias("marker"), turned.alias("limit")), eight, tile)
    return spread.join(edge.select("frame", "__top"), "frame").select("frame", "y", "x", (F.col("__top") - F.col("marker")).alias("m"))
