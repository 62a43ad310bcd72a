"""Calibration, annotation, pairing and tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import geo_tile, tile_parent


def calibrate(df: DataFrame, dark: DataFrame, flat: DataFrame, missing: DataFrame | None = None, on: Sequence[str] = ("y", "x", "c"), bpp: int = 0, value: str = "v") -> DataFrame:
    """(v / 2^bpp - dark) / flat; a place of `missing` isn't valid, nor is one without dark or flat. Spark broadcasts a small dark or flat by itself."""
    on = list(on)
    j = df.join(dark.select(*on, "dark"), on, "left").join(flat.select(*on, "flat"), on, "left")
    v = (F.col(value).cast("double") / float(1 << bpp) - F.col("dark")) / F.when(F.col("flat") != 0, F.col("flat"))
    j = j.withColumn(value, v).withColumn("valid", F.col("valid") & F.col(value).isNotNull())
    if missing is not None:
        j = j.join(missing.select(*on).withColumn("__gone", F.lit(True)), on, "left").withColumn("valid", F.col("valid") & F.col("__gone").isNull()).drop("__gone")
    return j.drop("dark", "flat")


def _largest_labels(points: pa.Table, boxes: pa.Table) -> pa.Table:
    """pid, cmap, new: of the boxes of each cmap the largest label among those that hold a point, in blocks that grow from few boxes."""
    at = [points[c].to_numpy() for c in ("x", "y", "depth")]
    edges = [(boxes[f"{c}0"].to_numpy(), boxes[f"{c}1"].to_numpy()) for c in ("x", "y", "depth")]
    places, winners = [], []
    kinds = boxes["cmap"].combine_chunks().dictionary_encode()
    for kind in range(-1, len(kinds.dictionary)):  # -1: null
        mine = pa.array(np.flatnonzero(kinds.indices.fill_null(-1).to_numpy() == kind))
        mine = mine.take(pc.sort_indices(boxes["label"].take(mine), sort_keys=[("", "descending")])).to_numpy()
        left, b, size = np.arange(len(points)), 0, 4
        while b < len(mine) and len(left):
            some = mine[b : b + size]
            held = np.ones((len(left), len(some)), bool)
            for c, (low, high) in zip(at, edges, strict=True):
                held &= (c[left, None] >= low[some]) & (c[left, None] <= high[some])
            any_of = held.any(axis=1)
            places.append(left[any_of]), winners.append(some[held[any_of].argmax(axis=1)])
            left, b = left[~any_of], b + size
            size = min(2 * size, max(4, (1 << 22) // max(1, len(left))))
    i, j = (pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (places, winners))
    return pa.table({"pid": points["pid"].take(i), "cmap": boxes["cmap"].take(j), "new": boxes["label"].take(j)})


def annotate_points(points: DataFrame, boxes: DataFrame, labels: DataFrame, cell: float = 64.0, overwrite: bool = False, part: int = 20_000) -> DataFrame:
    """points: frame, pid, x, y, depth. boxes: frame, x0, y0, x1, y1, depth0, depth1, cmap, label. labels: pid, cmap, label.

    pid, cmap, label for points in a box, and for those labelled before; an old label other than 0 stays unless
    overwrite. Of several boxes the largest label counts. Boxes meet points by the grid cells they cover, those of large labels
    first; a point that one holds meets no more of them.
    """
    g = lambda c: F.floor(F.col(c) / cell).cast("long")
    edges = ("x0", "y0", "x1", "y1", "depth0", "depth1")
    cover = boxes.select("frame", *(F.col(c).cast("double").alias(c) for c in edges), "cmap", "label")
    cover = cover.withColumn("gx", F.explode(F.sequence(g("x0"), g("x1")))).withColumn("gy", F.explode(F.sequence(g("y0"), g("y1"))))
    there = points.select("frame", "pid", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "depth")), g("x").alias("gx"), g("y").alias("gy")).where("frame IS NOT NULL AND gx IS NOT NULL AND gy IS NOT NULL")
    # A cell's points are dealt out, its boxes go to each of the parts.
    full = there.groupBy("frame", "gx", "gy").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    there = there.join(full, ["frame", "gx", "gy"]).withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")))
    cover = cover.join(full, ["frame", "gx", "gy"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    kinds = {f.name: f.dataType.simpleString() for f in [*points.schema, *boxes.schema]}
    keys = ("frame", "gx", "gy", "part")
    found = there.toDF(*there.columns).groupBy(*keys).cogroup(cover.toDF(*cover.columns).groupBy(*keys)).applyInArrow(_largest_labels, f"pid {kinds['pid']}, cmap {kinds['cmap']}, new {kinds['label']}")
    hit = found.groupBy("pid", "cmap").agg(F.max("new").alias("new"))
    j = hit.join(labels, ["pid", "cmap"], "full")
    old = F.nullif("label", F.lit(0))
    return j.select("pid", "cmap", F.coalesce(*(["new", old] if overwrite else [old, "new"]), F.lit(0)).alias("label"))


def label_names(labels: DataFrame, names: DataFrame) -> DataFrame:
    """names: cmap, label, name, color."""
    return labels.join(names, ["cmap", "label"], "left")


def stereo_pairs(df: DataFrame, width: int, height: int, layout: str = "horizontal", swap: bool = False, value: str = "v") -> DataFrame:
    """frame, y, x, left, right from frames that hold both views side by side or one above the other."""
    axis, half = ("x", width // 2) if layout == "horizontal" else ("y", height // 2)
    second = F.col(axis) >= half
    place = F.when(second, F.col(axis) - half).otherwise(F.col(axis))
    a = df.where(~second if not swap else second).withColumn(axis, place).select("frame", "y", "x", F.col(value).alias("left"))
    b = df.where(second if not swap else ~second).withColumn(axis, place).select("frame", "y", "x", F.col(value).alias("right"))
    return a.join(b, ["frame", "y", "x"])


def stereo_sources(left: DataFrame, right: DataFrame, value: str = "v") -> DataFrame:
    """Two sources paired by frame index."""
    return left.select("frame", "y", "x", F.col(value).alias("left")).join(right.select("frame", "y", "x", F.col(value).alias("right")), ["frame", "y", "x"])


def tile_join(points: DataFrame, facts: DataFrame, zoom: int, up: int = 0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with the facts (tx, ty, ...) of their tile, or of its ancestor `up` levels above."""
    x, y = geo_tile(lat, lon, zoom)
    px, py = tile_parent(x, y, up)
    return points.withColumns({"tx": px, "ty": py}).join(facts, ["tx", "ty"])
