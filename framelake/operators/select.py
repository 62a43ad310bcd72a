"""Predicates and selections of samples and frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import crop, point_line_distance


def select_pixels(df: DataFrame, expr: str, invert: bool = False, out: str = "sel") -> DataFrame:
    """A formula over x, y, v0 and so on, not zero or true where selected."""
    s = F.coalesce(F.expr(f"CAST(({expr}) AS BOOLEAN)"), F.lit(False))
    return df.withColumn(out, ~s if invert else s)


def combine_selection(old: Column, new: Column, mode: str) -> Column:
    """KEEP, REPLACE, AND, OR, XOR and their N (not both) and ..N (with the new one negated) forms. A missing old selection gives the new one, negated for N modes."""
    o = old
    pairs = {
        "KEEP": o, "REPLACE": new, "AND": o & new, "OR": o | new, "XOR": o != new, "NAND": ~(o & new), "NOR": ~(o | new), "NXOR": o == new,
        "ANDN": new & ~o, "ORN": new | ~o, "XORN": new != ~o,
    }
    missing = ~new if mode.startswith("N") else new
    return F.when(old.isNull(), missing).otherwise(pairs[mode])


def threshold(value: str | Column, limit: float | Column, cmp: str = "GT") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return {"GT": v > limit, "GE": v >= limit, "LT": v < limit, "LE": v <= limit, "EQ": v == limit, "NE": v != limit}[cmp]


select_roi = crop


def drop_parasitic_returns(points: DataFrame, depth: str = "depth") -> DataFrame:
    """Depths between 0 and 1 m are no returns; 0 and less are missing and become null."""
    return points.where(~((F.col(depth) > 0) & (F.col(depth) < 1)) | F.col(depth).isNull()).withColumn(depth, F.when(F.col(depth) > 0, F.col(depth)))


def blob_filter(blobs: DataFrame, min_a: float = 0.0, max_a: float = 1e9, max_elongation: float = 4.0, min_compactness: float = 0.0) -> DataFrame:
    """blobs: blob_moments()."""
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    elongation2 = (a * a + 0.5) / (b * b + 0.5)
    return blobs.where((n > 3) & (b > 0) & a.between(min_a, max_a) & (elongation2 <= max_elongation**2) & (n / (math.pi * a * b) >= min_compactness))


def point_filter(points: DataFrame, keep: Column) -> DataFrame:
    return points.where(keep)


def clear_mask(df: DataFrame, valid: str = "valid") -> DataFrame:
    return df.withColumn(valid, F.lit(True))


def line_profile(df: DataFrame, x0: float, y0: float, x1: float, y1: float, value: str = "v") -> DataFrame:
    """Samples within half a cell of a segment: frame, t (place along it, in cells), value; sort by frame and t."""
    size = math.hypot(x1 - x0, y1 - y0)
    t = ((F.col("x") - x0) * (x1 - x0) + (F.col("y") - y0) * (y1 - y0)) / size
    near = point_line_distance("x", "y", F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1)) <= 0.5
    return df.where(near & (t >= 0) & (t <= size)).select("frame", "y", "x", t.alias("t"), F.col(value).cast("double").alias(value))


# Sets of selected samples


def mask_sets(a: DataFrame, b: DataFrame, op: str, on: Sequence[str] = ("y", "x")) -> DataFrame:
    """Distinct places: union, intersect, except or symmetric."""
    a, b = a.select(*on), b.select(*on)
    if op == "union":
        return a.union(b).distinct()
    if op == "intersect":
        return a.intersect(b)
    if op == "except":
        return a.subtract(b)
    # One aggregate tells on which sides a place is.
    both = a.withColumn("__s", F.lit(1)).union(b.withColumn("__s", F.lit(2)))
    return both.groupBy(*on).agg(F.bit_or("__s").alias("__s")).where("__s <> 3").select(*on)


def merge_clouds(*clouds: DataFrame) -> DataFrame:
    """The clouds of several sources, frame by frame, with the number of the source; columns that one lacks are null."""
    out = None
    for k, c in enumerate(clouds):
        c = c.withColumn("cloud", F.lit(k))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    return out


def set_landmark(landmarks: DataFrame, new: DataFrame, key: str = "frame") -> DataFrame:
    """New rows take the place of old ones of their frame."""
    return remove_landmark(landmarks, new.select(key), key).unionByName(new)


def remove_landmark(landmarks: DataFrame, gone: DataFrame, key: str = "frame") -> DataFrame:
    return landmarks.join(gone.select(key), key, "left_anti")
