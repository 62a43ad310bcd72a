"""Accumulators: mergeable sums per place over frames. Spark's partial aggregation takes the place of a running update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ("y", "x", "c")


def mean(value: str | Column, where: Column | None = None) -> Column:
    """sum / count: exact and free of order for decimals."""
    v = F.col(value) if isinstance(value, str) else value
    v = F.when(where, v) if where is not None else v
    return F.try_divide(F.sum(v).cast("double"), F.count(v))


def stack_average(df: DataFrame, by: Sequence[str] = PLACE, value: str = "v") -> DataFrame:
    """mean and n of every place."""
    return df.groupBy(*by).agg(mean(value).alias("mean"), F.count(value).alias("n"))


def stack_masked_average(df: DataFrame, by: Sequence[str] = PLACE, value: str = "v", valid: str = "valid") -> DataFrame:
    """Only valid samples count; a place without any has n = 0 and no mean."""
    ok = F.col(valid)
    return df.groupBy(*by).agg(mean(value, ok).alias("mean"), F.count_if(ok & F.col(value).isNotNull()).alias("n"))


def weighted_sums(df: DataFrame, by: Sequence[str] = PLACE, value: str = "v", weight: str = "w") -> DataFrame:
    """swv and sw: the state that stacks merge."""
    ok = (F.col(weight) > 0) & F.col(value).isNotNull()
    return df.where(ok).groupBy(*by).agg(F.sum(F.col(value) * F.col(weight)).cast("double").alias("swv"), F.sum(weight).cast("double").alias("sw"))


def stack_weighted_average(df: DataFrame, by: Sequence[str] = PLACE, value: str = "v", weight: str = "w") -> DataFrame:
    """Weighted mean and total weight of places with a positive weight."""
    s = weighted_sums(df, by, value, weight)
    return s.select(*by, (F.col("swv") / F.col("sw")).alias("mean"), F.col("sw").alias("weight"))


def stack_weights(df: DataFrame, by: Sequence[str] = PLACE, weight: str = "w") -> DataFrame:
    return df.where(F.col(weight) > 0).groupBy(*by).agg(F.sum(weight).cast("double").alias("weight"), F.count(F.lit(1)).alias("n"))


def stack_resume(state: DataFrame, df: DataFrame, by: Sequence[str] = PLACE, value: str = "v", weight: str = "w") -> DataFrame:
    """The state (weighted_sums) after more samples."""
    return state.unionByName(weighted_sums(df, by, value, weight)).groupBy(*by).agg(F.sum("swv").alias("swv"), F.sum("sw").alias("sw"))


def canvas_average(df: DataFrame, offsets: DataFrame, width: int, height: int, value: str = "v", weight: str | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Frames moved by their offset (frame, dx, dy) on a canvas of 3/2 the size, the first frame in its middle. box: x, y, width, height on the canvas."""
    w = F.col(weight) if weight else F.lit(1)
    moved = df.join(offsets, "frame").select(
        (F.col("y") + F.col("dy") + height // 4).cast("long").alias("cy"), (F.col("x") + F.col("dx") + width // 4).cast("long").alias("cx"), F.col(value).alias("__v"), w.alias("__w")
    ).where((F.col("__w") > 0) & F.col("cy").between(0, 3 * height // 2 - 1) & F.col("cx").between(0, 3 * width // 2 - 1))
    if box:
        moved = moved.where(F.col("cx").between(box[0], box[0] + box[2] - 1) & F.col("cy").between(box[1], box[1] + box[3] - 1))
    return moved.groupBy("cy", "cx").agg((F.sum(F.col("__v") * F.col("__w")).cast("double") / F.sum("__w")).alias("mean"), F.count(F.lit(1)).alias("n"))


BAYER = {"rggb": "RGGB", "bggr": "BGGR", "grbg": "GRBG", "gbrg": "GBRG"}


def bayer_color(pattern: str = "rggb") -> Column:
    """The colour of a site."""
    p = BAYER[pattern]
    site = (F.col("y") % 2) * 2 + F.col("x") % 2
    return F.when(site == 0, p[0]).when(site == 1, p[1]).when(site == 2, p[2]).otherwise(p[3])


def bayer_average(df: DataFrame, pattern: str = "rggb", value: str = "v") -> DataFrame:
    """Mosaic samples averaged in the plane of their site's colour."""
    return df.withColumn("color", bayer_color(pattern)).groupBy("y", "x", "color").agg(mean(value).alias("mean"), F.count(value).alias("n"))


def bayer_drizzle(df: DataFrame, offsets: DataFrame, pattern: str = "rggb", value: str = "v") -> DataFrame:
    """Samples moved by a fraction of a place (frame, dx, dy), shared among four neighbours by area, averaged by colour."""
    j = df.join(offsets, "frame").withColumns({"color": bayer_color(pattern), "__fx": F.col("x") + F.col("dx"), "__fy": F.col("y") + F.col("dy")})
    fx, fy = F.col("__fx") - F.floor("__fx"), F.col("__fy") - F.floor("__fy")
    shares = [F.struct((F.floor("__fy") + a).cast("long").alias("y"), (F.floor("__fx") + b).cast("long").alias("x"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)]
    each = j.select("color", F.col(value).cast("double").alias("v"), F.explode(F.array(*shares)).alias("s")).where("s.w > 0")
    return each.groupBy(F.col("s.y").alias("y"), F.col("s.x").alias("x"), "color").agg((F.sum(F.col("v") * F.col("s.w")) / F.sum("s.w")).alias("mean"), F.sum("s.w").alias("weight"))


def detail(df: DataFrame, k: int = 4, value: str = "v") -> DataFrame:
    """Adds detail: a sample less the mean of its k by k block in its frame."""
    block = Window.partitionBy("frame", F.expr(f"y div {k}"), F.expr(f"x div {k}"))
    m = F.sum(value).over(block).cast("double") / F.count(value).over(block)
    return df.withColumn("detail", F.col(value).cast("double") - m)


def focus_stack_max_energy(df: DataFrame, value: str = "v") -> DataFrame:
    """Per place the sample with the largest absolute detail; of equal ones that of the earliest frame."""
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col("frame").alias("frame")), F.struct(F.abs("detail"), -F.col("frame")))
    return df.groupBy("y", "x").agg(best.alias("b")).select("y", "x", F.col("b.v").cast("double").alias("v"), "b.frame")


def focus_stack_weighted(df: DataFrame) -> DataFrame:
    """Details averaged with their squares as weights."""
    e = F.col("detail") * F.col("detail")
    return df.groupBy("y", "x").agg(F.try_divide(F.sum(F.col("detail") * e), F.sum(e)).alias("detail"), F.sum(e).alias("energy"))


def dark_frame(df: DataFrame, by: Sequence[str] = PLACE, value: str = "v", valid: str = "valid") -> DataFrame:
    """Mean of the valid samples; 0 where there are none."""
    v = F.when(F.col(valid), F.col(value))
    return df.groupBy(*by).agg((F.coalesce(F.sum(v).cast("double"), F.lit(0.0)) / F.greatest(F.count(v), F.lit(1))).alias("dark"), F.count(v).alias("n"))


def flat_field(df: DataFrame, by: Sequence[str] = PLACE, value: str = "v", valid: str = "valid", per: Sequence[str] = ("c",)) -> DataFrame:
    """dark_frame over its mean, per channel by default."""
    d = dark_frame(df, by, value, valid)
    means = d.groupBy(*per).agg(F.avg("dark").alias("__m")) if per else d.agg(F.avg("dark").alias("__m"))
    j = d.join(means, list(per)) if per else d.crossJoin(F.broadcast(means))  # one row
    return j.select(*by, F.when(F.col("__m") != 0, F.col("dark") / F.col("__m")).otherwise(1.0).alias("flat"))


def hdr_blend(a: DataFrame, b: DataFrame, value: str = "v", saturation: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """Two exposures (y, x, value in 0 to 1). The second is brought to the first by the mean log ratio of samples unsaturated in both; weights w0 = a, w1 = 1 - a, squared.
    With `by` (columns of both) many pairs of exposures."""
    keys = [*by, "y", "x"]
    j = a.select(*keys, F.col(value).cast("double").alias("a")).join(b.select(*keys, F.col(value).cast("double").alias("b")), keys)
    both = (F.col("a") < saturation) & (F.col("b") < saturation) & (F.col("a") > 0) & (F.col("b") > 0)
    offset = j.groupBy(*by).agg(F.coalesce(F.avg(F.when(both, F.ln("a") - F.ln("b"))), F.lit(0.0)).alias("__o"))
    w0, w1 = F.col("a") * F.col("a"), (1 - F.col("a")) * (1 - F.col("a"))
    known = j.join(offset, list(by)) if by else j.crossJoin(F.broadcast(offset))  # one row
    return known.select(*keys, ((w0 * F.col("a") + w1 * F.col("b") * F.exp("__o")) / (w0 + w1)).alias("v"))


def voxel_accumulate(points: DataFrame, cell: float = 0.1, low: tuple[float, float, float] = (-500.0, -500.0, -10.0), high: tuple[float, float, float] = (500.0, 500.0, 20.0), values: Sequence[str] = ("r", "t")) -> DataFrame:
    """Means of coordinates and values, and n, per voxel; points outside are dropped."""
    axes = ("x", "y", "z")
    inside = points
    for a, lo, hi in zip(axes, low, high, strict=True):
        inside = inside.where((F.col(a) >= lo) & (F.col(a) < hi)).withColumn(f"i{a}", F.floor((F.col(a) - lo) / cell).cast("long"))
    return inside.groupBy("ix", "iy", "iz").agg(*(F.avg(F.col(v).cast("double")).alias(v) for v in (*axes, *values)), F.count(F.lit(1)).alias("n"))


def stack_sum_abs(df: DataFrame, by: Sequence[str] = PLACE, value: str = "v") -> DataFrame:
    return df.groupBy(*by).agg(mean(F.abs(F.col(value))).alias("mean_abs"))


def stack_max(df: DataFrame, by: Sequence[str] = PLACE, value: str = "v") -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.abs(F.col(value))).cast("double").alias("max_abs"))


def reduce_axis(df: DataFrame, keep: str, op: str, value: str = "v", valid: str | None = None) -> DataFrame:
    """One value per row (keep='y') or column (keep='x') of each frame: sum, avg, max, min or sum2."""
    v = F.when(F.col(valid), F.col(value)) if valid else F.col(value)
    f = {"sum": F.sum(v), "avg": mean(v), "max": F.max(v), "min": F.min(v), "sum2": F.sum(v * v)}[op]
    return df.groupBy("frame", keep).agg(f.cast("double").alias(op))


def flow_average(df: DataFrame, by: Sequence[str] = ("y", "x"), dx: str = "dx", dy: str = "dy") -> DataFrame:
    return df.groupBy(*by).agg(mean(dx).alias("dx"), mean(dy).alias("dy"), F.count(F.lit(1)).alias("n"))
