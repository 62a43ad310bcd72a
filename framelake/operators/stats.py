"""Statistics per group, histograms, and the levels that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.pixels import clip
from framelake.operators.stack import mean
from framelake.sources.storage import cut


def _by(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by)


def valid_value(value: str, valid: str | None) -> Column:
    v = F.col(value).cast("double")
    return F.when(F.col(valid), v) if valid else v


def frame_stats(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v", valid: str | None = None, rollup: bool = False) -> DataFrame:
    """n, sum, mean, stdev (population), min, max; rollup adds the totals of all key prefixes."""
    v = F.when(F.col(valid), F.col(value)) if valid else F.col(value)
    groups = df.rollup(*by) if rollup else df.groupBy(*by)
    return groups.agg(F.count(v).alias("n"), F.sum(v).cast("double").alias("sum"), mean(v).alias("mean"), F.stddev_pop(v.cast("double")).alias("stdev"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))


def blob_moments(df: DataFrame, by: Sequence[str] = ("frame", "label"), value: str = "v") -> DataFrame:
    """n, I, centroid, central moments, angle and half axes of every blob."""
    v = F.col(value)
    sums = {"I": v, "sx": v * F.col("x"), "sy": v * F.col("y"), "sxx": v * F.col("x") * F.col("x"), "syy": v * F.col("y") * F.col("y"), "sxy": v * F.col("x") * F.col("y")}
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).cast("double").alias(k) for k, e in sums.items())).where(F.col("I") != 0)
    s = s.withColumns({"x": F.col("sx") / F.col("I"), "y": F.col("sy") / F.col("I")})
    s = s.withColumns({"x2": F.col("sxx") / F.col("I") - F.col("x") * F.col("x"), "y2": F.col("syy") / F.col("I") - F.col("y") * F.col("y"), "xy": F.col("sxy") / F.col("I") - F.col("x") * F.col("y")})
    root = F.sqrt((F.col("x2") - F.col("y2")) * (F.col("x2") - F.col("y2")) + 4 * F.col("xy") * F.col("xy"))
    half = lambda sign: F.sqrt(F.greatest(2 * (F.col("x2") + F.col("y2") + sign * root), F.lit(0.0)))
    return s.select(*by, "n", "I", "x", "y", "x2", "y2", "xy", (F.atan2(2 * F.col("xy"), F.col("x2") - F.col("y2")) / 2).alias("theta"), half(1).alias("a"), half(-1).alias("b"))


def barycenter(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v") -> DataFrame:
    at = lambda axis: F.try_divide(F.sum(F.col(value) * F.col(axis)).cast("double"), F.sum(value).cast("double"))
    return _by(df, by).agg(at("x").alias("x"), at("y").alias("y"))


def component_stats(df: DataFrame, by: Sequence[str] = ("frame", "label")) -> DataFrame:
    return _by(df, by).agg(F.count(F.lit(1)).alias("area"), *(f(a).alias(n) for a in ("x", "y") for f, n in ((F.min, f"{a}0"), (F.max, f"{a}1"))))


def weighted_mean(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v", weight: str = "w") -> DataFrame:
    return _by(df, by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)).cast("double"), F.sum(weight).cast("double")).alias("mean"))


def _digits(v: Column) -> list[Column]:
    """Two whole numbers that rise with v: sign, exponent and ten leading bits, then the next twenty bits."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    scaled = (size / F.pow(F.lit(2.0), exponent) - 1) * 1024
    sign, far = F.signum(v), F.lit(1 << 40)
    first = F.when(F.isnan(v), far).when(size == float("inf"), sign * (far - 1)).when(v == 0, 0).otherwise(sign * (exponent * 1024 + F.floor(scaled) + 2_000_000))
    second = F.when(F.isnan(v) | (size == float("inf")) | (v == 0), 0).otherwise(sign * F.floor((scaled - F.floor(scaled)) * (1 << 20)))
    return [first.cast("long"), second.cast("long")]


def frame_median(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v", valid: str | None = None) -> DataFrame:
    """Exact; the mean of the two middle values of an even number, null without any. Distributed selection for groups of any size: counts by
    leading digits tell which digits hold the middle, and only the values with these are looked at more closely."""
    by = list(by)
    first, second = _digits(F.col("__v"))
    rows = df.select(*by, valid_value(value, valid).alias("__v")).withColumn("__d0", first)
    counts = cut(_by(rows, [*by, "__d0"]).agg(F.count(F.lit(1)).alias("__n")), "digits")
    known = counts.where(F.col("__d0").isNotNull())
    total = _by(known, by).agg(F.sum("__n").alias("__all"))
    ranks = F.array_distinct(F.array(F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)))
    wanted = cut(_held(known, total.select(*by, F.explode(ranks).alias("__rank")), by, "__d0"), "ranks")  # two rows a group at most
    near = _meet(rows.where(F.col("__v").isNotNull()), wanted.select(*by, "__d0").distinct(), [*by, "__d0"])
    near = cut(_by(near, [*by, "__d0", "__v"]).agg(F.count(F.lit(1)).alias("__n")).withColumn("__d1", second), "near")
    wanted = cut(_held(near, wanted, [*by, "__d0"], "__d1"), "ranks")
    last = _meet(near, wanted.select(*by, "__d0", "__d1").distinct(), [*by, "__d0", "__d1"])
    found = _by(_held(last, wanted, [*by, "__d0", "__d1"], "__v"), by).agg(F.avg("__v").alias("median"))
    return _meet(counts.select(*by).distinct(), found, by, "left") if by else found


def _held(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], digit: str) -> DataFrame:
    """rows: keys, digit, __n; wanted: keys, __rank. The digits that hold the ranks, and the ranks counted from where they begin."""
    counts = _by(rows, [*keys, digit]).agg(F.sum("__n").alias("__n"))
    up = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(digit)  # a row per digit
    ends = counts.withColumn("__end", F.sum("__n").over(up)).withColumn("__start", F.col("__end") - F.col("__n"))
    held = _meet(ends, wanted, keys).where((F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__end")))
    return held.select(*keys, digit, (F.col("__rank") - F.col("__start")).alias("__rank"))


def _meet(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined by keys that may be null."""
    if not keys:
        return a.crossJoin(b)  # b: two rows at most
    b = b.withColumnsRenamed({k: f"{k}__b" for k in keys})
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"{k}__b")) for k in keys], how).drop(*(f"{k}__b" for k in keys))


def mean_abs_dev(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v") -> DataFrame:
    means = _by(df, by).agg(mean(value).alias("__m"))
    return df.join(means, list(by)).groupBy(*by).agg(F.avg(F.abs(F.col(value).cast("double") - F.col("__m"))).alias("mad"))


def normalized_variance(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v") -> DataFrame:
    s = frame_stats(df, by, value)
    return s.select(*by, F.when(F.col("mean") != 0, F.col("stdev") / F.abs("mean")).otherwise(0.0).alias("sharpness"))


def sharpness_average(df: DataFrame, by: Sequence[str] = (), metric: str = "sharpness") -> DataFrame:
    return _by(df, by).agg(F.avg(metric).alias("sharpness"))


# Histograms


def value_range(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return _by(df, by).agg(F.min(value).cast("double").alias("minv"), F.max(value).cast("double").alias("maxv"))


def histogram(df: DataFrame, by: Sequence[str] = (), value: str = "v", minv: float | None = None, maxv: float | None = None, bins: int = 256, dense: bool = True) -> DataFrame:
    """by, bin, n, minv, maxv: floor((v - min) / (max - min) * bins), the top value in the last bin; values outside a given range don't count. dense adds the empty bins."""
    by = list(by)
    if minv is None or maxv is None:
        ranges = value_range(df, by, value)
        j = df.join(ranges, by) if by else df.crossJoin(F.broadcast(ranges))  # one row without keys
    else:
        ranges = df.select(*by).distinct().withColumns({"minv": F.lit(float(minv)), "maxv": F.lit(float(maxv))}) if by else df.sparkSession.range(1).select(F.lit(float(minv)).alias("minv"), F.lit(float(maxv)).alias("maxv"))
        j = df.withColumns({"minv": F.lit(float(minv)), "maxv": F.lit(float(maxv))})
    v = F.col(value).cast("double")
    j = j.where(v.isNotNull() & (v >= F.col("minv")) & (v <= F.col("maxv")))
    at = F.when(F.col("maxv") > F.col("minv"), F.least(F.floor((v - F.col("minv")) * bins / (F.col("maxv") - F.col("minv"))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    found = j.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if not dense:
        return found.join(ranges, by) if by else found.crossJoin(F.broadcast(ranges))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(found, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), "minv", "maxv")


def _over(by: Sequence[str]):
    # A histogram has at most `bins` rows per key, so a window without keys is as small.
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def cumulative_histogram(hist: DataFrame, by: Sequence[str] = (), normalize: bool = True) -> DataFrame:
    """Adds cum: the running sum, as a share of the total if asked for."""
    running = F.sum("n").over(_over(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("cum", running / F.sum("n").over(_over(by)) if normalize else running)


def normalize_histogram(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return hist.withColumn("h", F.col("n") / F.max("n").over(_over(by)))


def crossing(hist: DataFrame, by: Sequence[str], q: float, name: str) -> DataFrame:
    """Where the cumulative share reaches q, in bins, interpolated from the bin before."""
    c = cumulative_histogram(hist, by).withColumn("__before", F.coalesce(F.lag("cum").over(_over(by).orderBy("bin")), F.lit(0.0)))
    first = c.where(F.col("cum") >= q).groupBy(*by).agg(F.min_by(F.struct("bin", "cum", "__before", "minv", "maxv"), "bin").alias("f"))
    at = F.col("f.bin") - 1 + F.when(F.col("f.cum") > F.col("f.__before"), (q - F.col("f.__before")) / (F.col("f.cum") - F.col("f.__before"))).otherwise(0.0)
    return first.select(*by, at.alias(name), F.col("f.minv").alias("minv"), F.col("f.maxv").alias("maxv"))


def _both(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    return a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))  # one row each


def clip_levels(hist: DataFrame, by: Sequence[str] = (), qlow: float = 0.001, qhigh: float = 0.999, bins: int = 256) -> DataFrame:
    """low and high: the interpolated quantiles as values; half a bin is added to the high one."""
    lo, hi = crossing(hist, by, qlow, "__lo"), crossing(hist, by, qhigh, "__hi").drop("minv", "maxv")
    step = (F.col("maxv") - F.col("minv")) / bins
    low = F.col("minv") + F.greatest(F.col("__lo"), F.lit(0.0)) * step
    high = F.least(F.col("minv") + (F.col("__hi") + 0.5) * step, F.col("maxv"))
    return _both(lo, hi, by).select(*by, low.alias("low"), high.alias("high"))


def clip_levels_percent(hist: DataFrame, by: Sequence[str] = (), plow: float = 1.0, phigh: float = 99.0, bins: int = 256) -> DataFrame:
    """Without interpolation: the first bins whose share reaches the percentages, empty bins in front skipped."""
    c = cumulative_histogram(hist, by).where("cum > 0")
    at = c.groupBy(*by).agg(F.min(F.when(F.col("cum") * 100 >= plow, F.col("bin"))).alias("lo"), F.min(F.when(F.col("cum") * 100 >= phigh, F.col("bin"))).alias("hi"), F.first("minv").alias("minv"), F.first("maxv").alias("maxv"))
    step = (F.col("maxv") - F.col("minv")) / bins
    return at.select(*by, (F.col("minv") + F.col("lo") * step).alias("low"), (F.col("minv") + F.col("hi") * step).alias("high"))


def histogram_mode(hist: DataFrame, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """The middle of the first highest plateau, moved by the parabola through its neighbours; a bin is (max - min) / (bins - 1) wide."""
    w = _over(by).orderBy("bin")
    h = hist.withColumns({"__top": F.max("n").over(_over(by)), "__prev": F.lag("n").over(w)})
    h = h.withColumn("__new", ((F.col("n") == F.col("__top")) & F.coalesce(F.col("__prev") != F.col("__top"), F.lit(True))).cast("int"))
    h = h.withColumns({"__run": F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.lead("n").over(w)})
    top = h.where((F.col("n") == F.col("__top")) & (F.col("__run") == 1)).groupBy(*by).agg(
        F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.min_by("__prev", "bin").alias("left"), F.max_by("__next", "bin").alias("right"), F.first("n").alias("n"), F.first("minv").alias("minv"), F.first("maxv").alias("maxv")
    )
    left, right = F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))
    bend = left - 2 * F.col("n") + right
    shift = F.when((F.col("b0") == F.col("b1")) & (bend != 0), 0.5 * (left - right) / bend).otherwise(0.0)
    at = (F.col("b0") + F.col("b1")) / 2 + shift
    return top.select(*by, (F.col("minv") + at * (F.col("maxv") - F.col("minv")) / (bins - 1)).alias("mode"))


def histogram_median(hist: DataFrame, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    c = crossing(hist, by, 0.5, "__at")
    return c.select(*by, (F.col("minv") + F.col("__at") * (F.col("maxv") - F.col("minv")) / bins).alias("median"))


def rescale(df: DataFrame, levels: DataFrame, by: Sequence[str], omin: float, omax: float, value: str = "v", out: str = "v_out") -> DataFrame:
    """Values clamped to [low, high] and brought to [omin, omax]."""
    j = _both(df, levels, by)
    v = F.least(F.greatest(F.col(value).cast("double"), F.col("low")), F.col("high"))
    unit = F.when(F.col("high") > F.col("low"), (v - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return j.withColumn(out, unit * (omax - omin) + omin).drop("low", "high")


def autoclip(df: DataFrame, by: Sequence[str] = (), value: str = "v", qlow: float = 0.001, qhigh: float = 0.999, omin: float = 0.0, omax: float = 255.0, bins: int = 256) -> DataFrame:
    return rescale(df, clip_levels(histogram(df, by, value, bins=bins), by, qlow, qhigh, bins), by, omin, omax, value)


def auto_levels(df: DataFrame, value: str = "v", bins: int = 256) -> DataFrame:
    """Levels at the fixed quantiles 1e-3 and 1 - 1e-5."""
    return clip_levels(histogram(df, (), value, bins=bins), (), 1e-3, 1 - 1e-5, bins)


def white_balance(df: DataFrame, channel: str = "c", value: str = "v", qlow: float = 0.01, qhigh: float = 0.99, bins: int = 256) -> DataFrame:
    """scale and shift per channel that bring its levels to the outermost of all channels; a channel without a span keeps scale 1 and shift 0."""
    levels = clip_levels(histogram(df, (channel,), value, bins=bins), (channel,), qlow, qhigh, bins)
    outer = levels.agg(F.min("low").alias("__lo"), F.max("high").alias("__hi"))
    span = F.col("high") - F.col("low")
    scale = F.when(span > 0, (F.col("__hi") - F.col("__lo")) / span).otherwise(1.0)
    return levels.crossJoin(F.broadcast(outer)).select(channel, scale.alias("scale"), F.when(span > 0, F.col("__lo") - F.col("low") * scale).otherwise(0.0).alias("shift"))  # one row


def auto_mtf(df: DataFrame, value: str = "v", bins: int = 256) -> DataFrame:
    """Parameters of the tone curve from levels at 0.001 and 0.9999 and the median between them."""
    h = histogram(df, (), value, bins=bins)
    both = _both(clip_levels(h, (), 0.001, 0.9999, bins), histogram_median(h, (), bins), ())
    middle = clip(F.when(F.col("high") > F.col("low"), (F.col("median") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5), 0.001, 0.999)
    return both.select(F.col("low").alias("lclip"), F.col("high").alias("hclip"), clip(F.log10(middle / 0.5) * -1, -1.0, 1.0).alias("shadows"), clip(1 - middle, 0.05, 0.95).alias("midtones"), F.lit(0.0).alias("highlights"))


def background_normalize(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v", mode: str = "mean", stretch: float = 1.0, offset: float = 0.0, bins: int = 256) -> DataFrame:
    """(v - background) * stretch + offset; the background is the group's mean, mode or median."""
    if mode == "mean":
        b = _by(df, by).agg(mean(value).alias("__b"))
    elif mode == "mode":
        b = histogram_mode(histogram(df, by, value, bins=bins), by, bins).withColumnRenamed("mode", "__b")
    else:
        b = frame_median(df, by, value).withColumnRenamed("median", "__b")
    return _both(df, b, by).withColumn("v_out", (F.col(value).cast("double") - F.col("__b")) * stretch + offset).drop("__b")


def equalize_histogram(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v", bins: int = 256) -> DataFrame:
    """The cumulative share at a value's bin."""
    by = list(by)
    h = cumulative_histogram(histogram(df, by, value, bins=bins, dense=False), by)
    j = _both(df, value_range(df, by, value), by)
    v = F.col(value).cast("double")
    at = F.when(F.col("maxv") > F.col("minv"), F.least(F.floor((v - F.col("minv")) * bins / (F.col("maxv") - F.col("minv"))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return j.withColumn("bin", at).drop("minv", "maxv").join(h.select(*by, "bin", F.col("cum").alias("v_out")), [*by, "bin"]).drop("bin")


def gradient_direction_histogram(df: DataFrame, gx: str = "gx", gy: str = "gy", by: Sequence[str] = ("frame",)) -> DataFrame:
    """360 bins of half a degree over 180 degrees, shifted by 45; weights are gradient sizes."""
    angle = F.pmod(F.degrees(F.atan2(F.col(gy), F.col(gx))) + 45, F.lit(180.0))
    return df.where(F.col(gx).isNotNull() & F.col(gy).isNotNull()).groupBy(*by, (F.floor(angle * 2 + 1e-9) % 360).cast("int").alias("bin")).agg(F.sum(F.hypot(F.col(gx), F.col(gy))).alias("weight"))


def radial_profile(df: DataFrame, cx: float, cy: float, scale: float = 1.0, by: Sequence[str] = ("frame",), value: str = "v") -> DataFrame:
    r = F.rint(F.hypot(F.col("x") - cx, F.col("y") - cy) * scale).cast("int")
    return df.groupBy(*by, r.alias("r")).agg(mean(value).alias("mean"), F.count(value).alias("n"))


def correlation(a: DataFrame, b: DataFrame, on: Sequence[str] = ("y", "x"), value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """Of two frames' samples at common places; with `by` (columns of both, among `on`) a row for each of many pairs of frames."""
    j = a.select(*on, F.col(value).cast("double").alias("a")).join(b.select(*on, F.col(value).cast("double").alias("b")), list(on))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(spread > 0, F.covar_pop("a", "b") / spread).otherwise(0.0).alias("correlation"))


def anscombe_params(df: DataFrame, bright: Column, dark: Column, value: str = "v", residual: str = "residual") -> DataFrame:
    """gain and offset from the mean and residual variance of a bright and of a dark region."""
    var = lambda where: F.avg(F.when(where, F.col(residual) * F.col(residual)))
    s = df.agg(var(bright).alias("vb"), var(dark).alias("vd"), mean(value, bright).alias("ib"), mean(value, dark).alias("id"))
    g = F.greatest(F.coalesce(F.try_divide(F.col("vb") - F.col("vd"), F.col("ib") - F.col("id")), F.lit(0.0)), F.lit(0.0))
    return s.withColumn("gain", g).select("gain", F.greatest(F.lit(1e-12), 0.375 * F.col("gain") * F.col("gain") + F.col("vd") - F.col("gain") * F.col("id")).alias("offset"))
