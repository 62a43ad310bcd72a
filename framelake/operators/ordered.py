"""Operators along an order: neighbours, stencils, rolling windows, gaps, running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.stack import mean

ROW = (("frame", "y"), "x")
COLUMN = (("frame", "x"), "y")


def along(axis: str = "x") -> WindowSpec:
    """One row of a frame in order of x, or one column in order of y."""
    by, order = ROW if axis == "x" else COLUMN
    return Window.partitionBy(*by).orderBy(order)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined by keys that may be null."""
    b = b.withColumnsRenamed({k: f"{k}__b" for k in keys})
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"{k}__b")) for k in keys], how).drop(*(f"{k}__b" for k in keys))


def _means(maps: DataFrame, by: Sequence[str], start: Column | None = None) -> DataFrame:
    """maps: by, s: an array of pos, w, x, rest in order. A row for each of s with m, the means m -> (a * m + x) / w from start on."""
    step = lambda m, z: (z["a"] * m + z["x"]) / z["w"]
    first = F.lit(0.0) if start is None else start
    states = F.aggregate("s", F.array().cast("array<double>"), lambda acc, z: F.array_append(acc, step(F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(first), z)))
    return maps.select(*by, F.explode(F.arrays_zip(F.col("s").alias("s"), states.alias("m"))).alias("z")).select(*by, "z.s.*", "z.m")


def _mean_scan(maps: DataFrame, by: Sequence[str], chunk: int, levels: int) -> DataFrame:
    """maps: by, pos (0, 1, ...), a, x, w, rest. Adds m, the value of all maps m -> (a * m + x) / w up to pos. No array is longer than chunk,
    but for those of the last level, a row for chunk ** levels rows."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "a", "x", "w", "rest"))).alias("s")
    if not levels:
        return _means(maps.groupBy(*by).agg(packed), by)
    parts = maps.groupBy(*by, F.floor(F.col("pos") / chunk).alias("__p")).agg(packed)
    # The cast makes the fields nullable: a value that is missing leaves no mean after it.
    whole = F.aggregate("s", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("x")).cast("struct<a:double,x:double>"), lambda m, z: F.struct((z["a"] * m["a"] / z["w"]).alias("a"), ((z["a"] * m["x"] + z["x"]) / z["w"]).alias("x")))
    totals = parts.select(*by, F.col("__p").alias("pos"), whole.alias("t")).select(*by, "pos", "t.a", "t.x", F.lit(1.0).alias("w"), F.lit(None).cast("int").alias("rest"))
    before = _mean_scan(totals, by, chunk, levels - 1).select(*by, (F.col("pos") + 1).alias("__p"), F.col("m").alias("__m"))
    return _means(_same(parts, before, [*by, "__p"], "left"), by, F.when(F.col("__p") == 0, 0.0).otherwise(F.col("__m")))


def running_average(df: DataFrame, n: int = 5, by: Sequence[str] = ("series",), order: str = "ord", value: str = "v", out: str = "avg", chunk: int = 512) -> DataFrame:
    """The mean of all values up to n, then (avg * n + v) / (n + 1). Series of any length: each is cut into chunks of its order, a chunk is
    reduced to its map avg -> a * avg + b, and the means at the ends of chunks are carried over one row per chunk."""
    by, kind = list(by), df.schema[order].dataType
    d = df.select(*by, order, F.col(value).cast("double").alias(value))
    place = F.col(order) if isinstance(kind, T.NumericType) else F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    d = d.withColumn("__c", place).withColumn("__c", F.coalesce(F.floor(F.col("__c") / chunk).cast("long"), F.lit(-(2**62))))
    before = Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*by, "__c").agg(F.count(F.lit(1)).alias("__n")).select(*by, "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    k = F.row_number().over(Window.partitionBy(*by, "__c").orderBy(order, value)) - 1
    d = _same(d.withColumn("__k", k), base, [*by, "__c"]).withColumn("pos", F.col("__base") + F.col("__k"))
    w = F.least("pos", F.lit(n)).cast("double")
    maps = d.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), "pos", w.alias("a"), F.col(value).alias("x"), (w + 1).alias("w"), F.struct(F.col(order).alias("o")).alias("rest"))
    done = _mean_scan(maps, [f"__by{i}" for i in range(len(by))], chunk, 2)
    return done.select(*(F.col(f"__by{i}").alias(c) for i, c in enumerate(by)), F.col("rest.o").alias(order), F.col("x").alias(value), F.col("m").alias(out))


def running_average_series(df: DataFrame, n: int = 5, by: Sequence[str] = ("series",), order: str = "ord", value: str = "v", out: str = "avg") -> DataFrame:
    """running_average for long series, in longer chunks."""
    return running_average(df, n, by, order, value, out, 2048)


def neighbourhood_average(df: DataFrame, r: int, w: WindowSpec | None = None, value: str = "v", out: str = "avg") -> DataFrame:
    """The mean of the neighbours up to r away, without the value itself."""
    near = (w or along()).rowsBetween(-r, r)
    n = F.count(value).over(near) - F.col(value).isNotNull().cast("int")
    return df.withColumn(out, F.when(n > 0, (F.sum(value).over(near) - F.coalesce(F.col(value), F.lit(0))).cast("double") / n))


def gradient(df: DataFrame, axis: str = "x", value: str = "v", out: str = "g", w: WindowSpec | None = None) -> DataFrame:
    """Central difference; null at the ends."""
    w = w or along(axis)
    return df.withColumn(out, (F.lead(value).over(w) - F.lag(value).over(w)).cast("double") / 2)


def second_difference(value: str, w: WindowSpec) -> Column:
    return F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)


def laplacian(df: DataFrame, value: str = "v", out: str = "lap") -> DataFrame:
    return df.withColumn(out, (second_difference(value, along("x")) + second_difference(value, along("y"))).cast("double"))


def hessian(df: DataFrame, value: str = "v") -> DataFrame:
    """gxx, gxy and gyy: gradients of gradients."""
    d = gradient(gradient(df, "x", value, "gx"), "y", value, "gy")
    return gradient(gradient(gradient(d, "x", "gx", "gxx"), "y", "gx", "gxy"), "y", "gy", "gyy")


def hessian_eigen(df: DataFrame, value: str = "v") -> DataFrame:
    """l1 >= l2."""
    h = hessian(df, value)
    half, diff = (F.col("gxx") + F.col("gyy")) / 2, (F.col("gxx") - F.col("gyy")) / 2
    root = F.sqrt(diff * diff + F.col("gxy") * F.col("gxy"))
    return h.withColumns({"l1": half + root, "l2": half - root})


def harris_response(df: DataFrame, k: float = 0.04, value: str = "v", out: str = "harris") -> DataFrame:
    h = hessian(df, value)
    trace = F.col("gxx") + F.col("gyy")
    return h.withColumn(out, F.abs(F.col("gxx") * F.col("gyy") - F.col("gxy") * F.col("gxy")) + k * trace * trace)


def ridgeness(df: DataFrame, value: str = "v", out: str = "ridge") -> DataFrame:
    e = hessian_eigen(df, value)
    return e.withColumn(out, F.greatest(F.abs("l1"), F.abs("l2")) - F.least(F.abs("l1"), F.abs("l2")))


def convolve_1d(df: DataFrame, kernel: Sequence[float], w: WindowSpec | None = None, value: str = "v", out: str = "conv", masked: bool = False) -> DataFrame:
    """Sum of kernel times neighbours, centred; missing neighbours make it null, or are left out and the rest scaled if masked."""
    w, half = w or along(), len(kernel) // 2
    near = lambda k: (F.lag(value, half - k) if k <= half else F.lead(value, k - half)).over(w).cast("double")
    terms = [(float(c), near(k)) for k, c in enumerate(kernel)]
    if masked:
        top = sum((F.coalesce(c * v, F.lit(0.0)) for c, v in terms), F.lit(0.0))
        weight = sum((F.when(v.isNotNull(), F.lit(c)).otherwise(0.0) for c, v in terms), F.lit(0.0))
        return df.withColumn(out, F.when(weight != 0, top / weight))
    return df.withColumn(out, sum((c * v for c, v in terms[1:]), terms[0][0] * terms[0][1]))


def gaussian_kernel(sigma: float) -> list[float]:
    import math

    r = max(1, round(3 * sigma))
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def lowpass(df: DataFrame, sigma: float, w: WindowSpec | None = None, value: str = "v", out: str = "low") -> DataFrame:
    return convolve_1d(df, gaussian_kernel(sigma), w, value, out, masked=True)


def unsharp_mask(df: DataFrame, sigma: float = 1.0, alpha: float = 0.5, w: WindowSpec | None = None, value: str = "v", out: str = "sharp") -> DataFrame:
    d = lowpass(df, sigma, w, value, "__low")
    return d.withColumn(out, F.col(value).cast("double") + alpha * (F.col(value).cast("double") - F.col("__low"))).drop("__low")


def dog(df: DataFrame, s1: float, s2: float, w: WindowSpec | None = None, value: str = "v", out: str = "dog") -> DataFrame:
    d = lowpass(lowpass(df, s1, w, value, "__1"), s2, w, value, "__2")
    return d.withColumn(out, F.col("__1") - F.col("__2")).drop("__1", "__2")


def highpass(df: DataFrame, sigma: float, w: WindowSpec | None = None, value: str = "v", out: str = "high") -> DataFrame:
    return lowpass(df, sigma, w, value, "__low").withColumn(out, F.col(value).cast("double") - F.col("__low")).drop("__low")


def rolling_median(df: DataFrame, r: int, w: WindowSpec | None = None, value: str = "v", out: str = "median") -> DataFrame:
    """The middle of the sorted neighbours; the mean of two for an even number."""
    s = F.array_sort(F.collect_list(F.col(value).cast("double")).over((w or along()).rowsBetween(-r, r)))
    n = F.size("__s")
    middle = (F.get("__s", F.floor((n - 1) / 2).cast("int")) + F.get("__s", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("__s", s).withColumn(out, middle).drop("__s")


def median_hat(df: DataFrame, r: int, w: WindowSpec | None = None, value: str = "v", out: str = "hat") -> DataFrame:
    return rolling_median(df, r, w, value, "__med").withColumn(out, F.col(value).cast("double") - F.col("__med")).drop("__med")


def median_outlier_replace(df: DataFrame, k: float, w: WindowSpec | None = None, value: str = "v", out: str = "v_out") -> DataFrame:
    """Values farther from the median of five than k times its mean absolute distance become it."""
    w = w or along()
    d = median_hat(df, 2, w, value, "__hat")
    d = d.withColumn("__spread", F.avg(F.abs("__hat")).over(w.rowsBetween(-2, 2)))
    v = F.col(value).cast("double")
    return d.withColumn(out, F.when(F.abs("__hat") > k * F.col("__spread") + 1e-7, v - F.col("__hat")).otherwise(v)).drop("__hat", "__spread")


def _erode(df: DataFrame, r: int, value: str, out: str, axes: Sequence[WindowSpec], f) -> DataFrame:
    for i, w in enumerate(axes):
        df = df.withColumn(out, f(value if i == 0 else out).over(w.rowsBetween(-r, r)))
    return df


def morph(df: DataFrame, op: str, r: int = 1, axes: Sequence[WindowSpec] | None = None, value: str = "v", out: str = "m") -> DataFrame:
    """Rolling minima and maxima along each axis in turn (a box), and what is made of them."""
    axes = axes or (along(),)
    erode = lambda d, v, o: _erode(d, r, v, o, axes, F.min)
    dilate = lambda d, v, o: _erode(d, r, v, o, axes, F.max)
    opened = lambda d, v, o: dilate(erode(d, v, "__a"), "__a", o)
    closed = lambda d, v, o: erode(dilate(d, v, "__b"), "__b", o)
    d = df.withColumn("__v", F.col(value).cast("double"))
    v, e, x, o, c = (F.col(n) for n in ("__v", "__E", "__D", "__O", "__C"))
    need = {
        "erode": ("E", e), "dilate": ("D", x), "open": ("O", o), "close": ("C", c), "gradient": ("ED", x - e), "tophat": ("O", v - o), "blackhat": ("C", c - v), "internal_gradient": ("E", v - e), "external_gradient": ("D", x - v),
        "laplacian": ("ED", x - 2 * v + e), "laplacian_abs": ("ED", F.abs(x - 2 * v + e)), "ramp_lee": ("EDOC", F.least(x - c, o - e)), "tex_lee": ("EDOC", F.least(x - v, v - e) - F.least(x - c, o - e)),
    }
    if op in ("smooth_open", "smooth_close"):
        first, second = (opened, closed) if op == "smooth_open" else (closed, opened)
        return second(first(d, "__v", "__x"), "__x", out).drop("__v", "__a", "__b", "__x")
    letters, result = need[op]
    for letter, f in (("E", erode), ("D", dilate), ("O", opened), ("C", closed)):
        if letter in letters:
            d = f(d, "__v", f"__{letter}")
    return d.withColumn(out, result).drop("__v", "__a", "__b", "__E", "__D", "__O", "__C")


def local_minmax(df: DataFrame, r: int, filter: str = "average", alpha: float = 1.0, beta: float = 0.0, maxima: bool = True, w: WindowSpec | None = None, value: str = "v", out: str = "extreme") -> DataFrame:
    """Whether a value is strictly above (below) alpha * reference + beta: the neighbours' mean, or their largest (least)."""
    w = w or along()
    if filter == "average":
        d = neighbourhood_average(df, r, w, value, "__ref")
    else:
        f = F.max if maxima else F.min
        pick = F.greatest if maxima else F.least
        d = df.withColumn("__ref", pick(f(value).over(w.rowsBetween(-r, -1)), f(value).over(w.rowsBetween(1, r))).cast("double"))
    v, ref = F.col(value).cast("double"), alpha * F.col("__ref") + beta
    return d.withColumn(out, F.coalesce(v > ref if maxima else v < ref, F.lit(False))).drop("__ref")


def local_peak(df: DataFrame, r: int, w: WindowSpec | None = None, value: str = "v", out: str = "peak") -> DataFrame:
    w = w or along()
    contrast = lambda a, b: F.greatest(F.col(value).cast("double") - F.sum(value).over(w.rowsBetween(a, b)).cast("double") / F.count(value).over(w.rowsBetween(a, b)), F.lit(0.0))
    return df.withColumn(out, F.sqrt(contrast(-r, -1) * contrast(1, r)))


def local_variance(df: DataFrame, r: int, w: WindowSpec | None = None, value: str = "v", out: str = "var") -> DataFrame:
    return df.withColumn(out, F.var_pop(F.col(value).cast("double")).over((w or along()).rowsBetween(-r, r)))


def interpolate_gaps(df: DataFrame, by: Sequence[str] = ("series",), order: str = "ord", value: str = "v", out: str = "filled") -> DataFrame:
    """Null values from the neighbours on both sides, linear in the order; the nearest at the ends. distance: to the nearer neighbour."""
    w = Window.partitionBy(*by).orderBy(order)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))
    # Frames that end with the partition are computed anew for every row, so what comes after is what came before in the reversed order.
    back = Window.partitionBy(*by).orderBy(F.col(order).desc())
    before, after = (F.last(at, True).over(x.rowsBetween(Window.unboundedPreceding, 0)) for x in (w, back))
    d = df.withColumns({"__b": before, "__a": after})
    o, b, a = F.col(order), F.col("__b"), F.col("__a")
    line = b["v"] + (a["v"] - b["v"]) * (o - b["o"]) / (a["o"] - b["o"])
    filled = F.when(a["o"] == b["o"], b["v"]).when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).otherwise(line)
    return d.withColumns({out: filled, "distance": F.least(o - b["o"], a["o"] - o)}).drop("__b", "__a")


def interpolate_gaps_2d(df: DataFrame, value: str = "v", out: str = "filled") -> DataFrame:
    """Gaps filled along rows and along columns, each weighted by the other's distance to its support."""
    h = interpolate_gaps(df, ("frame", "y"), "x", value, "__h").withColumnRenamed("distance", "__dh")
    b = interpolate_gaps(h, ("frame", "x"), "y", value, "__v").withColumnRenamed("distance", "__dv")
    dh, dv = F.coalesce("__dh", F.lit(1e9)).cast("double"), F.coalesce("__dv", F.lit(1e9)).cast("double")
    mixed = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(F.col("__h").isNull(), F.col("__v")).when(F.col("__v").isNull(), F.col("__h")).otherwise((F.col("__h") * dv + F.col("__v") * dh) / (dh + dv))
    return b.withColumn(out, mixed).drop("__h", "__dh", "__v", "__dv")


def accumulate_rotation(df: DataFrame, by: Sequence[str] = ("series",), order: str = "ord", value: str = "v", out: str = "total") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def prefix_sum(df: DataFrame, by: Sequence[str], order: str, value: str, out: str = "total", chunk: int = 1_000_000) -> DataFrame:
    """A running sum of series too long for one task: sums within chunks of the order, and the sums of the chunks before."""
    d = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    within = F.sum(value).over(Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*by, "__chunk").agg(F.sum(value).alias("__s")).select(*by, "__chunk", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    return d.withColumn("__in", within).join(base, [*by, "__chunk"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__in", "__base", "__chunk")


def previous(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], part: Column, out: str = "__before") -> DataFrame:
    """Adds out: the values (a struct) of the row before in order, null for the first. part rises with the order and cuts a series into parts; a part's
    first row gets the last of the parts before, found on one row per part."""
    by, row = list(by), F.struct(*(F.col(c).alias(c) for c in values))
    d = df.withColumn("__part", part)
    ends = d.groupBy(*by, "__part").agg(F.max_by(row, F.struct(*order)).alias("__end"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row per part
    carried = ends.select(*by, "__part", F.lag("__end").over(over.orderBy("__part")).alias("__carry"))
    within = F.lag(row).over(Window.partitionBy(*by, "__part").orderBy(*order))
    return _same(d, carried, [*by, "__part"]).withColumn(out, F.coalesce(within, "__carry")).drop("__part", "__carry")


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column], part: Column) -> DataFrame:
    """Adds a column for each of values: its sum up to each row, within parts (see previous) and over the sums of the parts before."""
    by, names = list(by), list(values)
    d = df.withColumns({"__part": part, **{f"__x_{n}": x for n, x in values.items()}})
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    sums = d.groupBy(*by, "__part").agg(*(F.sum(f"__x_{n}").alias(f"__s_{n}") for n in names))
    base = sums.select(*by, "__part", *(F.coalesce(F.sum(f"__s_{n}").over(over), F.lit(0)).alias(f"__base_{n}") for n in names))
    up = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = _same(d.withColumns({f"__in_{n}": F.sum(f"__x_{n}").over(up) for n in names}), base, [*by, "__part"])
    return d.withColumns({n: F.col(f"__base_{n}") + F.col(f"__in_{n}") for n in names}).drop("__part", *(f"__{k}_{n}" for n in names for k in ("in", "base", "x")))


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, part: Column, out: str) -> DataFrame:
    """Adds out: the sum of value up to each row (see running_totals)."""
    return running_totals(df, by, order, {out: value}, part)


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], part: Column, out: str = "__i") -> DataFrame:
    """Adds out: 0, 1, ... in order."""
    return running_total(df, by, order, F.lit(1).cast("long"), part, out).withColumn(out, F.col(out) - 1)


def frame_interval(df: DataFrame, by: Sequence[str], ts: str, out: str = "interval") -> DataFrame:
    return df.withColumn(out, F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(ts)))


def dropped_frames(df: DataFrame, by: Sequence[str], index: str) -> DataFrame:
    """Numbers missing between the first and the last index."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("saved"), (F.max(index) - F.min(index) + 1 - F.count(F.lit(1))).cast("long").alias("dropped"))


def rank_frames(quality: DataFrame, q: str = "q", index: str = "frame") -> DataFrame:
    """quality: one row per frame. Adds rank (best first) and percent."""
    w = Window.orderBy(F.col(q).desc(), index)
    return quality.withColumns({"rank": F.row_number().over(w).cast("long"), "percent": F.percent_rank().over(w)})


# Sharpness and noise of frames


def noise_map(df: DataFrame, value: str = "v", out: str = "residual") -> DataFrame:
    """Second difference along x of the second difference along y; null at the border."""
    d = df.withColumn("__yy", second_difference(value, along("y")).cast("double"))
    return d.withColumn(out, second_difference("__yy", along("x"))).drop("__yy")


def noise_sigma(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v") -> DataFrame:
    return noise_map(df, value, "__r").groupBy(*by).agg((F.avg(F.abs("__r")) * ((3.141592653589793 / 2) ** 0.5 / 6)).alias("noise"))


def best_snr_channel(df: DataFrame, channels: Sequence[str] = ("v0", "v1", "v2")) -> DataFrame:
    """The channel of each frame with the largest stdev / noise, and the ratio."""
    rows = None
    for k, c in enumerate(channels):
        s = df.groupBy("frame").agg(F.stddev_pop(F.col(c).cast("double")).alias("s")).join(noise_sigma(df, ("frame",), c), "frame").select("frame", F.lit(k).alias("channel"), F.try_divide("s", "noise").alias("snr"))
        rows = s if rows is None else rows.unionByName(s)
    return rows.groupBy("frame").agg(F.max_by(F.struct("channel", "snr"), F.struct("snr", -F.col("channel"))).alias("b")).select("frame", "b.channel", "b.snr")


def sharpness_g4(df: DataFrame, k: int = 1, scale: float = 1.0, value: str = "v") -> DataFrame:
    """sum(G^4) * scale^3 / sum(G) of every frame; G is the spread in a (2k + 1)^2 box."""
    g = morph(df, "gradient", k, (along("x"), along("y")), value, "__g")
    total = F.sum("__g")
    return g.groupBy("frame").agg(F.when(total > 0, F.sum(F.pow("__g", F.lit(4.0))) * scale**3 / total).otherwise(0.0).alias("q"))


def sharpness_lpg(df: DataFrame, alpha: float = 1.0, beta: float = 1.0, value: str = "v") -> DataFrame:
    """Mean of alpha * laplacian^2 + beta * gradient^2 inside the frame."""
    d = gradient(gradient(laplacian(df, value), "x", value, "__gx"), "y", value, "__gy")
    return d.groupBy("frame").agg(F.avg(alpha * F.col("lap") * F.col("lap") + beta * (F.col("__gx") * F.col("__gx") + F.col("__gy") * F.col("__gy"))).alias("q"))


def sharpness_local_contrast(df: DataFrame, k: int = 4, value: str = "v") -> DataFrame:
    """sum(G * low) / sum(low): G the spread in a 5 by 5 box, low the mean of the k by k block."""
    g = morph(df, "gradient", 2, (along("x"), along("y")), value, "__g")
    block = Window.partitionBy("frame", F.expr(f"y div {k}"), F.expr(f"x div {k}"))
    g = g.withColumn("__low", F.sum(value).over(block).cast("double") / F.count(value).over(block))
    return g.groupBy("frame").agg(F.try_divide(F.sum(F.col("__g") * F.col("__low")), F.sum("__low")).alias("q"))


def bad_rows(df: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Frames in which the mean difference between neighbouring rows leaves its median of five by threshold or more: frame, worst, bad."""
    d = df.withColumn("__d", F.abs(F.col(value) - F.lag(value).over(along("y"))))
    rows = d.groupBy("frame", "y").agg(mean("__d").alias("m")).where("m IS NOT NULL")
    hat = median_hat(rows, 2, Window.partitionBy("frame").orderBy("y"), "m", "h")
    return hat.groupBy("frame").agg(F.max(F.abs("h")).alias("worst")).withColumn("bad", F.col("worst") >= threshold)
