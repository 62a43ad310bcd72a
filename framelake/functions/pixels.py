"""Per-sample projections: columns from columns. Missing samples are null, or false in a `valid` column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.scalar import UNARY, C, bgr2gray, col, poly

RANGES = {"8u": (0, 255), "8s": (-128, 127), "16u": (0, 65535), "16s": (-32768, 32767), "32s": (-2147483648, 2147483647)}


def clip(x: C, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def saturate(x: C, depth: str) -> Column:
    """Rounded to even and clamped to an integer depth; float depths stay."""
    return clip(F.rint(col(x)), *map(float, RANGES[depth])) if depth in RANGES else col(x)


def math_expression(expr: str, depth: str = "32f", value: str = "v", valid: str | None = "valid") -> Column:
    """A formula over the row's columns; masked samples keep their value."""
    new = saturate(F.expr(expr), depth)
    return F.when(F.col(valid), new).otherwise(F.col(value).cast("double")) if valid else new


def point_expression(df: DataFrame, expr: str, out: str) -> DataFrame:
    return df.withColumn(out, F.expr(expr))


def pixel_func(name: str, x: C = "v", c1: float = 1, c2: float = 0, c3: float = 1, c4: float = 0) -> Column:
    """c3 * f(c1 * x + c2) + c4; pow takes c2 as the exponent, poly all as coefficients."""
    v = col(x).cast("double")
    if name == "pow":
        return c3 * F.pow(c1 * v, F.lit(float(c2))) + c4
    if name == "poly":
        return poly(v, c1, c2, c3, c4)
    return c3 * UNARY[name](c1 * v + c2) + c4


def calc(name: str, a: C, b: C) -> Column:
    """A binary operation of two samples; a division by zero gives zero."""
    a, b = col(a), col(b)
    return {"add": a + b, "subtract": a - b, "absdiff": F.abs(a - b), "multiply": a * b, "divide": F.when(b != 0, a / b).otherwise(0.0), "max": F.greatest(a, b), "min": F.least(a, b)}[name]


def frame_calc(df: DataFrame, other: DataFrame, name: str, on: tuple[str, ...] = ("y", "x"), value: str = "v") -> DataFrame:
    """Each sample with that of the other frame at its place."""
    right = other.select(*on, F.col(value).alias("__b"))
    return df.join(right, list(on)).withColumn(value, calc(name, F.col(value).cast("double"), F.col("__b").cast("double"))).drop("__b")


def absdiff_previous(df: DataFrame, by: tuple[str, ...] = ("y", "x"), order: str = "frame", value: str = "v", out: str = "diff") -> DataFrame:
    return df.withColumn(out, F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))))


def extract_channel(mode: str | int, channels: tuple[str, ...] = ("v0", "v1", "v2")) -> Column:
    """One value from channels in blue, green, red order."""
    c = [F.col(x).cast("double") for x in channels]
    if isinstance(mode, int):
        return c[mode]
    total = sum(c[1:], c[0])
    return {
        "blue": c[0], "green": c[1], "red": c[2], "gray": bgr2gray(*c[:3]), "min": F.least(*c), "max": F.greatest(*c), "avg": total / len(c), "sum": total,
        "sum2": sum((x * x for x in c[1:]), c[0] * c[0]), "absmax": F.greatest(*map(F.abs, c)), "first_nonzero": F.coalesce(*(F.nullif(x, F.lit(0.0)) for x in c)), "max_color": F.greatest(*c) - F.least(*c),
    }[mode]


def reduce_channels(kind: str, channels: tuple[str, ...] = ("v0", "v1", "v2")) -> Column:
    return extract_channel({"sum": "sum", "avg": "avg", "min": "min", "max": "max", "sum2": "sum2"}[kind], channels)


def color_diff(channel: int, channels: tuple[str, ...] = ("v0", "v1", "v2")) -> Column:
    return F.col(channels[channel]).cast("double") - extract_channel("avg", channels)


def matrix3(m: list[list[float]], channels: tuple[str, str, str] = ("v0", "v1", "v2")) -> list[Column]:
    c = [F.col(x).cast("double") for x in channels]
    return [row[0] * c[0] + row[1] * c[1] + row[2] * c[2] for row in m]


def rotation(rx: float, ry: float, rz: float) -> list[list[float]]:
    """Rx Ry Rz."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(a), math.sin(a)) for a in (rx, ry, rz))
    return [[cy * cz, -cy * sz, sy], [cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy], [sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy]]


def color_balance(alpha: float, gscale: float = 1.0, channels: tuple[str, str, str] = ("v0", "v1", "v2")) -> list[Column]:
    v = math.copysign(alpha * alpha, alpha)
    b, g, r = (F.col(x).cast("double") for x in channels)
    return [b * (1 + v), g * gscale, r * (1 - v)]


def color_matrix(df: DataFrame, matrices: DataFrame, on: str = "src") -> DataFrame:
    """matrices: a row per source with m00 to m22. Replaces v0, v1, v2."""
    j = df.join(matrices, on)
    out = [sum((F.col(f"m{i}{k}") * F.col(f"v{k}").cast("double") for k in range(1, 3)), F.col(f"m{i}0") * F.col("v0").cast("double")) for i in range(3)]
    return j.select(*[c for c in df.columns if c not in ("v0", "v1", "v2")], *(o.alias(f"v{i}") for i, o in enumerate(out)))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 6), saturation and lightness in [0, 1]."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, light = hi - lo, (hi + lo) / 2
    hue = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return hue, F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1))), light


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    c = (1 - F.abs(2 * light - 1)) * s
    k = lambda n: F.pmod(F.lit(float(n)) + h * 2, F.lit(12.0))
    f = lambda n: light - c / 2 * F.greatest(F.lit(-1.0), F.least(k(n) - 3, 9 - k(n), F.lit(1.0)))
    return f(0), f(8), f(4)


def color_saturation(df: DataFrame, scale: float, channels: tuple[str, str, str] = ("v0", "v1", "v2")) -> DataFrame:
    """Saturation times scale, over the data's own range. The range is one row, joined back."""
    c = [F.col(x).cast("double") for x in channels]
    spread = df.agg(F.min(F.least(*c)).alias("__lo"), F.max(F.greatest(*c)).alias("__hi"))
    j = df.crossJoin(F.broadcast(spread))  # one row
    unit = [F.when(F.col("__hi") > F.col("__lo"), (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0) for x in c]
    h, s, light = rgb_to_hsl(unit[2], unit[1], unit[0])
    j = j.withColumns({"__h": h, "__s": F.least(F.greatest(s * scale, F.lit(0.0)), F.lit(1.0)), "__l": light})
    r, g, b = hsl_to_rgb(F.col("__h"), F.col("__s"), F.col("__l"))
    back = lambda x: x * (F.col("__hi") - F.col("__lo")) + F.col("__lo")
    return j.withColumns({n: F.when(col(o).isNotNull(), back(x)) for n, o, x in zip(channels, channels, (b, g, r), strict=True)}).drop("__lo", "__hi", "__h", "__s", "__l")


def scale_channels(stretch: tuple[float, ...], shift: tuple[float, ...], channels: tuple[str, ...] = ("v0", "v1", "v2")) -> list[Column]:
    return [F.col(c).cast("double") * s + o for c, s, o in zip(channels, stretch, shift, strict=True)]


def range_normalize(df: DataFrame, omin: float, omax: float, imin: float | None = None, imax: float | None = None, value: str = "v", out: str = "norm") -> DataFrame:
    """[imin, imax] to [omin, omax]; without a range that of all samples, masked ones too."""
    v = F.col(value).cast("double")
    if imin is not None and imax is not None:
        return df.withColumn(out, (v - imin) * ((omax - omin) / (imax - imin)) + omin)
    spread = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (v - F.col("__lo")) * (omax - omin) / (F.col("__hi") - F.col("__lo")) + omin).otherwise(F.lit(omin))
    return df.crossJoin(F.broadcast(spread)).withColumn(out, scaled).drop("__lo", "__hi")  # one row


def normalize_mean_stdev(df: DataFrame, k: float, omin: float, omax: float, value: str = "v", out: str = "norm") -> DataFrame:
    """[m - k s, m + k s] to [omin, omax]."""
    v = F.col(value).cast("double")
    stats = df.agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"))
    low = F.col("__m") - k * F.col("__s")
    return df.crossJoin(F.broadcast(stats)).withColumn(out, (v - low) * (omax - omin) / (2 * k * F.col("__s") + 1.1920929e-07) + omin).drop("__m", "__s")  # one row


def convert_depth(x: C, to: str, scale: float = 1.0, offset: float = 0.0) -> Column:
    return saturate(col(x).cast("double") * scale + offset, to)


def to_unit_float(x: C, bpp: int) -> Column:
    return col(x).cast("double") / float(1 << bpp)


def mtf(x: C, shadows: float = 0.0, midtones: float = 0.5, highlights: float = 0.0, lclip: float = 0.0, hclip: float = 1.0) -> Column:
    """A smooth rational tone curve on [lclip, hclip] with f(0.5) = midtones; constants are folded here."""
    s, h, m = 10.0**shadows, 10.0**highlights, midtones
    k = 2.0 * (0.5**s * (1 - m) / m) ** (1 / h)
    t = clip((col(x).cast("double") - lclip) / (hclip - lclip), 0.0, 1.0)
    up, down = F.pow(t, F.lit(s)), F.pow(k * (1 - t), F.lit(h))
    return up / (up + down + 1e-9)


def anscombe(x: C, gain: float = 1.0, offset: float = 0.375) -> Column:
    return 2 * F.sqrt(F.greatest(gain * col(x).cast("double") + offset, F.lit(0.0)))


def anscombe_inverse(x: C, gain: float = 1.0, offset: float = 0.375) -> Column:
    half = col(x).cast("double") / 2
    return F.greatest((half * half - offset) / gain, F.lit(0.0))


def apply_colormap(df: DataFrame, lut: DataFrame, index: str) -> DataFrame:
    """lut: i (0 to 255), b, g, r. At most 256 rows, so it may go everywhere."""
    return df.join(F.broadcast(lut.limit(256)), F.col(index) == F.col("i"), "left").drop("i")


def set_pixels(value: float, valid: str = "valid", x: C = "v", invert: bool = False) -> Column:
    where = ~F.col(valid) if invert else F.col(valid)
    return F.when(where, F.lit(value)).otherwise(col(x).cast("double"))


def pow_gamma(x: C, gamma: float, top: float = 65535.0) -> Column:
    return top * F.pow(col(x).cast("double") / top, F.lit(1 / gamma))


def log_curve(x: C, top: float = 65535.0) -> Column:
    return top * F.log1p(col(x).cast("double")) / math.log1p(top)


def flow_to_hsv(df: DataFrame, dx: str, dy: str, maxmotion: float = 0.0, invert_y: bool = False) -> DataFrame:
    """hue (degrees), sat and val: the magnitude, cut at maxmotion, between the least and largest of all."""
    y = -F.col(dy) if invert_y else F.col(dy)
    size = F.hypot(F.col(dx), y)
    df = df.withColumns({"hue": F.pmod(F.degrees(F.atan2(y, F.col(dx))), F.lit(360.0)), "__m": F.least(size, F.lit(maxmotion)) if maxmotion > 0 else size})
    spread = df.agg(F.min("__m").alias("__lo"), F.max("__m").alias("__hi"))
    unit = F.when(F.col("__hi") > F.col("__lo"), (F.col("__m") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(spread)).withColumns({"sat": unit, "val": unit}).drop("__m", "__lo", "__hi")  # one row


def radial_projection(gx: C, gy: C, x: C, y: C, cx: float, cy: float) -> tuple[Column, Column]:
    """Parts of a gradient along and across the direction from a centre."""
    phi = F.atan2(col(y) - cy, col(x) - cx)
    return col(gx) * F.cos(phi) + col(gy) * F.sin(phi), -col(gy) * F.cos(phi) + col(gx) * F.sin(phi)


def convert_color(kind: str, channels: tuple[str, str, str] = ("v0", "v1", "v2")) -> list[Column]:
    """Pointwise conversions of channels in [0, 1], blue first."""
    b, g, r = (F.col(x).cast("double") for x in channels)
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    if kind == "gray":
        return [bgr2gray(b, g, r)]
    if kind == "hsv":
        return [60 * rgb_to_hsl(r, g, b)[0], F.when(hi == 0, 0.0).otherwise((hi - lo) / hi), hi]
    if kind == "hls":
        h, s, light = rgb_to_hsl(r, g, b)
        return [60 * h, light, s]
    if kind == "ycrcb":
        y = bgr2gray(b, g, r)
        return [y, (r - y) * 0.713 + 0.5, (b - y) * 0.564 + 0.5]
    if kind == "xyz":
        return [0.412453 * r + 0.357580 * g + 0.180423 * b, 0.212671 * r + 0.715160 * g + 0.072169 * b, 0.019334 * r + 0.119193 * g + 0.950227 * b]
    raise ValueError(kind)


def desaturate_shadows(wmin: float, wmax: float, channels: tuple[str, str, str] = ("v0", "v1", "v2")) -> list[Column]:
    """Colour mixed with its lightness, from all lightness at a luminance of wmin to all colour at wmax."""
    b, g, r = (F.col(x).cast("double") for x in channels)
    light = (F.greatest(r, g, b) + F.least(r, g, b)) / 2
    share = clip((bgr2gray(b, g, r) - wmin) / (wmax - wmin), 0.0, 1.0)
    return [light + (x - light) * share for x in (b, g, r)]
