"""Registered queries: per-sample projections, scalar functions, geometry, selections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framelake.functions import geometry as geo
from framelake.functions import pixels as px
from framelake.functions import scalar as sc
from framelake.functions.formula import formula
from framelake.operators import joins, lidar, select
from framelake.plans.base import r, reg, rounded

_KEYS = ("frame", "y", "x")
_V = "CAST(v AS DOUBLE)"
_B, _G, _R = (f"CAST(v{k} AS DOUBLE)" for k in range(3))


def _bgr(v):
    return v("bgr").where("v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL")


_FULL = "full_bgr AS (SELECT * FROM bgr WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL)"


def pixel(name: str, f, sql: str, digits: int = 6) -> None:
    """A query with one column out per pixel."""
    reg(name, "pixels", lambda v: v("pixels").select(*_KEYS, r(f(), digits).alias("out")), f"SELECT frame, y, x, round({sql}, {digits}) AS out FROM pixels")


def color(name: str, f, sqls: list[str], digits: int = 6) -> None:
    """A query with columns out0, out1, ... per pixel with all channels."""
    def run(v):
        out = f()
        return _bgr(v).select(*_KEYS, *(r(o, digits).alias(f"out{k}") for k, o in enumerate(out if isinstance(out, (list, tuple)) else [out])))

    reg(name, "bgr", run, f"WITH {_FULL} SELECT frame, y, x, {', '.join(f'round({s}, {digits}) AS out{k}' for k, s in enumerate(sqls))} FROM full_bgr")


pixel("math_expression", lambda: px.math_expression("v * 0.5 + x - y", "16u"), f"CASE WHEN valid THEN least(greatest(round_even({_V} * 0.5e0 + x - y, 0), 0), 65535) ELSE {_V} END")
for _n, _s in (("sqrt", "sqrt({0})"), ("sqr", "{0} * {0}"), ("abs", "abs({0})"), ("log", "ln({0})"), ("inv", "1 / {0}"), ("sin", "sin({0})"), ("cos", "cos({0})"), ("asinh", "asinh({0})"), ("acosh", "acosh({0})")):
    pixel(f"pixel_func_{_n}", lambda n=_n: px.pixel_func(n, F.col("v").cast("double") / 1000, 1, 1), _s.format(f"({_V} / 1000 + 1)"))
for _n in ("exp", "asin", "acos"):
    pixel(f"pixel_func_{_n}", lambda n=_n: px.pixel_func(n, F.col("v").cast("double") / 200000), f"{_n}({_V} / 200000)")
pixel("pixel_func_pow", lambda: px.pixel_func("pow", F.col("v").cast("double") / 1000, 1, 1.5, 2, 3), f"2 * pow({_V} / 1000, 1.5e0) + 3")
pixel("pixel_func_poly", lambda: px.pixel_func("poly", F.col("v").cast("double") / 1000, 1, 2, 3, 4), f"((4 * ({_V} / 1000) + 3) * ({_V} / 1000) + 2) * ({_V} / 1000) + 1", 4)
for _n, _s in (("add", "a + b"), ("subtract", "a - b"), ("absdiff", "abs(a - b)"), ("multiply", "a * b"), ("divide", "CASE WHEN b <> 0 THEN a / b ELSE 0 END"), ("max", "greatest(a, b)"), ("min", "least(a, b)")):
    reg(f"frame_calc_{_n}", "pixels", lambda v, n=_n: px.frame_calc(v("pixels").select(*_KEYS, "v"), v("pixels").where("frame = 0"), n).select(*_KEYS, r("v", 4).alias("out")),
        f"SELECT p.frame, y, x, round({_s}, 4) AS out FROM (SELECT frame, y, x, {_V} AS a FROM pixels) p JOIN (SELECT y, x, {_V} AS b FROM pixels WHERE frame = 0) q USING (y, x)")
reg("absdiff_previous", "pixels", lambda v: px.absdiff_previous(v("pixels")).select(*_KEYS, F.col("diff").cast("double").alias("diff")), "SELECT frame, y, x, CAST(abs(v - lag(v) OVER (PARTITION BY y, x ORDER BY frame)) AS DOUBLE) AS diff FROM pixels")
for _n, _s in {
    "blue": _B, "green": _G, "red": _R, "gray": f"0.114e0 * {_B} + 0.587e0 * {_G} + 0.299e0 * {_R}", "min": f"least({_B}, {_G}, {_R})", "max": f"greatest({_B}, {_G}, {_R})", "avg": f"({_B} + {_G} + {_R}) / 3", "sum": f"{_B} + {_G} + {_R}",
    "sum2": f"{_B} * {_B} + {_G} * {_G} + {_R} * {_R}", "absmax": f"greatest(abs({_B}), abs({_G}), abs({_R}))", "first_nonzero": f"coalesce(nullif({_B}, 0), nullif({_G}, 0), nullif({_R}, 0))", "max_color": f"greatest({_B}, {_G}, {_R}) - least({_B}, {_G}, {_R})",
}.items():
    color(f"extract_channel_{_n}", lambda n=_n: px.extract_channel(n), [_s], 1 if _n == "sum2" else 6)
color("reduce_channels", lambda: px.reduce_channels("avg"), [f"({_B} + {_G} + {_R}) / 3"])
color("bgr2gray", lambda: sc.bgr2gray(*(F.col(c).cast("double") for c in ("v0", "v1", "v2"))), [f"0.114e0 * {_B} + 0.587e0 * {_G} + 0.299e0 * {_R}"])
color("color_diff", lambda: [px.color_diff(k) for k in range(3)], [f"{c} - ({_B} + {_G} + {_R}) / 3" for c in (_B, _G, _R)])
_ROT = px.rotation(0.1, 0.2, 0.3)
color("color_transform", lambda: px.matrix3(_ROT), [f"({m[0]!r})::DOUBLE * {_B} + ({m[1]!r})::DOUBLE * {_G} + ({m[2]!r})::DOUBLE * {_R}" for m in _ROT])
color("color_balance", lambda: px.color_balance(0.5, 1.1), [f"{_B} * 1.25e0", f"{_G} * 1.1e0", f"{_R} * 0.75e0"])
color("scale_channels", lambda: px.scale_channels((1.5, 0.5, 2.0), (1.0, -1.0, 0.25)), [f"{_B} * 1.5e0 + 1", f"{_G} * 0.5e0 - 1", f"{_R} * 2 + 0.25e0"])
reg("color_matrix", "bgr", lambda v: rounded(px.color_matrix(_bgr(v).select(F.col("frame").alias("src"), "y", "x", "v0", "v1", "v2"), v("bgr").select(F.col("frame").alias("src")).distinct().select("src", *((F.lit(float(i == k)) + F.col("src") / 100.0 * (i + k)).alias(f"m{i}{k}") for i in range(3) for k in range(3)))), 4),
    f"WITH {_FULL} SELECT frame AS src, y, x, " + ", ".join("round(" + " + ".join(f"({float(i == k)} + frame / 100e0 * {i + k}) * {c}" for k, c in enumerate((_B, _G, _R))) + f", 4) AS v{i}" for i in range(3)) + " FROM full_bgr")
_UNIT = "u AS (SELECT frame, y, x, " + ", ".join(f"({c} - lo) / (hi - lo) AS {n}" for c, n in zip((_B, _G, _R), "bgr", strict=True)) + f", lo, hi FROM full_bgr, (SELECT min(least({_B}, {_G}, {_R})) AS lo, max(greatest({_B}, {_G}, {_R})) AS hi FROM full_bgr))"
_HSL = """h AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, greatest(r, g, b) - least(r, g, b) AS d, (greatest(r, g, b) + least(r, g, b)) / 2 AS l FROM u),
 s AS (SELECT *, CASE WHEN d = 0 THEN 0e0 ELSE d / (1 - abs(2 * l - 1)) END AS s, CASE WHEN d = 0 THEN 0e0 WHEN mx = r THEN ((g - b) / d + 6) - 6 * floor(((g - b) / d + 6) / 6) WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS h FROM h)"""
reg("color_saturation", "bgr", lambda v: rounded(px.color_saturation(_bgr(v), 1.5), 4),
    f"""WITH {_FULL}, {_UNIT}, {_HSL}, c AS (SELECT *, (1 - abs(2 * l - 1)) * least(greatest(s * 1.5e0, 0), 1) AS c FROM s),
        k AS (SELECT *, h * 2 - 12 * floor(h * 2 / 12) AS k0, 8 + h * 2 - 12 * floor((8 + h * 2) / 12) AS k8, 4 + h * 2 - 12 * floor((4 + h * 2) / 12) AS k4 FROM c)
        SELECT frame, y, x, """ + ", ".join(f"round((l - c / 2 * greatest(-1e0, least({k} - 3, 9 - {k}, 1e0))) * (hi - lo) + lo, 4) AS {n}" for n, k in (("v0", "k4"), ("v1", "k8"), ("v2", "k0"))) + " FROM k")  # fmt: skip
reg("range_normalize", "pixels", lambda v: px.range_normalize(v("pixels"), 0.0, 255.0).select(*_KEYS, r("norm").alias("norm")), f"SELECT frame, y, x, round(({_V} - min({_V}) OVER ()) * 255 / (max({_V}) OVER () - min({_V}) OVER ()), 6) AS norm FROM pixels")
reg("normalize_mean_stdev", "pixels", lambda v: px.normalize_mean_stdev(v("pixels"), 3.0, 0.0, 1.0).select(*_KEYS, r("norm", 5).alias("norm")),
    f"SELECT frame, y, x, round(({_V} - (m - 3 * s)) / (6 * s + 1.1920929e-07), 5) AS norm FROM pixels, (SELECT avg({_V}) AS m, stddev_pop({_V}) AS s FROM pixels)")
pixel("range_clip", lambda: px.clip(F.col("v").cast("double"), 20000.0, 60000.0), f"least(greatest({_V}, 20000e0), 60000e0)")
pixel("convert_depth", lambda: px.convert_depth("v", "8u", 1 / 256), f"least(greatest(round_even({_V} / 256, 0), 0), 255)")
pixel("to_unit_float", lambda: px.to_unit_float("v", 16), f"{_V} / 65536")
_MTF = dict(shadows=0.1, midtones=0.3, highlights=0.2, lclip=1000.0, hclip=90000.0)
_S, _H = 10**0.1, 10**0.2
_K = 2.0 * (0.5**_S * 0.7 / 0.3) ** (1 / _H)
pixel("mtf", lambda: px.mtf("v", **_MTF), f"pow(least(greatest(({_V} - 1000) / 89000, 0e0), 1e0), {_S!r}::DOUBLE) / (pow(least(greatest(({_V} - 1000) / 89000, 0e0), 1e0), {_S!r}::DOUBLE) + pow({_K!r}::DOUBLE * (1 - least(greatest(({_V} - 1000) / 89000, 0e0), 1e0)), {_H!r}::DOUBLE) + 1e-9)")
pixel("anscombe", lambda: px.anscombe("v", 2.0, 1.5), f"2 * sqrt(2 * {_V} + 1.5e0)")
pixel("anscombe_inverse", lambda: px.anscombe_inverse(F.col("v").cast("double") / 100, 3.0, 1.5), f"greatest((({_V} / 100 / 2) * ({_V} / 100 / 2) - 1.5e0) / 3, 0)")
reg("apply_colormap", "pixels", lambda v: px.apply_colormap(v("pixels").withColumn("i8", (F.floor(F.col("v").cast("double") / 512)).cast("int")), v.spark.range(256).select(F.col("id").cast("int").alias("i"), (255 - F.col("id")).alias("b"), (F.col("id") * 7 % 256).alias("g"), F.col("id").alias("r")), "i8").select(*_KEYS, "b", "g", "r"),
    "SELECT frame, y, x, 255 - i AS b, i * 7 % 256 AS g, i AS r FROM (SELECT *, CAST(floor(CAST(v AS DOUBLE) / 512) AS BIGINT) AS i FROM pixels)")
pixel("set_pixels", lambda: px.set_pixels(7.0), f"CASE WHEN valid THEN 7e0 ELSE {_V} END")
pixel("pow_gamma", lambda: px.pow_gamma("v", 2.2), f"65535 * pow({_V} / 65535, {1 / 2.2!r}::DOUBLE)")
pixel("log_curve", lambda: px.log_curve("v"), f"65535 * ln(1 + {_V}) / {math.log1p(65535.0)!r}::DOUBLE", 5)
reg("flow_to_hsv", "pixels", lambda v: rounded(px.flow_to_hsv(v("pixels").select(*_KEYS, (F.col("v").cast("double") - 40000).alias("dx"), (F.col("w").cast("double") * 1000 - 25000).alias("dy")), "dx", "dy", 30000.0).select(*_KEYS, "hue", "sat", "val")),
    f"""WITH f AS (SELECT frame, y, x, {_V} - 40000 AS dx, CAST(w AS DOUBLE) * 1000 - 25000 AS dy FROM pixels), m AS (SELECT *, least(sqrt(dx * dx + dy * dy), 30000e0) AS m, degrees(atan2(dy, dx)) AS a FROM f)
        SELECT frame, y, x, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS hue, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()), 6) AS sat, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()), 6) AS val FROM m""")  # fmt: skip
reg("radial_projection", "pixels", lambda v: v("pixels").select(*_KEYS, *(r(e, 4).alias(n) for n, e in zip(("gr", "gt"), px.radial_projection(F.col("v").cast("double"), F.col("w").cast("double"), "x", "y", 24.5, 19.5), strict=True))),
    f"WITH p AS (SELECT frame, y, x, {_V} AS gx, CAST(w AS DOUBLE) AS gy, atan2(y - 19.5e0, x - 24.5e0) AS p FROM pixels) SELECT frame, y, x, round(gx * cos(p) + gy * sin(p), 4) AS gr, round(-gy * cos(p) + gx * sin(p), 4) AS gt FROM p")
_b, _g, _r = (f"({c} / 105000)" for c in (_B, _G, _R))
_UB = lambda: [(F.col(f"v{k}").cast("double") / 105000).alias(f"v{k}") for k in range(3)]


def unit_color(name: str, f, sqls: list[str]) -> None:
    def run(v):
        return _bgr(v).select(*_KEYS, *_UB()).select(*_KEYS, *(r(o).alias(f"out{k}") for k, o in enumerate(f())))

    reg(name, "bgr", run, f"WITH {_FULL} SELECT frame, y, x, {', '.join(f'round({s}, 6) AS out{k}' for k, s in enumerate(sqls))} FROM full_bgr")


_Y = f"(0.114e0 * {_b} + 0.587e0 * {_g} + 0.299e0 * {_r})"
unit_color("convert_color_ycrcb", lambda: px.convert_color("ycrcb"), [_Y, f"({_r} - {_Y}) * 0.713e0 + 0.5e0", f"({_b} - {_Y}) * 0.564e0 + 0.5e0"])
unit_color("convert_color_xyz", lambda: px.convert_color("xyz"), [f"0.412453e0 * {_r} + 0.357580e0 * {_g} + 0.180423e0 * {_b}", f"0.212671e0 * {_r} + 0.715160e0 * {_g} + 0.072169e0 * {_b}", f"0.019334e0 * {_r} + 0.119193e0 * {_g} + 0.950227e0 * {_b}"])
_MX, _MN = f"greatest({_r}, {_g}, {_b})", f"least({_r}, {_g}, {_b})"
_HUE = f"60 * CASE WHEN {_MX} = {_MN} THEN 0e0 WHEN {_MX} = {_r} THEN CASE WHEN {_g} >= {_b} THEN ({_g} - {_b}) / ({_MX} - {_MN}) ELSE ({_g} - {_b}) / ({_MX} - {_MN}) + 6 END WHEN {_MX} = {_g} THEN ({_b} - {_r}) / ({_MX} - {_MN}) + 2 ELSE ({_r} - {_g}) / ({_MX} - {_MN}) + 4 END"
unit_color("convert_color_hsv", lambda: px.convert_color("hsv"), [_HUE, f"CASE WHEN {_MX} = 0 THEN 0 ELSE ({_MX} - {_MN}) / {_MX} END", _MX])
unit_color("convert_color_hls", lambda: px.convert_color("hls"), [_HUE, f"({_MX} + {_MN}) / 2", f"CASE WHEN {_MX} = {_MN} THEN 0 ELSE ({_MX} - {_MN}) / (1 - abs({_MX} + {_MN} - 1)) END"])
_SH = f"least(greatest(({_Y} - 0.2e0) / 0.3e0, 0e0), 1e0)"
unit_color("desaturate_shadows", lambda: px.desaturate_shadows(0.2, 0.5), [f"({_MX} + {_MN}) / 2 + ({c} - ({_MX} + {_MN}) / 2) * {_SH}" for c in (_b, _g, _r)])
reg("point_expression", "lidar_points", lambda v: px.point_expression(v("lidar_points"), "distance * cos(elevation) + intensity", "out").select("pid", r("out").alias("out")), "SELECT pid, round(distance * cos(elevation) + intensity, 6) AS out FROM lidar_points")

# Scalar functions, on two doubles a and b


def scalar(name: str, f, sql: str) -> None:
    reg(f"fn_{name}", "signal", lambda v: v("signal").select("id", ((F.col("v").cast("double") - 50) / 7).alias("a"), ((F.col("id") % 23 - 11).cast("double") / 3).alias("b")).select("id", r(f(F.col("a"), F.col("b"))).alias("out")),
        f"SELECT id, round({sql}, 6) AS out FROM (SELECT id, (CAST(v AS DOUBLE) - 50) / 7 AS a, CAST(id % 23 - 11 AS DOUBLE) / 3 AS b FROM signal)")


_TAU = "(2 * pi())"
for _n, _f, _s in [
    ("trunc", lambda a, b: sc.trunc(a), "trunc(a)"), ("round", lambda a, b: sc.round_half_away(a), "sign(a) * floor(abs(a) + 0.5e0)"), ("fmod", sc.fmod, "CASE WHEN b <> 0 THEN a % b END"),
    ("exp2", lambda a, b: sc.exp2(b), "pow(2e0, b)"), ("fdim", sc.fdim, "greatest(a - b, 0e0)"), ("fma", lambda a, b: sc.fma(a, b, F.lit(2.0)), "a * b + 2"), ("fmax", sc.fmax, "greatest(a, b)"), ("fmin", sc.fmin, "least(a, b)"),
    ("copysign", sc.copysign, "abs(a) * CASE WHEN b < 0 THEN -1 ELSE 1 END"), ("sinc", lambda a, b: sc.sinc(b), "CASE WHEN b = 0 THEN 1e0 ELSE sin(b) / b END"), ("gexp", lambda a, b: sc.gexp(b), "exp(-b * b / 2)"),
    ("hypot", F.hypot, "sqrt(a * a + b * b)"), ("atan2", F.atan2, "atan2(a, b)"), ("cbrt", lambda a, b: F.cbrt(b), "cbrt(b)"), ("expm1", lambda a, b: F.expm1(b), "exp(b) - 1"), ("log1p", lambda a, b: F.log1p(F.abs(a)), "ln(1 + abs(a))"),
    ("log2", lambda a, b: F.log2(F.abs(a) + 1), "log2(abs(a) + 1)"), ("sinh", lambda a, b: F.sinh(b), "(exp(b) - exp(-b)) / 2"), ("tanh", lambda a, b: F.tanh(b), "(exp(b) - exp(-b)) / (exp(b) + exp(-b))"), ("atanh", lambda a, b: F.atanh(b / 4), "ln((1 + b / 4) / (1 - b / 4)) / 2"),
    ("logb", lambda a, b: sc.logb(F.abs(a) + 0.3123).cast("double"), "floor(log2(abs(a) + 0.3123e0))"), ("significand", lambda a, b: sc.significand(F.abs(a) + 0.3123), "(abs(a) + 0.3123e0) / pow(2e0, floor(log2(abs(a) + 0.3123e0)))"),
    ("remainder", lambda a, b: sc.remainder(a, F.lit(2.0)), "a - 2 * round_even(a / 2, 0)"), ("wrap_0_2pi", lambda a, b: sc.wrap_0_2pi(a), f"a - {_TAU} * floor(a / {_TAU})"), ("wrap_pi", lambda a, b: sc.wrap_pi(a), f"pi() - ((pi() - a) - {_TAU} * floor((pi() - a) / {_TAU}))"),
    ("short_angle", sc.short_angle, f"pi() - ((pi() - (b - a)) - {_TAU} * floor((pi() - (b - a)) / {_TAU}))"), ("linint", lambda a, b: sc.linint(a, F.lit(0.0), F.lit(2.0), b, F.lit(5.0)), "b + a * (5 - b) / 2"),
    ("bit_and", sc.bit_and, "CAST((CAST(trunc(a) AS BIGINT) & 4294967295) & (CAST(trunc(b) AS BIGINT) & 4294967295) AS DOUBLE)"), ("bit_or", sc.bit_or, "CAST((CAST(trunc(a) AS BIGINT) & 4294967295) | (CAST(trunc(b) AS BIGINT) & 4294967295) AS DOUBLE)"),
    ("bit_xor", sc.bit_xor, "CAST(xor(CAST(trunc(a) AS BIGINT) & 4294967295, CAST(trunc(b) AS BIGINT) & 4294967295) AS DOUBLE)"), ("shift_left", lambda a, b: sc.shift_left(a, 3), "CAST(((CAST(trunc(a) AS BIGINT) & 4294967295) * 8) & 4294967295 AS DOUBLE)"),
    ("shift_right", lambda a, b: sc.shift_right(a, 3), "CAST((CAST(trunc(a) AS BIGINT) & 4294967295) >> 3 AS DOUBLE)"), ("less", lambda a, b: sc.truth(a < b), "CAST(a < b AS DOUBLE)"),
    ("aitoff_x", lambda a, b: sc.aitoff_x(b / 2, a / 10), "2 * cos(a / 10) * sin(b / 4) / CASE WHEN acos(cos(a / 10) * cos(b / 4)) = 0 THEN 1 ELSE sin(acos(cos(a / 10) * cos(b / 4))) / acos(cos(a / 10) * cos(b / 4)) END"),
    ("aitoff_y", lambda a, b: sc.aitoff_y(b / 2, a / 10), "sin(a / 10) / CASE WHEN acos(cos(a / 10) * cos(b / 4)) = 0 THEN 1 ELSE sin(acos(cos(a / 10) * cos(b / 4))) / acos(cos(a / 10) * cos(b / 4)) END"),
]:
    scalar(_n, _f, _s)
reg("fn_fractional_year", "track", lambda v: v("events").select("event_id", r(sc.fractional_year(F.year("ts"), F.month("ts"), F.dayofmonth("ts"))).alias("out")),
    "SELECT event_id, round(year(ts) + (dayofyear(ts) - 1) / CASE WHEN (year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 THEN 366e0 ELSE 365e0 END, 6) AS out FROM events")


def special(v):
    sc.register_special(v.spark)
    return v("signal").select("id", *(F.expr(f"round({n}(CAST(v AS DOUBLE) / 20 + 0.1), 6)").alias(n) for n in ("erf", "erfc", "lgamma", "tgamma", "j0", "j1", "y0", "y1")))


reg("fn_special", "signal", special)


def special_one(name: str, call: str, sql: str) -> None:
    """A special function of x (0.1 to 3.8 by steps of a third), against its series or integral."""

    def run(v):
        sc.register_special(v.spark)
        return v("signal").select("id", (F.abs(F.col("id") % 23 - 11).cast("double") / 3 + 0.1).alias("x"), ((F.col("v").cast("double") - 50) / 7 + 0.0123).alias("a")).select("id", r(F.expr(call)).alias("out"))

    reg(f"fn_{name}", "signal", run, f"SELECT id, round({sql}, 6) AS out FROM (SELECT id, CAST(abs(id % 23 - 11) AS DOUBLE) / 3 + 0.1e0 AS x, (CAST(v AS DOUBLE) - 50) / 7 + 0.0123e0 AS a FROM signal)")


_ERF = "exp(-x * x) * list_sum(list_transform(range(0, 100), lambda k: exp((2 * k + 1) * ln(x) - lgamma(k + 1.5e0))))"
_J = "list_sum(list_transform(range(0, 64), lambda k: cos({0} * pi() * (k + 0.5e0) / 64 - x * sin(pi() * (k + 0.5e0) / 64)))) / 64"
_EULER, _HARMONIC = "0.57721566490153286e0", "coalesce(list_sum(list_transform(range(1, {0} + 1), lambda j: 1e0 / j)), 0)"
for _n, _c, _s in [
    ("erf", "erf(x)", _ERF), ("erfc", "erfc(x)", f"1 - {_ERF}"), ("lgamma", "lgamma(x)", "lgamma(x)"), ("tgamma", "tgamma(x)", "gamma(x)"), ("j0", "j0(x)", _J.format(0)), ("j1", "j1(x)", _J.format(1)),
    ("y0", "y0(x)", f"2 / pi() * ((ln(x / 2) + {_EULER}) * {_J.format(0)} + list_sum(list_transform(range(1, 30), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * {_HARMONIC.format('k')} * exp(2 * k * ln(x / 2) - 2 * lgamma(k + 1.0)))))"),
    ("y1", "y1(x)", f"-2 / (pi() * x) + 2 / pi() * ln(x / 2) * {_J.format(1)} - 1 / pi() * list_sum(list_transform(range(0, 30), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * ({_HARMONIC.format('k')} + {_HARMONIC.format('(k + 1)')} - 2 * {_EULER}) * exp((2 * k + 1) * ln(x / 2) - lgamma(k + 1.0) - lgamma(k + 2.0))))"),
    # One unit in the last place towards x.
    ("nextafter", "(nextafter(a, x) - a) * pow(2D, 52 - floor(log2(abs(a))))", "sign(x - a)"),
]:
    special_one(_n, _c, _s)

# Geometry

reg("crop", "pixels", lambda v: geo.crop(v("pixels"), 10, 5, 20, 15).select(*_KEYS, F.col("v").cast("double").alias("v")), f"SELECT frame, y - 5 AS y, x - 10 AS x, {_V} AS v FROM pixels WHERE x BETWEEN 10 AND 29 AND y BETWEEN 5 AND 19")
reg("flip", "pixels", lambda v: geo.flip(v("pixels"), 50, 40, True, True).select(*_KEYS, "n"), "SELECT frame, 39 - y AS y, 49 - x AS x, n FROM pixels")
reg("transpose", "pixels", lambda v: geo.transpose(v("pixels")).select(*_KEYS, "n"), "SELECT frame, x AS y, y AS x, n FROM pixels")
reg("rotate90", "pixels", lambda v: geo.rotate90(v("pixels"), 50, 40).select(*_KEYS, "n"), "SELECT frame, x AS y, 39 - y AS x, n FROM pixels")
_C, _S = math.cos(0.3), math.sin(0.3)
for _n, _s in (("translation", ("x + 2.5e0", "y - 1.5e0")), ("euclidean", (f"1 * ({_C!r}::DOUBLE * x - {_S!r}::DOUBLE * y) + 2.5e0", f"1 * ({_S!r}::DOUBLE * x + {_C!r}::DOUBLE * y) - 1.5e0")), ("scaled_euclidean", (f"2 * ({_C!r}::DOUBLE * x - {_S!r}::DOUBLE * y) + 2.5e0", f"2 * ({_S!r}::DOUBLE * x + {_C!r}::DOUBLE * y) - 1.5e0")), ("affine", ("1.5e0 * x + 0.5e0 * y + 3", "-0.5e0 * x + 2 * y + 4"))):
    reg(f"transform_points_{_n}", "keypoints", lambda v, n=_n: v("keypoints").select("frame", "kp", *(r(e).alias(o) for o, e in zip(("x", "y"), geo.transform_points(n, tx=2.5, ty=-1.5, angle=0.3, scale=2.0, a=(1.5, 0.5, 3.0, -0.5, 2.0, 4.0)), strict=True))),
        f"SELECT frame, kp, round({_s[0]}, 6) AS x, round({_s[1]}, 6) AS y FROM keypoints")
reg("polar_coords", "pixels", lambda v: v("pixels").select(*_KEYS, *(r(e).alias(n) for n, e in zip(("radius", "angle"), geo.polar_coords("x", "y", 24.5, 19.5), strict=True))),
    "SELECT frame, y, x, round(sqrt((x - 24.5e0) * (x - 24.5e0) + (y - 19.5e0) * (y - 19.5e0)), 6) AS radius, round(atan2(y - 19.5e0, x - 24.5e0), 6) AS angle FROM pixels")
reg("downstrike_uneven", "pixels", lambda v: geo.downstrike(v("pixels")).select(*(F.col(c).cast("long").alias(c) for c in _KEYS), "n"), "SELECT frame, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, n FROM pixels WHERE x % 2 = 1 AND y % 2 = 1")
reg("downstrike_even", "pixels", lambda v: geo.downstrike(v("pixels"), odd=False).select(*(F.col(c).cast("long").alias(c) for c in _KEYS), "n"), "SELECT frame, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, n FROM pixels WHERE x % 2 = 0 AND y % 2 = 0")
reg("grid_downsample", "pixels", lambda v: rounded(geo.grid_downsample(v("pixels"), 4).select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v", "n")), "SELECT frame, CAST(y // 4 AS BIGINT) AS y, CAST(x // 4 AS BIGINT) AS x, round(CAST(sum(v) AS DOUBLE) / count(v), 6) AS v, count(v) AS n FROM pixels GROUP BY 1, 2, 3")
reg("derotation_longitude", "track", lambda v: v("track").select("id", r(geo.derotation_longitude("ts")).alias("angle")), f"SELECT id, round(ts * {2 * math.pi / geo.JUPITER_PERIOD!r}::DOUBLE, 6) AS angle FROM track")
_D = "CASE WHEN distance > 0 THEN distance END"
reg("lidar_to_cartesian", "lidar_points", lambda v: v("lidar_points").select("pid", *(r(e).alias(n) for n, e in zip("xyz", geo.lidar_to_cartesian(), strict=True))),
    f"SELECT pid, round({_D} * cos(elevation) * sin(azimuth), 6) AS x, round({_D} * cos(elevation) * cos(azimuth), 6) AS y, round({_D} * sin(elevation), 6) AS z FROM lidar_points")
reg("lidar_depth_height", "lidar_points", lambda v: v("lidar_points").select("pid", r(geo.lidar_depth()).alias("depth"), r(geo.lidar_height()).alias("height"), *(r(e).alias(n) for n, e in zip("xyz", geo.depth_to_cartesian(geo.lidar_depth(), "azimuth", "elevation"), strict=True))),
    "SELECT pid, round(distance * cos(elevation), 6) AS depth, round(distance * sin(elevation), 6) AS height, round(distance * cos(elevation) * sin(azimuth), 6) AS x, round(distance * cos(elevation) * cos(azimuth), 6) AS y, round(distance * cos(elevation) * tan(elevation), 6) AS z FROM lidar_points")
_BIN = "CAST(floor((azimuth - 2 * pi() * floor(azimuth / (2 * pi()))) / (2 * pi() / 720) + 1e-9) AS INT) % 720"
reg("range_bin", "lidar_points", lambda v: geo.range_bin(v("lidar_points"), 2 * math.pi / 720).select("pid", "r", "c"), f"SELECT pid, {_BIN} AS r, laser_ring AS c FROM lidar_points")
_N = f"({geo.EARTH_A!r}::DOUBLE / sqrt(1 - {geo.E2!r}::DOUBLE * sin(lat) * sin(lat)))"
_X, _YY, _Z = f"({_N} + alt) * cos(lat) * cos(lon)", f"({_N} + alt) * cos(lat) * sin(lon)", f"({_N} * (1 - {geo.E2!r}::DOUBLE) + alt) * sin(lat)"
reg("gps_to_ecef", "track", lambda v: v("track").select("id", *(r(e, 4).alias(n) for n, e in zip("xyz", geo.gps_to_ecef("lat", "lon", "alt"), strict=True))), f"SELECT id, round({_X}, 4) AS x, round({_YY}, 4) AS y, round({_Z}, 4) AS z FROM track")


def _there_and_back(v):
    """Positions of the track from their earth-centred coordinates; longitudes by the turn that the track's have, as coordinates hold none."""
    ecef = v("track").select("id", F.col("lon").alias("lon0"), *(e.alias(n) for n, e in zip("xyz", geo.gps_to_ecef("lat", "lon", "alt"), strict=True)))
    back = ecef.select("id", "lon0", *(e.alias(n) for n, e in zip(("lat", "lon", "alt"), geo.ecef_to_gps("x", "y", "z"), strict=True)))
    return back.select("id", r("lat", 8).alias("lat"), r(sc.same_turn("lon", "lon0"), 8).alias("lon"), r("alt", 3).alias("alt"))


reg("ecef_to_gps", "track", _there_and_back,
    "SELECT id, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 3) AS alt FROM track")
reg("enu_round_trip", "track", lambda v: v("track").select("id", *(r(e, 4).alias(n) for n, e in zip("enu", geo.ecef_to_enu(geo.enu_to_ecef((F.lit(1.5), F.lit(-2.5), F.lit(3.5)), geo.gps_to_ecef("lat", "lon", "alt"), "lat", "lon"), geo.gps_to_ecef("lat", "lon", "alt"), "lat", "lon"), strict=True))),
    "SELECT id, 1.5e0 AS e, -2.5e0 AS n, 3.5e0 AS u FROM track")
reg("vehicle_to_enu", "track", lambda v: v("track").select("id", *(r(e).alias(n) for n, e in zip("enu", geo.vehicle_to_enu((F.lit(1.0), F.lit(2.0), F.lit(3.0)), "roll", "pitch", "yaw"), strict=True))),
    """SELECT id, round(cos(yaw) * cos(pitch) + 2 * (cos(yaw) * sin(pitch) * sin(roll) - sin(yaw) * cos(roll)) + 3 * (cos(yaw) * sin(pitch) * cos(roll) + sin(yaw) * sin(roll)), 6) AS e,
       round(sin(yaw) * cos(pitch) + 2 * (sin(yaw) * sin(pitch) * sin(roll) + cos(yaw) * cos(roll)) + 3 * (sin(yaw) * sin(pitch) * cos(roll) - cos(yaw) * sin(roll)), 6) AS n,
       round(-sin(pitch) + 2 * cos(pitch) * sin(roll) + 3 * cos(pitch) * cos(roll), 6) AS u FROM track""")  # fmt: skip
reg("vehicle_round_trip", "track", lambda v: v("track").select("id", *(r(e, 4).alias(n) for n, e in zip("xyz", geo.ecef_to_vehicle(geo.vehicle_to_ecef((F.lit(1.5), F.lit(-2.5), F.lit(3.5)), "lat", "lon", "alt", "roll", "pitch", "yaw"), "lat", "lon", "alt", "roll", "pitch", "yaw"), strict=True))),
    "SELECT id, 1.5e0 AS x, -2.5e0 AS y, 3.5e0 AS z FROM track")
reg("web_mercator", "gps_points", lambda v: v("gps_points").select("id", *(r(e, 3).alias(n) for n, e in zip("xy", geo.web_mercator("lat", "lon"), strict=True))),
    "SELECT id, round(radians(lon) * 6378137e0, 3) AS x, round(6378137e0 * ln(tan(pi() / 4 + radians(least(lat, 85e0)) / 2)), 3) AS y FROM gps_points")
reg("web_mercator_inverse", "gps_points", lambda v: v("gps_points").select("id", *(e.alias(n) for n, e in zip("xy", geo.web_mercator("lat", "lon"), strict=True))).select("id", *(r(e, 6).alias(n) for n, e in zip(("lat", "lon"), geo.web_mercator_inverse("x", "y"), strict=True))),
    "SELECT id, round(least(lat, 85e0), 6) AS lat, round(lon, 6) AS lon FROM gps_points")
reg("geodesic_meters", "gps_points", lambda v: v("gps_points").select("id", r(geo.geodesic_meters(F.radians("lat"), F.radians("lon"), F.lit(0.5), F.lit(-0.25)), 3).alias("m")),
    "SELECT id, round(2 * 6378137e0 * asin(sqrt(least(pow(sin((0.5e0 - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(0.5e0) * pow(sin((-0.25e0 - radians(lon)) / 2), 2), 1))), 3) AS m FROM gps_points")
_TILE = "t AS (SELECT id, lat, lon, least(greatest(CAST(floor((lon + 180) / 360 * 4096) AS BIGINT), 0), 4095) AS tx, least(greatest(CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT), 0), 4095) AS ty FROM gps_points)"


def _tiles(v):
    x, y = geo.geo_tile("lat", "lon", 12)
    return v("gps_points").withColumns({"tx": x, "ty": y})


reg("geo_tile", "gps_points", lambda v: _tiles(v).select("id", "tx", "ty"), f"WITH {_TILE} SELECT id, tx, ty FROM t")
reg("tile_parent", "gps_points", lambda v: _tiles(v).select("id", *(e.alias(n) for n, e in zip(("px", "py"), geo.tile_parent("tx", "ty", 4), strict=True)), geo.tile_contains(8, *geo.tile_parent("tx", "ty", 4), 12, "tx", "ty").alias("inside")), f"WITH {_TILE} SELECT id, tx >> 4 AS px, ty >> 4 AS py, true AS inside FROM t")
reg("tile_bounds", "gps_points", lambda v: _tiles(v).select("id", *(r(e).alias(n) for n, e in zip(("west", "south", "east", "north"), geo.tile_bounds("tx", "ty", 12), strict=True))),
    f"WITH {_TILE} SELECT id, round(tx / 4096e0 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 4096e0)))), 6) AS south, round((tx + 1) / 4096e0 * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * ty / 4096e0)))), 6) AS north FROM t")
reg("quadkey", "gps_points", lambda v: _tiles(v).select("id", geo.quadkey("tx", "ty", 12).alias("key")), f"WITH {_TILE} SELECT id, " + " || ".join(f"CAST(((tx >> {i}) & 1) + 2 * ((ty >> {i}) & 1) AS VARCHAR)" for i in reversed(range(12))) + " AS key FROM t")
reg("tile_join", "gps_points", lambda v: joins.tile_join(v("gps_points"), _tiles(v).groupBy((F.shiftright("tx", 8)).alias("tx"), F.shiftright("ty", 8).alias("ty")).agg(F.count(F.lit(1)).alias("n")), 12, 8).select("id", "tx", "ty", "n"),
    f"WITH {_TILE} SELECT id, tx >> 8 AS tx, ty >> 8 AS ty, count(*) OVER (PARTITION BY tx >> 8, ty >> 8) AS n FROM t")
reg("point_line_distance", "keypoints", lambda v: v("keypoints").select("kp", r(geo.point_line_distance("x", "y", F.lit(10.0), F.lit(20.0), F.lit(500.0), F.lit(300.0))).alias("d")), "SELECT kp, round(abs(280e0 * (x - 10) - 490e0 * (y - 20)) / sqrt(490e0 * 490 + 280e0 * 280), 6) AS d FROM keypoints")
reg("pad_grid", "pixels", lambda v: geo.pad_grid(v("pixels"), 50, 40, 3, "reflect").where("v IS NOT NULL").select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v"),
    f"""WITH g AS (SELECT y, x, CASE WHEN (y + 78) % 78 < 40 THEN (y + 78) % 78 ELSE 78 - (y + 78) % 78 END AS sy, CASE WHEN (x + 98) % 98 < 50 THEN (x + 98) % 98 ELSE 98 - (x + 98) % 98 END AS sx FROM range(-3, 43) a(y), range(-3, 53) b(x))
        SELECT frame, CAST(g.y + 3 AS BIGINT) AS y, CAST(g.x + 3 AS BIGINT) AS x, {_V} AS v FROM g JOIN pixels p ON p.y = sy AND p.x = sx""")  # fmt: skip
reg("aitoff", "gps_points", lambda v: v("gps_points").select("id", *(r(e).alias(n) for n, e in zip("xy", geo.aitoff(F.radians("lon"), F.radians("lat")), strict=True))),
    """WITH a AS (SELECT id, radians(lon) AS o, radians(lat) AS a, acos(cos(radians(lat)) * cos(radians(lon) / 2)) AS q FROM gps_points), s AS (SELECT *, CASE WHEN q = 0 THEN 1 ELSE sin(q) / q END AS s FROM a)
       SELECT id, round(2 * cos(a) * sin(o / 2) / s, 6) AS x, round(sin(a) / s, 6) AS y FROM s""")  # fmt: skip

# Selections

reg("select_pixels", "pixels", lambda v: select.select_pixels(v("pixels"), "v > 50000 AND x % 2 = 0").select(*_KEYS, "sel"), "SELECT frame, y, x, v > 50000 AND x % 2 = 0 AS sel FROM pixels")
_NEW, _OLD = "(v > 50000)", "CASE WHEN x % 7 = 0 THEN NULL ELSE valid END"
for _n, _s in {"KEEP": "o", "REPLACE": "n", "AND": "o AND n", "OR": "o OR n", "XOR": "o <> n", "NAND": "NOT (o AND n)", "NOR": "NOT (o OR n)", "NXOR": "o = n", "ANDN": "n AND NOT o", "ORN": "n OR NOT o", "XORN": "n <> (NOT o)"}.items():
    reg(f"combine_selection_{_n.lower()}", "pixels", lambda v, n=_n: v("pixels").select(*_KEYS, select.combine_selection(F.when(F.col("x") % 7 != 0, F.col("valid")), F.col("v") > 50000, n).alias("sel")),
        f"SELECT frame, y, x, CASE WHEN o IS NULL THEN {'NOT n' if _n[0] == 'N' else 'n'} ELSE {_s} END AS sel FROM (SELECT frame, y, x, {_NEW} AS n, {_OLD} AS o FROM pixels)")
for _n, _s in (("GT", ">"), ("GE", ">="), ("LT", "<"), ("LE", "<="), ("EQ", "="), ("NE", "<>")):
    reg(f"threshold_{_n.lower()}", "pixels", lambda v, n=_n: v("pixels").where(select.threshold("w", 25, n)).select(*_KEYS, "n"), f"SELECT frame, y, x, n FROM pixels WHERE w {_s} 25")
reg("select_roi", "pixels", lambda v: select.select_roi(v("pixels"), 0, 0, 8, 8).select(*_KEYS, "n"), "SELECT frame, y, x, n FROM pixels WHERE x < 8 AND y < 8")
reg("drop_parasitic_returns", "lidar_points", lambda v: rounded(select.drop_parasitic_returns(v("lidar_points").withColumn("depth", geo.lidar_depth())).select("pid", "depth")),
    "SELECT pid, round(CASE WHEN d > 0 THEN d END, 6) AS depth FROM (SELECT pid, distance * cos(elevation) AS d FROM lidar_points) WHERE NOT (d > 0 AND d < 1)")
reg("point_filter", "lidar_points", lambda v: select.point_filter(v("lidar_points"), (F.col("intensity") > 0.5) & (F.col("laser_ring") < 8)).select("pid"), "SELECT pid FROM lidar_points WHERE intensity > 0.5e0 AND laser_ring < 8")
reg("clear_mask", "pixels", lambda v: select.clear_mask(v("pixels")).select(*_KEYS, "valid"), "SELECT frame, y, x, true AS valid FROM pixels")
reg("line_profile", "pixels", lambda v: rounded(select.line_profile(v("pixels"), 2.0, 3.0, 42.0, 33.0)),
    f"SELECT frame, y, x, round(((x - 2) * 40e0 + (y - 3) * 30e0) / 50, 6) AS t, {_V} AS v FROM pixels WHERE abs(30e0 * (x - 2) - 40e0 * (y - 3)) / 50 <= 0.5e0 AND ((x - 2) * 40e0 + (y - 3) * 30e0) / 50 BETWEEN 0 AND 50")
reg("project_to_points", "lidar_points", lambda v: lidar.project_to_points(geo.range_bin(v("lidar_points"), 2 * math.pi / 90), lidar.range_aliasing(geo.range_bin(v("lidar_points"), 2 * math.pi / 90))).select("pid", "n"),
    f"WITH b AS (SELECT *, {_BIN.replace('720', '90')} AS r FROM lidar_points), n AS (SELECT frame, r, laser_ring, count(*) AS n FROM b WHERE distance > 0 GROUP BY ALL) SELECT pid, n FROM b LEFT JOIN n USING (frame, r, laser_ring)")
reg("laser_corrections", "lidar_points", lambda v: rounded(lidar.laser_corrections(v("lidar_points").withColumnRenamed("laser_ring", "laser_id"), v("lidar_points").select(F.col("laser_ring").alias("laser_id")).distinct().select("laser_id", F.col("laser_id").alias("ring"), (F.col("laser_id") / 100.0).alias("rot_corr"), (F.col("laser_id") / 50.0 - 0.15).alias("vert_corr"))).select("pid", "ring", "azimuth", "elevation")),
    "SELECT pid, laser_ring AS ring, round(a - 2 * pi() * floor(a / (2 * pi())), 6) AS azimuth, round(laser_ring / 50e0 - 0.15e0, 6) AS elevation FROM (SELECT *, azimuth - laser_ring / 100e0 AS a FROM lidar_points)")
reg("formula_functions", "signal", lambda v: formula(v("signal").selectExpr("id", "(CAST(v AS DOUBLE) - 50) / 7 AS a", "CAST(id % 23 - 11 AS DOUBLE) / 3 AS b"), "sinc(b) + gexp(b) * lwrap(a) - shortdist(a, b) + fdim(a, b) + fma(a, b, 2) + choose(b, copysign(a, b), exp2(b)) + bgr2gray(a, b, 1)", "out").select("id", r("out").alias("out")),
    """WITH s AS (SELECT id, (CAST(v AS DOUBLE) - 50) / 7 AS a, CAST(id % 23 - 11 AS DOUBLE) / 3 AS b FROM signal)
       SELECT id, round(CASE WHEN b = 0 THEN 1 ELSE sin(b) / b END + exp(-b * b / 2) * (a - 2 * pi() * floor(a / (2 * pi()))) - (pi() - ((pi() - (b - a)) - 2 * pi() * floor((pi() - (b - a)) / (2 * pi())))) + greatest(a - b, 0e0) + (a * b + 2)
       + CASE WHEN b <> 0 THEN abs(a) * CASE WHEN b < 0 THEN -1 ELSE 1 END ELSE pow(2e0, b) END + (0.114e0 * a + 0.587e0 * b + 0.299e0), 6) AS out FROM s""")  # fmt: skip


def _drawn(v):
    """Random draws by seed and id, of which each frame's bounds and moments are known."""
    d = formula(formula(v("samples").selectExpr("frame", "y", "x", "c", "v"), "rand(2, 5)", "u", 7), "noise(10, 3)", "g", 8)
    again = formula(v("samples").selectExpr("frame", "y", "x", "c", "v").repartition("y", "x"), "rand(2, 5)", "u", 7)
    same = again.groupBy("frame").agg(F.round(F.sum("u"), 6).alias("again"))
    each = d.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("u") >= 2) & (F.col("u") < 5)).alias("inside"), (F.abs(F.avg("u") - 3.5) < 0.7).alias("centred"), (F.abs(F.avg("g") - 10) < 2).alias("around"),
        (F.abs(F.stddev_pop("g") - 3) < 1.5).alias("spread"), F.round(F.sum("u"), 6).alias("once"),
    )
    return each.join(same, "frame").select("frame", "n", "inside", "centred", "around", "spread", (F.abs(F.col("once") - F.col("again")) < 1e-3).alias("repeats"))


reg("fn_random", "samples", _drawn, "SELECT frame, count(*) AS n, count(*) AS inside, true AS centred, true AS around, true AS spread, true AS repeats FROM samples GROUP BY frame")
