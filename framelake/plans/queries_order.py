"""Registered queries: windows, stencils, laser cells, top-k."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framelake.functions import geometry as geo
from framelake.operators import geodesic, lidar, ordered, topk
from framelake.plans.base import r, reg, rounded

_K = ("frame", "y", "x")
_V = "CAST(v AS DOUBLE)"
_A, _B = "(PARTITION BY frame, y ORDER BY x)", "(PARTITION BY frame, x ORDER BY y)"


def near(k: int, axis: str = _A) -> str:
    return f"{axis[:-1]} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


def pixel(name: str, f, sql: str, digits: int = 5, out: str = "out") -> None:
    """f adds the column `out` to pixels."""
    reg(name, "pixels", lambda v: f(v("pixels")).select(*_K, r(F.col(out).cast("double"), digits).alias("out")), f"{sql.split('|')[0]}SELECT frame, y, x, round(CAST({sql.split('|')[1]} AS DOUBLE), {digits}) AS out FROM {sql.split('|')[2]}")


_RUNNING = f"""WITH RECURSIVE a AS (SELECT series, ord, {_V} AS avg FROM signal WHERE ord = 0 UNION ALL
        SELECT s.series, s.ord, CASE WHEN s.ord < 5 THEN (a.avg * s.ord + CAST(s.v AS DOUBLE)) / (s.ord + 1) ELSE (a.avg * 5 + CAST(s.v AS DOUBLE)) / 6 END FROM a JOIN signal s ON s.series = a.series AND s.ord = a.ord + 1)
        SELECT series, ord, round(avg, 6) AS avg FROM a"""
reg("running_average", "signal", lambda v: ordered.running_average(v("signal")).select("series", "ord", r("avg", 6).alias("avg")), _RUNNING)
reg("running_average_series", "signal", lambda v: ordered.running_average_series(v("signal")).select("series", "ord", r("avg", 6).alias("avg")), _RUNNING)
pixel("neighbourhood_average", lambda d: ordered.neighbourhood_average(d, 2, out="out"), f"|CAST(sum(v) OVER w - v AS DOUBLE) / nullif(count(v) OVER w - 1, 0)|pixels WINDOW w AS {near(2)}", 6)
pixel("gradient", lambda d: ordered.gradient(d, out="out"), f"|CAST(lead(v) OVER w - lag(v) OVER w AS DOUBLE) / 2|pixels WINDOW w AS {_A}")
pixel("laplacian", lambda d: ordered.laplacian(d, out="out"), f"|lag(v) OVER a - 2 * v + lead(v) OVER a + lag(v) OVER b - 2 * v + lead(v) OVER b|pixels WINDOW a AS {_A}, b AS {_B}")
_HESS = f"""WITH g AS (SELECT *, CAST(lead(v) OVER a - lag(v) OVER a AS DOUBLE) / 2 AS gx, CAST(lead(v) OVER b - lag(v) OVER b AS DOUBLE) / 2 AS gy FROM pixels WINDOW a AS {_A}, b AS {_B}),
 hs AS (SELECT *, (lead(gx) OVER a - lag(gx) OVER a) / 2 AS gxx, (lead(gx) OVER b - lag(gx) OVER b) / 2 AS gxy, (lead(gy) OVER b - lag(gy) OVER b) / 2 AS gyy FROM g WINDOW a AS {_A}, b AS {_B}),
 eg AS (SELECT *, (gxx + gyy) / 2 + sqrt((gxx - gyy) / 2 * ((gxx - gyy) / 2) + gxy * gxy) AS l1, (gxx + gyy) / 2 - sqrt((gxx - gyy) / 2 * ((gxx - gyy) / 2) + gxy * gxy) AS l2 FROM hs) """
reg("hessian_eigen", "pixels", lambda v: ordered.hessian_eigen(v("pixels")).select(*_K, r("l1", 4).alias("l1"), r("l2", 4).alias("l2")), _HESS + "SELECT frame, y, x, round(l1, 4) AS l1, round(l2, 4) AS l2 FROM eg")
pixel("harris_response", lambda d: ordered.harris_response(d.withColumn("v", F.col("v").cast("double") / 1000), out="out"), _HESS.replace("CAST(lead(v) OVER a - lag(v) OVER a AS DOUBLE) / 2", "(CAST(lead(v) OVER a AS DOUBLE) / 1000 - CAST(lag(v) OVER a AS DOUBLE) / 1000) / 2").replace("CAST(lead(v) OVER b - lag(v) OVER b AS DOUBLE) / 2", "(CAST(lead(v) OVER b AS DOUBLE) / 1000 - CAST(lag(v) OVER b AS DOUBLE) / 1000) / 2") + "|abs(gxx * gyy - gxy * gxy) + 0.04e0 * (gxx + gyy) * (gxx + gyy)|hs", 4)
pixel("ridgeness", lambda d: ordered.ridgeness(d, out="out"), _HESS + "|greatest(abs(l1), abs(l2)) - least(abs(l1), abs(l2))|eg", 4)
_G = ordered.gaussian_kernel(1.0)
_CONV = " + ".join(f"({c!r})::DOUBLE * CAST({'lag' if k <= 1 else 'lead'}(v, {abs(1 - k)}) OVER w AS DOUBLE)" for k, c in enumerate((0.25, 0.5, 0.25)))
pixel("convolve_1d", lambda d: ordered.convolve_1d(d, (0.25, 0.5, 0.25), out="out"), f"|{_CONV}|pixels WINDOW w AS {_A}", 6)


def low(sigma: float, w: str = "w") -> str:
    k = ordered.gaussian_kernel(sigma)
    h = len(k) // 2
    term = lambda i: f"CAST({'lag' if i <= h else 'lead'}(v, {abs(h - i)}) OVER {w} AS DOUBLE)"
    return "((" + " + ".join(f"coalesce({c!r}::DOUBLE * {term(i)}, 0)" for i, c in enumerate(k)) + ") / (" + " + ".join(f"CASE WHEN {term(i)} IS NULL THEN 0 ELSE {c!r}::DOUBLE END" for i, c in enumerate(k)) + "))"


_W = f"pixels WINDOW w AS {_A}"
pixel("lowpass", lambda d: ordered.lowpass(d, 1.0, out="out"), f"|{low(1.0)}|{_W}", 4)
pixel("unsharp_mask", lambda d: ordered.unsharp_mask(d, 1.0, 0.5, out="out"), f"|{_V} + 0.5e0 * ({_V} - {low(1.0)})|{_W}", 4)
pixel("dog", lambda d: ordered.dog(d, 1.0, 1.5, out="out"), f"|{low(1.0)} - {low(1.5)}|{_W}", 4)
pixel("highpass", lambda d: ordered.highpass(d, 1.0, out="out"), f"|{_V} - {low(1.0)}|{_W}", 4)
_MED = f"quantile_cont({_V}, 0.5) OVER w"
pixel("rolling_median", lambda d: ordered.rolling_median(d, 2, out="out"), f"|{_MED}|pixels WINDOW w AS {near(2)}")
pixel("median_hat", lambda d: ordered.median_hat(d, 2, out="out"), f"|{_V} - {_MED}|pixels WINDOW w AS {near(2)}")
pixel("median_outlier_replace", lambda d: ordered.median_outlier_replace(d, 1.5, out="out"), f"WITH h AS (SELECT *, {_V} - {_MED} AS hat FROM pixels WINDOW w AS {near(2)}), s AS (SELECT *, avg(abs(hat)) OVER w AS s FROM h WINDOW w AS {near(2)}) |CASE WHEN abs(hat) > 1.5e0 * s + 1e-7 THEN {_V} - hat ELSE {_V} END|s", 4)
_MO = f"""WITH m1 AS (SELECT *, {_V} AS d, min({_V}) OVER {near(1)} AS e, max({_V}) OVER {near(1)} AS dl FROM pixels), m2 AS (SELECT *, max(e) OVER {near(1)} AS o, min(dl) OVER {near(1)} AS c FROM m1),
 m3 AS (SELECT *, max(o) OVER {near(1)} AS od, min(c) OVER {near(1)} AS ce FROM m2), m4 AS (SELECT *, min(od) OVER {near(1)} AS so, max(ce) OVER {near(1)} AS sc FROM m3) """
for _n, _s in {
    "erode": "e", "dilate": "dl", "open": "o", "close": "c", "gradient": "dl - e", "tophat": "d - o", "blackhat": "c - d", "internal_gradient": "d - e", "external_gradient": "dl - d", "laplacian": "dl - 2 * d + e", "laplacian_abs": "abs(dl - 2 * d + e)",
    "ramp_lee": "least(dl - c, o - e)", "tex_lee": "least(dl - d, d - e) - least(dl - c, o - e)", "smooth_open": "so", "smooth_close": "sc",
}.items():
    pixel(f"morph_{_n}", lambda d, n=_n: ordered.morph(d, n, 1, out="out"), f"{_MO}|{_s}|m4")
pixel("morph_box", lambda d: ordered.morph(d, "gradient", 1, (ordered.along("x"), ordered.along("y")), out="out"), f"WITH a AS (SELECT *, min({_V}) OVER {near(1)} AS e, max({_V}) OVER {near(1)} AS dl FROM pixels) |max(dl) OVER {near(1, _B)} - min(e) OVER {near(1, _B)}|a")
reg("local_minmax", "pixels", lambda v: ordered.local_minmax(v("pixels"), 2, "average", 1.1).select(*_K, "extreme"), f"SELECT frame, y, x, coalesce({_V} > 1.1e0 * (CAST(sum(v) OVER w - v AS DOUBLE) / nullif(count(v) OVER w - 1, 0)), false) AS extreme FROM pixels WINDOW w AS {near(2)}")
reg("local_minmax_dilate", "pixels", lambda v: ordered.local_minmax(v("pixels"), 1, "dilate").select(*_K, "extreme"), f"SELECT frame, y, x, coalesce({_V} > CAST(greatest(lag(v) OVER w, lead(v) OVER w) AS DOUBLE), false) AS extreme FROM {_W}")
_SIDE = lambda a, b: f"greatest({_V} - CAST(sum(v) OVER ({_A[1:-1]} ROWS BETWEEN {a} AND {b}) AS DOUBLE) / count(v) OVER ({_A[1:-1]} ROWS BETWEEN {a} AND {b}), 0)"
reg("local_peak", "pixels", lambda v: ordered.local_peak(v("pixels"), 2).where("peak IS NOT NULL").select(*_K, r("peak", 4).alias("peak")),
    f"WITH c AS (SELECT frame, y, x, count(v) OVER ({_A[1:-1]} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS nl, count(v) OVER ({_A[1:-1]} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS nr, {_SIDE('2 PRECEDING', '1 PRECEDING')} AS l, {_SIDE('1 FOLLOWING', '2 FOLLOWING')} AS rr FROM pixels) SELECT frame, y, x, round(CASE WHEN nl = 0 OR nr = 0 THEN 0 ELSE sqrt(l * rr) END, 4) AS peak FROM c")
pixel("local_variance", lambda d: ordered.local_variance(d.withColumn("v", F.col("v").cast("double") / 1000), 2, out="out"), f"|var_pop({_V} / 1000) OVER w|pixels WINDOW w AS {near(2)}", 4)
_GAP = "CASE WHEN valid THEN CAST(v AS DOUBLE) END"
reg("interpolate_gaps", "signal", lambda v: ordered.interpolate_gaps(v("signal").withColumn("v", F.when(F.col("valid"), F.col("v")))).select("series", "ord", r("filled", 5).alias("filled"), "distance"),
    f"""WITH g AS (SELECT series, ord, {_GAP} AS v FROM signal), e AS (SELECT series, ord, last_value(CASE WHEN v IS NOT NULL THEN ord END IGNORE NULLS) OVER u AS bo, last_value(v IGNORE NULLS) OVER u AS bv, first_value(CASE WHEN v IS NOT NULL THEN ord END IGNORE NULLS) OVER d AS ao, first_value(v IGNORE NULLS) OVER d AS av
        FROM g WINDOW u AS (PARTITION BY series ORDER BY ord ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY series ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT series, ord, round(CASE WHEN ao = bo THEN bv WHEN bo IS NULL THEN av WHEN ao IS NULL THEN bv ELSE bv + (av - bv) * (ord - bo) / (ao - bo) END, 5) AS filled, least(ord - bo, ao - ord) AS distance FROM e""")  # fmt: skip
reg("interpolate_gaps_2d", "pixels", lambda v: ordered.interpolate_gaps_2d(v("pixels").select(*_K, F.when(F.col("valid"), F.col("v").cast("double")).alias("v"))).select(*_K, r("filled", 7).alias("filled")),
    """WITH g AS (SELECT frame, y, x, CASE WHEN valid THEN CAST(v AS DOUBLE) END AS v FROM pixels), """ + ", ".join(
        f"""e{n} AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {o} END IGNORE NULLS) OVER u AS bo{n}, last_value(v IGNORE NULLS) OVER u AS bv{n}, first_value(CASE WHEN v IS NOT NULL THEN {o} END IGNORE NULLS) OVER d AS ao{n}, first_value(v IGNORE NULLS) OVER d AS av{n}
        FROM {s} WINDOW u AS (PARTITION BY frame, {k} ORDER BY {o} ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY frame, {k} ORDER BY {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""" for n, s, k, o in (("h", "g", "y", "x"), ("v", "eh", "x", "y"))) + """,
    f AS (SELECT *, """ + ", ".join(f"CASE WHEN ao{n} = bo{n} THEN bv{n} WHEN bo{n} IS NULL THEN av{n} WHEN ao{n} IS NULL THEN bv{n} ELSE bv{n} + (av{n} - bv{n}) * ({o} - bo{n}) / (ao{n} - bo{n}) END AS f{n}, coalesce(least({o} - bo{n}, ao{n} - {o}), 1e9) AS d{n}" for n, o in (("h", "x"), ("v", "y"))) + """ FROM ev)
    SELECT frame, y, x, round(CASE WHEN v IS NOT NULL THEN v WHEN fh IS NULL THEN fv WHEN fv IS NULL THEN fh ELSE (fh * dv + fv * dh) / (dh + dv) END, 7) AS filled FROM f""")  # fmt: skip
reg("accumulate_rotation", "signal", lambda v: ordered.accumulate_rotation(v("signal")).select("series", "ord", F.col("total").cast("double").alias("total")), "SELECT series, ord, CAST(sum(v) OVER (PARTITION BY series ORDER BY ord) AS DOUBLE) AS total FROM signal")
reg("prefix_sum", "signal", lambda v: ordered.prefix_sum(v("signal"), ("series",), "ord", "v", chunk=32).select("series", "ord", F.col("total").cast("double").alias("total")), "SELECT series, ord, CAST(sum(v) OVER (PARTITION BY series ORDER BY ord) AS DOUBLE) AS total FROM signal")
reg("frame_interval", "lidar_points", lambda v: ordered.frame_interval(v("lidar_points").select("frame", "laser_ring", "pid", (F.col("t") * 1000000 + F.col("pid")).alias("t")), ("frame", "laser_ring"), "t").select("pid", "interval"),
    "SELECT pid, u - lag(u) OVER (PARTITION BY frame, laser_ring ORDER BY u) AS interval FROM (SELECT *, t * 1000000 + pid AS u FROM lidar_points)")
reg("dropped_frames", "lidar_points", lambda v: ordered.dropped_frames(v("lidar_points"), ("frame", "laser_ring"), "pid"), "SELECT frame, laser_ring, count(*) AS saved, CAST(max(pid) - min(pid) + 1 - count(*) AS BIGINT) AS dropped FROM lidar_points GROUP BY 1, 2")
_Q = f"q AS (SELECT frame, round(stddev_pop({_V}) / abs(CAST(sum(v) AS DOUBLE) / count(v)), 8) AS q FROM pixels GROUP BY frame)"


def _quality(v):
    from framelake.operators import stats

    return stats.normalized_variance(v("pixels")).select("frame", F.round("sharpness", 8).alias("q"))


reg("rank_frames", "pixels", lambda v: rounded(ordered.rank_frames(_quality(v)), 8), f"WITH {_Q} SELECT frame, q, row_number() OVER w AS rank, round(percent_rank() OVER w, 8) AS percent FROM q WINDOW w AS (ORDER BY q DESC, frame)")
reg("master_frame", "pixels", lambda v: topk.master_frame(_quality(v), n=20), f"WITH {_Q} SELECT frame FROM q WHERE frame >= 16 - 10 AND frame < 16 - 10 + 10 ORDER BY q DESC, frame LIMIT 1")
reg("master_frame_middle", "pixels", lambda v: topk.master_frame(_quality(v), "middle_index"), "SELECT frame FROM (SELECT DISTINCT frame FROM pixels) WHERE frame = (SELECT (max(frame) + 1) // 2 FROM pixels)")
reg("master_frame_specific", "pixels", lambda v: topk.master_frame(_quality(v), "specific_index", 7), "SELECT DISTINCT frame FROM pixels WHERE frame = 7")
reg("best_percent", "pixels", lambda v: topk.best_percent(_quality(v), 25), f"WITH {_Q} SELECT frame, q FROM q QUALIFY percent_rank() OVER (ORDER BY q DESC, frame) <= 0.25e0")
reg("top_keypoints", "keypoints", lambda v: topk.top_keypoints(v("keypoints")).select("frame", "kp", F.col("rank").cast("long").alias("rank")), "SELECT frame, kp, row_number() OVER w AS rank FROM keypoints WINDOW w AS (PARTITION BY frame ORDER BY response DESC, kp) QUALIFY row_number() OVER w <= 20")
reg("sort_track", "track", lambda v: topk.sort_track(v("track")).select("id", "ts"), "SELECT id, ts FROM track")
reg("bad_rows_frame_check", "pixels", lambda v: rounded(ordered.bad_rows(v("pixels"), 9000.0), 5),
    f"""WITH d AS (SELECT frame, y, abs(v - lag(v) OVER {_B}) AS d FROM pixels), m AS (SELECT frame, y, CAST(sum(d) AS DOUBLE) / count(d) AS m FROM d WHERE d IS NOT NULL GROUP BY frame, y),
        h AS (SELECT frame, m - quantile_cont(m, 0.5) OVER (PARTITION BY frame ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM m) SELECT frame, round(max(abs(h)), 5) AS worst, max(abs(h)) >= 9000 AS bad FROM h GROUP BY frame""")  # fmt: skip
reg("radial_gradient", "pixels", lambda v: _radial(v), f"""WITH g AS (SELECT frame, y, x, CAST(lead(v) OVER a - lag(v) OVER a AS DOUBLE) / 2 AS gx, CAST(lead(v) OVER b - lag(v) OVER b AS DOUBLE) / 2 AS gy, atan2(y - 19.5e0, x - 24.5e0) AS p FROM pixels WINDOW a AS {_A}, b AS {_B})
        SELECT frame, y, x, round(gx * cos(p) + gy * sin(p), 4) AS gr, round(-gy * cos(p) + gx * sin(p), 4) AS gt FROM g""")  # fmt: skip


def _radial(v):
    from framelake.functions import pixels as px

    d = ordered.gradient(ordered.gradient(v("pixels"), "x", out="gx"), "y", out="gy")
    return d.select(*_K, *(r(e, 4).alias(n) for n, e in zip(("gr", "gt"), px.radial_projection("gx", "gy", "x", "y", 24.5, 19.5), strict=True)))


# Laser cells: 90 azimuth bins

_BIN = "CAST(floor((azimuth - 2 * pi() * floor(azimuth / (2 * pi()))) / (2 * pi() / 90) + 1e-9) AS INT) % 90"
_CELLS = f"cells AS (SELECT frame, {_BIN} AS r, laser_ring AS c, pid, distance, distance * cos(elevation) AS depth, distance * sin(elevation) AS height, distance * sin(elevation) AS z, intensity, azimuth, elevation, t FROM lidar_points)"


def _binned(v):
    return geo.range_bin(v("lidar_points"), 2 * math.pi / 90)


for _n in ("distance", "depth", "x", "y", "z", "height", "intensity", "elevation", "azimuth", "ring", "timestamp"):
    _e = {"ring": "CAST(c AS DOUBLE)", "timestamp": "CAST(t AS DOUBLE)", "x": "distance * cos(elevation) * sin(azimuth)", "y": "distance * cos(elevation) * cos(azimuth)"}.get(_n, _n)
    reg(f"range_image_{_n}", "lidar_points", lambda v, n=_n: rounded(lidar.range_image(_binned(v), (n,)).withColumnRenamed(n, "value")), f"WITH {_CELLS} SELECT frame, r, c, round(arg_min({_e}, (distance, pid)), 6) AS value FROM cells WHERE distance > 0 GROUP BY frame, r, c")
reg("range_aliasing", "lidar_points", lambda v: lidar.range_aliasing(_binned(v)), f"WITH {_CELLS} SELECT frame, r, c, count(*) AS n FROM cells WHERE distance > 0 GROUP BY frame, r, c")


def _image(v):
    return lidar.range_image(_binned(v), ("depth", "height", "z"))


#: A cell's rows of ground_scan by recursion over the rings of a line; v is the height of the next cell or null.
_GROUND = f"""WITH RECURSIVE {_CELLS}, img AS (SELECT frame, r, c, arg_min(z, (distance, pid)) AS z FROM cells WHERE distance > 0 GROUP BY frame, r, c), ln AS (SELECT DISTINCT frame, r FROM img),
 sc AS (SELECT frame, r, -1 AS c, 0 AS state, CAST(NULL AS DOUBLE) AS last, 0 AS gaps, false AS ground FROM ln
   UNION ALL SELECT frame, r, c, CASE move WHEN 'wait' THEN 0 WHEN 'look' THEN 1 WHEN 'lose' THEN 1 ELSE 2 END, CASE WHEN move IN ('find', 'follow') THEN v ELSE last END,
     CASE move WHEN 'follow' THEN 0 WHEN 'lose' THEN 0 WHEN 'skip' THEN gaps + 1 ELSE gaps END, move IN ('find', 'follow')
   FROM (SELECT frame, r, c, v, last, gaps, CASE WHEN state = 0 AND NOT coalesce(v < -1.1e0, false) THEN 'wait' WHEN state < 2 AND coalesce(abs(v + 2e0) < 0.25e0, false) THEN 'find' WHEN state < 2 THEN 'look'
       WHEN coalesce(v - last > -0.2e0 AND v - last < 0.1e0, false) THEN 'follow' WHEN gaps >= 4 THEN 'lose' ELSE 'skip' END AS move
     FROM (SELECT sc.frame, sc.r, sc.c + 1 AS c, sc.state, sc.last, sc.gaps, img.z AS v FROM sc LEFT JOIN img ON img.frame = sc.frame AND img.r = sc.r AND img.c = sc.c + 1 WHERE sc.c < 15)))
 SELECT frame, r, c, ground FROM sc JOIN img USING (frame, r, c)"""
reg("ground_scan", "lidar_points", lambda v: lidar.ground_scan(lidar.range_image(_binned(v), ("z",)), rings=16).select("frame", "r", "c", "ground"), _GROUND)
reg("surface_slope", "lidar_points", lambda v: rounded(lidar.surface_slope(_image(v), 90)),
    f"""WITH {_CELLS}, img AS (SELECT frame, r, c, arg_min(depth, (distance, pid)) AS d, arg_min(height, (distance, pid)) AS h FROM cells WHERE distance > 0 GROUP BY frame, r, c),
        bo AS (SELECT *, true AS own FROM img UNION ALL SELECT frame, CASE WHEN r < 8 THEN r + 90 ELSE r - 90 END, c, d, h, false FROM img WHERE r < 8 OR r >= 82),
        n1 AS (SELECT *, lag(d) OVER w AS rpd, lag(h) OVER w AS rph, lead(d) OVER w AS rnd, lead(h) OVER w AS rnh FROM bo WINDOW w AS (PARTITION BY frame, c ORDER BY r)),
        n2 AS (SELECT *, lag(d) OVER w AS cpd, lag(h) OVER w AS cph, lead(d) OVER w AS cnd, lead(h) OVER w AS cnh FROM n1 WHERE own WINDOW w AS (PARTITION BY frame, r ORDER BY c)),
        n3 AS (SELECT *, coalesce(rnh - rph, 0) AS a, coalesce(cnh - cph, 0) AS b, coalesce(rnd - rpd, 0) AS e, coalesce(cnd - cpd, 0) AS f FROM n2)
        SELECT frame, r, c, round(atan2(sqrt(a * a + b * b), sqrt(e * e + f * f)), 6) AS slope FROM n3""")  # fmt: skip
#: The modes of every cell (a list, the most distant first) by recursion over the frames: the change by the depth, then weights behind the updated mode, then overlapping neighbours.
_MIXTURES = f"""WITH RECURSIVE {_CELLS}, img AS (SELECT frame, r, c, arg_min(depth, (distance, pid)) AS d FROM cells WHERE distance > 0 GROUP BY frame, r, c),
 fr AS (SELECT frame, CAST(row_number() OVER (ORDER BY frame) AS INT) AS n FROM (SELECT DISTINCT frame FROM img)), cl AS (SELECT DISTINCT r, c FROM img),
 gr AS (SELECT cl.r, cl.c, fr.n, coalesce(img.d, 0e0) AS d FROM cl CROSS JOIN fr LEFT JOIN img ON img.frame = fr.frame AND img.r = cl.r AND img.c = cl.c),
 st AS (SELECT r, c, 0 AS n, CAST([] AS STRUCT(w DOUBLE, m DOUBLE, s DOUBLE)[]) AS modes, false AS foreground FROM cl
   UNION ALL SELECT r, c, n, CASE WHEN kind = 'noise' OR len(aged) = 0 THEN aged ELSE list_reverse(list_reduce(list_transform(list_reverse(aged), lambda x: [x]),
       lambda a, x: CASE WHEN (a[-1].m - x[1].m) * (a[-1].m - x[1].m) <= 25 * (a[-1].s + x[1].s)
         THEN a[:-2] || [{{'w': (a[-1].w * a[-1].w + x[1].w * x[1].w) / (a[-1].w + x[1].w), 'm': (a[-1].m * a[-1].w + x[1].m * x[1].w) / (a[-1].w + x[1].w), 's': (a[-1].s * a[-1].w + x[1].s * x[1].w) / (a[-1].w + x[1].w)}}]
         ELSE a || x END)) END AS modes, foreground
   FROM (SELECT *, CASE WHEN kind = 'noise' THEN changed ELSE list_filter(list_transform(changed, lambda x, i: CASE WHEN i > place THEN {{'w': x.w * (h / (1e0 + h)), 'm': x.m, 's': x.s}} ELSE x END), lambda x, i: i <= place OR x.w >= 1e0 / h) END AS aged
   FROM (SELECT *, CASE kind WHEN 'fit' THEN k WHEN 'new' THEN CASE WHEN len(base) = 0 THEN 0 ELSE ins + 1 END ELSE 0 END AS place, kind = 'new' OR (kind = 'fit' AND (1 - e) * modes[k].w + e < 0.2e0) AS foreground,
       CASE kind WHEN 'fit' THEN list_transform(modes, lambda x, i: CASE WHEN i = k THEN {{'w': (1 - e) * x.w + e, 'm': (1 - e) * x.m + e * d, 's': greatest((1 - e) * x.s + e * near, 0.1e0 * 0.1e0)}} ELSE x END)
         WHEN 'new' THEN base[:ins] || [{{'w': 2 * e, 'm': d, 's': 0.2e0 * 0.2e0}}] || base[ins + 1:] ELSE modes END AS changed
   FROM (SELECT *, CASE WHEN len(base) = 0 THEN 0 ELSE least(len(base), CASE WHEN d > (CASE WHEN kb > len(base) THEN modes[k].m ELSE base[kb].m END) THEN kb - 1 ELSE kb END) END AS ins
   FROM (SELECT *, CASE WHEN old > 0 THEN modes[:old - 1] || modes[old + 1:] ELSE modes END AS base, k - CASE WHEN old > 0 AND k > old THEN 1 ELSE 0 END AS kb
   FROM (SELECT *, CASE WHEN kind = 'new' AND len(modes) = 4 THEN list_position(list_transform(modes, lambda x: x.w), list_min(list_transform(modes, lambda x: x.w))) ELSE 0 END AS old
   FROM (SELECT *, CASE WHEN d > 0 AND d < 1 THEN 'noise' WHEN NOT d > 0 THEN 'none' WHEN len(modes) > 0 AND near < 25e0 * modes[k].s THEN 'fit' ELSE 'new' END AS kind
   FROM (SELECT *, list_min(off) AS near, len(off) - coalesce(list_position(list_reverse(off), list_min(off)), 1) + 1 AS k, 1e0 / (h + 1) AS e
   FROM (SELECT st.r, st.c, st.n + 1 AS n, st.modes, gr.d, least(st.n + 1, 200) AS h, list_transform(st.modes, lambda x: (gr.d - x.m) * (gr.d - x.m)) AS off FROM st JOIN gr ON gr.r = st.r AND gr.c = st.c AND gr.n = st.n + 1)))))))))
 SELECT img.frame, img.r, img.c, foreground FROM st JOIN fr USING (n) JOIN img ON img.frame = fr.frame AND img.r = st.r AND img.c = st.c"""
reg("motion_filter", "lidar_points", lambda v: lidar.motion_filter(lidar.range_image(_binned(v), ("depth",))).select("frame", "r", "c", "foreground"), _MIXTURES)
reg("motion_denoise", "lidar_points", lambda v: lidar.motion_denoise(lidar.range_image(_binned(v), ("depth",)).withColumn("foreground", F.col("depth") < 60), 2, 10.0, 2),
    f"""WITH {_CELLS}, img AS (SELECT frame, r, c, arg_min(depth, (distance, pid)) AS d FROM cells WHERE distance > 0 GROUP BY frame, r, c), fg AS (SELECT * FROM img WHERE d < 60)
        SELECT a.frame, a.r, a.c, count(*) AS n FROM fg a JOIN fg b ON a.frame = b.frame AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 AND (a.r <> b.r OR a.c <> b.c) AND abs(a.d - b.d) <= 10 GROUP BY 1, 2, 3 HAVING count(*) >= 2""")  # fmt: skip


# Geodesic morphology: a step spreads a frame's markers to their neighbours; frames in which nothing changed are done.
def _spread(first: str, eight: bool) -> str:
    side = "(abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)" if eight else "(abs(a.y - b.y) + abs(a.x - b.x) <= 1)"
    return f"""WITH RECURSIVE px AS (SELECT frame, y, x, CAST(v AS DOUBLE) AS v FROM pixels), {first},
 st AS (SELECT 0 AS n, frame, y, x, lim, m, true AS moved FROM init
   UNION ALL SELECT n + 1, frame, y, x, lim, new, bool_or(new <> m) OVER (PARTITION BY frame) FROM (
     SELECT a.n, a.frame, a.y, a.x, a.lim, a.m, least(a.lim, max(b.m)) AS new FROM st a JOIN st b ON a.frame = b.frame AND {side} WHERE a.moved GROUP BY a.n, a.frame, a.y, a.x, a.lim, a.m))"""


_ERODED = "er AS (SELECT frame, y, x, min(v) OVER (PARTITION BY frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM {0})"
_INIT = "init AS (SELECT p.frame, p.y, p.x, p.v AS lim, min(e) OVER (PARTITION BY p.frame, p.x ORDER BY p.y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM {0} p JOIN er USING (frame, y, x))"
_MINUS = "mx AS (SELECT frame, y, x, -v AS v FROM px)"
_HOLES = "tp AS (SELECT frame, max(v) AS top, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px GROUP BY frame), init AS (SELECT frame, y, x, top - v AS lim, CASE WHEN y IN (y0, y1) OR x IN (x0, x1) THEN top - v ELSE 0 END AS m FROM px JOIN tp USING (frame))"
reg("geo_open", "pixels", lambda v: rounded(geodesic.geo_open(v("pixels"), tile=32), 4), f"{_spread(f'{_ERODED.format("px")}, {_INIT.format("px")}', False)} SELECT frame, y, x, round(arg_max(m, n), 4) AS m FROM st GROUP BY 1, 2, 3")
reg("geo_close", "pixels", lambda v: rounded(geodesic.geo_open(v("pixels"), eight=True, close=True, tile=32), 4), f"{_spread(f'{_MINUS}, {_ERODED.format("mx")}, {_INIT.format("mx")}', True)} SELECT frame, y, x, round(-arg_max(m, n), 4) AS m FROM st GROUP BY 1, 2, 3")
reg("geo_fill_holes", "pixels", lambda v: rounded(geodesic.geo_fill_holes(v("pixels"), tile=32), 4), f"{_spread(_HOLES, False)} SELECT frame, y, x, round(top - arg_max(m, n), 4) AS m FROM st JOIN tp USING (frame) GROUP BY 1, 2, 3, top")
