"""Registered queries: statistics, histograms, levels and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import pixels as px
from framelake.operators import ordered, regression, select, stack, stats, thresholds, topk
from framelake.plans.base import r, reg, rounded

_V = "CAST(v AS DOUBLE)"
_MEAN = "CAST(sum(v) AS DOUBLE) / count(v)"

reg("frame_stats", "pixels", lambda v: rounded(stats.frame_stats(v("pixels")), 4),
    f"SELECT frame, count(v) AS n, CAST(sum(v) AS DOUBLE) AS sum, round({_MEAN}, 4) AS mean, round(stddev_pop({_V}), 4) AS stdev, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM pixels GROUP BY frame")
reg("frame_stats_rollup", "samples", lambda v: rounded(stats.frame_stats(v("samples"), ("frame", "c"), valid="valid", rollup=True), 4),
    f"SELECT frame, c, count(v) AS n, CAST(sum(v) AS DOUBLE) AS sum, round({_MEAN}, 4) AS mean, round(stddev_pop({_V}), 4) AS stdev, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM samples WHERE valid GROUP BY ROLLUP (frame, c)")
_BLOBS = "blobs AS (SELECT frame, (y // 8) * 7 + x // 8 AS label, y, x, w AS v FROM pixels)"


def _blobs(v):
    return v("pixels").select("frame", (F.expr("y div 8") * 7 + F.expr("x div 8")).cast("long").alias("label"), "y", "x", F.col("w").alias("v"))


_MOMENTS = """s AS (SELECT frame, label, count(*) AS n, CAST(sum(v) AS DOUBLE) AS I, CAST(sum(v * x) AS DOUBLE) AS sx, CAST(sum(v * y) AS DOUBLE) AS sy, CAST(sum(v * x * x) AS DOUBLE) AS sxx, CAST(sum(v * y * y) AS DOUBLE) AS syy, CAST(sum(v * x * y) AS DOUBLE) AS sxy FROM blobs GROUP BY frame, label),
 c AS (SELECT *, sx / I AS cx, sy / I AS cy FROM s WHERE I <> 0), m AS (SELECT *, sxx / I - cx * cx AS x2, syy / I - cy * cy AS y2, sxy / I - cx * cy AS xy FROM c),
 e AS (SELECT *, sqrt((x2 - y2) * (x2 - y2) + 4 * xy * xy) AS q FROM m), ab AS (SELECT *, sqrt(greatest(2 * (x2 + y2 + q), 0)) AS a, sqrt(greatest(2 * (x2 + y2 - q), 0)) AS b FROM e)"""
reg("blob_moments", "pixels", lambda v: rounded(stats.blob_moments(_blobs(v)).drop("theta"), 5),
    f"WITH {_BLOBS}, {_MOMENTS} SELECT frame, CAST(label AS BIGINT) AS label, n, I, round(cx, 5) AS x, round(cy, 5) AS y, round(x2, 5) AS x2, round(y2, 5) AS y2, round(xy, 5) AS xy, round(a, 5) AS a, round(b, 5) AS b FROM ab")
reg("blob_filter", "pixels", lambda v: select.blob_filter(stats.blob_moments(_blobs(v)), min_a=1.0, max_elongation=1.5, min_compactness=0.1).select("frame", "label", "n"),
    f"WITH {_BLOBS}, {_MOMENTS} SELECT frame, CAST(label AS BIGINT) AS label, n FROM ab WHERE n > 3 AND b > 0 AND a BETWEEN 1 AND 1e9 AND (a * a + 0.5e0) / (b * b + 0.5e0) <= 2.25e0 AND n / (pi() * a * b) >= 0.1e0")
reg("barycenter", "pixels", lambda v: rounded(stats.barycenter(v("pixels"))), "SELECT frame, round(CAST(sum(v * x) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 6) AS x, round(CAST(sum(v * y) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 6) AS y FROM pixels GROUP BY frame")
reg("component_stats", "pixels", lambda v: stats.component_stats(_blobs(v)), f"WITH {_BLOBS} SELECT frame, CAST(label AS BIGINT) AS label, count(*) AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM blobs GROUP BY frame, label")
reg("largest_component", "pixels", lambda v: topk.largest_component(stats.component_stats(_blobs(v))),
    f"WITH {_BLOBS}, a AS (SELECT frame, CAST(label AS BIGINT) AS label, count(*) AS area FROM blobs GROUP BY frame, label) SELECT frame, label, area FROM a WHERE area >= 4 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY area DESC, label) = 1")
reg("weighted_mean", "pixels", lambda v: rounded(stats.weighted_mean(v("pixels"))), "SELECT frame, round(CAST(sum(v * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 6) AS mean FROM pixels GROUP BY frame")
reg("frame_median", "pixels", lambda v: rounded(stats.frame_median(v("pixels"), valid="valid"), 4), f"SELECT frame, round(quantile_cont({_V}, 0.5) FILTER (valid), 4) AS median FROM pixels GROUP BY frame")
reg("mean_abs_dev", "pixels", lambda v: rounded(stats.mean_abs_dev(v("pixels")), 5), f"WITH m AS (SELECT frame, {_MEAN} AS m FROM pixels GROUP BY frame) SELECT frame, round(avg(abs({_V} - m)), 5) AS mad FROM pixels JOIN m USING (frame) GROUP BY frame")
reg("normalized_variance", "pixels", lambda v: rounded(stats.normalized_variance(v("pixels")), 7), f"SELECT frame, round(stddev_pop({_V}) / abs({_MEAN}), 7) AS sharpness FROM pixels GROUP BY frame")
reg("sharpness_average", "pixels", lambda v: rounded(stats.sharpness_average(stats.normalized_variance(v("pixels"))), 7), f"SELECT round(avg(s), 7) AS sharpness FROM (SELECT stddev_pop({_V}) / abs({_MEAN}) AS s FROM pixels GROUP BY frame)")
reg("correlation", "pixels", lambda v: rounded(stats.correlation(v("pixels").where("frame = 0 AND valid"), v("pixels").where("frame = 1 AND valid")), 7),
    "SELECT count(*) AS n, round(covar_pop(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) / (stddev_pop(CAST(a.v AS DOUBLE)) * stddev_pop(CAST(b.v AS DOUBLE))), 7) AS correlation FROM pixels a JOIN pixels b USING (y, x) WHERE a.frame = 0 AND a.valid AND b.frame = 1 AND b.valid")
reg("radial_profile", "pixels", lambda v: rounded(stats.radial_profile(v("pixels"), 24.5, 19.25)),
    f"SELECT frame, CAST(round_even(sqrt((x - 24.5e0) * (x - 24.5e0) + (y - 19.25e0) * (y - 19.25e0)), 0) AS INT) AS r, round({_MEAN}, 6) AS mean, count(v) AS n FROM pixels GROUP BY 1, 2")

# Histograms of pixels per frame, 64 bins

_H = """rng AS (SELECT frame, min(CAST(v AS DOUBLE)) AS minv, max(CAST(v AS DOUBLE)) AS maxv FROM pixels GROUP BY frame),
 cnt AS (SELECT frame, CAST(least(floor((CAST(v AS DOUBLE) - minv) * 64 / (maxv - minv)), 63) AS INT) AS bin, count(*) AS n FROM pixels JOIN rng USING (frame) GROUP BY 1, 2),
 h AS (SELECT frame, CAST(bin AS INT) AS bin, coalesce(n, 0) AS n, minv, maxv FROM rng CROSS JOIN range(64) b(bin) LEFT JOIN cnt USING (frame, bin)),
 cum AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin) / CAST(sum(n) OVER (PARTITION BY frame) AS DOUBLE) AS cum FROM h)"""
_CROSS = "(SELECT frame, arg_min(bin - 1 + CASE WHEN cum > b THEN ({q} - b) / (cum - b) ELSE 0 END, bin) AS place FROM (SELECT *, coalesce(lag(cum) OVER (PARTITION BY frame ORDER BY bin), 0) AS b FROM cum) WHERE cum >= {q} GROUP BY frame)"


def _hist(v):
    return stats.histogram(v("pixels"), ("frame",), bins=64)


reg("histogram", "pixels", _hist, f"WITH {_H} SELECT frame, bin, n, minv, maxv FROM h")
reg("cumulative_histogram", "pixels", lambda v: rounded(stats.cumulative_histogram(_hist(v), ("frame",)).select("frame", "bin", "cum")), f"WITH {_H} SELECT frame, bin, round(cum, 6) AS cum FROM cum")
reg("normalize_histogram", "pixels", lambda v: rounded(stats.normalize_histogram(_hist(v), ("frame",)).select("frame", "bin", "h")), f"WITH {_H} SELECT frame, bin, round(n / CAST(max(n) OVER (PARTITION BY frame) AS DOUBLE), 6) AS h FROM h")
_LEVELS = lambda lo, hi: f"lv AS (SELECT frame, minv + greatest(a.place, 0) * (maxv - minv) / 64 AS low, least(minv + (b.place + 0.5e0) * (maxv - minv) / 64, maxv) AS high FROM rng JOIN {_CROSS.format(q=lo)} a USING (frame) JOIN {_CROSS.format(q=hi)} b USING (frame))"
reg("clip_levels", "pixels", lambda v: rounded(stats.clip_levels(_hist(v), ("frame",), 0.01, 0.99, 64), 4), f"WITH {_H}, {_LEVELS('0.01e0', '0.99e0')} SELECT frame, round(low, 4) AS low, round(high, 4) AS high FROM lv")
reg("clip_levels_percent", "pixels", lambda v: rounded(stats.clip_levels_percent(_hist(v), ("frame",), 2.0, 98.0, 64), 4),
    f"WITH {_H} SELECT frame, round(any_value(minv) + min(bin) FILTER (cum * 100 >= 2) * (any_value(maxv) - any_value(minv)) / 64, 4) AS low, round(any_value(minv) + min(bin) FILTER (cum * 100 >= 98) * (any_value(maxv) - any_value(minv)) / 64, 4) AS high FROM cum WHERE cum > 0 GROUP BY frame")
reg("histogram_median", "pixels", lambda v: rounded(stats.histogram_median(_hist(v), ("frame",), 64), 4), f"WITH {_H} SELECT frame, round(minv + place * (maxv - minv) / 64, 4) AS median FROM rng JOIN {_CROSS.format(q='0.5e0')} USING (frame)")
reg("histogram_mode", "pixels", lambda v: rounded(stats.histogram_mode(_hist(v), ("frame",), 64), 4),
    f"""WITH {_H}, t AS (SELECT *, max(n) OVER (PARTITION BY frame) AS top, lag(n) OVER w AS l, lead(n) OVER w AS rr FROM h WINDOW w AS (PARTITION BY frame ORDER BY bin)),
        g AS (SELECT *, sum(CASE WHEN n = top AND (l IS NULL OR l <> top) THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY bin) AS run FROM t),
        p AS (SELECT frame, min(bin) AS b0, max(bin) AS b1, coalesce(arg_min(l, bin), 0) AS l, coalesce(arg_max(rr, bin), 0) AS rr, any_value(n) AS n, any_value(minv) AS minv, any_value(maxv) AS maxv FROM g WHERE n = top AND run = 1 GROUP BY frame)
        SELECT frame, round(minv + ((b0 + b1) / 2e0 + CASE WHEN b0 = b1 AND l - 2 * n + rr <> 0 THEN 0.5e0 * (l - rr) / (l - 2 * n + rr) ELSE 0 END) * (maxv - minv) / 63, 4) AS mode FROM p""")  # fmt: skip
_RESCALE = "CASE WHEN high > low THEN (least(greatest(CAST(v AS DOUBLE), low), high) - low) / (high - low) ELSE 0 END"
reg("autoclip", "pixels", lambda v: stats.autoclip(v("pixels"), ("frame",), qlow=0.01, qhigh=0.99, bins=64).select("frame", "y", "x", r("v_out").alias("v_out")),
    f"WITH {_H}, {_LEVELS('0.01e0', '0.99e0')} SELECT frame, y, x, round({_RESCALE} * 255, 6) AS v_out FROM pixels JOIN lv USING (frame)")
_ALL = _H.replace("SELECT frame, min(", "SELECT 0 AS frame, min(").replace("FROM pixels GROUP BY frame)", "FROM pixels)").replace("SELECT frame, CAST(least", "SELECT 0 AS frame, CAST(least").replace("JOIN rng USING (frame) GROUP BY", "CROSS JOIN rng GROUP BY").replace("64", "256").replace("63)", "255)")
_ALL_LEVELS = lambda lo, hi: _LEVELS(lo, hi).replace("64", "256")
reg("auto_levels", "pixels", lambda v: rounded(stats.auto_levels(v("pixels")), 4), f"WITH {_ALL}, {_ALL_LEVELS('1e-3', '0.99999e0')} SELECT round(low, 4) AS low, round(high, 4) AS high FROM lv")
reg("auto_mtf", "pixels", lambda v: rounded(stats.auto_mtf(v("pixels")), 5),
    f"""WITH {_ALL}, {_ALL_LEVELS('0.001e0', '0.9999e0')}, m AS (SELECT low, high, least(greatest(CASE WHEN high > low THEN (minv + place * (maxv - minv) / 256 - low) / (high - low) ELSE 0.5e0 END, 0.001e0), 0.999e0) AS t FROM lv JOIN rng USING (frame) JOIN {_CROSS.format(q='0.5e0')} USING (frame))
        SELECT round(low, 5) AS lclip, round(high, 5) AS hclip, round(least(greatest(-log10(t / 0.5e0), -1), 1), 5) AS shadows, round(least(greatest(1 - t, 0.05e0), 0.95e0), 5) AS midtones, 0e0 AS highlights FROM m""")  # fmt: skip
reg("white_balance", "samples", lambda v: rounded(stats.white_balance(v("samples"), bins=64), 5),
    "WITH pixels AS (SELECT c AS frame, v FROM samples), " + _H + f", {_LEVELS('0.01e0', '0.99e0')} SELECT frame AS c, round((max(high) OVER () - min(low) OVER ()) / (high - low), 5) AS scale, round(min(low) OVER () - low * (max(high) OVER () - min(low) OVER ()) / (high - low), 5) AS shift FROM lv")
reg("background_normalize", "pixels", lambda v: stats.background_normalize(v("pixels"), mode="median", stretch=0.5, offset=10).select("frame", "y", "x", r("v_out", 5).alias("v_out")),
    f"WITH m AS (SELECT frame, quantile_cont({_V}, 0.5) AS m FROM pixels GROUP BY frame) SELECT frame, y, x, round(({_V} - m) * 0.5e0 + 10, 5) AS v_out FROM pixels JOIN m USING (frame)")
reg("equalize_histogram", "pixels", lambda v: stats.equalize_histogram(v("pixels"), bins=64).select("frame", "y", "x", r("v_out").alias("v_out")),
    f"WITH {_H} SELECT frame, y, x, round(cum, 6) AS v_out FROM pixels JOIN rng USING (frame) JOIN cum USING (frame) WHERE bin = CAST(least(floor((CAST(v AS DOUBLE) - rng.minv) * 64 / (rng.maxv - rng.minv)), 63) AS INT)")

# Thresholds of those histograms

_SUMS = f"""{_H}, s AS (SELECT *, n / CAST(sum(n) OVER w AS DOUBLE) AS p, sum(n) OVER q / CAST(sum(n) OVER w AS DOUBLE) AS P0, sum(bin * n) OVER q / CAST(sum(n) OVER w AS DOUBLE) AS M, sum(bin * n) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS MT
 FROM h WINDOW w AS (PARTITION BY frame), q AS (PARTITION BY frame ORDER BY bin))"""
_PICK = "SELECT frame, bin, round(minv + bin * (maxv - minv) / 64, 8) AS threshold FROM z WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC, bin) = 1"


def _th(f):
    return lambda v: rounded(f(_hist(v), ("frame",), 64), 8)


reg("otsu_threshold", "pixels", _th(thresholds.otsu_threshold), f"WITH {_SUMS}, z AS (SELECT *, round(CASE WHEN P0 > 0 AND P0 < 1 THEN (MT * P0 - M) * (MT * P0 - M) / (P0 * (1 - P0)) END, 9) AS score FROM s) {_PICK}")
reg("yen_threshold", "pixels", _th(thresholds.yen_threshold),
    f"""WITH {_SUMS}, y AS (SELECT *, sum(p * p) OVER (PARTITION BY frame ORDER BY bin) AS q, sum(p * p) OVER (PARTITION BY frame) AS qt FROM s),
        z AS (SELECT *, CASE WHEN P0 > 0 AND P0 < 1 AND q > 0 AND qt - q > 1e-15 THEN round(2 * ln(P0 * (1 - P0)) - ln(q * (qt - q)), 9) END AS score FROM y) {_PICK}""")  # fmt: skip
reg("triangle_threshold", "pixels", _th(thresholds.triangle_threshold),
    f"""WITH {_H}, a AS (SELECT frame, min(bin) FILTER (n > 0) AS lo, max(bin) FILTER (n > 0) AS hi, arg_max(bin, (n, -bin)) AS peak, max(n) AS top FROM h GROUP BY frame), e AS (SELECT *, CASE WHEN hi - peak >= peak - lo THEN hi ELSE lo END AS e FROM a),
        z AS (SELECT frame, bin, minv, maxv, CASE WHEN bin BETWEEN least(peak, e) AND greatest(peak, e) THEN round(top * abs(e - bin) / CAST(greatest(abs(e - peak), 1) AS DOUBLE) - n, 9) END AS score FROM h JOIN e USING (frame)) {_PICK}""")  # fmt: skip
reg("moments_threshold", "pixels", _th(thresholds.moments_threshold),
    f"""WITH {_SUMS}, m AS (SELECT frame, sum(pow(CAST(bin AS DOUBLE), 1) * n) / sum(n) AS m1, sum(pow(CAST(bin AS DOUBLE), 2) * n) / sum(n) AS m2, sum(pow(CAST(bin AS DOUBLE), 3) * n) / sum(n) AS m3 FROM h GROUP BY frame),
        c AS (SELECT *, (m1 * m3 - m2 * m2) / (m2 - m1 * m1) AS c0, (m1 * m2 - m3) / (m2 - m1 * m1) AS c1 FROM m WHERE m2 > m1 * m1), z AS (SELECT *, sqrt(greatest(c1 * c1 - 4 * c0, 0)) AS q FROM c),
        p AS (SELECT frame, CASE WHEN q > 0 THEN ((-c1 + q) / 2 - m1) / q ELSE 0.5e0 END AS p0 FROM z)
        SELECT frame, min(bin) AS bin, round(any_value(minv) + min(bin) * (any_value(maxv) - any_value(minv)) / 64, 8) AS threshold FROM s JOIN p USING (frame) WHERE round(s.P0, 9) > round(p.p0, 9) GROUP BY frame""")  # fmt: skip
reg("huang_threshold", "pixels", _th(thresholds.huang_threshold),
    f"""WITH {_SUMS}, b AS (SELECT frame, min(bin) AS lo, max(bin) AS hi FROM h WHERE n > 0 GROUP BY frame), t AS (SELECT s.*, lo, hi, CASE WHEN P0 > 0 THEN M / P0 END AS m0, CASE WHEN P0 < 1 THEN (MT - M) / (1 - P0) END AS m1 FROM s JOIN b USING (frame) WHERE bin BETWEEN lo AND hi - 1),
        u AS (SELECT t.frame, t.bin, t.minv, t.maxv, h.n, 1 / (1 + abs(h.bin - coalesce(CASE WHEN h.bin <= t.bin THEN m0 ELSE m1 END, h.bin)) / greatest(CAST(hi - lo AS DOUBLE), 1)) AS u FROM t JOIN h ON h.frame = t.frame),
        z AS (SELECT frame, bin, any_value(minv) AS minv, any_value(maxv) AS maxv, -round(sum(CASE WHEN u > 1e-9 AND u < 1 - 1e-9 THEN n * (-u * ln(u) - (1 - u) * ln(1 - u)) ELSE 0 END), 6) AS score FROM u GROUP BY frame, bin) {_PICK}""")  # fmt: skip
reg("isodata_threshold", "pixels", lambda v: rounded(rounded(thresholds.isodata_threshold(_hist(v), ("frame",), 64), 6, "bin"), 4, "threshold"),
    f"""WITH RECURSIVE {_H}, it AS (SELECT 0 AS k, frame, (min(bin) + max(bin)) / 2e0 AS t FROM h WHERE n > 0 GROUP BY frame
        UNION ALL SELECT k + 1, it.frame, (coalesce((SELECT sum(bin * n) / CAST(nullif(sum(n), 0) AS DOUBLE) FROM h WHERE h.frame = it.frame AND bin <= t), t) + coalesce((SELECT sum(bin * n) / CAST(nullif(sum(n), 0) AS DOUBLE) FROM h WHERE h.frame = it.frame AND bin > t), t)) / 2 FROM it WHERE k < 64)
        SELECT frame, round(t, 6) AS bin, round(minv + t * (maxv - minv) / 64, 4) AS threshold FROM it JOIN rng USING (frame) WHERE k = 64""".strip())  # fmt: skip
_PEAKS = "list_filter(range(1, len({0}) + 1), lambda i: {0}[i] > coalesce({0}[i - 1], 0) AND {0}[i] > coalesce({0}[i + 1], 0))"
reg("minimum_threshold", "pixels", lambda v: rounded(thresholds.minimum_threshold(_hist(v), ("frame",), 64), 4),
    f"""WITH RECURSIVE {_H}, l AS (SELECT frame, list(CAST(n AS DOUBLE) ORDER BY bin) AS l, any_value(minv) AS minv, any_value(maxv) AS maxv FROM h GROUP BY frame),
        it AS (SELECT frame, 0 AS k, l, {_PEAKS.format('l')} AS pk FROM l
          UNION ALL SELECT frame, k + 1, m, {_PEAKS.format('m')} FROM (SELECT frame, k, list_transform(range(1, len(l) + 1), lambda i: (l[greatest(i - 1, 1)] + l[i] + l[least(i + 1, len(l))]) / 3) AS m FROM it WHERE len(pk) > 2 AND k < 10000)),
        last AS (SELECT frame, CASE WHEN len(pk) = 2 THEN CAST(pk[1] + list_position(l[pk[1]:pk[2]], list_min(l[pk[1]:pk[2]])) - 2 AS INT) END AS bin FROM it QUALIFY row_number() OVER (PARTITION BY frame ORDER BY k DESC) = 1)
        SELECT frame, bin, round(minv + bin * (maxv - minv) / 64, 4) AS threshold FROM last JOIN rng USING (frame)""")  # fmt: skip
reg("mean_threshold", "pixels", lambda v: rounded(thresholds.mean_threshold(v("pixels"))), f"SELECT frame, round({_MEAN}, 6) AS threshold FROM pixels GROUP BY frame")
reg("mean_stdev_threshold", "pixels", lambda v: rounded(thresholds.mean_stdev_threshold(v("pixels"), 2.0), 4), f"SELECT frame, round({_MEAN} + 2 * stddev_pop({_V}), 4) AS threshold FROM pixels GROUP BY frame")
reg("mean_mad_threshold", "pixels", lambda v: rounded(thresholds.mean_mad_threshold(v("pixels"), 2.0), 4), f"WITH m AS (SELECT frame, {_MEAN} AS m FROM pixels GROUP BY frame) SELECT frame, round(any_value(m) + 2 * avg(abs({_V} - m)), 4) AS threshold FROM pixels JOIN m USING (frame) GROUP BY frame")

# Sharpness, noise and gradients

_YY = "yy AS (SELECT *, CAST(lag(v) OVER w - 2 * v + lead(v) OVER w AS DOUBLE) AS yy FROM pixels WINDOW w AS (PARTITION BY frame, x ORDER BY y))"
_RES = f"{_YY}, res AS (SELECT frame, y, x, lag(yy) OVER w - 2 * yy + lead(yy) OVER w AS residual, v FROM yy WINDOW w AS (PARTITION BY frame, y ORDER BY x))"
reg("noise_map", "pixels", lambda v: ordered.noise_map(v("pixels")).select("frame", "y", "x", r("residual", 3).alias("residual")), f"WITH {_RES} SELECT frame, y, x, round(residual, 3) AS residual FROM res")
_SIGMA = f"{((3.141592653589793 / 2) ** 0.5 / 6)!r}::DOUBLE"
reg("noise_sigma", "pixels", lambda v: rounded(ordered.noise_sigma(v("pixels")), 4), f"WITH {_RES} SELECT frame, round(avg(abs(residual)) * {_SIGMA}, 4) AS noise FROM res GROUP BY frame")
reg("noise_threshold", "pixels", lambda v: rounded(thresholds.noise_threshold(ordered.noise_sigma(v("pixels"))), 3), f"WITH {_RES} SELECT frame, round(3 * avg(abs(residual)) * {_SIGMA}, 3) AS threshold FROM res GROUP BY frame")
reg("anscombe_params", "pixels", lambda v: rounded(stats.anscombe_params(ordered.noise_map(v("pixels")), F.col("v") > 60000, F.col("v") < 40000), 3),
    f"""WITH {_RES}, a AS (SELECT avg(residual * residual) FILTER (v > 60000) AS vb, avg(residual * residual) FILTER (v < 40000) AS vd, CAST(sum(v) FILTER (v > 60000) AS DOUBLE) / count(v) FILTER (v > 60000) AS ib, CAST(sum(v) FILTER (v < 40000) AS DOUBLE) / count(v) FILTER (v < 40000) AS id FROM res),
        g AS (SELECT *, greatest((vb - vd) / (ib - id), 0) AS gain FROM a) SELECT round(gain, 3) AS gain, round(greatest(1e-12, 0.375e0 * gain * gain + vd - gain * id), 3) AS "offset" FROM g""")  # fmt: skip
_BC = "bc AS (" + " UNION ALL ".join(f"SELECT {k} AS channel, frame, y, x, v{k} AS v FROM bgr" for k in range(3)) + ")"
reg("best_snr_channel", "bgr", lambda v: rounded(ordered.best_snr_channel(v("bgr")), 5),
    f"""WITH {_BC}, yy AS (SELECT *, CAST(lag(v) OVER w - 2 * v + lead(v) OVER w AS DOUBLE) AS yy FROM bc WINDOW w AS (PARTITION BY channel, frame, x ORDER BY y)), res AS (SELECT *, lag(yy) OVER w - 2 * yy + lead(yy) OVER w AS residual FROM yy WINDOW w AS (PARTITION BY channel, frame, y ORDER BY x)),
        s AS (SELECT frame, channel, stddev_pop({_V}) / nullif(avg(abs(residual)) * {_SIGMA}, 0) AS snr FROM res GROUP BY 1, 2) SELECT frame, channel, round(snr, 5) AS snr FROM s QUALIFY row_number() OVER (PARTITION BY frame ORDER BY snr DESC NULLS LAST, channel) = 1""")  # fmt: skip
_BOX = lambda k: f"""gx AS (SELECT *, min({_V}) OVER w AS e0, max({_V}) OVER w AS d0 FROM pixels WINDOW w AS (PARTITION BY frame, y ORDER BY x ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)),
 g AS (SELECT frame, y, x, v, max(d0) OVER w - min(e0) OVER w AS g FROM gx WINDOW w AS (PARTITION BY frame, x ORDER BY y ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING))"""  # noqa: E731
reg("sharpness_g4", "pixels", lambda v: ordered.sharpness_g4(v("pixels").withColumn("v", F.col("v").cast("double") / 1000)).select("frame", r("q", 4).alias("q")), f"WITH {_BOX(1)} SELECT frame, round(sum(pow(g / 1000, 4)) / sum(g / 1000), 4) AS q FROM g GROUP BY frame")
reg("sharpness_lpg", "pixels", lambda v: rounded(ordered.sharpness_lpg(v("pixels").withColumn("v", (F.col("v") / 1000).cast("decimal(12,5)"))), 4),
    """WITH p AS (SELECT frame, y, x, CAST(v / 1000 AS DECIMAL(12,5)) AS v FROM pixels), s AS (SELECT frame, CAST(lag(v) OVER a - 2 * v + lead(v) OVER a + lag(v) OVER b - 2 * v + lead(v) OVER b AS DOUBLE) AS l, CAST(lead(v) OVER a - lag(v) OVER a AS DOUBLE) / 2 AS gx, CAST(lead(v) OVER b - lag(v) OVER b AS DOUBLE) / 2 AS gy
       FROM p WINDOW a AS (PARTITION BY frame, y ORDER BY x), b AS (PARTITION BY frame, x ORDER BY y)) SELECT frame, round(avg(l * l + gx * gx + gy * gy), 4) AS q FROM s GROUP BY frame""")  # fmt: skip
reg("sharpness_local_contrast", "pixels", lambda v: rounded(ordered.sharpness_local_contrast(v("pixels")), 4),
    f"WITH {_BOX(2)}, l AS (SELECT *, CAST(sum(v) OVER b AS DOUBLE) / count(v) OVER b AS low FROM g WINDOW b AS (PARTITION BY frame, y // 4, x // 4)) SELECT frame, round(sum(g * low) / sum(low), 4) AS q FROM l GROUP BY frame")
reg("gradient_direction_histogram", "pixels", lambda v: rounded(stats.gradient_direction_histogram(ordered.gradient(ordered.gradient(v("pixels"), "x", out="gx"), "y", out="gy")), 3),
    """WITH g AS (SELECT frame, CAST(lead(v) OVER a - lag(v) OVER a AS DOUBLE) / 2 AS gx, CAST(lead(v) OVER b - lag(v) OVER b AS DOUBLE) / 2 AS gy FROM pixels WINDOW a AS (PARTITION BY frame, y ORDER BY x), b AS (PARTITION BY frame, x ORDER BY y)),
       d AS (SELECT frame, degrees(atan2(gy, gx)) + 45 AS a, sqrt(gx * gx + gy * gy) AS s FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL) SELECT frame, CAST(floor((a - 180 * floor(a / 180)) * 2 + 1e-9) AS INT) % 360 AS bin, round(sum(s), 3) AS weight FROM d GROUP BY 1, 2""")  # fmt: skip
reg("stacking_weights_mtf", "pixels", lambda v: stack.stack_average(v("pixels").select("y", "x", F.lit(0).alias("c"), px.to_unit_float("v", 16).alias("v"))).select("y", "x", r("mean").alias("mean"), "n"), "SELECT y, x, round(avg(CAST(v AS DOUBLE) / 65536), 6) AS mean, count(v) AS n FROM pixels GROUP BY y, x")


# Each frame against the one after it


def _next(v):
    return v("pixels").where("valid"), v("pixels").where("valid").withColumn("frame", F.col("frame") - 1)


reg("correlation_successive", "pixels", lambda v: rounded(stats.correlation(*_next(v), on=("frame", "y", "x"), by=("frame",)), 7),
    """SELECT frame, count(*) AS n, round(CASE WHEN stddev_pop(CAST(a.v AS DOUBLE)) * stddev_pop(CAST(b.v AS DOUBLE)) > 0 THEN covar_pop(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) / (stddev_pop(CAST(a.v AS DOUBLE)) * stddev_pop(CAST(b.v AS DOUBLE))) ELSE 0 END, 7) AS correlation
       FROM (SELECT * FROM pixels WHERE valid) a JOIN (SELECT frame - 1 AS frame, y, x, v FROM pixels WHERE valid) b USING (frame, y, x) GROUP BY frame""")  # fmt: skip


def _exposures(v):
    p = v("pixels")
    return p.select("frame", "y", "x", (F.col("v").cast("double") / 105000.0).alias("v")), p.select((F.col("frame") - 1).alias("frame"), "y", "x", (F.col("v").cast("double") / 120000.0).alias("v"))


reg("hdr_blend_successive", "pixels", lambda v: rounded(stack.hdr_blend(*_exposures(v), by=("frame",))),
    """WITH j AS (SELECT frame, y, x, CAST(p.v AS DOUBLE) / 105000e0 AS a, CAST(q.v AS DOUBLE) / 120000e0 AS b FROM pixels p JOIN (SELECT frame - 1 AS frame, y, x, v FROM pixels) q USING (frame, y, x)),
       o AS (SELECT frame, coalesce(avg(ln(a) - ln(b)) FILTER (a < 0.8e0 AND b < 0.8e0 AND a > 0 AND b > 0), 0) AS o FROM j GROUP BY frame)
       SELECT frame, y, x, round((a * a * a + (1 - a) * (1 - a) * b * exp(o)) / (a * a + (1 - a) * (1 - a)), 6) AS v FROM j JOIN o USING (frame)""")  # fmt: skip

# Fits per key

_LINE = "SELECT series, CAST(ord AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y, CAST(id % 4 + 1 AS DOUBLE) AS w FROM signal"


def _line(v):
    return v("signal").select("series", F.col("ord").cast("double").alias("x"), F.col("v").cast("double").alias("y"), (F.col("id") % 4 + 1).alias("w"))


reg("line_fit", "signal", lambda v: rounded(regression.line_fit(_line(v), weight="w"), 4),
    f"""WITH d AS ({_LINE}), s AS (SELECT series, count(*) AS n, sum(w) AS sw, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy, sum(w*y*y) AS syy FROM d GROUP BY series),
        f AS (SELECT *, (sw*sxy - sx*sy) / (sw*sxx - sx*sx) AS slope FROM s WHERE n > 1 AND sw*sxx - sx*sx > 0), g AS (SELECT *, (sy - slope*sx) / sw AS shift FROM f), h AS (SELECT *, syy - slope*sxy - shift*sy AS rss, sw*syy - sy*sy AS tss FROM g)
        SELECT series, round(shift, 4) AS shift, round(slope, 4) AS slope, round(greatest(rss, 0) / sw, 4) AS stdev2, round(CASE WHEN tss > 0 AND rss > 0 THEN 1 - rss*sw/tss ELSE 1 END, 4) AS r2, n FROM h""")  # fmt: skip
reg("slope_fit", "signal", lambda v: rounded(regression.slope_fit(_line(v), weight="w"), 4),
    f"""WITH d AS ({_LINE}), s AS (SELECT series, count(*) AS n, sum(w) AS sw, sum(w*w) AS sww, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy, sum(w*y*y) AS syy FROM d GROUP BY series), f AS (SELECT *, sxy / sxx AS slope, sw - sww / sw AS free FROM s WHERE sxx > 0), g AS (SELECT *, syy - slope*sxy AS rss FROM f)
        SELECT series, round(slope, 4) AS slope, round(CASE WHEN free > 0 AND rss > 0 THEN rss / free ELSE 0 END, 4) AS stdev2, round(CASE WHEN syy > 0 THEN slope*sxy/syy ELSE 1 END, 4) AS r2, n FROM g""")  # fmt: skip
reg("two_factor_fit", "samples", lambda v: rounded(regression.two_factor_fit(v("samples").where("valid"), ("frame",), "y", "x", "v", "w"), 3),
    """WITH s AS (SELECT frame, count(*) AS n, sum(w*y*y) AS pp, sum(w*y*x) AS pq, sum(w*x*x) AS qq, sum(w*y*b) AS pb, sum(w*x*b) AS qb FROM (SELECT frame, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, CAST(v AS DOUBLE) AS b, CAST(w AS DOUBLE) AS w FROM samples WHERE valid) GROUP BY frame)
       SELECT frame, round((qq*pb - pq*qb) / (pp*qq - pq*pq), 3) AS a0, round((pp*qb - pq*pb) / (pp*qq - pq*pq), 3) AS a1, n FROM s WHERE pp*qq - pq*pq <> 0""")  # fmt: skip
# The quadratic through moments about the mean, another way to the same fit
reg("quadratic_fit", "samples", lambda v: rounded(regression.quadratic_fit(v("samples").where("valid"), ("frame",), "x", "v"), 2),
    """WITH d AS (SELECT frame, CAST(x AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y FROM samples WHERE valid), m AS (SELECT *, avg(x) OVER (PARTITION BY frame) AS mx FROM d),
       c AS (SELECT frame, any_value(mx) AS mx, count(*) AS n, avg(y) AS my, avg(pow(x - mx, 2)) AS u2, avg(pow(x - mx, 3)) AS u3, avg(pow(x - mx, 4)) AS u4, avg((x - mx) * y) AS v1, avg(pow(x - mx, 2) * y) AS v2 FROM m GROUP BY frame),
       e AS (SELECT *, u2 * (u4 - u2 * u2) - u3 * u3 AS det FROM c), f AS (SELECT *, (u2 * (v2 - u2 * my) - u3 * v1) / det AS q, ((u4 - u2 * u2) * v1 - u3 * (v2 - u2 * my)) / det AS l FROM e WHERE det > 0), g AS (SELECT *, my - q * u2 AS k FROM f)
       SELECT frame, round(k - l * mx + q * mx * mx, 2) AS a0, round(l - 2 * q * mx, 2) AS a1, round(q, 2) AS a2, n FROM g""")  # fmt: skip
