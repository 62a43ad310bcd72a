"""Registered queries: streams that run over all there is."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import geometry as geo
from framelake.operators import lidar, stack
from framelake.plans.base import r, reg, rounded
from framelake.plans.chains import run_chain
from framelake.plans.queries_order import _MIXTURES
from framelake.sources.adapters import Views
from framelake.streaming import live
from framelake.streaming.run import finish, replay_in_order, table_stream, view_stream

_MEAN = "CAST(sum(v) AS DOUBLE) / count(v)"


def _samples(v: Views) -> DataFrame:
    return view_stream(v.spark, v.sf_dir, "samples")


def _events(v: Views) -> DataFrame:
    return table_stream(v.spark, v.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


reg("live_stack", "samples", lambda v: rounded(finish(live.live_stack(_samples(v)), "complete")), f"SELECT y, x, c, round({_MEAN}, 6) AS mean, count(v) AS n FROM samples GROUP BY y, x, c")


def _calibrated(v: Views) -> DataFrame:
    dark = stack.dark_frame(v("samples"))
    flat = dark.select("y", "x", "c", F.lit(2.0).alias("flat"))
    out = live.live_calibrate(_samples(v).select("frame", "y", "x", "c", "v", "w", "valid"), dark, flat)
    return finish(out).groupBy("frame").agg(F.count_if("valid").alias("n"), r(F.sum("v"), 3).alias("total"))


reg("live_calibrate", "samples", _calibrated,
    """WITH d AS (SELECT y, x, c, coalesce(CAST(sum(v) FILTER (valid) AS DOUBLE), 0) / greatest(count(*) FILTER (valid), 1) AS dark FROM samples GROUP BY y, x, c)
       SELECT frame, count(*) FILTER (valid) AS n, round(sum((CAST(v AS DOUBLE) - dark) / 2), 3) AS total FROM samples JOIN d USING (y, x, c) GROUP BY frame""")  # fmt: skip
reg("live_frame_stats", "samples", lambda v: rounded(finish(live.live_frame_stats(_samples(v)), "complete"), 4),
    "SELECT frame, count(v) AS n, round(avg(CAST(v AS DOUBLE)), 4) AS mean, round(stddev_pop(CAST(v AS DOUBLE)), 4) AS stdev, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM samples GROUP BY frame")
reg("freshest_per_batch", "samples", lambda v: finish(_samples(v), "append", live.freshest).groupBy("frame").agg(F.count(F.lit(1)).alias("n")), "SELECT frame, count(*) AS n FROM samples WHERE frame = (SELECT max(frame) FROM samples) GROUP BY frame")
reg("best_of_backlog", "samples", lambda v: finish(_samples(v).groupBy("frame").agg(F.sum("v").cast("double").alias("q")), "complete", live.best_of_backlog).select("frame", "q"), "SELECT frame, CAST(sum(v) AS DOUBLE) AS q FROM samples GROUP BY frame ORDER BY sum(v) DESC, frame DESC LIMIT 1")
reg("capture_rounds_count", "firings", lambda v: finish(live.capture_rounds(_events(v).select("ts", F.col("event_id").alias("frame")), count=250), "complete").select("round", "saved", "dropped", "first", "last"),
    "SELECT CAST(event_id // 250 AS BIGINT) AS round, count(*) AS saved, CAST(max(event_id) - min(event_id) + 1 - count(*) AS BIGINT) AS dropped, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
reg("capture_rounds_time", "firings", lambda v: finish(live.capture_rounds(_events(v).select("ts", F.col("event_id").alias("frame")), seconds=86400), "complete").select(F.unix_timestamp("round.start").alias("start"), "saved", "dropped", "first", "last"),
    "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS saved, CAST(max(event_id) - min(event_id) + 1 - count(*) AS BIGINT) AS dropped, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")


def _rate(v: Views, **options) -> DataFrame:
    out = finish(live.windowed_rate(_events(v), **options), "complete")
    return out.select(F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), *[c for c in out.columns if c not in ("start", "end")])


reg("windowed_rate_tumbling", "firings", lambda v: _rate(v, size="1 hour"), "SELECT CAST(epoch(ts) AS BIGINT) // 3600 * 3600 AS start, CAST(epoch(ts) AS BIGINT) // 3600 * 3600 + 3600 AS \"end\", count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1, 2")
reg("windowed_rate_sliding", "firings", lambda v: _rate(v, kind="sliding", size="2 hours", slide="1 hour"),
    "SELECT CAST(epoch(ts) AS BIGINT) // 3600 * 3600 - k * 3600 AS start, CAST(epoch(ts) AS BIGINT) // 3600 * 3600 - k * 3600 + 7200 AS \"end\", count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts FROM events), range(2) g(k) GROUP BY 1, 2")
reg("windowed_rate_session", "firings", lambda v: _rate(v, kind="session", size="6 hours", by=("user_id",)),
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
       SELECT CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS start, CAST(epoch(date_trunc('second', max(ts) + INTERVAL 6 HOURS)) AS BIGINT) AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""")  # fmt: skip


def _in_order(v: Views, view: str, order: str, f: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame] = lambda d: d, width: int = 250_000, **dealt) -> DataFrame:
    return finish(f(replay_in_order(v.spark, v.sf_dir, view, order, change, width, **dealt)))


reg("live_running_average", "signal", lambda v: rounded(_in_order(v, "signal", "ord", live.live_running_average, lambda d: d.select("series", "ord", F.col("v").cast("double").alias("v")), key="series", files=None)),
    """WITH RECURSIVE a AS (SELECT series, ord, CAST(v AS DOUBLE) AS avg FROM signal WHERE ord = 0 UNION ALL
       SELECT s.series, s.ord, CASE WHEN s.ord < 5 THEN (a.avg * s.ord + CAST(s.v AS DOUBLE)) / (s.ord + 1) ELSE (a.avg * 5 + CAST(s.v AS DOUBLE)) / 6 END FROM a JOIN signal s ON s.series = a.series AND s.ord = a.ord + 1)
       SELECT series, ord, round(avg, 6) AS avg FROM a""")  # fmt: skip
reg("live_rotation_frames", "firings", lambda v: _in_order(v, "firings", "pkt", lambda d: live.live_rotation_frames(d, 9000)),
    """WITH a AS (SELECT sensor, pkt, (azimuth + 27000) % 36000 AS a FROM firings), b AS (SELECT sensor, pkt, CASE WHEN a < lag(a) OVER (PARTITION BY sensor ORDER BY pkt) THEN 1 ELSE 0 END AS n FROM a)
       SELECT sensor, pkt, CAST(sum(n) OVER (PARTITION BY sensor ORDER BY pkt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frame FROM b""")  # fmt: skip


def _numbered_image(d: DataFrame) -> DataFrame:
    image = lidar.range_image(geo.range_bin(d, 2 * math.pi / 90), ("depth",))
    frames = image.select("frame").distinct()  # a row per frame
    return image.join(frames.withColumn("n", F.row_number().over(Window.orderBy("frame")).cast("long")), "frame")


reg("live_motion_filter", "lidar_points", lambda v: _in_order(v, "lidar_points", "n", live.live_motion_filter, _numbered_image, 8), _MIXTURES)

# Chains

_CHAIN = """[{"step": "push", "name": "raw"}, {"step": "filter", "expr": "valid"}, {"step": "column", "name": "v", "expr": "v / 3e0"}, {"step": "filter", "expr": "v < 0", "enabled": false},
             {"step": "clip", "low": 5000.0, "high": 40000.0}, {"step": "average", "by": ["y", "x"]}]"""
reg("processor_chain", "samples", lambda v: rounded(run_chain(v("samples"), _CHAIN), 5),
    "SELECT y, x, round(avg(least(greatest(CAST(v AS DOUBLE) / 3, 5000), 40000)), 5) AS mean, count(*) AS n FROM samples WHERE valid GROUP BY y, x")

# A longer chain: edges of bright places against a stored average
_EDGES = """[{"step": "Average", "by": ["y", "x"]}, {"step": "select", "exprs": ["y", "x", "mean AS v"]}, {"step": "push", "name": "average"}]"""
_CALC = """[{"step": "filter", "expr": "valid"}, {"step": "Frame_Calc", "other": "average", "name": "subtract", "on": ["y", "x"]}, {"step": "pixel_func", "name": "abs"}, {"step": "no_such_column_step", "enabled": false},
            {"step": "anscombe", "gain": 2.0, "out": "a"}, {"step": "gradient", "axis": "x", "value": "a", "out": "g"}, {"step": "local_variance", "r": 2, "axis": "y", "value": "a", "out": "var"},
            {"step": "select_pixels", "expr": "v > 5000"}, {"step": "combine_selection", "mode": "AND", "new": "var > 100"}]"""


def _edges(v: Views) -> DataFrame:
    frames: dict[str, DataFrame] = {}
    run_chain(v("samples"), _EDGES, frames)
    out = run_chain(v("pixels"), _CALC, frames)
    return out.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count_if("sel").alias("chosen"), r(F.avg("g"), 4).alias("g"), r(F.avg("var"), 3).alias("var"))


reg("processor_chain_edges", "samples pixels", _edges,
    f"""WITH av AS (SELECT y, x, {_MEAN} AS m FROM samples GROUP BY y, x), d AS (SELECT frame, y, x, abs(CAST(p.v AS DOUBLE) - m) AS v FROM pixels p JOIN av USING (y, x) WHERE valid),
        a AS (SELECT *, 2 * sqrt(2 * v + 0.375e0) AS a FROM d), g AS (SELECT *, (lead(a) OVER w - lag(a) OVER w) / 2 AS g, var_pop(a) OVER (PARTITION BY frame, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS var FROM a WINDOW w AS (PARTITION BY frame, y ORDER BY x))
        SELECT frame, count(*) AS n, count(*) FILTER (v > 5000 AND var > 100) AS chosen, round(avg(g), 4) AS g, round(avg(var), 3) AS var FROM g GROUP BY frame""")  # fmt: skip
