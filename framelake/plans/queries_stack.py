"""Registered queries: sources, calibration, stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import joins, lidar, select, stack
from framelake.plans.base import r, reg, rounded
from framelake.sources import catalog as src
from framelake.sources.adapters import Views

# Sources and catalogs

reg("sequence_catalog", "sources", lambda v: src.sequence_catalog(v("sources")),
    "SELECT src, ord, n_frames, CAST(coalesce(sum(n_frames) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS global_pos FROM sources")

_CATALOG = "cat AS (SELECT src, n_frames, CAST(coalesce(sum(n_frames) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM sources)"
reg("global_frame_index", "sources", lambda v: src.global_frame_index(v("documents").select(F.col("source").alias("src"), (F.col("doc_id") % 97).alias("local"), "doc_id"), src.sequence_catalog(v("sources"))).select("doc_id", "src", "local", "pos"),
    f"WITH {_CATALOG} SELECT doc_id, src, doc_id % 97 AS local, g + doc_id % 97 AS pos FROM documents JOIN cat ON source = src WHERE doc_id % 97 < n_frames")
reg("seek", "sources", lambda v: src.seek(v("documents").select(F.col("doc_id").alias("pos")), src.sequence_catalog(v("sources"))).select("pos", "src", "local"),
    f"WITH {_CATALOG} SELECT doc_id AS pos, src, doc_id - g AS local FROM documents JOIN cat ON doc_id >= g AND doc_id < g + n_frames")
reg("exclude_bad_frames", "samples badframes", lambda v: src.exclude_bad_frames(v("samples"), v("badframes")).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total")),
    "SELECT frame, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM samples WHERE frame NOT IN (SELECT frame FROM badframes) GROUP BY frame")
reg("frame_slice", "samples", lambda v: src.frame_slice(v("samples"), 5, 10).groupBy("frame").agg(F.count(F.lit(1)).alias("n")),
    "SELECT frame, count(*) AS n FROM samples WHERE frame BETWEEN 5 AND 14 GROUP BY frame")
_SUFFIX = "['ser', 'AVI', 'fits', 'tif', 'pcap', 'gpx', 'bin', 'nef', 'txt', 'parquet']"
_NAMES = lambda: F.concat_ws("", F.lit("/data/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ("ser", "AVI", "fits", "tif", "pcap", "gpx", "bin", "nef", "txt", "parquet"))), (F.col("doc_id") % 10 + 1).cast("int")))
reg("source_kind", "sources", lambda v: v("documents").select("doc_id", _NAMES().alias("path")).withColumn("kind", src.source_kind("path")),
    f"""SELECT doc_id, '/data/' || source || '/f' || doc_id || '.' || {_SUFFIX}[CAST(doc_id % 10 AS INT) + 1] AS path,
        ['ser', 'video', 'fits', 'image', 'lidar', 'track', 'cloud', 'raw', 'unknown', 'table'][CAST(doc_id % 10 AS INT) + 1] AS kind FROM documents""")  # fmt: skip
reg("timestamp_from_filename", "sources", lambda v: v("events").select("event_id", F.concat_ws("", F.lit("/cap/x-"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_GMT.ser")).alias("path")).select("event_id", F.unix_timestamp(src.timestamp_from_filename("path")).alias("t")),
    "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events")
reg("point_time", "gps_points", lambda v: v("gps_points").select("id", r(lidar.point_time("lon", "lat", F.lit(10.0), F.lit(10.1), F.lit(10.05))).alias("t")),
    "SELECT id, round(10.05e0 - atan2(lat, lon) * (10.1e0 - 10e0) / (2 * pi()), 6) AS t FROM gps_points")
reg("packet_frames", "firings", lambda v: lidar.packet_frames(v("firings"), seam=9000).select("sensor", "pkt", "frame"),
    """WITH a AS (SELECT sensor, pkt, (azimuth + 27000) % 36000 AS a FROM firings), b AS (SELECT sensor, pkt, CASE WHEN a < lag(a) OVER (PARTITION BY sensor ORDER BY pkt) THEN 1 ELSE 0 END AS n FROM a)
       SELECT sensor, pkt, CAST(sum(n) OVER (PARTITION BY sensor ORDER BY pkt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frame FROM b""")  # fmt: skip
reg("toh_unwrap", "firings", lambda v: lidar.toh_unwrap(v("firings")).select("sensor", "pkt", r("t").alias("t")),
    """WITH b AS (SELECT *, CASE WHEN toh < lag(toh) OVER (PARTITION BY sensor ORDER BY pkt) THEN 1 ELSE 0 END AS n FROM firings)
       SELECT sensor, pkt, round(toh / 1e6 + 3600 * sum(n) OVER (PARTITION BY sensor ORDER BY pkt ROWS UNBOUNDED PRECEDING), 6) AS t FROM b""")  # fmt: skip
reg("split_streams", "firings", lambda v: lidar.split_streams(v("firings").withColumn("address", F.col("azimuth") % 7)).select("address", "sensor", "pkt", "stream").withColumn("place", F.lit(0)).drop("place"),
    "SELECT azimuth % 7 AS address, sensor, pkt, CAST(dense_rank() OVER (ORDER BY azimuth % 7) - 1 AS BIGINT) AS stream FROM firings")
reg("frame_mapping", "samples badframes", lambda v: src.frame_mapping(src.exclude_bad_frames(v("samples"), v("badframes")).select(F.col("frame").alias("seqidx")).distinct()),
    "SELECT frame AS seqidx, CAST(row_number() OVER (ORDER BY frame) - 1 AS BIGINT) AS frmidx FROM (SELECT DISTINCT frame FROM samples WHERE frame NOT IN (SELECT frame FROM badframes))")
reg("export_track", "track", lambda v: rounded(src.export_rows(v("track")), 6),
    "SELECT CAST(row_number() OVER (ORDER BY ts, id) - 1 AS BIGINT) AS I, ts AS TS, ts - min(ts) OVER () AS DTS, round(degrees(lat), 6) AS LAT, round(degrees(lon), 6) AS LON, round(alt, 6) AS ALT FROM track")
reg("concat_sequences", "pixels samples",
    lambda v: src.concat_sequences([v("pixels").select("frame", F.col("v").cast("double").alias("v")), v("samples").select("frame", F.col("v").cast("double").alias("v"))]).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 2).alias("total")),
    "SELECT frame, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT frame, CAST(v AS DOUBLE) AS v FROM pixels UNION ALL SELECT frame + (SELECT max(frame) + 1 FROM pixels), CAST(v AS DOUBLE) FROM samples) GROUP BY frame")


def _two_sequences(v: Views) -> DataFrame:
    """The pixels, and the pixels again behind them, by positions of the catalog."""
    frames = v("pixels").select(F.col("frame").alias("local"), "v")
    files = frames.agg((F.max("local") + 1).alias("n_frames")).select(F.explode(F.array(*(F.struct(F.lit(s).alias("src"), F.lit(k).alias("ord")) for k, s in enumerate(("first", "second"))))).alias("s"), "n_frames").select("s.*", "n_frames")
    both = frames.withColumn("src", F.lit("first")).unionByName(frames.withColumn("src", F.lit("second")))
    return src.global_frame_index(both, src.sequence_catalog(files)).groupBy(F.col("pos").alias("frame")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


reg("concat_whole_sequences", "pixels", _two_sequences,
    "SELECT frame, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT frame, v FROM pixels UNION ALL SELECT frame + (SELECT max(frame) + 1 FROM pixels), v FROM pixels) GROUP BY frame")

# Stacking

_MEAN = "CAST(sum(v) AS DOUBLE) / count(v)"
reg("stack_average", "samples", lambda v: rounded(stack.stack_average(v("samples"))), f"SELECT y, x, c, round({_MEAN}, 6) AS mean, count(v) AS n FROM samples GROUP BY y, x, c")
reg("stack_masked_average", "samples", lambda v: rounded(stack.stack_masked_average(v("samples"))),
    "SELECT y, x, c, round(CAST(sum(v) FILTER (valid) AS DOUBLE) / nullif(count(*) FILTER (valid), 0), 6) AS mean, count(*) FILTER (valid) AS n FROM samples GROUP BY y, x, c")
reg("stack_weighted_average", "samples", lambda v: rounded(stack.stack_weighted_average(v("samples"))),
    "SELECT y, x, c, round(CAST(sum(v * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 6) AS mean, CAST(sum(w) AS DOUBLE) AS weight FROM samples WHERE w > 0 GROUP BY y, x, c")
reg("stack_weights", "samples", lambda v: stack.stack_weights(v("samples")), "SELECT y, x, c, CAST(sum(w) AS DOUBLE) AS weight, count(*) AS n FROM samples WHERE w > 0 GROUP BY y, x, c")
reg("stack_resume", "samples", lambda v: rounded(stack.stack_resume(stack.weighted_sums(v("samples").where("frame < 16")), v("samples").where("frame >= 16"))),
    "SELECT y, x, c, round(CAST(sum(v * w) AS DOUBLE), 6) AS swv, CAST(sum(w) AS DOUBLE) AS sw FROM samples WHERE w > 0 GROUP BY y, x, c")
_OFFSETS = "offsets AS (SELECT DISTINCT frame, frame % 5 - 2 AS dx, frame % 3 - 1 AS dy FROM samples)"
reg("canvas_average", "pixels", lambda v: rounded(stack.canvas_average(v("pixels"), v("pixels").select("frame", (F.col("frame") % 5 - 2).alias("dx"), (F.col("frame") % 3 - 1).alias("dy")).distinct(), 50, 40)),
    f"WITH {_OFFSETS} SELECT y + dy + 10 AS cy, x + dx + 12 AS cx, round({_MEAN}, 6) AS mean, count(*) AS n FROM pixels JOIN offsets USING (frame) WHERE y + dy + 10 BETWEEN 0 AND 59 AND x + dx + 12 BETWEEN 0 AND 74 GROUP BY 1, 2")
_COLOR = "CASE (y % 2) * 2 + x % 2 WHEN 0 THEN 'R' WHEN 1 THEN 'G' WHEN 2 THEN 'G' ELSE 'B' END"
reg("bayer_average", "pixels", lambda v: rounded(stack.bayer_average(v("pixels"))), f"SELECT y, x, {_COLOR} AS color, round({_MEAN}, 6) AS mean, count(v) AS n FROM pixels GROUP BY y, x, color")
reg("bayer_drizzle", "pixels", lambda v: rounded(stack.bayer_drizzle(v("pixels").withColumn("v", F.col("v").cast("double") / 7), v("pixels").select("frame", (F.col("frame") % 4 / F.lit(4.0)).alias("dx"), (F.col("frame") % 2 / F.lit(2.0)).alias("dy")).distinct()), 6),
    f"""WITH m AS (SELECT {_COLOR} AS color, CAST(v AS DOUBLE) / 7 AS v, x + (frame % 4) / 4e0 AS fx, y + (frame % 2) / 2e0 AS fy FROM pixels),
        s AS (SELECT color, CAST(v AS DOUBLE) AS v, CAST(floor(fy) AS BIGINT) + a AS y, CAST(floor(fx) AS BIGINT) + b AS x, (CASE a WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE b WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
              FROM m, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b))
        SELECT y, x, color, round(sum(v * w) / sum(w), 6) AS mean, round(sum(w), 6) AS weight FROM s WHERE w > 0 GROUP BY y, x, color""")  # fmt: skip
_DETAIL = "d AS (SELECT *, CAST(v AS DOUBLE) - CAST(sum(v) OVER b AS DOUBLE) / count(v) OVER b AS detail FROM pixels WINDOW b AS (PARTITION BY frame, y // 4, x // 4))"
reg("focus_stack_max_energy", "pixels", lambda v: rounded(stack.focus_stack_max_energy(stack.detail(v("pixels")).withColumn("detail", F.round("detail", 6)))),
    f"WITH {_DETAIL} SELECT y, x, CAST(arg_max(v, (abs(round(detail, 6)), -frame)) AS DOUBLE) AS v, arg_max(frame, (abs(round(detail, 6)), -frame)) AS frame FROM d GROUP BY y, x")
reg("focus_stack_weighted", "pixels", lambda v: rounded(stack.focus_stack_weighted(stack.detail(v("pixels"))), 1),
    f"WITH {_DETAIL} SELECT y, x, round(CASE WHEN sum(detail * detail) <> 0 THEN sum(detail * detail * detail) / sum(detail * detail) END, 1) AS detail, round(sum(detail * detail), 1) AS energy FROM d GROUP BY y, x")
_DARK = "dark AS (SELECT y, x, c, coalesce(CAST(sum(v) FILTER (valid) AS DOUBLE), 0) / greatest(count(*) FILTER (valid), 1) AS dark, count(*) FILTER (valid) AS n FROM samples GROUP BY y, x, c)"
reg("dark_frame", "samples", lambda v: rounded(stack.dark_frame(v("samples"))), f"WITH {_DARK} SELECT y, x, c, round(dark, 6) AS dark, n FROM dark")
reg("flat_field", "samples", lambda v: rounded(stack.flat_field(v("samples"))), f"WITH {_DARK} SELECT y, x, c, round(dark / avg(dark) OVER (PARTITION BY c), 6) AS flat FROM dark")
reg("hdr_blend", "pixels", lambda v: rounded(stack.hdr_blend(v("pixels").where("frame = 0").select("y", "x", (F.col("v").cast("double") / 105000.0).alias("v")), v("pixels").where("frame = 1").select("y", "x", (F.col("v").cast("double") / 120000.0).alias("v")))),
    """WITH j AS (SELECT y, x, CAST(p.v AS DOUBLE) / 105000e0 AS a, CAST(q.v AS DOUBLE) / 120000e0 AS b FROM pixels p JOIN pixels q USING (y, x) WHERE p.frame = 0 AND q.frame = 1),
       o AS (SELECT coalesce(avg(ln(a) - ln(b)), 0) AS o FROM j WHERE a < 0.8e0 AND b < 0.8e0 AND a > 0 AND b > 0)
       SELECT y, x, round((a * a * a + (1 - a) * (1 - a) * b * exp(o)) / (a * a + (1 - a) * (1 - a)), 6) AS v FROM j, o""")  # fmt: skip
_XYZ = """xyz AS (SELECT *, d * cos(elevation) * sin(azimuth) AS x, d * cos(elevation) * cos(azimuth) AS y, d * sin(elevation) AS z FROM (SELECT *, CASE WHEN distance > 0 THEN distance END AS d FROM lidar_points))"""
reg("voxel_accumulate", "lidar_points", lambda v: rounded(stack.voxel_accumulate(_points(v).select("x", "y", "z", F.col("intensity").alias("r"), "t"), 0.5)),
    f"""WITH {_XYZ} SELECT CAST(floor((x + 500) / 0.5e0) AS BIGINT) AS ix, CAST(floor((y + 500) / 0.5e0) AS BIGINT) AS iy, CAST(floor((z + 10) / 0.5e0) AS BIGINT) AS iz,
        round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(intensity), 6) AS r, round(avg(t), 6) AS t, count(*) AS n
        FROM xyz WHERE x >= -500 AND x < 500 AND y >= -500 AND y < 500 AND z >= -10 AND z < 20 GROUP BY 1, 2, 3""")  # fmt: skip


def _points(v: Views) -> DataFrame:
    from framelake.functions.geometry import lidar_to_cartesian

    x, y, z = lidar_to_cartesian()
    return v("lidar_points").withColumns({"x": x, "y": y, "z": z})


reg("stack_sum_abs", "samples", lambda v: rounded(stack.stack_sum_abs(v("samples"))), f"SELECT y, x, c, round({_MEAN.replace('sum(v)', 'sum(abs(v))')}, 6) AS mean_abs FROM samples GROUP BY y, x, c")
reg("stack_max", "samples", lambda v: stack.stack_max(v("samples")), "SELECT y, x, c, CAST(max(abs(v)) AS DOUBLE) AS max_abs FROM samples GROUP BY y, x, c")
reg("reduce_rows", "pixels", lambda v: rounded(stack.reduce_axis(v("pixels"), "y", "avg", valid="valid")), "SELECT frame, y, round(CAST(sum(v) FILTER (valid) AS DOUBLE) / nullif(count(*) FILTER (valid), 0), 6) AS avg FROM pixels GROUP BY frame, y")
reg("reduce_cols", "pixels", lambda v: rounded(stack.reduce_axis(v("pixels"), "x", "sum2"), 2), "SELECT frame, x, round(CAST(sum(v * v) AS DOUBLE), 2) AS sum2 FROM pixels GROUP BY frame, x")
reg("flow_average", "pixels", lambda v: rounded(stack.flow_average(v("pixels").select("y", "x", (F.col("v") - 50000).alias("dx"), (F.col("w") - 25).alias("dy")))),
    "SELECT y, x, round(CAST(sum(v - 50000) AS DOUBLE) / count(*), 6) AS dx, round(CAST(sum(w - 25) AS DOUBLE) / count(*), 6) AS dy, count(*) AS n FROM pixels GROUP BY y, x")
reg("calibrate", "samples badframes", lambda v: rounded(joins.calibrate(src.exclude_bad_frames(v("samples"), v("badframes")).select("frame", "y", "x", "c", "v", "valid"), stack.dark_frame(v("samples")), stack.flat_field(v("samples"))).groupBy("frame").agg(F.sum(F.round("v", 4)).alias("total"), F.count_if("valid").alias("n")), 2),
    f"""WITH {_DARK}, flat AS (SELECT y, x, c, dark / avg(dark) OVER (PARTITION BY c) AS flat FROM dark)
        SELECT frame, round(sum(round((CAST(v AS DOUBLE) - d.dark) / nullif(flat, 0), 4)), 2) AS total, count(*) FILTER (valid AND flat <> 0) AS n
        FROM samples s JOIN dark d USING (y, x, c) JOIN flat USING (y, x, c) WHERE frame NOT IN (SELECT frame FROM badframes) GROUP BY frame""")  # fmt: skip
_LEFT = "SELECT frame, y, x - 25 AS x, v FROM pixels WHERE x >= 25"
reg("stereo_pairs", "pixels", lambda v: joins.stereo_pairs(v("pixels"), 50, 40).select("frame", "y", "x", F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right")),
    f"SELECT frame, y, x, CAST(a.v AS DOUBLE) AS \"left\", CAST(b.v AS DOUBLE) AS \"right\" FROM (SELECT frame, y, x, v FROM pixels WHERE x < 25) a JOIN ({_LEFT}) b USING (frame, y, x)")
reg("stereo_sources", "pixels", lambda v: joins.stereo_sources(v("pixels").where("frame % 2 = 0").withColumn("frame", F.expr("frame div 2")), v("pixels").where("frame % 2 = 1").withColumn("frame", F.expr("frame div 2"))).select("frame", "y", "x", F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right")),
    "SELECT a.frame // 2 AS frame, y, x, CAST(a.v AS DOUBLE) AS \"left\", CAST(b.v AS DOUBLE) AS \"right\" FROM pixels a JOIN pixels b USING (y, x) WHERE a.frame % 2 = 0 AND b.frame = a.frame + 1")
_MASKS = "a AS (SELECT DISTINCT y, x FROM pixels WHERE frame = 0 AND valid), b AS (SELECT DISTINCT y, x FROM pixels WHERE frame = 1 AND valid)"
for _op, _sql in (("union", "SELECT * FROM a UNION SELECT * FROM b"), ("intersect", "SELECT * FROM a INTERSECT SELECT * FROM b"), ("except", "SELECT * FROM a EXCEPT SELECT * FROM b"), ("symmetric", "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)")):
    reg(f"mask_{_op}", "pixels", lambda v, op=_op: select.mask_sets(v("pixels").where("frame = 0 AND valid"), v("pixels").where("frame = 1 AND valid"), op), f"WITH {_MASKS} {_sql}")
reg("merge_clouds", "lidar_points", lambda v: select.merge_clouds(v("lidar_points").where("laser_ring < 8").select("frame", "pid", "distance"), v("lidar_points").where("laser_ring >= 8").select("frame", "pid", "distance")).groupBy("frame", "cloud").agg(F.count(F.lit(1)).alias("n"), r(F.sum("distance"), 4).alias("total")),
    "SELECT frame, CAST(laser_ring >= 8 AS INT) AS cloud, count(*) AS n, round(sum(distance), 4) AS total FROM lidar_points GROUP BY 1, 2")
reg("set_landmark", "track", lambda v: select.set_landmark(v("track").select(F.col("id").alias("frame"), "ts"), v("track").where("id % 3 = 0").select(F.col("id").alias("frame"), (F.col("ts") + 7).alias("ts"))),
    "SELECT id AS frame, CASE WHEN id % 3 = 0 THEN ts + 7 ELSE ts END AS ts FROM track")
reg("remove_landmark", "track", lambda v: select.remove_landmark(v("track").select(F.col("id").alias("frame"), "ts"), v("track").where("id % 3 = 0").select(F.col("id").alias("frame"))), "SELECT id AS frame, ts FROM track WHERE id % 3 <> 0")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good frames, calibrated by a dark frame, stacked by weight."""
    v = Views(spark, sf_dir)
    good = src.exclude_bad_frames(v("samples"), v("badframes"))
    dark = stack.dark_frame(v("samples").where("frame < 4"))
    flat = dark.select("y", "x", "c", F.lit(1.0).alias("flat"))
    done = joins.calibrate(good.select("frame", "y", "x", "c", "v", "w", "valid"), dark, flat)
    return rounded(stack.stack_weighted_average(done.where("valid").withColumn("v", r("v", 4).cast("decimal(18,4)"))), 4)


reg("flagship_stack", "samples badframes", lambda v: flagship(v.spark, v.sf_dir),
    """WITH d AS (SELECT y, x, c, coalesce(CAST(sum(v) FILTER (valid) AS DOUBLE), 0) / greatest(count(*) FILTER (valid), 1) AS dark FROM samples WHERE frame < 4 GROUP BY y, x, c),
       s AS (SELECT y, x, c, CAST(round(CAST(v AS DOUBLE) - dark, 4) AS DECIMAL(18,4)) AS v, w FROM samples JOIN d USING (y, x, c) WHERE valid AND w > 0 AND frame NOT IN (SELECT frame FROM badframes))
       SELECT y, x, c, round(CAST(sum(v * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 4) AS mean, CAST(sum(w) AS DOUBLE) AS weight FROM s GROUP BY y, x, c""")  # fmt: skip
