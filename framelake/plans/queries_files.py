"""Registered queries: what is written to files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import match
from framelake.plans.base import reg, rounded
from framelake.operators.ordered import number_rows
from framelake.sources import catalog as src
from framelake.sources import records
from framelake.sources.adapters import Views
from framelake.streaming.run import scratch


def _frames(v: Views) -> DataFrame:
    path = scratch(v.spark, "frames")
    src.write_frames(src.exclude_bad_frames(v("samples"), v("badframes")), path)
    return v.spark.read.parquet(f"{path}/frames").groupBy(F.col("frmidx").cast("long").alias("frmidx")).agg(F.min("frame").alias("frame"), F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


reg("write_frames", "samples badframes", _frames,
    "SELECT CAST(dense_rank() OVER (ORDER BY frame) - 1 AS BIGINT) AS frmidx, frame, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM samples WHERE frame NOT IN (SELECT frame FROM badframes) GROUP BY frame")


def _all_frames(v: Views) -> DataFrame:
    path = scratch(v.spark, "frames")
    src.write_frames(v("samples").withColumn("frame", F.col("frame") * 7), path)
    return v.spark.read.parquet(f"{path}/frames").groupBy(F.col("frmidx").cast("long").alias("frmidx")).agg(F.min("frame").alias("frame"), F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


# Every sample; the frame numbers are spread so that the mapping has gaps to close.
reg("write_all_frames", "samples", _all_frames, "SELECT CAST(dense_rank() OVER (ORDER BY frame) - 1 AS BIGINT) AS frmidx, frame * 7 AS frame, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM samples GROUP BY frame")


def _matches(v: Views) -> DataFrame:
    path = scratch(v.spark, "matches")
    m = v("keypoints").select(F.col("kp").alias("q"), (F.col("kp") + 1).alias("t"))
    src.write_matches_csv(match.matched_positions(m, v("keypoints"), v("keypoints")), path)
    return v.spark.read.option("header", True).schema("q long, t long, x0 long, y0 long, x1 long, y1 long").csv(path)


reg("write_matches_csv", "keypoints", _matches, "SELECT a.kp AS q, b.kp AS t, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM keypoints a JOIN keypoints b ON b.kp = a.kp + 1")


def _points(v: Views) -> DataFrame:
    path = scratch(v.spark, "points")
    src.write_points(v("lidar_points"), path)
    return v.spark.read.parquet(path).select(F.col("frame").cast("long").alias("frame"), "pid", "laser_ring")


reg("write_points", "lidar_points", _points, "SELECT frame, pid, laser_ring FROM lidar_points")


def _csv(v: Views) -> DataFrame:
    path = scratch(v.spark, "csv")
    v("gps_points").select((F.col("id") * 2).alias("Time"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), (F.col("id") / 10).alias("Altitude")).write.option("header", True).csv(path)
    return rounded(src.read_gps_csv(v.spark, path))


reg("read_gps_csv", "gps_points", _csv, "SELECT CAST(id * 2 AS DOUBLE) AS ts, round(radians(lat), 6) AS lat, round(radians(lon), 6) AS lon, round(id / 10e0, 6) AS alt FROM gps_points")


def _gpx(v: Views) -> DataFrame:
    path = scratch(v.spark, "gpx")
    t = v("gps_points").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.when(F.col("id") % 5 > 0, F.col("id") / 10).alias("ele"), F.timestamp_seconds("id").alias("time"))
    t.write.format("xml").option("rootTag", "trkseg").option("rowTag", "trkpt").save(path)
    return rounded(src.read_gpx_xml(v.spark, path))


reg("read_gpx_xml", "gps_points", _gpx, "SELECT CAST(id AS DOUBLE) AS ts, round(radians(lat), 6) AS lat, round(radians(lon), 6) AS lon, round(id / 10e0, 6) AS alt FROM gps_points WHERE id % 5 > 0")


def _bad(v: Views) -> DataFrame:
    path = scratch(v.spark, "bad")
    v("badframes").select(F.col("frame").cast("string")).write.text(path)
    return src.exclude_bad_frames(v("pixels"), src.read_bad_frames(v.spark, path)).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


reg("read_bad_frames", "pixels badframes", _bad, "SELECT frame, count(*) AS n FROM pixels WHERE frame NOT IN (SELECT frame FROM badframes) GROUP BY frame")


def _clouds(v: Views) -> DataFrame:
    path = scratch(v.spark, "clouds")
    p = v("lidar_points")
    records.write_clouds(p.select("frame", "pid", F.col("azimuth").alias("x"), F.col("elevation").alias("y"), F.col("distance").alias("z"), F.col("intensity").alias("r")), path)
    return rounded(records.read_clouds(v.spark, path), 4)


reg("read_float_clouds", "lidar_points", _clouds,
    """SELECT dense_rank() OVER (ORDER BY frame) - 1 AS frame, row_number() OVER (PARTITION BY frame ORDER BY pid) - 1 AS pid, round(CAST(CAST(azimuth AS FLOAT) AS DOUBLE), 4) AS x,
       round(CAST(CAST(elevation AS FLOAT) AS DOUBLE), 4) AS y, round(CAST(CAST(distance AS FLOAT) AS DOUBLE), 4) AS z, round(CAST(CAST(intensity AS FLOAT) AS DOUBLE), 4) AS r FROM lidar_points""")  # fmt: skip


def _records(v: Views) -> DataFrame:
    path = scratch(v.spark, "records")
    numbered = number_rows(v("track"), [], ["ts", "id"], F.floor(F.col("ts") / 86400)).select(F.col("__i").alias("id"), "ts", "lat", "lon", "alt", "roll", "pitch", "yaw", F.col("id").alias("numsats"))
    records.write_records(numbered, path, 500)
    return rounded(records.read_records(v.spark, path).select("id", "ts", "lat", "lon", "alt", "roll", "pitch", "yaw", "numsats", "vf"))


reg("read_navigation_records", "track", _records,
    """SELECT row_number() OVER (ORDER BY ts, id) - 1 AS id, CAST(ts AS DOUBLE) AS ts, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt, 6) AS alt, round(roll, 6) AS roll, round(pitch, 6) AS pitch,
       round(yaw, 6) AS yaw, CAST(id AS DOUBLE) AS numsats, CAST(0 AS DOUBLE) AS vf FROM track""")  # fmt: skip
