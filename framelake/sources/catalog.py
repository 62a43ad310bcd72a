"""Sequences of sources, frame selection, and files in and out."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators.ordered import number_rows


def sequence_catalog(sources: DataFrame, enabled: str | None = None) -> DataFrame:
    """sources: src, ord, n_frames: a row per file. Adds global_pos, the frames of the enabled sources before."""
    s = sources.where(F.col(enabled)) if enabled else sources
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return s.withColumn("global_pos", F.coalesce(F.sum("n_frames").over(before), F.lit(0)).cast("long"))


def global_frame_index(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """frames: src, local. Adds pos; local frames that their source doesn't have are dropped."""
    j = frames.join(catalog.select("src", "n_frames", "global_pos"), "src")
    return j.where((F.col("local") >= 0) & (F.col("local") < F.col("n_frames"))).withColumn("pos", F.col("global_pos") + F.col("local")).drop("n_frames", "global_pos")


def concat_sequences(sequences: Sequence[DataFrame], frame: str = "frame") -> DataFrame:
    """The sequences one after another: pos, the place of a frame in the whole, takes the place of frame. A sequence is as long as its last frame says."""
    parts = [d.withColumns({"src": F.lit(k), "local": F.col(frame).cast("long")}).drop(frame) for k, d in enumerate(sequences)]
    lengths = [d.agg((F.max("local") + 1).alias("n_frames")).select(F.lit(k).alias("src"), F.lit(k).alias("ord"), F.coalesce("n_frames", F.lit(0)).alias("n_frames")) for k, d in enumerate(parts)]
    both, files = (functools.reduce(DataFrame.unionByName, x) for x in (parts, lengths))
    return global_frame_index(both, sequence_catalog(files)).withColumnRenamed("pos", frame).drop("src", "local")


def seek(positions: DataFrame, catalog: DataFrame, bucket: int = 1024) -> DataFrame:
    """positions: pos. Adds src and local. Sources meet positions by buckets of positions, so nothing is compared with everything."""
    last = F.col("global_pos") + F.col("n_frames") - 1
    c = catalog.where("n_frames > 0").select("src", "global_pos", last.alias("__last"), F.explode(F.sequence(F.floor(F.col("global_pos") / bucket), F.floor(last / bucket))).alias("__b"))
    j = positions.withColumn("__b", F.floor(F.col("pos") / bucket)).join(c, "__b").where("pos BETWEEN global_pos AND __last")
    return j.withColumn("local", F.col("pos") - F.col("global_pos")).drop("__b", "__last", "global_pos")


def read_bad_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame numbers, one to a line; other lines are skipped."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS BIGINT)").alias("frame")).where("frame IS NOT NULL").distinct()


def exclude_bad_frames(frames: DataFrame, bad: DataFrame) -> DataFrame:
    return frames.join(bad.select("frame"), "frame", "left_anti")


def frame_slice(frames: DataFrame, start: int = 0, max_frames: int = 0, position: str = "frame") -> DataFrame:
    """From start on, max_frames at most; all if that is below 1."""
    p = F.col(position)
    return frames.where(p >= start) if max_frames < 1 else frames.where(p.between(start, start + max_frames - 1))


#: Kinds of sources by file suffix.
KINDS = {
    "ser": "ser", "avi": "video", "mp4": "video", "mkv": "video", "mov": "video", "fits": "fits", "fit": "fits", "tif": "image", "tiff": "image", "png": "image", "jpg": "image", "jpeg": "image",
    "cr2": "raw", "nef": "raw", "arw": "raw", "dng": "raw", "pcap": "lidar", "bin": "cloud", "ply": "cloud", "sply": "cloud", "las": "cloud", "gpx": "track", "csv": "track", "parquet": "table",
}


def source_kind(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    suffix = F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    return functools.reduce(lambda w, kv: w.when(suffix == kv[0], kv[1]), KINDS.items(), F.when(suffix == "", "unknown")).otherwise("unknown")


def timestamp_from_filename(path: Column | str) -> Column:
    """From a token YYYYMMDD_HHMMSS_GMT, between dots and dashes; null without one."""
    p = F.col(path) if isinstance(path, str) else path
    token = F.regexp_extract(p, r"(?:^|[./-])(\d{8}_\d{6})_GMT(?:$|[.-])", 1)
    return F.try_to_timestamp(F.nullif(token, F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def read_velodyne_bin(spark: SparkSession, path: str) -> DataFrame:
    """Files of little-endian floats x, y, z, r: frame (place of the file by name), pid, x, y, z, r."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    names = files.select("path").withColumn("frame", F.row_number().over(Window.orderBy("path")).cast("long") - 1)  # a row per file

    def points(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for frame, content in zip(pdf["frame"], pdf["content"], strict=True):
                a = np.frombuffer(content, "<f4")[: len(content) // 16 * 4].reshape(-1, 4)
                yield pd.DataFrame({"frame": frame, "pid": np.arange(len(a)), **dict(zip("xyzr", a.T, strict=True))})

    return files.select("path", "content").join(names, "path").select("frame", "content").mapInPandas(points, "frame long, pid long, x float, y float, z float, r float")


OXTS = ("lat", "lon", "alt", "roll", "pitch", "yaw", "vn", "ve", "vf", "vl", "vu", "ax", "ay", "az", "af", "al", "au", "wx", "wy", "wz", "wf", "wl", "wu", "pos_accuracy", "vel_accuracy", "navstat", "numsats", "posmode", "velmode", "orimode")


def read_oxts(spark: SparkSession, data: str, timestamps: str) -> DataFrame:
    """A file with one record of numbers per frame, and the file of their times: id, ts and the fields; latitude and longitude in radians."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(data, wholetext=True).select("_metadata.file_path", F.split(F.trim("value"), r"\s+").alias("f"))
    rows = rows.withColumn("id", F.row_number().over(Window.orderBy("file_path")).cast("long") - 1)  # a row per file
    times = spark.read.text(timestamps, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("id", "t"))
    times = times.select(F.col("id").cast("long").alias("id"), (F.unix_micros(F.to_timestamp(F.substring("t", 1, 26))) / 1e6).alias("ts"))
    fields = [F.get("f", k).cast("double").alias(n) for k, n in enumerate(OXTS)]
    out = rows.select("id", *fields).join(times, "id")
    return out.select("id", "ts", F.radians("lat").alias("lat"), F.radians("lon").alias("lon"), *OXTS[2:])


def read_gpx_xml(spark: SparkSession, path: str) -> DataFrame:
    """ts (s), lat, lon (radians), alt of the track points of GPX files; incomplete ones are skipped."""
    p = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, ele double, time timestamp").load(path)
    return p.dropna().select((F.unix_micros("time") / 1e6).alias("ts"), F.radians("_lat").alias("lat"), F.radians("_lon").alias("lon"), F.col("ele").alias("alt"))


def read_gps_csv(spark: SparkSession, path: str) -> DataFrame:
    """ts, lat, lon (radians), alt from columns found by name in any case; seconds_elapsed goes before time. Rows with a missing number, and lines that start with # or /, are skipped."""
    lines = spark.read.option("header", True).option("comment", "#").csv(path)
    by = {c.strip().lower(): c for c in lines.columns}
    pick = lambda *names: F.coalesce(*[F.expr(f"try_cast(`{by[n]}` AS DOUBLE)") for n in names if n in by])
    out = lines.where(~F.coalesce(F.col(f"`{lines.columns[0]}`").startswith("/"), F.lit(False)))
    return out.select(pick("seconds_elapsed", "time").alias("ts"), F.radians(pick("latitude", "lat")).alias("lat"), F.radians(pick("longitude", "lon")).alias("lon"), pick("altitude", "alt", "ele").alias("alt")).dropna()


# Sinks


def frame_mapping(frames: DataFrame) -> DataFrame:
    """frames: seqidx, one row per kept frame. Adds frmidx, the place in the output."""
    return frames.withColumn("frmidx", F.row_number().over(Window.orderBy("seqidx")).cast("long") - 1)


def write_frames(df: DataFrame, path: str, frame: str = "frame") -> None:
    """Samples by frame number in the output, and the mapping beside them."""
    kept = frame_mapping(df.select(F.col(frame).alias("seqidx")).distinct())
    df.join(kept, F.col(frame) == F.col("seqidx")).drop("seqidx").repartition("frmidx").write.partitionBy("frmidx").parquet(f"{path}/frames")
    kept.write.parquet(f"{path}/mapping")


def write_matches_csv(matches: DataFrame, path: str) -> None:
    """matches: matched_positions()."""
    matches.select("q", "t", "x0", "y0", "x1", "y1").write.option("header", True).csv(path)


def export_rows(track: DataFrame, bucket: float = 86400.0) -> DataFrame:
    """I, TS, DTS (since the start), LAT, LON (degrees), ALT of a track in order; numbered within buckets of time, with the counts of those before."""
    start = track.agg(F.min("ts").alias("__t0"))
    rows = number_rows(track, [], ["ts", "id"], F.floor(F.col("ts") / bucket)).crossJoin(F.broadcast(start))  # one row
    return rows.select(F.col("__i").alias("I"), F.col("ts").alias("TS"), (F.col("ts") - F.col("__t0")).alias("DTS"), F.degrees("lat").alias("LAT"), F.degrees("lon").alias("LON"), F.col("alt").alias("ALT"))


def export_track(track: DataFrame, path: str) -> None:
    export_rows(track).write.option("header", True).option("sep", "\t").csv(path)


def write_points(points: DataFrame, path: str) -> None:
    points.repartition("frame").write.partitionBy("frame").parquet(path)
