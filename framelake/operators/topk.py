"""Best frames, points and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def master_frame(frames: DataFrame, method: str = "best_of_100_in_middle", index: int = 0, n: int = 100, full_window: bool = False, q: str = "q") -> DataFrame:
    """frames: frame (0, 1, ...), q. The chosen frame. The best is looked for among n / 2 frames from n / 2 before the middle, or among n if full_window."""
    if method == "specific_index":
        return frames.where(F.col("frame") == index).select("frame")
    total = frames.agg((F.max("frame") + 1).alias("__n"))
    j = frames.crossJoin(F.broadcast(total))  # one row
    if method == "middle_index":
        return j.where(F.col("frame") == F.floor(F.col("__n") / 2)).select("frame")
    start = F.when(F.col("__n") > n, F.floor(F.col("__n") / 2) - n // 2).otherwise(0)
    size = F.when(F.col("__n") > n, F.lit(n if full_window else n // 2)).otherwise(F.col("__n"))
    return j.where((F.col("frame") >= start) & (F.col("frame") < start + size)).orderBy(F.col(q).desc(), "frame").limit(1).select("frame")


def top_keypoints(kp: DataFrame, n: int = 20) -> DataFrame:
    """The n strongest of each frame; of equal ones those with the smaller number."""
    return kp.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.col("response").desc(), "kp"))).where(F.col("rank") <= n)


def largest_component(components: DataFrame, min_area: int = 4) -> DataFrame:
    """components: component_stats(). One row per frame whose largest has min_area at least."""
    best = components.groupBy("frame").agg(F.max_by(F.struct("label", "area"), F.struct("area", -F.col("label"))).alias("b"))
    return best.where(F.col("b.area") >= min_area).select("frame", "b.label", "b.area")


def sort_track(track: DataFrame, ts: str = "ts") -> DataFrame:
    return track.orderBy(ts, "id")


def best_percent(frames: DataFrame, p: float, q: str = "q") -> DataFrame:
    """The best p percent of frames, at least one."""
    w = Window.orderBy(F.col(q).desc(), "frame")  # one row per frame
    return frames.withColumn("__p", F.percent_rank().over(w)).where(F.col("__p") <= p / 100).drop("__p")
