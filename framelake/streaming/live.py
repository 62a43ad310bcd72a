"""The operators on streams: the same functions as on tables where Spark allows, state where an order matters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.joins import calibrate
from framelake.operators.lidar import HISTORY, MAX_MODES, Mixtures
from framelake.operators.stack import stack_average


def live_stack(stream: DataFrame, by: tuple[str, ...] = ("y", "x", "c"), value: str = "v") -> DataFrame:
    """The average of all frames so far (output mode update or complete)."""
    return stack_average(stream, by, value)


def live_calibrate(stream: DataFrame, dark: DataFrame, flat: DataFrame, on: tuple[str, ...] = ("y", "x", "c")) -> DataFrame:
    return calibrate(stream, dark, flat, on=on)


def freshest(batch: DataFrame, index: str = "frame") -> DataFrame:
    """The samples of a batch's newest frame."""
    top = batch.agg(F.max(index).alias("__i"))
    return batch.join(F.broadcast(top), F.col(index) == F.col("__i")).drop("__i")  # one row


def best_of_backlog(batch: DataFrame, lag: int = 3, index: str = "frame", q: str = "q") -> DataFrame:
    """The best frame of a batch with more than `lag` frames, else the newest. batch: a row per frame."""
    s = batch.agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*batch.columns), F.struct(F.col(q), F.col(index))).alias("best"), F.max_by(F.struct(*batch.columns), index).alias("last"))
    return s.where("n > 0").select(F.when(F.col("n") > lag, F.col("best")).otherwise(F.col("last")).alias("f")).select("f.*")


def per_batch(stream: DataFrame, pick: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], Any]):
    """A writer that hands what pick makes of each batch to sink."""
    return stream.writeStream.foreachBatch(lambda df, k: sink(pick(df), k))


def capture_rounds(frames: DataFrame, ts: str = "ts", index: str = "frame", seconds: int | None = None, count: int | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Rounds limited by time (windows of event time) or by number of frames: saved, dropped, first, last."""
    key = F.window(ts, f"{seconds} seconds").alias("round") if seconds else F.floor(F.col(index) / count).alias("round")
    src = frames.withWatermark(ts, watermark) if frames.isStreaming else frames
    return src.groupBy(key).agg(F.count(F.lit(1)).alias("saved"), (F.max(index) - F.min(index) + 1 - F.count(F.lit(1))).alias("dropped"), F.min(index).alias("first"), F.max(index).alias("last"))


def live_frame_stats(stream: DataFrame, value: str = "v", ts: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    src = stream.withWatermark(ts, watermark) if ts and stream.isStreaming else stream
    v = F.col(value).cast("double")
    keys = ["frame", *([ts] if ts else [])]
    return src.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"))


def windowed_rate(stream: DataFrame, kind: str = "tumbling", size: str = "1 hour", slide: str | None = None, ts: str = "ts", by: tuple[str, ...] = (), watermark: str = "1 hour") -> DataFrame:
    """Rows per window of event time; late rows are dropped on a stream."""
    src = stream.withWatermark(ts, watermark) if stream.isStreaming else stream
    w = F.session_window(ts, size) if kind == "session" else F.window(ts, size, slide) if kind == "sliding" else F.window(ts, size)
    return src.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def _stateful(stream: DataFrame, key: str | list[str], f, output: str, state: str) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(f, output, state, "append", GroupStateTimeout.NoTimeout)


def live_running_average(stream: DataFrame, n: int = 5, key: str = "series", order: str = "ord", value: str = "v") -> DataFrame:
    """running_average with the mean and count of every series as state; rows of a batch in order. A batch should hold a bounded part of a series (replay_in_order)."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, count = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        x = rows[value].to_numpy(float)
        w = np.minimum(count + np.arange(len(x)), n).astype(float)
        # m -> (w * m + x) / (w + 1) by doubling: each row holds the map of the 1, 2, 4, ... rows up to it.
        a, b, step = w / (w + 1), x / (w + 1), 1
        while step < len(x):
            a, b = np.append(a[:step], a[step:] * a[:-step]), np.append(b[:step], a[step:] * b[:-step] + b[step:])
            step *= 2
        out = np.where(a == 0, 0.0, a * m) + b
        state.update((float(out[-1]) if len(out) else m, count + len(x)))
        yield pd.DataFrame({key: rows[key], order: rows[order], "avg": out})

    return _stateful(stream, key, run, f"{key} long, {order} long, avg double", "m double, n long")


def live_motion_filter(stream: DataFrame, depth: str = "depth", count: str = "n", history: int = HISTORY, rows_of: int = 16, columns_of: int = 16) -> DataFrame:
    """motion_filter with the modes of blocks of cells as state: a call steps all cells of a block that have rows in a frame at once.

    count: the number of the frame among those processed (1, 2, ...); a cell's frames without a row age its modes when its next row comes.
    """
    block = rows_of * columns_of
    blocks = stream.withColumns({"__r": F.floor(F.col("r") / rows_of).cast("int"), "__c": F.floor(F.col("c") / columns_of).cast("int")})

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        modes, seen = Mixtures(block), np.zeros(block, np.int64)
        if state.exists:
            held, seen = np.array(state.get[0]), np.array(state.get[1], np.int64)
            modes.n[:] = held[:block]
            modes.w, modes.m, modes.s = held[block:].reshape(3, block, MAX_MODES).copy()
        rows = pd.concat(list(batches)).sort_values(count)
        at = (rows["r"].to_numpy() - k[0] * rows_of) * columns_of + rows["c"].to_numpy() - k[1] * columns_of
        n, d, out = rows[count].to_numpy(np.int64), rows[depth].fillna(0.0).to_numpy(float), np.zeros(len(rows), bool)
        cuts = np.flatnonzero(np.append(True, n[1:] != n[:-1])).tolist() if len(n) else []
        for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True):
            out[a:b] = modes.step(at[a:b], seen, d[a:b], int(n[a]), history)
        state.update((np.concatenate([modes.n, modes.w.ravel(), modes.m.ravel(), modes.s.ravel()]).tolist(), seen.tolist()))
        yield pd.DataFrame({"frame": rows["frame"], "r": rows["r"], "c": rows["c"], "foreground": out})

    return _stateful(blocks, ["__r", "__c"], run, "frame long, r int, c int, foreground boolean", "modes array<double>, seen array<bigint>")


def live_rotation_frames(stream: DataFrame, seam: int = 0) -> DataFrame:
    """packet_frames by rotation, with the last azimuth and the frame of every sensor as state. A batch should hold a bounded part of a sensor's packets (replay_in_order)."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, frame = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values("pkt")
        angle = ((rows["azimuth"] - seam) % 36000).to_numpy(np.int64)
        out = frame + np.cumsum(np.diff(angle, prepend=last) < 0)
        if len(angle):
            state.update((int(angle[-1]), int(out[-1])))
        yield pd.DataFrame({"sensor": k[0], "pkt": rows["pkt"], "frame": out})

    return _stateful(stream, "sensor", run, "sensor long, pkt long, frame long", "last long, frame long")
