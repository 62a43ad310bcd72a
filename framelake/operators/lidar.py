"""Laser scans: framing, range images, ground, surface slopes, motion."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.geometry import lidar_depth, lidar_height, lidar_to_cartesian
from framelake.operators.ordered import previous, running_total


def packet_frames(firings: DataFrame, mode: str = "rotation", seam: int = 0, by: tuple[str, ...] = ("sensor",), chunk: int = 100_000) -> DataFrame:
    """Adds frame: a rotation ends where the azimuth (0.01 degree) passes the seam; or every packet or data block is one. A sensor's packets are cut into chunks."""
    if mode in ("packet", "block"):
        return firings.withColumn("frame", F.col("pkt" if mode == "packet" else "block").cast("long"))
    part = F.floor(F.col("pkt") / chunk)
    d = previous(firings.withColumn("__a", F.pmod(F.col("azimuth") - seam, F.lit(36000))), by, ["pkt"], ["__a"], part)
    fell = F.coalesce((F.col("__a") < F.col("__before.__a")).cast("long"), F.lit(0))
    return running_total(d, by, ["pkt"], fell, part, "frame").drop("__a", "__before")


def toh_unwrap(firings: DataFrame, by: tuple[str, ...] = ("sensor",), chunk: int = 100_000) -> DataFrame:
    """Adds t (seconds): the top-of-hour stamp, an hour more after each time it falls."""
    part = F.floor(F.col("pkt") / chunk)
    fell = F.coalesce((F.col("toh") < F.col("__before.toh")).cast("long"), F.lit(0))
    d = running_total(previous(firings, by, ["pkt"], ["toh"], part), by, ["pkt"], fell, part, "__h")
    return d.withColumn("t", F.col("toh") / 1e6 + 3600 * F.col("__h")).drop("__h", "__before")


def split_streams(packets: DataFrame, address: str = "address") -> DataFrame:
    """Adds stream (number of the address, in order) and the packet's place in it. The addresses are counted apart, as a small table."""
    numbers = packets.select(address).distinct().withColumn("stream", F.row_number().over(Window.orderBy(address)).cast("long") - 1)
    return packets.join(numbers, address).withColumn("place", F.row_number().over(Window.partitionBy(address).orderBy("pkt")).cast("long") - 1)


def point_time(x: str, y: str, ts: Column, te: Column, tff: Column) -> Column:
    """The time of a point from its bearing in a rotation."""
    return tff - F.atan2(F.col(y), F.col(x)) * (te - ts) / (2 * math.pi)


CHANNELS = ("distance", "depth", "x", "y", "z", "height", "intensity", "elevation", "azimuth", "laser_id", "ring", "datablock", "pkt", "timestamp")


def channel(name: str) -> Column:
    x, y, z = lidar_to_cartesian()
    return {"depth": lidar_depth(), "x": x, "y": y, "z": z, "height": lidar_height(), "ring": F.col("laser_ring"), "timestamp": F.col("t")}.get(name, F.col(name)).cast("double")


def range_image(points: DataFrame, channels: tuple[str, ...] = ("distance",)) -> DataFrame:
    """points: with r and c. Per frame and cell the channels of the closest return; of equal ones that of the smallest pid."""
    seen = points.where(F.col("distance") > 0)
    best = F.min_by(F.struct(*(channel(n).alias(n) for n in channels)), F.struct("distance", "pid"))
    return seen.groupBy("frame", "r", "c").agg(best.alias("b")).select("frame", "r", "c", "b.*")


def range_aliasing(points: DataFrame) -> DataFrame:
    return points.where(F.col("distance") > 0).groupBy("frame", "r", "c").agg(F.count(F.lit(1)).alias("n"))


def project_to_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points: with r and c. Each with the result of its cell."""
    return points.join(cells, ["frame", "r", "c"], "left")


def laser_corrections(points: DataFrame, lasers: DataFrame, key: str = "laser_id") -> DataFrame:
    """lasers: laser_id, ring, rot_corr, vert_corr. Corrected azimuth and elevation."""
    j = points.join(lasers, key)
    return j.withColumns({"azimuth": F.pmod(F.col("azimuth") - F.col("rot_corr"), F.lit(2 * math.pi)), "elevation": F.col("vert_corr")}).drop("rot_corr", "vert_corr")


def ground_scan(image: DataFrame, h0: float = 2.0, zroof: float = -1.0, gtol: float = 0.1, z: str = "z", rings: int | None = None) -> DataFrame:
    """image: frame, r, c, z (null or no row without a return). Adds ground to the rows of image.

    Along the rings of one azimuth: wait for a point below the roof (by more than 0.1), then for one within 0.25 of -h0, then follow
    while the height changes by more than -2 gtol and less than gtol; after more than 4 cells that don't follow, cells without a return
    among them, wait again. A line has `rings` cells, or those that it has rows for.
    """
    held = F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), F.struct(F.col(z).cast("double").alias("z")).alias("z"))))
    lines = image.groupBy("frame", "r").agg(held.alias("__m"))
    places = F.array_sort(F.map_keys("__m")) if rings is None else F.sequence(F.lit(0), F.lit(rings - 1))
    lines = lines.withColumn("__s", F.transform(places, lambda c: F.struct(c.alias("c"), F.try_element_at("__m", c)["z"].alias("z"))))
    start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("gaps"), F.array().cast("array<boolean>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        v = p["z"]
        below = F.coalesce(v < zroof - 0.1, F.lit(False))
        near = F.coalesce(F.abs(v + h0) < 0.25, F.lit(False))
        follows = F.coalesce((v - a["last"] > -2 * gtol) & (v - a["last"] < gtol), F.lit(False))
        row = lambda state, last, gaps, ground: F.struct(F.lit(state).alias("state"), last.cast("double").alias("last"), gaps.alias("gaps"), F.array_append(a["out"], F.lit(ground)).alias("out"))
        return (
            F.when((a["state"] == 0) & ~below, row(0, a["last"], a["gaps"], False))
            .when((a["state"] < 2) & near, row(2, v, a["gaps"], True))
            .when(a["state"] < 2, row(1, a["last"], a["gaps"], False))
            .when(follows, row(2, v, F.lit(0), True))
            .when(a["gaps"] >= 4, row(1, a["last"], F.lit(0), False))
            .otherwise(row(2, a["last"], a["gaps"] + 1, False))
        )

    flags = F.aggregate("__s", start, step, lambda a: a["out"])
    each = lines.select("frame", "r", "__m", F.explode(F.arrays_zip(F.col("__s").alias("s"), flags.alias("g"))).alias("z")).where(F.map_contains_key("__m", F.col("z.s.c")))
    return each.select("frame", "r", F.col("z.s.c").alias("c"), F.col("z.s.z").alias("z"), F.col("z.g").alias("ground"))


def surface_slope(image: DataFrame, rows: int, depth: str = "depth", height: str = "height") -> DataFrame:
    """image: frame, r (wraps around at rows), c, depth, height of filled cells. slope: atan2 of height and depth differences between the filled neighbours of a cell in its ring (both sides) and on its azimuth."""
    val = F.struct(F.col(depth).alias("d"), F.col(height).alias("h"))
    # The first and last cells of each ring once more beyond the seam.
    edge = image.where((F.col("r") < 8) | (F.col("r") >= rows - 8)).withColumn("r", F.when(F.col("r") < 8, F.col("r") + rows).otherwise(F.col("r") - rows))
    ring = Window.partitionBy("frame", "c").orderBy("r")
    line = Window.partitionBy("frame", "r").orderBy("c")
    both = image.withColumn("__own", F.lit(True)).unionByName(edge.withColumn("__own", F.lit(False)))
    both = both.withColumns({"__rp": F.lag(val).over(ring), "__rn": F.lead(val).over(ring)}).where("__own").withColumns({"__cp": F.lag(val).over(line), "__cn": F.lead(val).over(line)})
    diff = lambda a, b, f: F.coalesce(F.col(f"{b}.{f}") - F.col(f"{a}.{f}"), F.lit(0.0))
    dh = F.hypot(diff("__rp", "__rn", "h"), diff("__cp", "__cn", "h"))
    dd = F.hypot(diff("__rp", "__rn", "d"), diff("__cp", "__cn", "d"))
    return both.select("frame", "r", "c", F.atan2(dh, dd).alias("slope"))


# Motion: a mixture of at most MAX_MODES normal distributions of depth per cell, the most distant first.

#: Modes of a cell, frames of history, deviations within which a depth fits, first and least deviation, weight below which a mode is motion, variances within which neighbours fuse.
MAX_MODES, HISTORY, FITS, SIGMA0, SIGMA_MIN, MOTION, FUSES = 4, 200, 5.0, 0.2, 0.1, 0.2, 25.0


class Mixtures:
    """The modes of many cells: w (weight), m (mean), s (variance), each cells x MAX_MODES, and how many of them a cell has."""

    def __init__(self, cells: int):
        import numpy as np

        self.n = np.zeros(cells, np.int64)
        self.w, self.m, self.s = (np.zeros((cells, MAX_MODES)) for _ in range(3))

    def remove(self, cells, places) -> None:
        for x in (self.w, self.m, self.s):
            for k in range(MAX_MODES - 1):
                later = cells[places <= k]
                x[later, k] = x[later, k + 1]
        self.n[cells] -= 1

    def insert(self, cells, places) -> None:
        for x in (self.w, self.m, self.s):
            for k in range(MAX_MODES - 1, 0, -1):
                later = cells[places < k]
                x[later, k] = x[later, k - 1]
        self.n[cells] += 1

    def _age(self, cells, updated, frames: int) -> None:
        """Modes behind the updated one lose weight; those below 1 / frames go. Then neighbours that overlap become one."""
        keep = frames / (1.0 + frames)
        for k in range(MAX_MODES - 1, -1, -1):
            older = cells[(self.n[cells] > k) & (updated < k)]
            self.w[older, k] *= keep
            gone = older[self.w[older, k] < 1.0 / frames]
            self.remove(gone, gone * 0 + k)
        for k in range(MAX_MODES - 1, 0, -1):
            c = cells[self.n[cells] > k]
            c = c[(self.m[c, k] - self.m[c, k - 1]) ** 2 <= FUSES * (self.s[c, k] + self.s[c, k - 1])]
            w1, w2 = self.w[c, k], self.w[c, k - 1]
            for x in (self.m, self.s):
                x[c, k - 1] = (x[c, k] * w1 + x[c, k - 1] * w2) / (w1 + w2)
            self.w[c, k - 1] = (w1 * w1 + w2 * w2) / (w1 + w2)
            self.remove(c, c * 0 + k)

    def pass_by(self, cells, n: int, history: int = HISTORY) -> None:
        """Frame n (1, 2, ...) has no return in these cells."""
        self._age(cells, cells * 0 - 1, min(n, history))

    def update(self, cells, depth, n: int, history: int = HISTORY):
        """Frame n has these depths in these cells. Which are foreground: new modes and those of little weight. Depths within 1 are passed over.

        A cell's first mode is not spared by the ageing of the frame that brings it: in the first two frames it goes at once.
        """
        import numpy as np

        found = np.zeros(len(cells), bool)
        empty = cells[~(depth > 0)]
        self.pass_by(empty, n, history)
        frames = min(n, history)
        rate = 1.0 / (frames + 1)
        here = np.flatnonzero(depth >= 1)
        c, d = cells[here], depth[here]
        nearest, least, search = np.zeros(len(c), np.int64), np.full(len(c), np.inf), np.ones(len(c), bool)
        for k in range(MAX_MODES):  # as far as they come closer
            search &= self.n[c] > k
            off = (d - self.m[c, k]) ** 2
            search &= off <= least
            nearest[search], least[search] = k, off[search]
        fits = (self.n[c] > 0) & (least < FITS**2 * self.s[c, nearest])
        f, k = c[fits], nearest[fits]
        self.m[f, k] = (1 - rate) * self.m[f, k] + rate * d[fits]
        self.s[f, k] = np.maximum((1 - rate) * self.s[f, k] + rate * least[fits], SIGMA_MIN**2)
        self.w[f, k] = (1 - rate) * self.w[f, k] + rate
        new, place = ~fits, nearest.copy()
        found[here[fits]] = self.w[f, k] < MOTION
        found[here[new]] = True
        full = np.flatnonzero(new & (self.n[c] == MAX_MODES))
        oldest = self.w[c[full]].argmin(axis=1)
        self.remove(c[full], oldest)
        nearest[full] -= nearest[full] > oldest
        b = np.flatnonzero(new)
        born = b[self.n[c[b]] == 0]
        behind = nearest[b] + ~(d[b] > self.m[c[b], nearest[b]])
        place[b] = np.where(self.n[c[b]] == 0, 0, np.minimum(self.n[c[b]], behind))
        self.insert(c[b], place[b])
        self.w[c[b], place[b]], self.m[c[b], place[b]], self.s[c[b], place[b]] = 2 * rate, d[b], SIGMA0**2
        place[born] = -1
        self._age(c, place, frames)
        return found


    def step(self, cells, seen, depth, n: int, history: int = HISTORY):
        """update() for cells that were last looked at in frames `seen` (by cell; set to n): the frames between had no return there."""
        late = cells[(seen[cells] < n - 1) & (self.n[cells] > 0)]
        for k in range(int(seen[late].min()) + 1, n) if len(late) else ():
            self.pass_by(late[seen[late] < k], k, history)
        seen[cells] = n
        return self.update(cells, depth, n, history)


def motion_filter(image: DataFrame, depth: str = "depth", history: int = HISTORY) -> DataFrame:
    """image: frame, r, c, depth (0, null or no row without a return). Adds foreground to the rows of image.

    A task holds the modes of its cells and walks through its rows by frame, all cells of a frame at once; a cell's frames without a row
    age its modes. The count of frames is that of the image.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in image.schema}
    frames = image.select("frame").distinct()  # a row per frame
    numbered = frames.withColumn("__n", F.row_number().over(Window.orderBy("frame")))
    rows = image.select("frame", "r", "c", F.col(depth).alias("__d")).join(numbered, "frame").repartition("r", "c").sortWithinPartitions("__n", "r", "c")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        cells: dict[tuple[int, int], int] = {}
        state, seen = Mixtures(0), np.zeros(0, np.int64)
        for pdf in batches:
            at = np.array([cells.setdefault(k, len(cells)) for k in zip(pdf["r"], pdf["c"], strict=True)], np.int64)
            more = len(cells) - len(seen)
            if more:
                grown = Mixtures(len(cells))
                for name in ("n", "w", "m", "s"):
                    getattr(grown, name)[: len(seen)] = getattr(state, name)
                state, seen = grown, np.concatenate([seen, np.full(more, np.iinfo(np.int64).max)])
            n, d, out = pdf["__n"].to_numpy(), pdf["__d"].to_numpy(float, na_value=0.0), np.zeros(len(pdf), bool)
            cuts = np.flatnonzero(np.append(True, n[1:] != n[:-1])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True):
                out[a:b] = state.step(at[a:b], seen, d[a:b], int(n[a]), history)
            yield pd.DataFrame({"frame": pdf["frame"], "r": pdf["r"], "c": pdf["c"], depth: pdf["__d"], "foreground": out})

    return rows.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in ("frame", "r", "c", depth)) + ", foreground boolean")


def motion_denoise(cells: DataFrame, radius: int = 1, tolerance: float = 0.5, threshold: int = 2, depth: str = "depth") -> DataFrame:
    """cells: frame, r, c, depth, foreground. Foreground cells with at least threshold foreground neighbours of about their depth."""
    fg = cells.where("foreground").select("frame", "r", "c", F.col(depth).alias("d"))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i or j])
    near = fg.select("frame", (F.col("r")).alias("r0"), (F.col("c")).alias("c0"), "d", F.explode(shifts).alias("s")).select("frame", "r0", "c0", F.col("d").alias("d0"), (F.col("r0") + F.col("s.i")).alias("r"), (F.col("c0") + F.col("s.j")).alias("c"))
    n = near.join(fg, ["frame", "r", "c"]).where(F.abs(F.col("d") - F.col("d0")) <= tolerance).groupBy("frame", F.col("r0").alias("r"), F.col("c0").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= threshold)
