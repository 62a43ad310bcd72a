"""Matching of descriptors, points and triangles; fits of transforms to matched points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.nearest import VoronoiIndex, hamming_nearest, l1_nearest
from framelake.sources.storage import cut


def match_l1(query: DataFrame, train: DataFrame, max_dist: float = 0.5, vec: str = "desc_vec", digits: int = 9) -> DataFrame:
    """q, t, dist: the nearest train rows within max_dist of every query of the stated set; equally near ones too."""
    found = l1_nearest(query, train, max_dist, vec, digits)
    near = found.select("q", "t", F.round("dist", digits).alias("dist")).where(F.col("dist") <= max_dist)
    return near.withColumn("__r", F.rank().over(Window.partitionBy("q").orderBy("dist"))).where("__r = 1").drop("__r")


def sign_bits(vec: str) -> Column:
    """Bit i is set if component i is above 0 (64 components at most)."""
    return F.aggregate(F.transform(vec, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def match_hamming(query: DataFrame, train: DataFrame, max_dist: int = 4, bits: str = "bits", tie: Sequence[str] = (), max_octaves: int | None = None) -> DataFrame:
    """q, t, dist: the nearest by differing bits among rows within max_dist (and max_octaves); ties by `tie` columns' differences, then the smaller t."""
    found = hamming_nearest(query, train, max_dist, bits, tuple(tie), max_octaves)
    return found.select("q", F.col("best.t").alias("t"), F.col("best.dist").alias("dist"))


def match_knn_ratio(query: DataFrame, train: DataFrame, ratio: float | None = 0.8, vec: str = "desc_vec", digits: int = 9) -> DataFrame:
    """q, t, dist of the exact nearest neighbour of every query of the stated set, kept if dist < ratio * that of the second."""
    near = VoronoiIndex(train, vec).nearest(query, vec, 1 if ratio is None else 2, digits)
    if ratio is not None:
        near = near.withColumn("__next", F.lead("d2").over(Window.partitionBy("q").orderBy("r")))
        near = near.where(F.col("__next").isNull() | (F.sqrt("d2") < ratio * F.sqrt("__next")))
    return near.where("r = 1").select("q", "t", F.sqrt("d2").alias("dist"))


def triangle_descriptors(kp: DataFrame, min_side: float = 1.0) -> DataFrame:
    """kp: the top points of each frame (few). frame, i, j, k (ordered by the opposite side, longest first), u = b/a, w = c/a for a > b > c; isosceles triangles are left out."""
    a, b, c = (kp.select("frame", F.col("kp").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for n in ("p", "q", "r"))
    t = a.join(b, "frame").where("p < q").join(c, "frame").where("q < r")
    side = lambda m, n: (F.col(f"x{m}") - F.col(f"x{n}")) * (F.col(f"x{m}") - F.col(f"x{n}")) + (F.col(f"y{m}") - F.col(f"y{n}")) * (F.col(f"y{m}") - F.col(f"y{n}"))
    sides = F.sort_array(F.array(F.struct(side("q", "r").alias("s"), F.col("p").alias("v")), F.struct(side("p", "r").alias("s"), F.col("q").alias("v")), F.struct(side("p", "q").alias("s"), F.col("r").alias("v"))), asc=False)
    t = t.select("frame", sides.alias("s"))
    s = [F.col("s")[n]["s"] for n in range(3)]
    t = t.where((s[0] > s[1]) & (s[1] > s[2]) & (s[2] >= min_side * min_side))
    return t.select("frame", *(F.col("s")[n]["v"].alias(v) for n, v in enumerate("ijk")), F.sqrt(s[1] / s[0]).alias("u"), F.sqrt(s[2] / s[0]).alias("w"))


def match_triangles(a: DataFrame, b: DataFrame, eps: float = 0.005) -> DataFrame:
    """a, b: triangle_descriptors() of two frames. p, q, votes: vertex pairs by votes of triangles within eps, best for p and alone the best for q."""
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    around = F.explode(F.array(*[F.struct((cell("u") + du).alias("cu"), (cell("w") + dw).alias("cw")) for du in (-1, 0, 1) for dw in (-1, 0, 1)]))
    left = a.select("i", "j", "k", "u", "w", around.alias("z")).select(*(F.col(c).alias(f"a{c}") for c in ("i", "j", "k", "u", "w")), "z.cu", "z.cw")
    right = b.select(*(F.col(c).alias(f"b{c}") for c in ("i", "j", "k", "u", "w")), cell("u").alias("cu"), cell("w").alias("cw"))
    du, dw = F.col("au") - F.col("bu"), F.col("aw") - F.col("bw")
    pairs = left.join(right, ["cu", "cw"]).where(du * du + dw * dw <= eps * eps).select(F.explode(F.array(*[F.struct(F.col(f"a{c}").alias("p"), F.col(f"b{c}").alias("q")) for c in "ijk"])).alias("z")).select("z.*")
    votes = pairs.groupBy("p", "q").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.withColumn("__r", F.row_number().over(Window.partitionBy("p").orderBy(F.col("votes").desc(), "q"))).withColumn("__m", F.max("votes").over(Window.partitionBy("q")))
    best = best.withColumn("__n", F.count_if(F.col("votes") == F.col("__m")).over(Window.partitionBy("q")))
    return best.where("__r = 1 AND votes = __m AND __n = 1").select("p", "q", "votes")


def match_single(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: frame, kp, one row per frame: the one point of a frame with that of the other set."""
    return a.select("frame", F.col("kp").alias("q")).join(b.select("frame", F.col("kp").alias("t")), "frame")


def matched_positions(matches: DataFrame, query: DataFrame, train: DataFrame) -> DataFrame:
    """matches: q, t. With x and y of both."""
    j = matches.join(query.select(F.col("kp").alias("q"), F.col("x").alias("x0"), F.col("y").alias("y0")), "q")
    return j.join(train.select(F.col("kp").alias("t"), F.col("x").alias("x1"), F.col("y").alias("y1")), "t")


def unmatched(points: DataFrame, matches: DataFrame, key: str = "q", id_col: str = "id") -> DataFrame:
    return points.join(matches.select(F.col(key).alias(id_col)), id_col, "left_anti")


def matched(points: DataFrame, matches: DataFrame, key: str = "q", id_col: str = "id") -> DataFrame:
    return points.join(matches.select(F.col(key).alias(id_col)), id_col, "left_semi")


def nearest_point(points: DataFrame, queries: DataFrame, cell: float, by: str = "frame", held: int = 8) -> DataFrame:
    """queries: by, qid, x, y. The closest point of the frame within one cell of the grid around: qid, pid, dist.

    Grids are halved until the fullest of their cells holds some `held` points. A query looks into the nine cells around it in the finest grid; what it
    finds within one of its cells is nearest, else it goes on to the next coarser grid. So a query meets few points however dense they are.
    """
    at = lambda c, side: F.floor(F.col(c) / side).cast("long")
    # Of points in one place the smallest pid counts.
    p = points.where(f"{by} IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").groupBy(by, "x", "y").agg(F.min("pid").alias("pid")).transform(lambda d: cut(d, "places"))
    going = queries.select(by, "qid", F.col("x").alias("qx"), F.col("y").alias("qy"))
    most = p.groupBy(by, at("x", cell), at("y", cell)).count().agg(F.max("count")).first()[0] or 0
    square = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    ended, levels = None, max(0, math.ceil(math.log(max(most, 1) / held, 4)))
    for level in range(levels, -1, -1):
        side = cell / 2**level
        around = F.explode(F.array(*[F.struct((at("qx", side) + i).alias("gx"), (at("qy", side) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        asked = going.withColumn("z", around).select(by, "qid", "qx", "qy", "z.*")
        j = asked.join(p.select(by, "pid", "x", "y", at("x", side).alias("gx"), at("y", side).alias("gy")), [by, "gx", "gy"]).withColumn("d2", square.cast("double"))
        found = j.where(F.sqrt("d2") <= side).groupBy(by, "qid").agg(F.min(F.struct("d2", "pid")).alias("b")).select(by, "qid", "b.pid", F.sqrt("b.d2").alias("dist"))
        if level:
            found = cut(found, "nearest")
            going = cut(going.join(found.select(by, "qid"), [by, "qid"], "left_anti"), "going")
        ended = found if ended is None else ended.unionByName(found)
        if level and going.isEmpty():
            break
    return ended


# Fits


def estimate_translation(pairs: DataFrame, by: Sequence[str] = ("frame",), factor: float = 3.0, passes: int = 3) -> DataFrame:
    """pairs: by, x0, y0, x1, y1. dx, dy: means after `passes` rejections of what is farther than factor deviations."""
    d = pairs.select(*by, (F.col("x1") - F.col("x0")).cast("double").alias("dx"), (F.col("y1") - F.col("y0")).cast("double").alias("dy"))
    w = Window.partitionBy(*by)
    for _ in range(passes):
        d = d.withColumns({f"__{f.__name__}_{c}": f(c).over(w) for c in ("dx", "dy") for f in (F.avg, F.stddev_pop)})
        near = lambda c: F.abs(F.col(c) - F.col(f"__avg_{c}")) <= factor * F.col(f"__stddev_pop_{c}") + 1e-9
        d = d.where(near("dx") & near("dy")).select(*by, "dx", "dy")
    return d.groupBy(*by).agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.count(F.lit(1)).alias("n"))


def estimate_similarity(pairs: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """scale, angle, tx, ty of the least-squares similarity (Umeyama's closed form in the plane)."""
    c = lambda a, b: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double"))
    s = pairs.groupBy(*by).agg((c("x0", "x0") + c("y0", "y0")).alias("v"), (c("x0", "x1") + c("y0", "y1")).alias("p"), (c("x0", "y1") - c("y0", "x1")).alias("q"), *(F.avg(F.col(k).cast("double")).alias(k) for k in ("x0", "y0", "x1", "y1")))
    s = s.where("v > 0").withColumns({"a": F.col("p") / F.col("v"), "b": F.col("q") / F.col("v")})
    return s.select(*by, F.hypot("a", "b").alias("scale"), F.atan2("b", "a").alias("angle"), (F.col("x1") - F.col("a") * F.col("x0") + F.col("b") * F.col("y0")).alias("tx"), (F.col("y1") - F.col("b") * F.col("x0") - F.col("a") * F.col("y0")).alias("ty"))


def estimate_affine(pairs: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """a00, a01, a02, a10, a11, a12 of the least-squares affine transform."""
    c = lambda a, b: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double"))
    s = pairs.groupBy(*by).agg(c("x0", "x0").alias("xx"), c("x0", "y0").alias("xy"), c("y0", "y0").alias("yy"), *(c(a, b).alias(f"{a}{b}") for a in ("x0", "y0") for b in ("x1", "y1")), *(F.avg(F.col(k).cast("double")).alias(k) for k in ("x0", "y0", "x1", "y1")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumn("__det", det).where("__det <> 0")
    for r, o in ((0, "x1"), (1, "y1")):
        s = s.withColumn(f"a{r}0", (F.col(f"x0{o}") * F.col("yy") - F.col(f"y0{o}") * F.col("xy")) / F.col("__det")).withColumn(f"a{r}1", (F.col(f"y0{o}") * F.col("xx") - F.col(f"x0{o}") * F.col("xy")) / F.col("__det"))
        s = s.withColumn(f"a{r}2", F.col(o) - F.col(f"a{r}0") * F.col("x0") - F.col(f"a{r}1") * F.col("y0"))
    return s.select(*by, "a00", "a01", "a02", "a10", "a11", "a12")
