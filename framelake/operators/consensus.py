"""Fits of transforms to matched points of which many are wrong: seeded minimal samples, counted support, a fit to the best sample's inliers."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.match import estimate_affine, estimate_similarity

#: Points of a minimal sample.
NEEDS = {"similarity": 2, "affine": 3}
TRIALS, POOL = 64, 48
TERMS = ("a00", "a01", "a02", "a10", "a11", "a12")


def sampled(size: int, trials: int = TRIALS, pool: int = POOL, seed: int = 1) -> list[list[int]]:
    """Places (from 0) of the samples in a pool; the same for a seed."""
    rng = random.Random(seed)
    return [rng.sample(range(pool), size) for _ in range(trials)]


def _through(kind: str, p: Sequence[Column]) -> list[Column]:
    """The transform through a minimal sample; null if its points don't span one."""
    x, y, u, v = ([q[n].cast("double") for q in p] for n in ("x0", "y0", "x1", "y1"))
    dx, dy, du, dv = ([c[k] - c[0] for k in range(1, len(p))] for c in (x, y, u, v))
    if kind == "similarity":
        size = F.nullif(dx[0] * dx[0] + dy[0] * dy[0], F.lit(0.0))
        a, b = (dx[0] * du[0] + dy[0] * dv[0]) / size, (dx[0] * dv[0] - dy[0] * du[0]) / size
        m = [[a, -b], [b, a]]
    else:
        det = F.nullif(dx[0] * dy[1] - dx[1] * dy[0], F.lit(0.0))
        m = [[(d[0] * dy[1] - d[1] * dy[0]) / det, (d[1] * dx[0] - d[0] * dx[1]) / det] for d in (du, dv)]
    return [m[0][0], m[0][1], u[0] - m[0][0] * x[0] - m[0][1] * y[0], m[1][0], m[1][1], v[0] - m[1][0] * x[0] - m[1][1] * y[0]]


def _off(m: Column) -> Column:
    """The squared distance of a pair's second point from where the transform puts its first."""
    du = m["a00"] * F.col("x0") + m["a01"] * F.col("y0") + m["a02"] - F.col("x1")
    dv = m["a10"] * F.col("x0") + m["a11"] * F.col("y0") + m["a12"] - F.col("y1")
    return du * du + dv * dv


def inliers(pairs: DataFrame, kind: str, order: Sequence[Column | str], by: Sequence[str] = ("frame",), threshold: float = 3.0, trials: int = TRIALS, pool: int = POOL, seed: int = 1) -> DataFrame:
    """pairs: by, x0, y0, x1, y1. The pairs of each group within threshold of the transform of `kind` that most pairs agree with.

    Each group's first `pool` pairs by `order` (a hash, say) are what samples are drawn from; all pairs are counted, in one
    aggregate over (group, trial). Of equal counts the smaller sum of squares wins, then the earlier trial. A group too small
    for any sample has no inliers.
    """
    by, points = list(by), ("x0", "y0", "x1", "y1")
    held = pairs.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= pool)
    pools = held.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__r", *points))).alias("p"))
    places = F.array(*(F.array(*map(F.lit, t)) for t in sampled(NEEDS[kind], trials, pool, seed)))
    drawn = pools.select(*by, "p", F.posexplode(places).alias("trial", "at")).select(*by, "trial", *(F.get("p", F.get("at", k)).alias(f"p{k}") for k in range(NEEDS[kind])))
    terms = _through(kind, [F.col(f"p{k}") for k in range(NEEDS[kind])])
    models = drawn.select(*by, "trial", *(t.alias(n) for t, n in zip(terms, TERMS, strict=True)))
    spans = F.when(F.col("a00").isNotNull() & F.col("a12").isNotNull(), F.struct("trial", *TERMS))
    every = models.groupBy(*by).agg(F.collect_list(spans).alias("__models"))  # `trials` of them at most
    each = pairs.join(every, by).withColumn("__m", F.explode("__models")).withColumn("__off", _off(F.col("__m"))).where(F.col("__off") <= threshold * threshold)
    score = each.groupBy(*by, F.col("__m.trial").alias("trial")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("__off"), 6).alias("off"))
    best = score.groupBy(*by).agg(F.max_by("trial", F.struct("n", -F.col("off"), -F.col("trial"))).alias("__best"))
    chosen = every.join(best, by).select(*by, F.get(F.filter("__models", lambda m: m["trial"] == F.col("__best")), 0).alias("__m"))
    return pairs.join(chosen, by).where(_off(F.col("__m")) <= threshold * threshold).drop("__m")


def consensus_similarity(pairs: DataFrame, order: Sequence[Column | str], by: Sequence[str] = ("frame",), **options) -> DataFrame:
    """scale, angle, tx, ty of the least-squares similarity of the inliers."""
    return estimate_similarity(inliers(pairs, "similarity", order, by, **options), by)


def consensus_affine(pairs: DataFrame, order: Sequence[Column | str], by: Sequence[str] = ("frame",), **options) -> DataFrame:
    """a00 ... a12 of the least-squares affine transform of the inliers."""
    return estimate_affine(inliers(pairs, "affine", order, by, **options), by)
