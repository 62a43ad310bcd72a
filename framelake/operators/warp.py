"""Curved transforms of matched points by normal equations: one aggregate per pass, rejection of what lies far off until nothing does."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.sources.storage import cut

#: Terms of a transform, in the order of its coefficients: x, y, 1, x * y, and for the second x * x, y * y.
TERMS = {"semi_quadratic": 4, "quadratic": 6}
#: Terms of length one depend on each other if an eigenvalue of their products is below this.
FLAT = 1e-9
#: A fit to fewer pairs than this isn't tried again after a rejection.
LEAST = 6


def _basis(size: int) -> list[Column]:
    x, y = F.col("__x"), F.col("__y")
    return [x, y, F.lit(1.0), x * y, x * x, y * y][:size]


_BOTH = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("u", "v")])


@F.pandas_udf(_BOTH)
def _solved(products: pd.Series, right: pd.Series) -> pd.DataFrame:
    """The solution of each row's normal equations (the upper triangle, and the products with both targets); null if terms depend on each other."""
    out = []
    for m, t in zip(products, right, strict=True):
        t = np.asarray(t, float).reshape(2, -1)
        size = t.shape[1]
        a = np.zeros((size, size))
        a[np.triu_indices(size)] = m
        a = a + np.triu(a, 1).T
        length = np.sqrt(np.diag(a))
        unit = a / np.outer(length, length) if length.all() else np.zeros_like(a)
        fine = np.linalg.eigvalsh(unit)[0] > FLAT
        out.append([(row / length).tolist() for row in np.linalg.solve(unit, (t / length).T).T] if fine else [None, None])
    return pd.DataFrame(out, columns=["u", "v"], dtype=object)


def _fit(points: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """by, n, fit (the coefficients of both targets, and the mean squared error per coordinate)."""
    terms, u, v = _basis(size), F.col("__u"), F.col("__v")
    sums = {f"__m{i}{j}": terms[i] * terms[j] for i in range(size) for j in range(i, size)}
    right = {f"__t{i}{c}": terms[i] * x for c, x in (("u", u), ("v", v)) for i in range(size)}
    s = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(u * u + v * v).alias("__uu"), *(F.sum(x).alias(k) for k, x in (sums | right).items()))
    s = s.select(*by, "n", "__uu", F.array(*sums).alias("__m"), F.array(*right).alias("__t")).withColumn("c", _solved("__m", "__t")).where(F.col("c.u").isNotNull())
    explained = F.aggregate(F.zip_with(F.concat("c.u", "c.v"), "__t", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    error = F.greatest(F.col("__uu") - explained, F.lit(0.0)) / (2 * F.col("n"))
    return s.select(*by, "n", F.struct("c.u", "c.v", error.alias("error")).alias("fit"))


def _near(fit: Column, size: int, factor: float) -> Column:
    off = {u: sum((fit[u][i] * t for i, t in enumerate(_basis(size))), F.lit(0.0)) - F.col(f"__{u}") for u in ("u", "v")}
    return off["u"] * off["u"] + off["v"] * off["v"] <= factor * factor * fit["error"] + 1e-18


def estimate_warp(pairs: DataFrame, kind: str = "quadratic", by: Sequence[str] = ("frame",), factor: float = 3.0, passes: int = 32) -> DataFrame:
    """pairs: by, x0, y0, x1, y1. Per group n (pairs of the last fit) and a00 ... a03 or a05 for x1, a10 ... for y1, over x, y, 1, x * y (, x * x, y * y).

    After each fit, pairs farther off than `factor` root mean squared errors go, until none does, fewer than six would be
    left, or after `passes` fits. Coordinates are centred and scaled per group, since sums of fourth powers of pixels would
    lose the digits that matter. A pass is one partial aggregate over the pairs; what it leaves is one row per group, written as a
    table. Pairs with a null or non-finite coordinate don't count. Groups whose points don't determine the transform (too few, in one line or curve) have no row.
    """
    size, by, xy = TERMS[kind], list(by), ("x0", "y0", "x1", "y1")
    d = pairs.select(*by, *(F.col(c).cast("double").alias(c) for c in xy))
    finite = F.lit(True)
    for c in xy:
        finite = finite & F.coalesce(F.abs(c) < float("inf"), F.lit(False))  # NaN is above all numbers
    d = d.where(finite)
    spread = lambda a, b: F.sqrt(F.var_pop(a) + F.var_pop(b))
    frame = d.groupBy(*by).agg(*(F.avg(c).alias(f"__{c}") for c in xy), spread("x0", "y0").alias("__s"), spread("x1", "y1").alias("__r")).where("__s > 0")
    groups = frame.withColumns({"__r": F.when(F.col("__r") > 0, F.col("__r")).otherwise(1.0), "h": F.array().cast(_history()), "n": F.lit(0).cast("long"), "open": F.lit(True)})
    groups = cut(groups, "warp")
    for _ in range(passes):
        at = d.join(groups.where("open"), by)
        at = at.select(*by, "h", *((F.col(c) - F.col(f"__{c}")).alias(c) for c in xy), "__s", "__r")
        at = at.select(*by, "h", (F.col("x0") / F.col("__s")).alias("__x"), (F.col("y0") / F.col("__s")).alias("__y"), (F.col("x1") / F.col("__r")).alias("__u"), (F.col("y1") / F.col("__r")).alias("__v"))
        fits = _fit(at.where(F.forall("h", lambda f: _near(f, size, factor))), size, by).withColumnRenamed("n", "__n")
        more = F.col("open") & F.col("__n").isNotNull() & (F.col("__n") != F.col("n")) & ((F.col("n") == 0) | (F.col("__n") >= LEAST))
        step = groups.join(fits, by, "left").withColumn("open", F.coalesce(more, F.lit(False)))
        step = step.withColumns({"h": F.when(F.col("open"), F.concat("h", F.array("fit"))).otherwise(F.col("h")), "n": F.when(F.col("open"), F.col("__n")).otherwise(F.col("n"))})
        groups = cut(step.drop("fit", "__n"), "warp")
        if groups.where("open").isEmpty():
            break
    out = groups.where(F.size("h") > 0).withColumn("f", F.element_at("h", -1))
    p, mx, my = 1 / F.col("__s"), F.col("__x0"), F.col("__y0")
    columns = []
    for k, (u, middle) in enumerate((("u", "__x1"), ("v", "__y1"))):
        c = [F.col("f")[u][i] * F.col("__r") for i in range(size)]
        cx, cy, one, cxy, cxx, cyy = (*c, *[F.lit(0.0)] * (6 - size))
        cx, cy, cxy, cxx, cyy = cx * p, cy * p, cxy * p * p, cxx * p * p, cyy * p * p
        whole = [cx - cxy * my - 2 * cxx * mx, cy - cxy * mx - 2 * cyy * my, F.col(middle) + one - cx * mx - cy * my + cxy * mx * my + cxx * mx * mx + cyy * my * my, cxy, cxx, cyy]
        columns += [x.alias(f"a{k}{i}") for i, x in enumerate(whole[:size])]
    return out.select(*by, "n", *columns)


def _history() -> str:
    return "array<struct<u: array<double>, v: array<double>, error: double>>"
