"""Least-squares fits per key from sums that add up: partial aggregates, whatever the size of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sums(df: DataFrame, by: Sequence[str], terms: dict[str, Column], needs: Sequence[str], weight: str | None) -> DataFrame:
    """n, sw and the weighted sums of terms; rows with a null in any needed column don't count."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = [F.col(c).isNotNull() for c in (*needs, *([weight] if weight else []))]
    return df.where(_all(known)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), *(F.sum(w * t).alias(k) for k, t in terms.items()))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _double(*names: str) -> list[Column]:
    return [F.col(c).cast("double") for c in names]


def line_fit(df: DataFrame, by: Sequence[str] = ("series",), x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """shift, slope, stdev2 (weighted mean of squared residuals), r2 and n of y = shift + slope * x. A key without two different x has no row."""
    a, b = _double(x, y)
    s = _sums(df, by, {"sx": a, "sy": b, "sxx": a * a, "sxy": a * b, "syy": b * b}, (x, y), weight)
    c = F.col
    s = s.withColumn("det", c("sw") * c("sxx") - c("sx") * c("sx")).where((c("n") > 1) & (c("det") > 0) & (c("sw") > 0))
    s = s.withColumn("slope", (c("sw") * c("sxy") - c("sx") * c("sy")) / c("det")).withColumn("shift", (c("sy") - c("slope") * c("sx")) / c("sw"))
    s = s.withColumns({"rss": c("syy") - c("slope") * c("sxy") - c("shift") * c("sy"), "tss": c("sw") * c("syy") - c("sy") * c("sy")})
    r2 = F.when((c("tss") > 0) & (c("rss") > 0), 1 - c("rss") * c("sw") / c("tss")).otherwise(1.0)
    return s.select(*by, "shift", "slope", (F.greatest("rss", F.lit(0.0)) / c("sw")).alias("stdev2"), r2.alias("r2"), "n")


def slope_fit(df: DataFrame, by: Sequence[str] = ("series",), x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """slope, stdev2 (residuals over the weights' degrees of freedom), r2 and n of y = slope * x."""
    a, b = _double(x, y)
    s = _sums(df, by, {"sxx": a * a, "sxy": a * b, "syy": b * b}, (x, y), weight)
    c = F.col
    s = s.where((c("sxx") > 0) & (c("sw") > 0)).withColumn("slope", c("sxy") / c("sxx"))
    s = s.withColumns({"rss": c("syy") - c("slope") * c("sxy"), "free": c("sw") - c("sww") / c("sw")})
    stdev2 = F.when((c("free") > 0) & (c("rss") > 0), c("rss") / c("free")).otherwise(0.0)
    return s.select(*by, "slope", stdev2.alias("stdev2"), F.when(c("syy") > 0, c("slope") * c("sxy") / c("syy")).otherwise(1.0).alias("r2"), "n")


def two_factor_fit(df: DataFrame, by: Sequence[str] = ("series",), x0: str = "x0", x1: str = "x1", y: str = "y", weight: str | None = None) -> DataFrame:
    """a0, a1 and n of y = a0 * x0 + a1 * x1. A key whose factors are proportional has no row."""
    p, q, b = _double(x0, x1, y)
    s = _sums(df, by, {"pp": p * p, "pq": p * q, "qq": q * q, "pb": p * b, "qb": q * b}, (x0, x1, y), weight)
    c = F.col
    s = s.withColumn("det", c("pp") * c("qq") - c("pq") * c("pq")).where(c("det") != 0)
    return s.select(*by, ((c("qq") * c("pb") - c("pq") * c("qb")) / c("det")).alias("a0"), ((c("pp") * c("qb") - c("pq") * c("pb")) / c("det")).alias("a1"), "n")


def quadratic_fit(df: DataFrame, by: Sequence[str] = ("series",), x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """a0, a1, a2 and n of y = a0 + a1 * x + a2 * x * x. A key without three different x has no row."""
    a, b = _double(x, y)
    powers = {f"s{k}": F.pow(a, F.lit(k)) for k in range(1, 5)} | {"t0": b, "t1": a * b, "t2": a * a * b}
    s = _sums(df, by, powers, (x, y), weight).withColumnRenamed("sw", "s0")
    m = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    t = [F.col(f"t{i}") for i in range(3)]

    def det(rows: list[list[Column]]) -> Column:
        (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = rows
        return a0 * (b1 * c2 - b2 * c1) - a1 * (b0 * c2 - b2 * c0) + a2 * (b0 * c1 - b1 * c0)

    s = s.withColumn("det", det(m)).where(F.abs("det") > 1e-12 * F.col("s0") * F.col("s2") * F.col("s4"))
    solved = [det([[t[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / F.col("det") for k in range(3)]
    return s.select(*by, *(x.alias(f"a{k}") for k, x in enumerate(solved)), "n")
