"""Automatic thresholds from histograms (by, bin, n, minv, maxv). A histogram has a bounded number of bins, so its
rows per key fit one window; what loops does so over an array of bins inside an expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.stack import mean
from framelake.operators.stats import _over, mean_abs_dev


def _value(at: Column, bins: int, half: bool = False) -> Column:
    return F.col("minv") + (at + 0.5 if half else at) * (F.col("maxv") - F.col("minv")) / bins


def _sums(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds share, and running and whole sums of shares (P) and of bin * share (M, MT)."""
    w, run = _over(by), _over(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("share", F.col("n") / F.sum("n").over(w))
    ip = F.col("bin") * F.col("n")
    total = F.sum("n").over(w)
    return h.withColumns({"P": F.sum("n").over(run) / total, "M": F.sum(ip).over(run) / total, "MT": F.sum(ip).over(w) / total})


def _first_best(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """The bin with the largest score, the first of equal ones."""
    return df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.max_by(F.struct("bin", "minv", "maxv"), F.struct(F.col(score), -F.col("bin"))).alias("b")).select(*by, "b.bin", "b.minv", "b.maxv")


def otsu_threshold(hist: DataFrame, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    s = _sums(hist, by)
    diff = F.col("MT") * F.col("P") - F.col("M")
    s = s.withColumn("__s", F.round(F.when((F.col("P") > 0) & (F.col("P") < 1), diff * diff / (F.col("P") * (1 - F.col("P")))), 9))
    return _first_best(s, by, "__s").select(*by, "bin", _value(F.col("bin"), bins).alias("threshold"))


def _arrays(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """h: counts by bin, and the range: one row per key."""
    return hist.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"].cast("double")).alias("h"), F.first("minv").alias("minv"), F.first("maxv").alias("maxv"))


def _pairs(h: Column) -> Column:
    return F.transform(h, lambda n, i: F.struct(i.cast("double").alias("i"), n.alias("n")))


def isodata_threshold(hist: DataFrame, by: Sequence[str] = (), bins: int = 256, rounds: int = 64) -> DataFrame:
    """t becomes the middle of the means below and above it until it stays, from the middle of the filled bins."""
    a = _arrays(hist, by).withColumn("s", _pairs(F.col("h")))
    used = F.transform(F.filter("s", lambda x: x["n"] > 0), lambda x: x["i"])

    def part(t: Column, above: bool) -> Column:
        z = F.aggregate("s", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda acc, x: F.when((x["i"] > t) if above else (x["i"] <= t), F.struct((acc["a"] + x["i"] * x["n"]).alias("a"), (acc["b"] + x["n"]).alias("b"))).otherwise(acc))
        return F.when(z["b"] > 0, z["a"] / z["b"]).otherwise(t)

    t = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), (F.array_min(used) + F.array_max(used)) / 2, lambda t, _: (part(t, False) + part(t, True)) / 2)
    return a.select(*by, t.alias("t"), "minv", "maxv").select(*by, F.round("t", 6).alias("bin"), _value(F.col("t"), bins).alias("threshold"))


def triangle_threshold(hist: DataFrame, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """The bin farthest below the chord from the peak to the end of the longer tail."""
    w = _over(by)
    h = hist.withColumns({"__lo": F.min(F.when(F.col("n") > 0, F.col("bin"))).over(w), "__hi": F.max(F.when(F.col("n") > 0, F.col("bin"))).over(w), "__top": F.max(F.struct("n", (-F.col("bin")).alias("b"))).over(w)})
    peak, top = -F.col("__top.b"), F.col("__top.n")
    end = F.when(F.col("__hi") - peak >= peak - F.col("__lo"), F.col("__hi")).otherwise(F.col("__lo"))
    between = F.col("bin").between(F.least(peak, end), F.greatest(peak, end))
    chord = top * F.abs(end - F.col("bin")) / F.greatest(F.abs(end - peak), F.lit(1))
    h = h.withColumn("__s", F.when(between, F.round(chord - F.col("n"), 9)))
    return _first_best(h, by, "__s").select(*by, "bin", _value(F.col("bin"), bins).alias("threshold"))


def moments_threshold(hist: DataFrame, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """Tsai: the share below that keeps the first three moments with two levels."""
    b = F.col("bin").cast("double")
    total = F.sum("n")
    m = hist.groupBy(*by).agg(*(((F.sum(F.pow(b, F.lit(float(k))) * F.col("n"))) / total).alias(f"m{k}") for k in (1, 2, 3)))
    d = F.col("m2") - F.col("m1") * F.col("m1")
    c0 = (F.col("m1") * F.col("m3") - F.col("m2") * F.col("m2")) / d
    c1 = (F.col("m1") * F.col("m2") - F.col("m3")) / d
    root = F.sqrt(F.greatest(c1 * c1 - 4 * c0, F.lit(0.0)))
    z0, z1 = (-c1 - root) / 2, (-c1 + root) / 2
    m = m.where(d > 0).select(*by, F.when(root > 0, (z1 - F.col("m1")) / (z1 - z0)).otherwise(0.5).alias("p0"))
    s = _sums(hist, by)
    j = s.join(m, list(by)) if by else s.crossJoin(F.broadcast(m))  # one row
    first = j.where(F.round("P", 9) > F.round("p0", 9)).groupBy(*by).agg(F.min_by(F.struct("bin", "minv", "maxv"), "bin").alias("b")).select(*by, "b.bin", "b.minv", "b.maxv")
    return first.select(*by, "bin", _value(F.col("bin"), bins).alias("threshold"))


def huang_threshold(hist: DataFrame, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """The bin with the least fuzzy entropy. Bins meet bins of their own histogram only, `bins` squared at most."""
    s = _sums(hist, by).withColumns({"__m0": F.when(F.col("P") > 0, F.col("M") / F.col("P")), "__m1": F.when(F.col("P") < 1, (F.col("MT") - F.col("M")) / (1 - F.col("P")))})
    a = _arrays(hist, by).select(*by, _pairs(F.col("h")).alias("s"), F.array_max(F.transform(F.filter(_pairs(F.col("h")), lambda x: x["n"] > 0), lambda x: x["i"])).alias("hi"), F.array_min(F.transform(F.filter(_pairs(F.col("h")), lambda x: x["n"] > 0), lambda x: x["i"])).alias("lo"))
    j = s.join(a, list(by)) if by else s.crossJoin(F.broadcast(a))  # one row
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))

    def entropy(x: Column) -> Column:
        m = F.coalesce(F.when(x["i"] <= F.col("bin"), F.col("__m0")).otherwise(F.col("__m1")), x["i"])
        u = 1 / (1 + F.abs(x["i"] - m) / span)
        return F.when((u > 1e-9) & (u < 1 - 1e-9), x["n"] * (-u * F.ln(u) - (1 - u) * F.ln(1 - u))).otherwise(0.0)

    j = j.where(F.col("bin").between(F.col("lo"), F.col("hi") - 1)).withColumn("__s", -F.round(F.aggregate("s", F.lit(0.0), lambda acc, x: acc + entropy(x)), 6))
    return _first_best(j, by, "__s").select(*by, "bin", _value(F.col("bin"), bins).alias("threshold"))


def yen_threshold(hist: DataFrame, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    w, run = _over(by), _over(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = _sums(hist, by)
    s = s.withColumns({"__q": F.sum(F.col("share") * F.col("share")).over(run), "__qt": F.sum(F.col("share") * F.col("share")).over(w)})
    rest = F.col("__qt") - F.col("__q")
    ok = (F.col("P") > 0) & (F.col("P") < 1) & (F.col("__q") > 0) & (rest > 1e-15)
    s = s.withColumn("__s", F.when(ok, F.round(2 * F.ln(F.col("P") * (1 - F.col("P"))) - F.ln(F.col("__q") * rest), 9)))
    return _first_best(s, by, "__s").select(*by, "bin", _value(F.col("bin"), bins).alias("threshold"))


def minimum_threshold(hist: DataFrame, by: Sequence[str] = ("frame",), bins: int = 256, rounds: int = 10_000) -> DataFrame:
    """The valley of a histogram smoothed over three bins until it has two peaks; null if it never has."""
    import pandas as pd

    key = hist.select(*by).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key)

    def valley(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("bin")
        h, at = pdf["n"].to_numpy(float), None
        for _ in range(rounds):
            edge = np.pad(h, 1)
            peaks = np.flatnonzero((h > edge[:-2]) & (h > edge[2:]))
            if len(peaks) < 2:
                break
            if len(peaks) == 2:
                at = int(peaks[0] + h[peaks[0] : peaks[1] + 1].argmin())
                break
            near = np.pad(h, 1, mode="edge")
            h = (near[:-2] + h + near[2:]) / 3
        first = pdf.iloc[0]
        t = None if at is None else first["minv"] + at * (first["maxv"] - first["minv"]) / bins
        return pd.DataFrame({**{k: [first[k]] for k in by}, "bin": pd.array([at], dtype="Int32"), "threshold": pd.array([t], dtype="Float64")})

    return hist.groupBy(*by).applyInPandas(valley, f"{fields}, bin int, threshold double")


def mean_threshold(df: DataFrame, by: Sequence[str] = ("frame",), value: str = "v") -> DataFrame:
    return df.groupBy(*by).agg(mean(value).alias("threshold"))


def mean_stdev_threshold(df: DataFrame, scale: float = 1.0, by: Sequence[str] = ("frame",), value: str = "v") -> DataFrame:
    return df.groupBy(*by).agg((mean(value) + scale * F.stddev_pop(F.col(value).cast("double"))).alias("threshold"))


def mean_mad_threshold(df: DataFrame, scale: float = 1.0, by: Sequence[str] = ("frame",), value: str = "v") -> DataFrame:
    return mean_threshold(df, by, value).join(mean_abs_dev(df, by, value), list(by)).select(*by, (F.col("threshold") + scale * F.col("mad")).alias("threshold"))


def noise_threshold(noise: DataFrame, scale: float = 3.0, by: Sequence[str] = ("frame",)) -> DataFrame:
    """noise: by, noise (its sigma)."""
    return noise.select(*by, (scale * F.col("noise")).alias("threshold"))
