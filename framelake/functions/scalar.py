"""Column functions of the formula language, and the registry that formulas draw on."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

C = Column | str


def col(x: C | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def trunc(x: C) -> Column:
    return F.signum(col(x)) * F.floor(F.abs(col(x)))


def round_half_away(x: C) -> Column:
    return F.signum(col(x)) * F.floor(F.abs(col(x)) + 0.5)


def fmod(a: C, b: C) -> Column:
    return F.try_mod(col(a).cast("double"), col(b).cast("double"))


def remainder(a: C, b: C) -> Column:
    return col(a) - col(b) * F.rint(col(a) / col(b))


def exp2(x: C) -> Column:
    return F.pow(F.lit(2.0), col(x))


def fdim(a: C, b: C) -> Column:
    return F.greatest(col(a) - col(b), F.lit(0.0))


def fma(x: C, y: C, z: C) -> Column:
    return col(x) * col(y) + col(z)


def fmax(a: C, b: C) -> Column:
    """The larger; a NaN loses against a number."""
    return F.greatest(F.nanvl(col(a).cast("double"), col(b).cast("double")), F.nanvl(col(b).cast("double"), col(a).cast("double")))


def fmin(a: C, b: C) -> Column:
    return F.least(F.nanvl(col(a).cast("double"), col(b).cast("double")), F.nanvl(col(b).cast("double"), col(a).cast("double")))


def copysign(x: C, y: C) -> Column:
    return F.abs(col(x)) * F.when(col(y) < 0, -1).otherwise(1)


def sinc(x: C) -> Column:
    return F.when(col(x) == 0, 1.0).otherwise(F.sin(col(x)) / col(x))


def gexp(x: C) -> Column:
    return F.exp(-col(x) * col(x) / 2)


def logb(x: C) -> Column:
    return F.floor(F.log2(F.abs(col(x))))


def significand(x: C) -> Column:
    return col(x) / F.pow(F.lit(2.0), logb(x))


def as_bits(x: C) -> Column:
    """The operand of bit operations: an unsigned 32-bit number."""
    return trunc(x).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def bit_and(a: C, b: C) -> Column:
    return as_bits(a).bitwiseAND(as_bits(b)).cast("double")


def bit_or(a: C, b: C) -> Column:
    return as_bits(a).bitwiseOR(as_bits(b)).cast("double")


def bit_xor(a: C, b: C) -> Column:
    return as_bits(a).bitwiseXOR(as_bits(b)).cast("double")


def shift_left(a: C, n: int) -> Column:
    return F.shiftleft(as_bits(a), n).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")


def shift_right(a: C, n: int) -> Column:
    return F.shiftright(as_bits(a), n).cast("double")


def integer_mod(a: C, b: C) -> Column:
    return F.when(as_bits(b) != 0, as_bits(a) % as_bits(b)).cast("double")


def truth(x: Column) -> Column:
    """A condition as 0 or 1."""
    return x.cast("double")


def wrap_0_2pi(a: C) -> Column:
    return F.pmod(col(a), F.lit(2 * math.pi))


def wrap_pi(a: C) -> Column:
    """Into (-pi, pi], by whole turns as the SQL counts them: a remainder sends half turns that are off by a last digit the other way."""
    x = F.lit(math.pi) - col(a)
    return F.lit(math.pi) - (x - 2 * math.pi * F.floor(x / (2 * math.pi)))


def same_turn(a: C, near: C) -> Column:
    """The angle by whole turns nearest to another one."""
    return col(a) + 2 * math.pi * F.round((col(near) - col(a)) / (2 * math.pi))


def short_angle(a: C, b: C) -> Column:
    """The shortest way from a to b, in (-pi, pi]."""
    return wrap_pi(col(b) - col(a))


def angle_between(a: C, b: C, t: C) -> Column:
    """The angle at share t of the shortest way from a to b."""
    return wrap_pi(col(a) + short_angle(a, b) * col(t))


def linint(x: C, x0: C, x1: C, y0: C, y1: C) -> Column:
    return col(y0) + (col(x) - col(x0)) * (col(y1) - col(y0)) / (col(x1) - col(x0))


def _aitoff(lon: C, lat: C) -> Column:
    return sinc(F.acos(F.cos(col(lat)) * F.cos(col(lon) / 2)))


def aitoff_x(lon: C, lat: C) -> Column:
    return 2 * F.cos(col(lat)) * F.sin(col(lon) / 2) / _aitoff(lon, lat)


def aitoff_y(lon: C, lat: C) -> Column:
    return F.sin(col(lat)) / _aitoff(lon, lat)


def fractional_year(y: C, m: C, d: C) -> Column:
    """The year with the share of it that is over at the start of the day; 0 if there is no such day."""
    date = F.try_make_timestamp(col(y).cast("int"), col(m).cast("int"), col(d).cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    leap = ((col(y) % 4 == 0) & (col(y) % 100 != 0)) | (col(y) % 400 == 0)
    return F.coalesce(col(y) + (F.dayofyear(date) - 1) / F.when(leap, 366.0).otherwise(365.0), F.lit(0.0))


def poly(x: C, *coefficients: float) -> Column:
    """c1 + c2 x + c3 x^2 + ..., by Horner's rule."""
    return reduce(lambda acc, c: acc * col(x) + c, reversed(coefficients[:-1]), F.lit(float(coefficients[-1])))


def bgr2gray(b: C, g: C, r: C) -> Column:
    return 0.114 * col(b) + 0.587 * col(g) + 0.299 * col(r)


#: Functions of one column that `pixel_func` may name.
UNARY: dict[str, Callable[[Column], Column]] = {
    "none": lambda x: x, "sqrt": F.sqrt, "sqr": lambda x: x * x, "abs": F.abs, "log": F.ln, "exp": F.exp, "inv": lambda x: F.when(x != 0, 1 / x).otherwise(0.0),
    "sin": F.sin, "cos": F.cos, "asin": F.asin, "acos": F.acos, "asinh": F.asinh, "acosh": F.acosh,
}

#: User functions of formulas by name: a function of columns.
REGISTRY: dict[str, Callable[..., Column]] = {
    f.__name__: f for f in (trunc, fmod, remainder, exp2, fdim, fma, fmax, fmin, copysign, sinc, gexp, logb, significand, wrap_0_2pi, wrap_pi, short_angle, angle_between, linint, aitoff_x, aitoff_y, fractional_year, bgr2gray)
}


def register(name: str):
    """Add a user function to the registry."""

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        REGISTRY[name.lower()] = f
        return f

    return add


def bessel(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bessel functions of the first and second kind of order n (0 or 1): their integrals up to 25, Hankel's expansion beyond.

    The second kind is -infinity at 0 and NaN below. Equal values are computed once, and values by blocks.
    """
    some, back = np.unique(x, return_inverse=True)
    kinds = _bessel(n, some)
    return kinds[0][back], kinds[1][back]


def _bessel(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, first, second = np.abs(x), np.full(len(x), np.nan), np.full(len(x), np.nan)
    nodes, weights = np.polynomial.legendre.leggauss(200)
    nodes, weights = (nodes + 1) / 2, weights / 2
    t = np.pi * nodes
    close = np.flatnonzero(size < 25)
    for b in range(0, len(close), 512):
        k = close[b : b + 512]
        z = size[k, None]
        first[k] = np.cos(n * t - z * np.sin(t)) @ weights
        k = k[size[k] > 0]
        z = size[k, None]
        top = np.arcsinh(745 / z)
        u = top * nodes
        grown = np.exp(n * u)
        tail = (grown + (-1) ** n / grown) * np.exp(-z * np.sinh(u))
        second[k] = np.sin(z * np.sin(t) - n * t) @ weights - top[:, 0] / np.pi * (tail @ weights)
    second[size == 0] = -np.inf
    far = (size >= 25) & np.isfinite(size)
    z, term, even, odd = size[far], np.ones(far.sum()), np.zeros(far.sum()), np.zeros(far.sum())
    for k in range(30):
        part = even if k % 2 == 0 else odd
        part += (-1) ** (k // 2) * term
        term = term * (4 * n * n - (2 * k + 1) ** 2) / ((k + 1) * 8 * z)
    phase, scale = z - n * np.pi / 2 - np.pi / 4, np.sqrt(2 / (np.pi * z))
    first[far] = scale * (even * np.cos(phase) - odd * np.sin(phase))
    second[far] = scale * (even * np.sin(phase) + odd * np.cos(phase))
    first[np.isinf(size)] = second[np.isinf(size)] = 0.0
    return np.where((x < 0) & (n == 1), -first, first), np.where(x < 0, np.nan, second)


def register_special(spark: SparkSession) -> None:
    """erf, erfc, lgamma, tgamma, nextafter and the Bessel functions j0, j1, y0, y1 as SQL functions over Arrow batches."""
    def vector(f):
        return lambda s: pd.Series([float("nan") if x is None or x != x else f(x) for x in s], dtype="float64")

    def of_kind(n, kind):
        return lambda s: pd.Series(bessel(n, s.fillna(float("nan")).to_numpy(float))[kind])

    def tgamma(x):
        return math.gamma(x) if x > 0 or x != math.floor(x) else float("nan")

    def udf(f):
        def special(s: pd.Series) -> pd.Series:
            return f(s)

        return F.pandas_udf(special, "double")

    @F.pandas_udf("double")
    def nextafter(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(x.to_numpy(float), y.to_numpy(float)))

    spark.udf.register("nextafter", nextafter)
    kinds = {f"{name}{n}": of_kind(n, kind) for n in (0, 1) for kind, name in enumerate("jy")}
    for name, f in {"erf": vector(math.erf), "erfc": vector(math.erfc), "lgamma": vector(math.lgamma), "tgamma": vector(tgamma), **kinds}.items():
        spark.udf.register(name, udf(f))
