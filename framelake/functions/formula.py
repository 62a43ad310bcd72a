"""Formulas as SQL text: the language's own functions as temporary SQL functions, and user functions added by name.

Catalyst inlines a SQL function, so a formula is one expression of built-in functions.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Arguments (doubles) and body.
FUNCTIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "sinc": (("x",), "CASE WHEN x = 0 THEN 1D ELSE sin(x) / x END"),
    "gexp": (("x",), "exp(-x * x / 2)"),
    "lwrap": (("a",), "pmod(a, 2 * pi())"),
    "shortdist": (("a", "b"), "pi() - ((pi() - (b - a)) - 2 * pi() * floor((pi() - (b - a)) / (2 * pi())))"),
    "fdim": (("a", "b"), "greatest(a - b, 0D)"),
    "fma": (("x", "y", "z"), "x * y + z"),
    "copysign": (("x", "y"), "abs(x) * CASE WHEN y < 0 THEN -1 ELSE 1 END"),
    "exp2": (("x",), "pow(2D, x)"),
    "bgr2gray": (("b", "g", "r"), "0.114D * b + 0.587D * g + 0.299D * r"),
    "rand": (("u", "lo", "hi"), "lo + (hi - lo) * u"),
    "noise": (("u", "w", "m", "s"), "m + s * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * w)"),
    "choose": (("c", "a", "b"), "CASE WHEN c <> 0 THEN a ELSE b END"),
}
#: Functions that first take so many random numbers of the row, which formula() puts in.
DRAWS = {"rand": 1, "noise": 2}
_NAME = re.compile(r"[a-z_]\w*", re.IGNORECASE)
_PREFIX = "fl_"


def add_function(name: str, args: tuple[str, ...], body: str) -> None:
    """A user function of doubles, by name, in any case."""
    if not all(_NAME.fullmatch(x) for x in (name, *args)):
        raise ValueError("names are letters, digits and underscores")
    FUNCTIONS[name.lower()] = (args, body)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, with a prefix so that built-in ones stay as they are."""
    for name, (args, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_PREFIX}{name}({', '.join(f'{a} DOUBLE' for a in args)}) RETURNS DOUBLE RETURN {body}")


def _uniform(seed: int, call: int, keys: Sequence[str]) -> str:
    """A number in [0, 1) that hangs on the row's keys alone: tasks that run again, and other partitions, give the same."""
    return f"(pmod(xxhash64({seed}, {call}{''.join(f', `{k}`' for k in keys)}), 9007199254740992L) / 9007199254740992D)"


def formula(df: DataFrame, text: str, out: str, seed: int = 0, keys: Sequence[str] | None = None) -> DataFrame:
    """df with the value of a formula over its columns; the language's functions by their own names.

    rand and noise draw by seed, place in the formula and keys (without keys: all columns that can be hashed, so equal rows draw alike).
    """
    register(df.sparkSession)
    own = list(keys) if keys is not None else [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    drawn = itertools.count()

    def call(m: re.Match) -> str:
        name = m[1].lower()
        if name not in FUNCTIONS:
            return m[0]
        return f"{_PREFIX}{name}(" + "".join(f"{_uniform(seed, next(drawn), own)}, " for _ in range(DRAWS.get(name, 0)))

    calls = re.sub(r"\b([a-z_]\w*)\s*\(", call, text, flags=re.IGNORECASE)
    return df.selectExpr("*", f"{calls} AS {out}")
