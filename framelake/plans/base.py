"""Helpers to register queries over the views."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.plans.catalog import query
from framelake.sources.adapters import Views, with_views


def reg(name: str, views: str | Sequence[str], f: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    """Register f (of the views) as a query, with SQL over the same views."""
    names = views.split() if isinstance(views, str) else views
    query(name, None if sql is None else with_views(sql, *names))(lambda spark, sf_dir: f(Views(spark, sf_dir)))


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, as the last digit of a transcendental differs between engines: half away from zero in doubles, which
    both engines compute alike where F.round goes by the decimal expansion."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = F.abs(x) * 10.0**digits
    whole = F.when(y >= 2.0**52, y).otherwise(F.floor(y + 0.5).cast("double"))
    return F.when(x < 0, -1.0).otherwise(1.0) * whole / 10.0**digits


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """All (or the named) double columns rounded."""
    pick = names or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: r(n, digits) for n in pick}) if pick else df
