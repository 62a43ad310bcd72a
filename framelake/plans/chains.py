"""Chains of operators from a JSON list, by name. A step that fails is logged and left out; a name that no step has is an error."""

from __future__ import annotations

import functools
import json
import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import geometry, pixels
from framelake.operators import ordered, select, stack, stats, topk

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}


def step(name: str):
    """Register a step: (df, frames, **parameters) -> df; frames holds what earlier steps have stored."""

    def add(f: Step) -> Step:
        STEPS[name.lower()] = f
        return f

    return add


def run_chain(df: DataFrame, spec: str | list[dict], frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """spec: [{"step": name, "enabled": true, ...parameters}, ...]. Steps that aren't enabled aren't in the plan."""
    steps = json.loads(spec) if isinstance(spec, str) else spec
    frames = {} if frames is None else frames

    def apply(d: DataFrame, s: dict) -> DataFrame:
        run = STEPS[s["step"].lower()]
        try:
            out = run(d, frames, **{k: v for k, v in s.items() if k not in ("step", "enabled")})
            out.schema  # noqa: B018 - what a step's expressions lack shows here
        except (PySparkException, KeyError, TypeError, ValueError) as e:
            logging.getLogger(__name__).warning("step %s is left out: %s", s["step"], e)
            return d
        return out

    return functools.reduce(apply, (s for s in steps if s.get("enabled", True)), df)


@step("push")
def push(df: DataFrame, frames: dict[str, DataFrame], name: str) -> DataFrame:
    frames[name] = df
    return df


@step("pop")
def pop(df: DataFrame, frames: dict[str, DataFrame], name: str) -> DataFrame:
    return frames.pop(name)


@step("clear")
def clear(df: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    frames.clear()
    return df


@step("filter")
def keep(df: DataFrame, frames: dict[str, DataFrame], expr: str) -> DataFrame:
    return df.where(F.expr(expr))


@step("column")
def column(df: DataFrame, frames: dict[str, DataFrame], name: str, expr: str) -> DataFrame:
    return df.withColumn(name, F.expr(expr))


@step("clip")
def clip(df: DataFrame, frames: dict[str, DataFrame], low: float, high: float, value: str = "v") -> DataFrame:
    return df.withColumn(value, pixels.clip(F.col(value).cast("double"), low, high))


@step("average")
def average(df: DataFrame, frames: dict[str, DataFrame], by: list[str], value: str = "v") -> DataFrame:
    return stack.stack_average(df, by, value)


def _on_frames(f: Callable[..., DataFrame]) -> Step:
    """Of an operator on tables. axis ("x" or "y") stands for the window along it, axes for several."""

    def run(df: DataFrame, frames: dict[str, DataFrame], axis: str | None = None, axes: list[str] | None = None, **options) -> DataFrame:
        if axis is not None:
            options["axis" if f is ordered.gradient else "w"] = axis if f is ordered.gradient else ordered.along(axis)
        if axes is not None:
            options["axes"] = tuple(map(ordered.along, axes))
        return f(df, **options)

    return run


def _on_values(f: Callable) -> Step:
    """Of a function of a column: `value` (v) goes in, `out` (the same column unless named) takes what comes out."""

    def run(df: DataFrame, frames: dict[str, DataFrame], value: str = "v", out: str | None = None, **options) -> DataFrame:
        return df.withColumn(out or value, f(F.col(value).cast("double"), **options))

    return run


def _of_channels(f: Callable) -> Step:
    """Of a function of the channels v0, v1, v2 that makes one column (out) or all of them anew."""

    def run(df: DataFrame, frames: dict[str, DataFrame], out: str = "v", channels: list[str] | None = None, **options) -> DataFrame:
        names = tuple(channels or ("v0", "v1", "v2"))
        made = f(**options, channels=names)
        if isinstance(made, list) and len(made) == len(names):
            return df.withColumns(dict(zip(names, made, strict=True)))
        return df.withColumn(out, made[0] if isinstance(made, list) else made)

    return run


@step("threshold")
def threshold(df: DataFrame, frames: dict[str, DataFrame], limit: float, cmp: str = "GT", value: str = "v", out: str = "sel") -> DataFrame:
    return df.withColumn(out, select.threshold(value, limit, cmp))


@step("combine_selection")
def combine(df: DataFrame, frames: dict[str, DataFrame], mode: str, new: str, old: str = "sel") -> DataFrame:
    return df.withColumn(old, select.combine_selection(F.col(old), F.expr(new), mode))


@step("pixel_func")
def pixel_func(df: DataFrame, frames: dict[str, DataFrame], name: str, value: str = "v", out: str | None = None, **options) -> DataFrame:
    return df.withColumn(out or value, pixels.pixel_func(name, value, **options))


@step("math_expression")
def math_expression(df: DataFrame, frames: dict[str, DataFrame], expr: str, out: str = "v", **options) -> DataFrame:
    return df.withColumn(out, pixels.math_expression(expr, **options))


@step("frame_calc")
def frame_calc(df: DataFrame, frames: dict[str, DataFrame], other: str, name: str, **options) -> DataFrame:
    """other: the name of a frame that an earlier step has pushed."""
    return pixels.frame_calc(df, frames[other], name, **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})


@step("merge")
def merge(df: DataFrame, frames: dict[str, DataFrame], other: str) -> DataFrame:
    return df.unionByName(frames[other])


@step("select")
def columns(df: DataFrame, frames: dict[str, DataFrame], exprs: list[str]) -> DataFrame:
    return df.selectExpr(*exprs)


_FRAME_STEPS = (
    ordered.running_average, ordered.neighbourhood_average, ordered.gradient, ordered.laplacian, ordered.hessian_eigen, ordered.harris_response, ordered.ridgeness, ordered.convolve_1d, ordered.lowpass, ordered.unsharp_mask,
    ordered.dog, ordered.highpass, ordered.rolling_median, ordered.median_hat, ordered.median_outlier_replace, ordered.morph, ordered.local_minmax, ordered.local_peak, ordered.local_variance, ordered.interpolate_gaps,
    ordered.interpolate_gaps_2d, ordered.accumulate_rotation, ordered.frame_interval, ordered.dropped_frames, ordered.rank_frames, ordered.noise_map, ordered.noise_sigma, ordered.sharpness_g4, ordered.sharpness_lpg,
    ordered.sharpness_local_contrast, ordered.bad_rows, select.select_pixels, select.drop_parasitic_returns, select.blob_filter, select.clear_mask, select.line_profile, pixels.point_expression, pixels.absdiff_previous,
    pixels.color_saturation, pixels.range_normalize, pixels.normalize_mean_stdev, pixels.flow_to_hsv, geometry.crop, geometry.flip, geometry.transpose, geometry.rotate90, geometry.downstrike, geometry.grid_downsample,
    geometry.range_bin, stack.stack_average, stack.stack_masked_average, stack.stack_weighted_average, stats.frame_stats, stats.weighted_mean, stats.frame_median, stats.mean_abs_dev, stats.normalized_variance,
    stats.sharpness_average, stats.histogram, topk.top_keypoints, topk.largest_component, topk.best_percent,
)
for _f in _FRAME_STEPS:
    STEPS[_f.__name__] = _on_frames(_f)
for _f in (pixels.saturate, pixels.convert_depth, pixels.to_unit_float, pixels.mtf, pixels.anscombe, pixels.anscombe_inverse, pixels.pow_gamma, pixels.log_curve):
    STEPS[_f.__name__] = _on_values(_f)
for _f in (pixels.extract_channel, pixels.reduce_channels, pixels.color_diff, pixels.color_balance, pixels.scale_channels, pixels.convert_color, pixels.desaturate_shadows):
    STEPS[_f.__name__] = _of_channels(_f)
