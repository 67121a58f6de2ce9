"""Backward-looking features per series: lags, rolling statistics, differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import nan_is_missing, safe_divide
from granary.operators.ordered import over_history
from granary.operators.rolling import rolling_robust

# Default lags and windows.
LAGS = (1, 3, 6, 12)
WINDOWS = (3, 6)
#: Rows of a window from which on it is kept sorted while it slides instead of being sorted for each row.
LONG_WINDOW = 32


def _series(df: DataFrame, group: str | list[str] | None, order: str | list[str]) -> tuple[list[str], list[Column]]:
    keys = [group] if isinstance(group, str) else list(group or [])
    names = [order] if isinstance(order, str) else list(order)
    return [k for k in keys if k in df.columns], [F.col(n).asc_nulls_last() for n in names]


def _blank_null_group(keys: list[str], new: dict[str, Column]) -> dict[str, Column]:
    """Rows without a series key take part in no series."""
    if not keys:
        return new
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return {n: F.when(known, c) for n, c in new.items()}


@nan_is_missing
def add_lags(
    df: DataFrame,
    target: str,
    lags: list[int] | None = None,
    group: str | list[str] | None = None,
    order_by: str | list[str] = (),
    bounded: bool | None = None,
) -> DataFrame:
    """``{target}_lag_{k}``: the value k rows earlier in the same series."""
    if target not in df.columns:
        return df
    steps = list(lags or LAGS)
    keys, order = _series(df, group, order_by)

    def build(w):
        return _blank_null_group(keys, {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in steps})

    return over_history(df, keys, order, max(steps), build, bounded)


@nan_is_missing
def add_rolling(
    df: DataFrame,
    target: str,
    windows: list[int] | None = None,
    group: str | list[str] | None = None,
    order_by: str | list[str] = (),
    bounded: bool | None = None,
) -> DataFrame:
    """``{target}_roll_mean_{w}`` and ``_roll_std_{w}`` over the w rows before the current one."""
    if target not in df.columns:
        return df
    sizes = list(windows or WINDOWS)
    keys, order = _series(df, group, order_by)

    def build(w):
        new = {}
        for n in sizes:
            frame = w.rowsBetween(-n, -1)
            new[f"{target}_roll_mean_{n}"] = F.avg(target).over(frame)
            new[f"{target}_roll_std_{n}"] = F.stddev_samp(target).over(frame)
        return _blank_null_group(keys, new)

    return over_history(df, keys, order, max(sizes), build, bounded)


def full_rolling_sum(target: str, scale: int, w) -> Column:
    """Sum over the last ``scale`` rows; NULL until all of them are present."""
    frame = w.rowsBetween(-(scale - 1), 0)
    return F.when(F.count(target).over(frame) == scale, F.sum(target).over(frame))


@nan_is_missing
def add_rolling_sum(
    df: DataFrame, target: str, scale: int, group=None, order_by=(), name: str | None = None, bounded: bool | None = None
) -> DataFrame:
    keys, order = _series(df, group, order_by)
    label = name or f"{target}_sum_{scale}"
    return over_history(df, keys, order, scale, lambda w: {label: full_rolling_sum(target, scale, w)}, bounded)


@nan_is_missing
def add_difference(df: DataFrame, target: str, group=None, order_by=(), bounded: bool | None = None) -> DataFrame:
    """First difference and the lagged level, the regressors of a unit-root test."""
    keys, order = _series(df, group, order_by)

    def build(w):
        before = F.lag(target, 1).over(w)
        return {f"{target}_prev": before, f"{target}_diff": F.col(target) - before}

    return over_history(df, keys, order, 1, build, bounded)


@nan_is_missing
def add_change(
    df: DataFrame, target: str, steps: list[int], group=None, order_by=(), bounded: bool | None = None
) -> DataFrame:
    """``{target}_pct_{k}``: percentage change against k rows earlier."""
    keys, order = _series(df, group, order_by)

    def build(w):
        new = {}
        for k in steps:
            base = F.lag(target, k).over(w)
            new[f"{target}_pct_{k}"] = safe_divide(F.col(target) - base, base) * 100.0
        return new

    return over_history(df, keys, order, max(steps), build, bounded)


@nan_is_missing
def add_rolling_robust(
    df: DataFrame, target: str, size: int, group=None, order_by=(), bounded: bool | None = None
) -> DataFrame:
    """Rolling coefficient of variation, median and MAD over the last ``size`` rows.

    Short windows are arrays that are sorted inside the JVM; from ``LONG_WINDOW`` rows on, a sorted window slides over blocks.
    """
    keys, order = _series(df, group, order_by)
    names = tuple(f"{target}_roll_{what}_{size}" for what in ("cv", "median", "mad"))
    if size >= LONG_WINDOW:
        return rolling_robust(df, keys, order, target, size, names, bounded)

    def build(w):
        frame = w.rowsBetween(-(size - 1), 0)
        held = F.filter(F.collect_list(target).over(frame), lambda x: x.isNotNull())
        return {
            f"{target}_roll_cv_{size}": safe_divide(F.stddev_samp(target).over(frame), F.avg(target).over(frame)),
            f"{target}_roll_median_{size}": middle(held),
            "__held": held,
        }

    wide = over_history(df, keys, order, size, build, bounded)
    centre = F.col(f"{target}_roll_median_{size}")
    spread = middle(F.transform("__held", lambda x: F.abs(x - centre)))
    return wide.withColumn(f"{target}_roll_mad_{size}", spread).drop("__held")


def middle(values: Column) -> Column:
    """Median of a short array (its length is a window size)."""
    ordered = F.array_sort(values)
    n = F.size(values)
    lower = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    upper = F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (lower + upper) / 2.0)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = value * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


# Mean Earth radius in kilometres.
EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (p2 - p1) / 2.0, F.radians(lon2 - lon1) / 2.0
    h = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return 2.0 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
