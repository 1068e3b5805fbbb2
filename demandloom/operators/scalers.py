"""Pluggable scalers: how an offset and a width are taken from the months a window knows.

A scaler only says what (offset, width) of an array of values is; fitting, applying and inverting are the same for
all.  Parameters are stored as (low, high) with high = low + width, so whatever applies or inverts min-max parameters takes
those of any scaler.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.series import month_arrays


class Scaler(Protocol):
    """Anything that turns an array of known values into (offset, width); a width of zero counts as one."""

    name: str

    def limits(self, values: Column) -> tuple[Column, Column]: ...


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: inside a lambda Spark computes a shared
    expression anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def _quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation between the neighbours in a sorted array; NULL for an empty one."""
    at = F.lit(q) * (F.size(ordered) - 1)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


@dataclass(frozen=True)
class MinMax:
    """Between the smallest and the largest value."""

    name: str = "minmax"

    def limits(self, values: Column) -> tuple[Column, Column]:
        return F.array_min(values), F.array_max(values) - F.array_min(values)


@dataclass(frozen=True)
class Standard:
    """By mean and population deviation."""

    name: str = "standard"

    def limits(self, values: Column) -> tuple[Column, Column]:
        known = F.when(F.size(values) > 0, values)
        variance = _bound(_mean(known), lambda mean: _mean(F.transform(known, lambda v: (v - mean) * (v - mean))))
        return _mean(known), F.sqrt(variance)


@dataclass(frozen=True)
class Robust:
    """By median and distance of two quantiles, so that single extremes don't move it."""

    lower: float = 0.25
    upper: float = 0.75
    name: str = "robust"

    def limits(self, values: Column) -> tuple[Column, Column]:
        ordered = F.array_sort(values)
        spread = lambda v: _quantile(v, self.upper) - _quantile(v, self.lower)
        return _bound(ordered, lambda v: _quantile(v, 0.5)), _bound(ordered, spread)


def safe_width(width: Column) -> Column:
    """A constant series is divided by one."""
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def fit_scaler(
    df: DataFrame, calendar: DataFrame, scaler: Scaler, variables: Sequence[str] = ("value",)
) -> DataFrame:
    """(window, variable, series_id, low, high) over the train split of every window, in one pass over each series.

    ``df`` is gap-free.  A window's known months are a prefix of the series' array; a row holds one window's while its limits are
    taken, so they are computed once and nothing is shuffled per window.
    """
    # one row per window
    ends = {r["window"]: r["train_end_date"].year * 12 + r["train_end_date"].month for r in calendar.collect()}
    parts = []
    for window, end in ends.items():
        known = F.greatest(F.lit(end) - F.col("first_no") + 1, F.lit(0))
        parts += [
            F.struct(F.lit(window).alias("window"), F.lit(v).alias("variable"), F.slice(v, 1, known).alias("_known"))
            for v in variables
        ]
    cut = month_arrays(df, variables).select("series_id", F.inline(F.array(*parts)))
    low, width = scaler.limits(F.col("_known"))
    fitted = cut.select("window", "variable", "series_id", low.alias("low"), width.alias("_width"))
    return fitted.where(F.col("low").isNotNull()).withColumn("high", F.col("low") + F.col("_width")).drop("_width")
