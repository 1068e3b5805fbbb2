"""Forecast-error expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute_error(actual: Column, forecast: Column) -> Column:
    return F.abs(actual - forecast)


def ape(actual: Column, forecast: Column) -> Column:
    """Absolute percentage error as a fraction; NULL when the actual is zero."""
    return F.abs((actual - forecast) / F.nullif(actual, F.lit(0.0)))


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0.0))


def avg_if_complete(values: Column) -> Column:
    """Aggregate mean that is NULL as soon as one input row is NULL."""
    return F.when(F.count(F.lit(1)) == F.count(values), F.avg(values))


def clip_nonneg(forecast: Column) -> Column:
    """Forecasts below zero become zero; NULL stays NULL."""
    return F.when(forecast < 0, F.lit(0.0)).otherwise(forecast)
