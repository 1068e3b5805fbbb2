"""APE, MAPE and WAPE, and the two result tables.

Sums per (model, window, month) combine on the map side, so few and large groups are no problem;
lists collected below are bounded by the forecast horizon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.errors import absolute_error, ape, avg_if_complete, ratio
from demandloom.operators.series import dense_index


def with_ape(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ape", ape(F.col("actual"), F.col("forecast")))


def mape(pairs: DataFrame) -> DataFrame:
    """Mean APE per model, window and series over the months where it is defined."""
    return (
        with_ape(pairs)
        .groupBy("model", "window", "series_id")
        .agg(
            F.avg("ape").alias("mape"),
            F.count(F.when(F.col("ape").isNull(), 1)).alias("n_undefined"),
        )
    )


def wape(pairs: DataFrame, by: Sequence[str] = ("model", "window", "time_index")) -> DataFrame:
    """Sum of absolute errors over sum of actuals across series; NULL where actuals sum to zero.

    Pairs without a forecast count on neither side.
    """
    error = absolute_error(F.col("actual"), F.col("forecast"))
    return (
        pairs.groupBy(*by)
        .agg(F.sum(error).alias("_error"), F.sum(F.when(error.isNotNull(), F.col("actual"))).alias("_actual"))
        .select(*by, ratio(F.col("_error"), F.col("_actual")).alias("wape"))
    )


def avg_wape(per_period: DataFrame, decimals: int = 6) -> DataFrame:
    """Mean over the periods of a window; undefined as soon as one period is."""
    return per_period.groupBy("model", "window").agg(
        F.round(avg_if_complete(F.col("wape")), decimals).alias("avg_wape_across_periods")
    )


def window_results(
    pairs: DataFrame,
    flagged_calendar: DataFrame,
    backtest_date: str,
    hyperparameters: dict[str, str] | None = None,
    decimals: int = 6,
    count_missing: bool = False,
) -> DataFrame:
    """One row per model and window.  ``flagged_calendar`` comes from ``retrain_flags``."""
    missing = pairs.groupBy("model", "window").agg(*_gaps(pairs))
    ordered = F.array_sort(F.collect_list(F.struct("time_index", "wape")))
    grouped = (
        wape(pairs)
        .groupBy("model", "window")
        .agg(
            F.min("time_index").alias("forecast_start"),
            F.max("time_index").alias("forecast_end"),
            F.round(avg_if_complete(F.col("wape")), decimals).alias("avg_wape_across_periods"),
            F.transform(ordered, lambda p: F.round(p["wape"], decimals)).alias("wape_per_period"),
        )
    )
    flags = flagged_calendar.select("window", "base_date", "retrained")
    if count_missing:
        grouped = grouped.join(missing, ["model", "window"])
    return grouped.join(F.broadcast(flags), "window").select(
        F.lit(backtest_date).alias("backtest_date"),
        "model",
        "window",
        "base_date",
        "retrained",
        "forecast_start",
        "forecast_end",
        "avg_wape_across_periods",
        "wape_per_period",
        _params_text(hyperparameters).alias("model_hyperparameters"),
        *(["n_missing", "n_fallback"] if count_missing else []),
    )


def _gaps(pairs: DataFrame):
    """Pairs without a forecast, and pairs whose history was too short for the model."""
    fallback = F.col("fallback") if "fallback" in pairs.columns else F.lit(None)
    return [F.count_if(F.col("forecast").isNull()).alias("n_missing"), F.count(fallback).alias("n_fallback")]


def series_results(
    pairs: DataFrame,
    flagged_calendar: DataFrame,
    backtest_date: str,
    hyperparameters: dict[str, str] | None = None,
    decimals: int = 6,
    ids: DataFrame | None = None,
    count_missing: bool = False,
) -> DataFrame:
    """One row per model, window and series with its values in month order.

    ``ids`` holds the series ids that ``series_index`` counts; without it they are taken from the
    pairs, which computes those once more.
    """
    ordered = F.array_sort(F.collect_list(F.struct("time_index", "actual", "forecast", "ape")))
    grouped = (
        with_ape(pairs)
        .groupBy("model", "window", "series_id")
        .agg(
            F.min("time_index").alias("forecast_start"),
            F.max("time_index").alias("forecast_end"),
            F.round(F.avg("ape"), decimals).alias("mape"),
            F.count(F.when(F.col("ape").isNull(), 1)).alias("n_undefined"),
            ordered.alias("_p"),
            *_gaps(pairs),
        )
    )
    flags = flagged_calendar.select("window", "base_date", "retrained")
    indexed = grouped.join(F.broadcast(flags), "window").join(
        dense_index(pairs if ids is None else ids, "series_id", "series_index"), "series_id"
    )
    return indexed.select(
        F.lit(backtest_date).alias("backtest_date"),
        "model",
        "series_index",
        F.col("series_id").alias("series_name"),
        "window",
        "base_date",
        "retrained",
        "forecast_start",
        "forecast_end",
        "mape",
        "n_undefined",
        F.transform("_p", lambda p: F.round(p["ape"], decimals)).alias("ape"),
        F.transform("_p", lambda p: p["actual"]).alias("actual_values"),
        F.transform("_p", lambda p: p["forecast"]).alias("forecast_values"),
        _params_text(hyperparameters).alias("model_hyperparameters"),
        *(["n_missing", "n_fallback"] if count_missing else []),
    )


def _params_text(hyperparameters: dict[str, str] | None):
    """Opaque text per model; models without an entry get an empty dictionary."""
    text = F.lit("{}")
    for model, params in (hyperparameters or {}).items():
        text = F.when(F.col("model") == model, F.lit(params)).otherwise(text)
    return text


def order_results(parts: Sequence[DataFrame], level: str = "window") -> DataFrame:
    """Union of runs, ordered by (model, window) or (model, series_index, window)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    keys = {"window": ["model", "window"], "series": ["model", "series_index", "window"]}[level]
    return out.orderBy(*keys)
