"""What every forecaster shares."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig

FORECAST_COLUMNS = ["model", "window", "series_id", "time_index", "forecast"]


class Forecaster(Protocol):
    """Anything with a name and a ``forecast`` that returns ``FORECAST_COLUMNS`` lazily.

    ``series`` is the gap-filled long table and ``calendar`` the window calendar; a forecaster may
    only use rows up to each window's ``validation_end_date`` (covariates known in advance:
    ``forecast_end``).
    """

    name: str

    def forecast(
        self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig
    ) -> DataFrame: ...


def horizon_months(calendar: DataFrame, cfg: BacktestConfig, with_offset: bool = False) -> DataFrame:
    """One row per window and step: the month forecast.

    With the offset, steps count from the month after the last known one and include the ``shift``
    steps that are thrown away; otherwise step 1 is the first month of the forecast period.
    """
    total = cfg.shift + cfg.horizon
    first = F.lit(1) if with_offset else F.lit(cfg.shift + 1)
    months = calendar.select(
        "*", F.explode(F.sequence(first, F.lit(total))).alias("_ahead")
    ).withColumn("time_index", F.add_months("validation_end_date", F.col("_ahead")))
    step = F.col("_ahead") if with_offset else F.col("_ahead") - cfg.shift
    return months.filter(F.col("time_index") <= F.col("forecast_end")).select(
        "window", step.alias("step"), "time_index", "validation_end_date"
    )
