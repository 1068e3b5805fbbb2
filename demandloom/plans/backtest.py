"""From series to result tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models.base import FORECAST_COLUMNS, Forecaster
from demandloom.models.per_series import BatchForecaster, fit_batches
from demandloom.functions.errors import clip_nonneg
from demandloom.operators.alignment import actuals, align_all, assert_complete
from demandloom.operators.metrics import order_results, series_results, window_results
from demandloom.operators.series import demand_series, finished_lines
from demandloom.operators.windows import pin_calendar, retrain_flags, window_calendar
from demandloom.plans.storage import cut_lineage


@dataclass(frozen=True)
class BacktestResult:
    """Scored pairs, written once, and the settings of their run; both result tables are derived from them.

    ``count_missing`` adds ``n_missing`` (pairs without a forecast) and ``n_fallback`` (pairs whose history was too short for
    the model) to the tables.
    """

    pairs: DataFrame
    flags: DataFrame
    backtest_date: str
    hyperparameters: dict[str, str] | None
    decimals: int
    ids: DataFrame
    count_missing: bool = False

    def window_table(self, ordered: bool = True) -> DataFrame:
        table = window_results(
            self.pairs, self.flags, self.backtest_date, self.hyperparameters, self.decimals,
            count_missing=self.count_missing,
        )
        return order_results([table], "window") if ordered else table

    def series_table(self, ordered: bool = True) -> DataFrame:
        table = series_results(
            self.pairs, self.flags, self.backtest_date, self.hyperparameters, self.decimals, self.ids,
            count_missing=self.count_missing,
        )
        return order_results([table], "series") if ordered else table


def forecast_all(
    series: DataFrame, calendar: DataFrame, models: Sequence[Forecaster], cfg: BacktestConfig
) -> DataFrame:
    """Forecasts of all models in one table.

    Batch models are an axis of one table, so they share one pass over the series whatever their number;
    every other model is a branch of the plan.  ``fallback``, there if any model has it, says what a model did where a
    history was too short for it.
    """
    batch = {m.name: m.kernel() for m in models if isinstance(m, BatchForecaster)}
    parts = [fit_batches(series, calendar, cfg, batch)] if batch else []
    parts += [m.forecast(series, calendar, cfg) for m in models if not isinstance(m, BatchForecaster)]
    columns = [*FORECAST_COLUMNS, "fallback"] if any("fallback" in p.columns for p in parts) else FORECAST_COLUMNS
    parts = [p if "fallback" in p.columns else p.withColumn("fallback", F.lit(None).cast("string")) for p in parts]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def scored_pairs(
    series: DataFrame,
    calendar: DataFrame,
    models: Sequence[Forecaster],
    cfg: BacktestConfig,
    check: bool = True,
) -> DataFrame:
    """Every actual once per model with its forecast in original units, clipped, written once.

    The pairs are scored from the actuals' side, so all models are judged on the same series and months.
    A model that has no forecast for one raises; without ``check`` the pair stays with a NULL forecast.
    The pairs (a row per model, window, series and month of the horizon) are cut in the shared folder:
    whatever is derived from them, each model is fitted once.
    """
    truth = actuals(series, calendar)
    predicted = forecast_all(series, calendar, models, cfg)
    pairs = align_all(truth, predicted, [m.name for m in models])
    pairs = cut_lineage(pairs.withColumn("forecast", clip_nonneg(F.col("forecast"))))
    if check:
        assert_complete(pairs)
    return pairs


def backtest(
    series: DataFrame,
    calendar: DataFrame,
    models: Sequence[Forecaster],
    cfg: BacktestConfig,
    backtest_date: str = "00000000_0000",
    hyperparameters: dict[str, str] | None = None,
    retrain: bool | int | None = None,
    check: bool = True,
    ids: DataFrame | None = None,
) -> BacktestResult:
    """Forecast, score and summarise.

    The forecasts are computed and written here; the result tables stay lazy.  Without ``check``
    missing forecasts are counted in ``n_missing`` instead of raising, and fall-backs in ``n_fallback``.  ``ids`` (the series ids, if a
    cheaper table than ``series`` has them) is what the numbering of series reads.
    """
    pairs = scored_pairs(series, calendar, models, cfg, check)
    flags = retrain_flags(calendar, cfg.retrain if retrain is None else retrain)
    known = series.select("series_id") if ids is None else ids
    return BacktestResult(pairs, flags, backtest_date, hyperparameters, cfg.decimals, known, not check)


def backtest_lines(
    lines: DataFrame, models: Sequence[Forecaster], cfg: BacktestConfig, backtest_date: str = "00000000_0000", **more
) -> BacktestResult:
    """From demand lines (series_id, time_index, value) to scored pairs.

    Honours ``cfg.drop_last_month``: with it the unfinished month is left out of the series and the calendar alike, without it
    every line is read and the last window ends in the latest month.  ``more`` goes to :func:`backtest`.
    """
    lines = finished_lines(lines, cfg)
    calendar = pin_calendar(window_calendar(lines, cfg))
    ids = lines.select("series_id").distinct()
    return backtest(demand_series(lines), calendar, models, cfg, backtest_date, ids=ids, **more)
