"""Per-series forecasters fitted in batches inside Spark tasks.

Spark partitions the series and the models; a task receives Arrow batches of arrays (one row per series and
model, at most one value per month) and fits all series and windows of a batch with vectorised NumPy.  Models and trials
are an axis of one table, so their number changes neither the plan nor the number of jobs.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.functions.months import month_number
from demandloom.models import arima, ets, kernels
from demandloom.models.base import FORECAST_COLUMNS, horizon_months
from demandloom.operators.alignment import drop_offset
from demandloom.operators.series import series_arrays

# the fits travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# rows fitted together; bounds a task's memory whatever the Arrow batch size
CHUNK = 512

# (values, months known per window, steps, first month) -> (forecasts, forms, fallbacks) per series and window
Kernel = Callable[[np.ndarray, np.ndarray, int, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

FIT_COLUMNS = [*FORECAST_COLUMNS, "form", "fallback"]


def _packed(series: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per series: its history, first month number and every window's cut."""
    # one entry per window
    ordered = F.array_sort(F.collect_list(F.struct("window", month_number(F.col("validation_end_date")).alias("cut"))))
    cuts = calendar.agg(ordered.alias("_c")).select(
        F.transform("_c", lambda c: c["cut"]).alias("cuts"),
        F.transform("_c", lambda c: c["window"]).alias("windows"),
    )
    arrays = series_arrays(series).select("series_id", month_number(F.col("first_month")).alias("first_no"), "history")
    return arrays.join(F.broadcast(cuts), F.col("series_id").isNotNull())


def fit_batches(series: DataFrame, calendar: DataFrame, cfg: BacktestConfig, fits: Mapping[str, Kernel]) -> DataFrame:
    """Run batch kernels over all series: FORECAST_COLUMNS, the form fitted, the fallback taken (or NULL), and ``seconds``.

    Every (model, series) is a row of one table that is spread over all shuffle partitions: fits cost far more per byte than
    the scans that adaptive execution sizes partitions for, and a model's share doesn't wait for another's.  ``seconds`` is the
    time a row took; summed over a model it is the time spent on it.
    """
    total = cfg.shift + cfg.horizon
    names = list(fits)
    model = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("place")
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = _packed(series, calendar).select("*", model).repartition(n, "place", "series_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, own in batch.groupby("place"):
                for at in range(0, len(own), CHUNK):
                    yield _fit_chunk(own.iloc[at : at + CHUNK], total, fits[names[place]], place)

    schema = "place int, series_id string, window int, step int, forecast double, form string, fallback string, seconds double"
    fitted = spread.mapInPandas(run, schema)
    steps = horizon_months(calendar, cfg, with_offset=True).select("window", "step", "time_index")
    dated = drop_offset(fitted.join(F.broadcast(steps), ["window", "step"]), cfg.shift)
    name = F.element_at(F.array(*[F.lit(m) for m in names]), F.col("place") + 1).alias("model")
    return dated.select(name, *FORECAST_COLUMNS[1:], "form", F.nullif("fallback", F.lit("")).alias("fallback"), "seconds")


def _batch(chunk: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, months known per window, first month numbers) of a chunk of packed series."""
    histories = [np.asarray(h, dtype=float) for h in chunk["history"]]
    first = chunk["first_no"].to_numpy()
    y = np.full((len(chunk), max(len(h) for h in histories)), np.nan)
    for i, h in enumerate(histories):
        y[i, : len(h)] = h
    lengths = np.array([len(h) for h in histories])
    return y, np.clip(np.stack(chunk["cuts"].to_numpy()) - first[:, None] + 1, 0, lengths[:, None]), first


def _fit_chunk(chunk: pd.DataFrame, total: int, kernel: Kernel, place: int) -> pd.DataFrame:
    y, known, first = _batch(chunk)
    started = time.perf_counter()
    out, forms, fallbacks = kernel(y, known, total, first)
    series, windows, steps = out.shape
    spent = (time.perf_counter() - started) / max(out.size, 1)
    # the calendar's own ids, whatever part of a calendar it is
    ids = np.asarray(chunk["windows"].iloc[0], dtype=np.int32)
    return pd.DataFrame(
        {
            "place": np.int32(place),
            "series_id": np.repeat(chunk["series_id"].to_numpy(), windows * steps),
            "window": np.tile(np.repeat(ids, steps), series),
            "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), series * windows),
            "forecast": out.ravel(),
            "form": np.repeat(forms.ravel(), steps),
            "fallback": np.repeat(fallbacks.ravel(), steps),
            "seconds": spent,
        }
    ).dropna(subset=["forecast"])


def _by_history(fit) -> Kernel:
    """A kernel that fits every (series, window) as a history of its own."""

    def kernel(y, known, steps, first):
        series, windows = known.shape
        out, forms, fallbacks = fit(np.repeat(y, windows, axis=0), known.ravel(), steps)
        return out.reshape(series, windows, steps), forms.reshape(series, windows), fallbacks.reshape(series, windows)

    return kernel


class BatchForecaster:
    """A forecaster whose fit is a kernel; several of them share one pass over the series."""

    name: str

    def kernel(self) -> Kernel:
        raise NotImplementedError

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        """FIT_COLUMNS: the forecasts with the form chosen and, where the history was too short for the model, the fallback."""
        return fit_batches(series, calendar, cfg, {self.name: self.kernel()}).select(*FIT_COLUMNS)


@dataclass(frozen=True)
class ExpSmoothing(BatchForecaster):
    """Exponential smoothing: season and (damped) trend chosen by AICc, weights fitted on the likelihood."""

    limits: ets.SmoothingLimits = field(default_factory=ets.SmoothingLimits)
    name: str = "ExponentialSmoothing"

    def kernel(self) -> Kernel:
        limits = self.limits
        return _by_history(lambda z, n, steps: ets.fit(z, n, steps, limits))


@dataclass(frozen=True)
class AutoAR(BatchForecaster):
    """Seasonal autoregression with differencing and moving-average terms, orders chosen stepwise by AICc."""

    limits: arima.OrderLimits = field(default_factory=arima.OrderLimits)
    name: str = "AutoAR"

    def kernel(self) -> Kernel:
        limits = self.limits
        return _by_history(lambda z, n, steps: arima.fit(z, n, steps, limits))


@dataclass(frozen=True)
class FourierTrend(BatchForecaster):
    """Trend plus yearly seasonality, additive or multiplicative; the trend may bend every ``knot_every`` months (0: never)."""

    multiplicative: bool = False
    waves: int = 3
    knot_every: int = 12
    name: str = "FourierTrend"

    def _bounds(self) -> kernels.Waves:
        return kernels.Waves(self.waves, self.multiplicative, self.knot_every)

    def kernel(self) -> Kernel:
        bounds = self._bounds()
        return lambda y, known, steps, first: kernels.trend_and_waves(y, known, steps, first, bounds)

    def moments(self, series: DataFrame, calendar: DataFrame) -> DataFrame:
        """(window, series_id, column, moment, residual): every unpenalised column's product with the series over the known
        months, and its correlation with what the fit leaves, which is zero for a least-squares fit.

        Columns are ``constant``, ``trend``, ``sin_k`` and ``cos_k``; those that a short history doesn't have are left out.
        """
        bounds = self._bounds()
        names = ["constant", "trend", *(f"{f}_{k}" for k in range(1, self.waves + 1) for f in ("sin", "cos"))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), CHUNK):
                    chunk = batch.iloc[at : at + CHUNK]
                    y, known, first = _batch(chunk)
                    found, left = kernels.moments(y, known, first, bounds)
                    has = np.broadcast_to(known[:, :, None] >= bounds.min_history, found.shape).copy()
                    has[:, :, 2:] &= (known >= bounds.min_seasonal)[:, :, None]
                    s, w, c = np.nonzero(has)
                    ids = np.asarray(chunk["windows"].iloc[0], dtype=np.int32)
                    yield pd.DataFrame(
                        {
                            "window": ids[w],
                            "series_id": chunk["series_id"].to_numpy()[s],
                            "column": np.array(names)[c],
                            "moment": found[has],
                            "residual": left[has],
                        }
                    )

        schema = "window int, series_id string, column string, moment double, residual double"
        return _packed(series, calendar).mapInPandas(run, schema)
