"""Joint forecaster for series of uneven starts: common factors by alternating least squares over observed months.

A series is a row, a month a column, and only the months that a series has are cells; nothing is padded or cut.  One round
is one pass over the series for all trained windows: a task solves the loadings of its series against the months' factors and
adds up, per month, what the next factors need.  Those sums (months times factors squared) are whole numbers, so the fit
doesn't depend on how the series are partitioned; the driver solves a few equations per month.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models.base import FORECAST_COLUMNS, horizon_months
from demandloom.models.design import exact_gram
from demandloom.models.pooled import model_windows
from demandloom.operators.alignment import drop_offset
from demandloom.operators.lookback import shared_arrays, with_limits
from demandloom.operators.scalers import MinMax, Scaler
from demandloom.operators.series import month_arrays, roles
from demandloom.plans.storage import cut_lineage

# the fits travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# loadings and values are rounded to multiples of this share of their unit before they are added up
QUANTUM = 1 << 18
SEASON = 12


@dataclass
class Window:
    """One trained window: months are counted from ``origin``, ``n_train`` of them are train, ``n_all`` are known to a window
    that it serves."""

    origin: int
    n_train: int
    n_all: int
    factors: np.ndarray


def start_factors(months: np.ndarray, k: int) -> np.ndarray:
    """The factors of round zero: a constant, a line, then yearly waves."""
    angle = 2 * np.pi * months / SEASON
    columns = [np.ones(len(months)), np.linspace(-1, 1, len(months))]
    wave = 1
    while len(columns) < k:
        columns += [np.sin(wave * angle), np.cos(wave * angle)]
        wave += 1
    return np.column_stack(columns[:k])


def loadings(values: np.ndarray, factors: np.ndarray, ridge: float) -> np.ndarray:
    """A series' weights on the factors, over its own months."""
    return np.linalg.solve(factors.T @ factors + ridge * np.eye(factors.shape[1]), factors.T @ values)


def _on_axis(batch: pa.RecordBatch, row: int, place: int, window: Window) -> tuple[int, np.ndarray]:
    """(first month on the window's axis, scaled values up to the last month known)."""
    low, width = (batch.column(c)[row].values[place].as_py() for c in ("low", "width"))
    first = batch.column("first_no")[row].as_py() - window.origin
    if low is None:
        return first, np.zeros(0)
    values = batch.column("value")[row].values.to_numpy(zero_copy_only=False)[: max(0, window.n_all - first)]
    return first, (values - low) / width


def sums_task(windows: dict[int, Window], ridge: float):
    """Per (place, month): the packed products of loadings, and of loadings and value, over the series that have the month."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for place, window in windows.items():
                k = window.factors.shape[1]
                weights, cells = np.zeros((batch.num_rows, k)), np.full((batch.num_rows, window.n_all), np.nan)
                for i in range(batch.num_rows):
                    first, values = _on_axis(batch, i, place, window)
                    train = values[: max(0, window.n_train - first)]
                    if len(train):
                        weights[i] = loadings(train, window.factors[first : first + len(train)], ridge)
                        cells[i, first : first + len(values)] = values
                weights, cells = np.rint(weights * QUANTUM), np.rint(cells * QUANTUM)
                found = sums.setdefault(place, [0] * window.n_all)
                for t in range(window.n_all):
                    seen = np.isfinite(cells[:, t])
                    found[t] = found[t] + exact_gram(np.column_stack([weights[seen], cells[seen, t]]))
        for place, found in sums.items():
            upper = np.triu_indices(windows[place].factors.shape[1] + 1)
            n = len(upper[0])
            for t, gram in enumerate(found):
                packed = pa.array([int(v) for v in gram[upper]], pa.decimal128(38, 0))
                same = [pa.array([v] * n, pa.int32()) for v in (place, t)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), packed], ["place", "month", "entry", "total"])

    return run


def next_factors(gram: np.ndarray, ridge: float) -> np.ndarray:
    """A month's factors from its sums; the last row and column are those of the values."""
    k = len(gram) - 1
    return np.linalg.solve(gram[:k, :k] + ridge * np.eye(k), gram[:k, k])


def covariates_at(cov: tuple[int, np.ndarray] | None, numbers: np.ndarray) -> np.ndarray:
    """Rows of ``cov`` = (first month number, months x covariates) at month numbers; zero outside its months."""
    if cov is None:
        return np.zeros((len(numbers), 0))
    at = numbers - cov[0]
    inside = (at >= 0) & (at < len(cov[1]))
    return np.where(inside[:, None], cov[1][np.clip(at, 0, len(cov[1]) - 1)], 0.0)


def factors_ahead(window: Window, at: int, step: int, ridge: float, cov: tuple[int, np.ndarray] | None) -> np.ndarray:
    """The factors ``step`` months after month ``at``: least squares over the train months on the factors then known and
    on the later month's season and covariates."""

    def inputs(t: np.ndarray) -> np.ndarray:
        later = window.origin + t + step
        angle = 2 * np.pi * later / SEASON
        return np.column_stack([np.ones(len(t)), window.factors[t], np.sin(angle), np.cos(angle), covariates_at(cov, later)])

    t = np.arange(max(0, window.n_train - step))
    x = inputs(t)
    weights = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ window.factors[t + step])
    return (inputs(np.array([at])) @ weights)[0]


def forecast_task(windows: dict[int, Window], model_of: dict[int, int], known: list[int], total: int, cov, ridge: float):
    """Forecasts of every series and window: loadings times factors ahead, plus what covariates explain of the rest."""
    ahead = {
        (place, step): factors_ahead(windows[model], known[place] - windows[model].origin, step, ridge, cov)
        for place, model in model_of.items()
        for step in range(1, total + 1)
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                for place, model in model_of.items():
                    window = windows[model]
                    first, values = _on_axis(batch, i, model, window)
                    train = values[: max(0, window.n_train - first)]
                    if not len(train):
                        continue
                    span = window.factors[first : first + len(train)]
                    weights = loadings(train, span, ridge)
                    x = covariates_at(cov, window.origin + first + np.arange(len(train)))
                    left = train - span @ weights
                    effect = np.linalg.solve(x.T @ x + max(ridge, 1e-9) * np.eye(x.shape[1]), x.T @ left)
                    low, width = (batch.column(c)[i].values[model].as_py() for c in ("low", "width"))
                    for step in range(1, total + 1):
                        extra = covariates_at(cov, np.array([known[place] + step]))[0] @ effect
                        value = (float(ahead[place, step] @ weights) + float(extra)) * width + low
                        rows.append((place, batch.column("series_id")[i].as_py(), step, value))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            types = (pa.int32(), pa.string(), pa.int32(), pa.float64())
            names = ["place", "series_id", "step", "forecast"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


@dataclass(frozen=True)
class MaskedFactorModel:
    """Common factors of series that start when they like, with month-level covariates known in advance.

    ``shared`` is an optional gap-free table with ``future_*`` columns per month; its columns, scaled to one unit, help to see the
    factors ahead and explain what the factors leave of a series.  A series with no train month gets no forecast.
    """

    factors: int = 3
    rounds: int = 8
    ridge: float = 0.1
    shared: DataFrame | None = None
    scaler: Scaler = MinMax()
    name: str = "MaskedFactorModel"

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        rows = sorted(calendar.collect(), key=lambda r: r["window"])
        number = lambda day: day.year * 12 + day.month
        place = {r["window"]: i for i, r in enumerate(rows)}
        ends, known = [number(r["train_end_date"]) for r in rows], [number(r["validation_end_date"]) for r in rows]
        served = model_windows(calendar, cfg)
        model_of = {place[w]: place[m] for m, ws in served.items() for w in ws}
        arrays = cut_lineage(with_limits(month_arrays(series, ["value"]), ["value"], ends, self.scaler))
        origin = arrays.agg(F.min("first_no")).first()[0]
        if origin is None:
            raise ValueError("there are no series to learn from")
        windows = {}
        for m, ws in served.items():
            n_train, n_all = ends[place[m]] - origin + 1, max(known[place[w]] for w in ws) - origin + 1
            if n_train <= cfg.shift + cfg.horizon:
                raise ValueError("the history is too short to train on")
            start = start_factors(np.arange(origin, origin + n_all), self.factors)
            windows[place[m]] = Window(origin, n_train, n_all, start)
        for _ in range(self.rounds):
            self._round(arrays, windows)
        total = cfg.shift + cfg.horizon
        task = forecast_task(windows, model_of, known, total, self._covariates(cfg), self.ridge)
        found = arrays.mapInArrow(task, "place int, series_id string, step int, forecast double")
        window = F.element_at(F.array(*[F.lit(r["window"]) for r in rows]), F.col("place") + 1).alias("window")
        months = horizon_months(calendar, cfg, with_offset=True).select("window", "step", "time_index")
        dated = found.select(window, "series_id", "step", "forecast").join(F.broadcast(months), ["window", "step"])
        return drop_offset(dated.withColumn("model", F.lit(self.name)), cfg.shift).select(*FORECAST_COLUMNS)

    def _round(self, arrays: DataFrame, windows: dict[int, Window]) -> None:
        """New factors for all trained windows, from one aggregation."""
        sums = arrays.mapInArrow(sums_task(windows, self.ridge), "place int, month int, entry int, total decimal(38,0)")
        size = self.factors + 1
        upper = np.triu_indices(size)
        grams = {p: np.zeros((w.n_all, size, size)) for p, w in windows.items()}
        for r in sums.groupBy("place", "month", "entry").agg(F.sum("total").alias("total")).collect():
            a, b = upper[0][r["entry"]], upper[1][r["entry"]]
            grams[r["place"]][r["month"], a, b] = grams[r["place"]][r["month"], b, a] = int(r["total"]) / QUANTUM**2
        for p, window in windows.items():
            found = np.stack([next_factors(g, self.ridge) for g in grams[p]])
            # a factor and its loadings share one scale; it is given to the loadings
            scale = np.sqrt((found[: window.n_train] ** 2).mean(axis=0))
            window.factors = found / np.where(scale > 1e-9, scale, 1.0)

    def _covariates(self, cfg: BacktestConfig) -> tuple[int, np.ndarray] | None:
        names = roles(self.shared.columns, False, False, cfg.use_future).future if self.shared is not None else ()
        if not names:
            return None
        # one row of a checked number of months
        row = shared_arrays(self.shared, names).first()
        columns = np.array([row[f"shared_{c}"] for c in names], dtype=float).T
        low, high = columns.min(axis=0), columns.max(axis=0)
        return row["shared_no"], (columns - low) / np.where(high > low, high - low, 1.0) - 0.5
