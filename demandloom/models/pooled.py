"""Global forecasters: one model over all series.

A series is one row of month-indexed arrays with the train limits of every window.  Samples are slices of
it, made and used up inside the tasks, so nothing is repeated per window or shuffled per sample.  All windows'
and steps' normal equations come from one aggregation of packed triangles; the driver sees those (features
squared per window and step), solves them and sends the coefficients back as constants.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models import design as dm
from demandloom.models.base import FORECAST_COLUMNS, horizon_months
from demandloom.operators.alignment import drop_offset
from demandloom.operators.lookback import cut_positions, sliced, with_limits, with_shared
from demandloom.operators.scalers import MinMax, Scaler
from demandloom.operators.series import Roles, month_arrays, roles
from demandloom.operators.windows import model_of_window, retrain_flags
from demandloom.plans.storage import cut_lineage


def model_windows(calendar: DataFrame, cfg: BacktestConfig) -> dict[int, list[int]]:
    """Windows served by each trained model; the calendar has a handful of rows."""
    served: dict[int, list[int]] = {}
    for row in model_of_window(retrain_flags(calendar, cfg.retrain)).collect():
        if row["model_window"] is None:
            raise ValueError(f"window {row['window']} comes before any window that trains a model")
        served.setdefault(row["model_window"], []).append(row["window"])
    return served


def _month_no(day) -> int:
    return day.year * 12 + day.month


@dataclass(frozen=True)
class _Run:
    """One fit: series arrays, the calendar's months, and which window is served by which model.

    Windows are numbered by their place in the calendar; ``model_of`` maps a place to that of its model.
    """

    arrays: DataFrame
    design: dm.Design
    found: Roles
    common: Roles
    windows: list[int]
    train_ends: dict[int, int]
    known_until: list[int]
    model_of: dict[int, int]
    shift: int
    ahead: int

    def _samples(self, placed: DataFrame, *more) -> DataFrame:
        horizon, shift = self.design.steps, self.shift
        ended = (F.col("first_no") + F.col("_at") + self.ahead).cast("int").alias("sample_end_no")
        slices = sliced(placed, self.design.lookback, horizon, shift, self.found, self.common)
        return placed.select("series_id", ended, "low", "width", *self.design.static, *slices, *more)

    def training(self) -> DataFrame:
        """Samples whose targets lie in the train split of any trained window."""
        placed = self.arrays.select("*", cut_positions(self.design.lookback).alias("_at"))
        in_time = F.col("first_no") + F.col("_at") + self.ahead <= max(self.train_ends.values())
        return self._samples(placed.where(in_time))

    def scoring(self) -> DataFrame:
        """The sample of every series and window that ends at the latest month known, with the window's ``place``."""
        cuts = F.array(
            *[F.struct(F.lit(i).alias("place"), (F.lit(no) - F.col("first_no")).alias("_at")) for i, no in enumerate(self.known_until)]
        )
        placed = self.arrays.select("*", F.inline(cuts))
        complete = F.col("_at").between(self.design.lookback - 1, F.size("value") - 1)
        return self._samples(placed.where(complete), "place")

    def weights(self, steps: range, ridge: float) -> dict[tuple[int, int], list[float] | None]:
        """Coefficients per (place, step) of all windows, from one aggregation over the training samples."""
        packed = self.training().mapInArrow(dm.gram_task(self.design, self.train_ends, steps), dm.GRAM)
        totals = packed.groupBy("place", "step", "entry").agg(F.sum("total").alias("total"))
        entries: dict[tuple[int, int], dict[int, int]] = {}
        for r in totals.collect():
            entries.setdefault((r["place"], r["step"]), {})[r["entry"]] = int(r["total"])
        size = len(self.design.names()) + 1
        solved = {}
        for place in self.train_ends:
            for step in steps:
                found = dm.solve(dm.unpacked(entries.get((place, step), {}), size), ridge)
                solved[place, step] = None if found is None else [float(v) for v in found]
        return {(i, step): solved[self.model_of[i], step] for i in self.model_of for step in steps}

    def residuals(self, steps: range, ridge: float) -> DataFrame:
        """How far the fits are from a least-squares solution, per trained window, step and feature.

        ``correlation`` of feature and residual over the training rows; zero for a solution (without ridge).  ``sum_x`` and
        ``sum_y`` are sums of the scaled feature and goal over ``n`` rows.
        """
        task = dm.residual_task(self.design, self.train_ends, self.weights(steps, ridge), steps)
        sums = self.training().mapInArrow(task, dm.RESIDUALS).groupBy("place", "step", "feature")
        totals = sums.agg(*[F.sum(c).alias(c) for c in ("n", "sum_x", "sum_y", "xr", "xx", "rr")])
        size = F.sqrt(F.col("xx") * F.col("rr"))
        correlation = F.when(size > 0, F.col("xr") / size).otherwise(0.0).alias("correlation")
        return totals.select(self._window(), "step", "feature", "n", "sum_x", "sum_y", correlation)

    def _window(self) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in self.windows]), F.col("place") + 1).alias("window")

    def dated(self, forecasts: DataFrame, months: DataFrame, name: str) -> DataFrame:
        """Forecasts by place and step on their months."""
        steps = forecasts.select(self._window(), "series_id", "step", "forecast")
        joined = steps.join(F.broadcast(months.select("window", "step", "time_index")), ["window", "step"])
        return joined.withColumn("model", F.lit(name))


def _run(
    series: DataFrame,
    calendar: DataFrame,
    cfg: BacktestConfig,
    design: dm.Design,
    found: Roles,
    static: DataFrame | None,
    shared: DataFrame | None,
    common: Roles,
    shift: int,
    ahead: int,
    scaler: Scaler,
) -> _Run:
    arrays = month_arrays(series, ["value", *found.past, *found.future])
    if common.all:
        arrays = with_shared(arrays, shared, common)
    if found.static:
        arrays = arrays.join(static.select("series_id", *found.static), "series_id", "left")
    # one row per window
    rows = sorted(calendar.collect(), key=lambda r: r["window"])
    windows = [r["window"] for r in rows]
    place = {w: i for i, w in enumerate(windows)}
    served = model_windows(calendar, cfg)
    ends = [_month_no(r["train_end_date"]) for r in rows]
    return _Run(
        # read by the fit and by the forecast, so it is written once
        cut_lineage(with_limits(arrays, design.scaled, ends, scaler)),
        design,
        found,
        common,
        windows,
        {place[w]: ends[place[w]] for w in served},
        [_month_no(r["validation_end_date"]) for r in rows],
        {place[w]: place[m] for m, ws in served.items() for w in ws},
        shift,
        ahead,
    )


@dataclass(frozen=True)
class GlobalDirect:
    """One regression per forecast step over all series, with covariates over the whole lookback.

    ``learner`` is ``linear`` or ``trees``.  ``static`` is an optional encoded dimension table, ``shared`` an optional gap-free
    table of month-level covariates (``past_*``, ``future_*``) that all series share.  ``ridge`` is relative to the features'
    variances.  ``scaler`` takes every series' units from its train months (unless ``cfg.scale`` is off).
    A series without its static row or a shared month gets no forecast.
    """

    lookback: int = 12
    learner: str = "linear"
    instance_norm: bool = True
    static: DataFrame | None = None
    shared: DataFrame | None = None
    ridge: float = 1e-4
    scaler: Scaler = MinMax()
    name: str = "GlobalDirect"

    def _prepared(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> _Run:
        own = roles(series.columns, False, cfg.use_past, cfg.use_future)
        names = tuple(c for c in self.static.columns if c.startswith("static_")) if self.static is not None else ()
        found = Roles(names if cfg.use_static else (), own.past, own.future)
        common = roles(self.shared.columns if self.shared is not None else (), False, cfg.use_past, cfg.use_future)
        design = dm.Design(
            self.lookback,
            cfg.horizon,
            found.past,
            found.future,
            found.static,
            tuple(f"shared_{c}" for c in common.past),
            tuple(f"shared_{c}" for c in common.future),
            cfg.scale,
            self.instance_norm,
        )
        ahead = cfg.shift + cfg.horizon
        return _run(series, calendar, cfg, design, found, self.static, self.shared, common, cfg.shift, ahead, self.scaler)

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        if self.learner not in ("linear", "trees"):
            raise ValueError("learner must be 'linear' or 'trees'")
        run, steps = self._prepared(series, calendar, cfg), range(cfg.horizon)
        if self.learner == "linear":
            task = dm.predict_task(run.design, run.weights(steps, self.ridge), steps, False)
            found = run.scoring().mapInArrow(task, "place int, series_id string, step int, forecast double")
        else:
            found = self._trees(run, steps, cfg)
        return run.dated(found, horizon_months(calendar, cfg), self.name).select(*FORECAST_COLUMNS)

    def _trees(self, run: _Run, steps: range, cfg: BacktestConfig) -> DataFrame:
        """Boosted trees per trained window and step, each a fit of Spark ML."""
        train = cut_lineage(run.training().mapInArrow(dm.learner_task(run.design, run.train_ends, steps), dm.LEARNER))
        scoring = cut_lineage(run.scoring().mapInArrow(dm.learner_task(run.design, None, steps), dm.LEARNER))
        vector = array_to_vector("features").alias("_features")
        parts = []
        for place in run.train_ends:
            served = [i for i, m in run.model_of.items() if m == place]
            for step in steps:
                rows = train.where((F.col("place") == place) & (F.col("step") == step)).select("goal", vector)
                learner = GBTRegressor(
                    maxIter=10, maxDepth=4, seed=cfg.random_state, featuresCol="_features", labelCol="goal", predictionCol="_raw"
                )
                ready = scoring.where(F.col("place").isin(served) & (F.col("step") == step)).select("*", vector)
                units = F.col("_raw") * F.col("scale") + F.col("base")
                scored = learner.fit(rows).transform(ready)
                parts.append(scored.select("place", "series_id", (F.col("step") + 1).alias("step"), units.alias("forecast")))
        return _union(parts)

    def residuals(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        """(window, step, feature, n, sum_x, sum_y, correlation) of the linear fits."""
        return self._prepared(series, calendar, cfg).residuals(range(cfg.horizon), self.ridge)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class GlobalRecursive:
    """A one-step regression over all series applied to its own output, month after month.

    Future covariates only, own and shared.  All steps of a series are predicted in one pass.
    """

    lookback: int = 12
    shared: DataFrame | None = None
    ridge: float = 1e-4
    scaler: Scaler = MinMax()
    name: str = "GlobalRecursive"

    def _prepared(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> _Run:
        total = cfg.shift + cfg.horizon
        found = Roles((), (), roles(series.columns, False, False, cfg.use_future).future)
        common = roles(self.shared.columns if self.shared is not None else (), False, False, cfg.use_future)
        ahead = tuple(f"shared_{c}" for c in common.future)
        design = dm.Design(self.lookback, total, (), found.future, (), (), ahead, cfg.scale, False)
        # trained on the month after the cut only
        return _run(series, calendar, cfg, design, found, None, self.shared, common, 0, 1, self.scaler)

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        run = self._prepared(series, calendar, cfg)
        weights = run.weights(range(1), self.ridge)
        task = dm.predict_task(run.design, weights, range(run.design.steps), True)
        found = run.scoring().mapInArrow(task, "place int, series_id string, step int, forecast double")
        dated = run.dated(found, horizon_months(calendar, cfg, with_offset=True), self.name)
        return drop_offset(dated, cfg.shift).select(*FORECAST_COLUMNS)

    def residuals(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        """(window, step, feature, n, sum_x, sum_y, correlation) of the one-step fits."""
        return self._prepared(series, calendar, cfg).residuals(range(1), self.ridge)
