"""Trials scored on the tuning windows, and the run from data through tuning to backtest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.functions.errors import clip_nonneg
from demandloom.models.base import Forecaster, horizon_months
from demandloom.models.closed_form import smoothing_levels
from demandloom.models.per_series import BatchForecaster, fit_batches
from demandloom.operators import tuning
from demandloom.operators.alignment import KEYS, actuals, align_all, assert_complete
from demandloom.operators.windows import assert_no_leakage, pin_calendar, window_calendar
from demandloom.plans.backtest import BacktestResult, backtest
from demandloom.plans.storage import cut_lineage

Build = Callable[[dict[str, str]], Forecaster]

STUDY_SCHEMA = (
    "study_name string, trial_number int, params map<string,string>, value double, "
    "wape_by_window array<double>, started timestamp, completed timestamp"
)


def smoothing_pairs(
    series: DataFrame, calendar: DataFrame, trials: DataFrame, cfg: BacktestConfig
) -> DataFrame:
    """Scored pairs of every smoothing trial (``trial_number``, ``alpha``), window and series.

    Trials ride along with the series as a broadcast table of a size fixed by the configuration;
    each (trial, series) pair is folded once for all windows.  An actual without a forecast raises, as in a backtest.
    """
    levels = smoothing_levels(series, calendar, trials)
    months = horizon_months(calendar, cfg).select("window", "time_index")
    forecasts = levels.join(F.broadcast(months), "window").select(
        "trial_number", "window", "series_id", "time_index", clip_nonneg(F.col("level")).alias("forecast")
    )
    # scored from the actuals' side, so that all trials are judged on the same series and months
    numbers = trials.select("trial_number")
    wanted = actuals(series, calendar).join(F.broadcast(numbers), F.col("series_id").isNotNull())
    pairs = cut_lineage(wanted.join(forecasts, ["trial_number", *KEYS], "left"))
    assert_complete(pairs.withColumn("model", F.col("trial_number")))
    return pairs


def run_trials(
    series: DataFrame,
    calendar: DataFrame,
    cfg: BacktestConfig,
    build: Build,
    packed: DataFrame,
    study_name: str,
) -> DataFrame:
    """A study table: every trial of ``packed`` (trial_number, params) scored on the windows.

    ``build`` turns a trial's parameters into a forecaster.  Trials of batch models are an axis of one table: they are fitted
    in one pass over the series and scored in one job, however many there are; a trial took the seconds spent in its fits.
    Other models get a job each.  One row per trial comes back to the driver.
    """
    # as many rows as the configuration asks for trials
    asked = {r["trial_number"]: r["params"] for r in packed.orderBy("trial_number").collect()}
    models = {number: build(params) for number, params in asked.items()}
    batch = {str(n): m.kernel() for n, m in models.items() if isinstance(m, BatchForecaster)}
    series = cut_lineage(series)
    truth = cut_lineage(actuals(series, calendar))
    rows = []
    if batch:
        started = datetime.now(timezone.utc)
        fitted = cut_lineage(fit_batches(series, calendar, cfg, batch))
        pairs = align_all(truth, fitted, list(batch)).withColumnRenamed("model", "trial_number")
        # seconds are summed before the fits are joined to anything
        spent = {r["model"]: r["seconds"] for r in fitted.groupBy("model").agg(F.sum("seconds").alias("seconds")).collect()}
        for score in _scored_trials(pairs, cfg).collect():
            n = int(score["trial_number"])
            ended = started + timedelta(seconds=spent.get(str(n), 0.0))
            rows.append((study_name, n, asked[n], score["value"], score["wape_by_window"], started, ended))
    for number, model in models.items():
        if str(number) in batch:
            continue
        started = datetime.now(timezone.utc)
        pairs = align_all(truth, model.forecast(series, calendar, cfg), [model.name])
        score = _scored_trials(pairs.withColumn("trial_number", F.lit(number)), cfg).first()
        ended = datetime.now(timezone.utc)
        rows.append((study_name, number, asked[number], score["value"], score["wape_by_window"], started, ended))
    return packed.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[1]), STUDY_SCHEMA)


def _scored_trials(pairs: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Objective and window scores per trial; every actual must have a forecast."""
    pairs = cut_lineage(pairs.withColumn("forecast", clip_nonneg(F.col("forecast"))))
    assert_complete(pairs.withColumn("model", F.col("trial_number")))
    return tuning.trial_scores(pairs, cfg.decimals)


def tune_and_backtest(
    series: DataFrame,
    lines: DataFrame,
    cfg: BacktestConfig,
    build: Build,
    space: DataFrame,
    defaults: dict[str, str],
    n_trials: int,
    model_name: str,
    timestamp: str,
    study_path: str,
    baselines: Sequence[Forecaster] = (),
    study_name: str | None = None,
    rank: int = 0,
    direction: str = "minimize",
) -> BacktestResult:
    """Tune on the windows before the backtest, then backtest with the best trial.

    ``lines`` is any table with the series' ids and times, read for the calendars only.  Trials are
    appended to the study table at ``study_path`` under ``<model_name>_utc_<timestamp>``, numbered and
    drawn on from those stored there before.  The trial of that ``rank`` (0: the best in ``direction``)
    of the study ``study_name``, or of all the model's studies, wins over ``defaults``, which serve when
    there is none.
    """
    calendar = pin_calendar(window_calendar(lines, cfg))
    spark = series.sparkSession
    if n_trials:
        tuning_calendar = pin_calendar(window_calendar(lines, cfg, "tuning"))
        assert_no_leakage(tuning_calendar, calendar)
        study = f"{model_name}_utc_{timestamp}"
        known = tuning.read_study(spark, study_path)
        last = known.where(F.col("study_name") == study).agg(F.max("trial_number")).first()[0] if known is not None else None
        first = 0 if last is None else last + 1
        packed = tuning.pack_trials(tuning.make_trials(space, n_trials, cfg.random_state, first))
        tuning.append_trials(
            run_trials(series, tuning_calendar, cfg, build, packed, study), study_path
        )
    stored = tuning.read_study(spark, study_path)
    params = dict(defaults)
    if stored is not None:
        # one row
        wanted = {"study_name": study_name} if study_name else {"model_name": model_name}
        for row in tuning.best_trial(stored, **wanted, rank=rank, direction=direction).collect():
            params |= row["params"]
    model = build(params)
    ids = lines.select("series_id").distinct()
    texts = {model.name: str(dict(sorted(params.items())))}
    return backtest(
        series, calendar, [model, *baselines], cfg, timestamp, hyperparameters=texts, ids=ids
    )
