import math
import random

import numpy as np
import pytest
from conftest import long_frame, month
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models import kernels
from demandloom.models.closed_form import LevelSmoothing, LinearTrend, OneLagAR, SeasonalNaive
from demandloom.models.factor import FactorModel
from demandloom.models.masked_factor import MaskedFactorModel
from demandloom.models.per_series import AutoAR, ExpSmoothing, FourierTrend
from demandloom.models.pooled import GlobalDirect, GlobalRecursive
from demandloom.operators.metrics import wape
from demandloom.operators.alignment import AlignmentError
from demandloom.operators.scaling import fit_minmax, scale_split
from demandloom.plans.backtest import backtest, scored_pairs
from demandloom.operators.windows import pin_calendar, window_calendar

LOCAL = BacktestConfig(windows=3, use_validation=False)
GLOBAL = BacktestConfig(windows=3, retrain=2)
LOCAL_MODELS = [SeasonalNaive(), OneLagAR(), LinearTrend(), LevelSmoothing(), ExpSmoothing(), AutoAR(),
                FourierTrend(), FourierTrend(multiplicative=True, name="FourierProduct")]
GLOBAL_MODELS = [GlobalDirect(lookback=6), GlobalRecursive(lookback=6), FactorModel(factors=2), MaskedFactorModel(factors=2)]


@pytest.fixture(scope="module")
def seasonal(spark):
    """Yearly waves of different heights with a trend and a little noise."""
    rng = random.Random(5)
    histories = {
        f"s{i}": [
            (i + 2) * (20 + 0.2 * t + 8 * math.sin(2 * math.pi * (t + i % 3) / 12)) + rng.random()
            for t in range(60)
        ]
        for i in range(8)
    }
    return long_frame(spark, histories).withColumn("future_month", F.month("time_index").cast("double")).cache()


def forecasts(model, df, calendar, cfg):
    return {
        (r["window"], r["series_id"], r["time_index"]): r["forecast"]
        for r in model.forecast(df, calendar, cfg).collect()
    }


@pytest.mark.parametrize("model", LOCAL_MODELS + GLOBAL_MODELS, ids=lambda m: m.name)
def test_every_month_is_forecast_and_nothing_later_is_used(spark, seasonal, model):
    cfg = GLOBAL if model in GLOBAL_MODELS else LOCAL
    calendar = pin_calendar(window_calendar(seasonal, cfg))
    before = forecasts(model, seasonal, calendar, cfg)
    assert len(before) == 3 * 8 * 3 and all(math.isfinite(v) for v in before.values())
    # demand after the first window's last known month must not matter to that window
    cut = calendar.filter("window = 0").first()["validation_end_date"]
    spoiled = seasonal.withColumn("value", F.when(F.col("time_index") > cut, F.lit(1e6)).otherwise(F.col("value")))
    after = forecasts(model, spoiled, calendar, cfg)
    for key, value in before.items():
        if key[0] == 0:
            assert after[key] == pytest.approx(value, rel=1e-9)


@pytest.mark.parametrize("model", [ExpSmoothing(), AutoAR(), FourierTrend(), GlobalDirect(), FactorModel()], ids=lambda m: m.name)
def test_seasonal_models_beat_the_seasonal_naive(spark, seasonal, model):
    cfg = LOCAL if not isinstance(model, (GlobalDirect, FactorModel)) else BacktestConfig(windows=3, retrain=True)
    calendar = pin_calendar(window_calendar(seasonal, cfg))
    pairs = scored_pairs(seasonal, calendar, [SeasonalNaive(), model], cfg)
    score = {r["model"]: r["w"] for r in wape(pairs).groupBy("model").agg(F.avg("wape").alias("w")).collect()}
    assert score[model.name] < score["SeasonalNaive"]


def test_seeded_fits_repeat(spark, seasonal):
    calendar = pin_calendar(window_calendar(seasonal, GLOBAL))
    trees = GlobalDirect(lookback=3, learner="trees", instance_norm=False)
    cfg = BacktestConfig(horizon=1, windows=1, use_validation=False)
    calendar = pin_calendar(window_calendar(seasonal, cfg))
    assert forecasts(trees, seasonal, calendar, cfg) == forecasts(trees, seasonal, calendar, cfg)
    with pytest.raises(ValueError):
        GlobalDirect(learner="magic").forecast(seasonal, calendar, cfg)


def test_level_smoothing_equals_a_plain_loop_for_late_starters(spark):
    rng = random.Random(2)
    histories = {"old": [rng.randint(0, 50) for _ in range(40)], "new": [rng.randint(0, 50) for _ in range(10)]}
    df = long_frame(spark, histories, {"new": 30})
    calendar = pin_calendar(window_calendar(df, LOCAL))
    fits = {(r["window"], r["series_id"]): r for r in LevelSmoothing().fits(df, calendar).collect()}
    for row in calendar.collect():
        known = (row["validation_end_date"].year - 2000) * 12 + row["validation_end_date"].month
        for name, values in histories.items():
            seen = values[: known - (30 if name == "new" else 0)]
            best = None
            for k in range(1, 20):
                alpha, level, sse = k / 20, float(seen[0]), 0.0
                for v in seen[1:]:
                    sse += (v - level) ** 2
                    level = alpha * v + (1 - alpha) * level
                best = min(best or (math.inf,), (sse, alpha, level))
            got = fits[(row["window"], name)]
            assert (got["sse"], got["alpha"], got["level"]) == pytest.approx(best)


def test_fourier_equals_least_squares_of_one_series():
    rng = np.random.default_rng(0)
    y = rng.uniform(0, 100, (3, 48))
    y[2, 40:] = np.nan
    known = np.array([[36, 48], [30, 44], [36, 40]])
    first = np.array([1, 5, 8])
    got = kernels.fourier(y, known, 4, first)
    for s in range(3):
        for w in range(2):
            n = known[s, w]
            t = np.arange(n + 4)
            angle = 2 * np.pi * (first[s] + t) / 12
            x = np.column_stack([np.ones(n + 4), t / 12] + [f(k * angle) for k in (1, 2, 3) for f in (np.sin, np.cos)])
            coef = np.linalg.lstsq(x[:n], y[s, :n], rcond=None)[0]
            assert got[s, w] == pytest.approx(x[n:] @ coef, rel=1e-6)


def test_offset_months_are_discarded(spark, seasonal):
    calendar = pin_calendar(window_calendar(seasonal, LOCAL))
    months = {k[2] for k in forecasts(LinearTrend(), seasonal, calendar, LOCAL) if k[0] == 0}
    first = calendar.filter("window = 0").first()
    assert min(months) == first["forecast_start"] and max(months) == first["forecast_end"]
    assert month(59) >= max(months)


def test_factor_forecast_equals_regression_on_the_factors(spark, seasonal):
    """One window by hand: loadings, factor levels, and every series regressed on lagged factors."""
    cfg = BacktestConfig(windows=1, use_validation=False)
    calendar = pin_calendar(window_calendar(seasonal, cfg))
    got = forecasts(FactorModel(factors=2), seasonal, calendar, cfg)
    names = sorted({k[1] for k in got})
    table = {(r["series_id"], r["time_index"]): r["value"] for r in seasonal.collect()}
    n = 56
    x = np.array([[table[(s, month(t))] for t in range(n)] for s in names])
    low, width = x.min(axis=1), np.ptp(x, axis=1)
    z = (x - low[:, None]) / width[:, None]
    centred = z - z.mean(axis=0)
    axes = np.linalg.svd(centred)[2][:2].T
    loadings = z @ axes
    levels = np.linalg.lstsq(loadings, z, rcond=None)[0].T
    design = np.column_stack([np.ones(n), levels])
    for i, s in enumerate(names):
        for h in (2, 3, 4):
            coef = np.linalg.lstsq(design[: n - h], z[i, h:], rcond=None)[0]
            expected = (design[-1] @ coef) * width[i] + low[i]
            assert got[(0, s, month(n - 1 + h))] == pytest.approx(expected, rel=1e-6)


@pytest.mark.parametrize("windows", [(1, 2), (2,), (0, 2)])
@pytest.mark.parametrize("model", LOCAL_MODELS, ids=lambda m: m.name)
def test_part_of_a_calendar_gives_the_same_forecasts(seasonal, model, windows):
    calendar = pin_calendar(window_calendar(seasonal, LOCAL))
    whole = forecasts(model, seasonal, calendar, LOCAL)
    part = forecasts(model, seasonal, calendar.filter(F.col("window").isin(*windows)), LOCAL)
    assert part == {k: pytest.approx(v) for k, v in whole.items() if k[0] in windows}


def test_part_of_a_calendar_gives_the_same_scaling(seasonal):
    calendar = pin_calendar(window_calendar(seasonal, LOCAL))
    later = calendar.filter("window > 0")
    keys = ("window", "series_id", "low", "high")
    rows = lambda df, cols: {tuple(r[c] for c in cols) for r in df.collect()}
    assert rows(fit_minmax(seasonal, later), keys) == {r for r in rows(fit_minmax(seasonal, calendar), keys) if r[0] > 0}
    keys = ("window", "series_id", "time_index", "value")
    scaled = rows(scale_split(seasonal, calendar, "test"), keys)
    assert rows(scale_split(seasonal, later, "test"), keys) == {r for r in scaled if r[0] > 0}


def test_global_models_reject_windows_without_a_model(seasonal):
    calendar = pin_calendar(window_calendar(seasonal, GLOBAL)).filter("window = 1")
    with pytest.raises(ValueError, match="window 1"):
        GlobalDirect(lookback=6).forecast(seasonal, calendar, GLOBAL)


@pytest.fixture(scope="module")
def late(spark):
    """Three series, one of which starts 16 months before the end."""
    histories = {s: [50 + 10 * math.sin(t / 2 + k) for t in range(60)] for k, s in enumerate("ab")}
    return long_frame(spark, histories | {"late": [float(t + 3) for t in range(16)]}, {"late": 44}).cache()


@pytest.mark.parametrize("model", LOCAL_MODELS + GLOBAL_MODELS, ids=lambda m: m.name)
def test_a_late_series_is_scored_or_raises(late, model):
    cfg = BacktestConfig(windows=6, retrain=3, use_validation=False)
    calendar = pin_calendar(window_calendar(late, cfg))
    try:
        pairs = scored_pairs(late, calendar, [model], cfg)
    except (AlignmentError, ValueError) as e:
        assert "prediction" in str(e) or "start" in str(e)
    else:
        assert pairs.count() == 54 and pairs.where("forecast IS NULL").count() == 0


def test_missing_forecasts_are_counted_on_request(late):
    cfg = BacktestConfig(windows=6, use_validation=False)
    calendar = pin_calendar(window_calendar(late, cfg))
    result = backtest(late, calendar, [SeasonalNaive()], cfg, check=False)
    by_window = {r["window"]: r["n_missing"] for r in result.window_table().collect()}
    by_series = result.series_table().where("n_missing > 0").collect()
    assert sum(by_window.values()) == sum(r["n_missing"] for r in by_series) == 9
    assert {r["series_name"] for r in by_series} == {"late"}


def test_every_model_is_fitted_once_for_both_tables(spark, seasonal):
    done = spark.sparkContext.accumulator(0)
    tick = F.udf(lambda v: (done.add(1), v)[1], "double")

    class Counted(OneLagAR):
        def forecast(self, series, calendar, cfg):
            return super().forecast(series, calendar, cfg).withColumn("forecast", tick("forecast"))

    calendar = pin_calendar(window_calendar(seasonal, LOCAL))
    result = backtest(seasonal, calendar, [Counted(name="Counted")], LOCAL)
    result.window_table().collect()
    result.series_table().collect()
    assert done.value == 3 * 8 * 3


def test_joint_model_needs_one_start_or_a_common_span(late):
    cfg = BacktestConfig(windows=3, use_validation=False)
    calendar = pin_calendar(window_calendar(late, cfg))
    with pytest.raises(ValueError, match="different months"):
        FactorModel(factors=1).forecast(late, calendar, cfg)
    found = forecasts(FactorModel(factors=1, common_span=True), late, calendar, cfg)
    assert len(found) == 27 and all(math.isfinite(v) for v in found.values())


def _dense_masked(table, origin, n_train, n_all, at, total, k, rounds, ridge):
    """Alternating least squares over observed cells of one window, as dense loops without any rounding."""
    from demandloom.models.masked_factor import start_factors

    low = {s: min(v for t, v in cells.items() if t < n_train) for s, cells in table.items()}
    width = {s: (max(v for t, v in cells.items() if t < n_train) - low[s]) or 1.0 for s, cells in table.items()}
    z = {s: {t: (v - low[s]) / width[s] for t, v in cells.items() if t < n_all} for s, cells in table.items()}
    f = start_factors(np.arange(origin, origin + n_all), k)

    def weights(cells):
        t = sorted(t for t in cells if t < n_train)
        x, y = f[t], np.array([cells[i] for i in t])
        return np.linalg.solve(x.T @ x + ridge * np.eye(k), x.T @ y)

    for _ in range(rounds):
        own = {s: weights(c) for s, c in z.items()}
        new = np.zeros_like(f)
        for t in range(n_all):
            seen = [s for s in z if t in z[s]]
            x, y = np.array([own[s] for s in seen]).reshape(-1, k), np.array([z[s][t] for s in seen])
            new[t] = np.linalg.solve(x.T @ x + ridge * np.eye(k), x.T @ y)
        f = new / np.sqrt((new[:n_train] ** 2).mean(axis=0))
    out = {}
    for h in range(1, total + 1):
        def inputs(t):
            angle = 2 * np.pi * (origin + t + h) / 12
            return np.concatenate([[1.0], f[t], [np.sin(angle), np.cos(angle)]])

        x, y = np.array([inputs(t) for t in range(n_train - h)]), f[h:n_train]
        b = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
        for s in z:
            out[s, h] = float(inputs(at) @ b @ weights(z[s])) * width[s] + low[s]
    return out


def test_masked_factors_equal_a_dense_solve_with_uneven_starts(late):
    cfg = BacktestConfig(windows=2, use_validation=False)
    calendar = pin_calendar(window_calendar(late, cfg))
    model = MaskedFactorModel(factors=2, rounds=4)
    got = forecasts(model, late, calendar, cfg)
    assert {k[1] for k in got} == {"a", "b", "late"}
    table, origin = {}, 2000 * 12 + 1
    for r in late.collect():
        table.setdefault(r["series_id"], {})[(r["time_index"].year - 2000) * 12 + r["time_index"].month - 1] = r["value"]
    first = calendar.filter("window = 0").first()
    no = lambda d: (d.year - 2000) * 12 + d.month - 1
    n_train, at = no(first["train_end_date"]) + 1, no(first["validation_end_date"])
    last = no(calendar.filter("window = 1").first()["validation_end_date"])
    want = _dense_masked(table, origin, n_train, last + 1, at, 4, 2, 4, 0.1)
    for s in table:
        for h in (2, 3, 4):
            assert got[0, s, month(at + h)] == pytest.approx(want[s, h], rel=1e-3, abs=1e-3)
    again = sorted(model.forecast(late.repartition(9), calendar, cfg).collect())
    assert again == sorted(model.forecast(late.repartition(1), calendar, cfg).collect())


def test_masked_factors_use_covariates_known_in_advance(spark):
    """Every third month is announced and raises all series; without the announcement it can't be foreseen."""
    rng = np.random.default_rng(6)
    marks = (rng.random(70) < 0.3).astype(float)
    table = {f"s{i}": [20 + i + 5 * marks[t] * (1 + i % 2) + rng.random() for t in range(60)] for i in range(6)}
    df = long_frame(spark, table)
    shared = spark.createDataFrame([(month(t), float(marks[t])) for t in range(70)], "time_index date, future_mark double")
    cfg = BacktestConfig(windows=6, use_validation=False, retrain=True)
    calendar = pin_calendar(window_calendar(df, cfg))
    models = [MaskedFactorModel(factors=1, name="blind"), MaskedFactorModel(factors=1, shared=shared, name="told")]
    pairs = scored_pairs(df, calendar, models, cfg)
    score = {r["model"]: r["w"] for r in wape(pairs).groupBy("model").agg(F.avg("wape").alias("w")).collect()}
    assert score["told"] < score["blind"]
