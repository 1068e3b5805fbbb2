import math
import random

import numpy as np
import pytest
from conftest import long_frame, month
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models import design as dm
from demandloom.models.pooled import GlobalDirect, GlobalRecursive
from demandloom.operators import lookback as lb
from demandloom.operators.windows import pin_calendar, window_calendar


@pytest.fixture(scope="module")
def table(spark):
    """Six series of different starts with an own past and an own future covariate."""
    rng = random.Random(3)
    histories = {f"s{i}": [rng.uniform(5, 50) for _ in range(48 - 3 * i)] for i in range(6)}
    df = long_frame(spark, histories, {f"s{i}": 3 * i for i in range(6)})
    past, future = F.round(F.col("value") % 7, 3), F.month("time_index").cast("double")
    return df.withColumns({"past_a": past, "future_m": future}).cache()


@pytest.fixture(scope="module")
def shared(spark):
    rng = random.Random(4)
    rows = [(month(t), rng.uniform(0, 9), float(t % 4)) for t in range(4, 44)]
    return spark.createDataFrame(rows, "time_index date, past_x double, future_y double").cache()


def plain_samples(table, shared, lookback, horizon, shift):
    own, common = {}, {r["time_index"]: r for r in shared.collect()}
    for r in table.collect():
        own.setdefault(r["series_id"], {})[(r["time_index"].year - 2000) * 12 + r["time_index"].month - 1] = r
    out = {}
    for name, rows in own.items():
        for t in sorted(rows):
            if t - lookback + 1 < min(rows):
                continue
            back, ahead = range(t, t - lookback, -1), range(t + shift + 1, t + shift + 1 + horizon)
            get = lambda k, c: rows[k][c] if k in rows else None
            far = lambda k, c: common[month(k)][c] if k >= 0 and month(k) in common else None
            out[name, month(t)] = (
                [get(k, "value") for k in back], [get(k, "value") for k in ahead], [get(k, "past_a") for k in back],
                [get(k, "future_m") for k in ahead], [far(k, "past_x") for k in back], [far(k, "future_y") for k in ahead],
            )
    return out


COLUMNS = ("value_lags", "targets", "past_a_lags", "future_m_ahead", "shared_past_x_lags", "shared_future_y_ahead")


@pytest.mark.parametrize("shape", [(1, 1, 0), (5, 3, 1), (12, 2, 2)])
def test_samples_equal_a_plain_loop(table, shared, shape):
    samples = lb.lookback_samples(table, *shape, shared=shared).collect()
    got = {(r["series_id"], r["time_index"]): tuple(r[c] for c in COLUMNS) for r in samples}
    assert got == plain_samples(table, shared, *shape)


def test_nothing_after_the_cut_is_seen(table, shared):
    cut = month(30)
    later = F.col("time_index") > F.lit(cut)
    spoil = lambda df, *names: df.withColumns({c: F.when(later, F.lit(1e9)).otherwise(F.col(c)) for c in names})
    seen = [c for c in COLUMNS if c.endswith("_lags")]
    rows = lambda *args: sorted(
        lb.lookback_samples(*args).where(F.col("time_index") <= F.lit(cut)).select("series_id", "time_index", *seen).collect()
    )
    spoiled = (spoil(table, "value", "past_a"), 5, 3, 1, spoil(shared, "past_x"))
    assert rows(table, 5, 3, 1, shared) == rows(*spoiled)


def test_spread_out_columns(table, shared):
    wide = lb.as_columns(lb.lookback_samples(table, 2, 2, 1, shared))
    names = ["value_lag_0", "value_lag_1", "y_1", "y_2", "past_a_lag_0", "past_a_lag_1", "future_m_h1", "future_m_h2"]
    names += ["shared_past_x_lag_0", "shared_past_x_lag_1", "shared_future_y_h1", "shared_future_y_h2"]
    assert wide.columns == ["series_id", "time_index", "sample_end", *names]


def test_a_table_with_more_rows_than_months_is_rejected(spark, table, monkeypatch):
    monkeypatch.setattr(lb, "MAX_SHARED_MONTHS", 10)
    shared = spark.createDataFrame([(month(t), 1.0) for t in range(11)], "time_index date, past_x double")
    with pytest.raises(ValueError, match="11 rows"):
        lb.lookback_samples(table, 2, 1, 1, shared)


def test_normal_equations_are_exact_in_any_order():
    rng = np.random.default_rng(0)
    rows = np.rint(rng.normal(size=(300, 5)) * dm.QUANTUM)
    whole = [[int(v) for v in r] for r in rows]
    want = [[sum(r[i] * r[j] for r in whole) for j in range(5)] for i in range(5)]
    for scale in (1, 2**20, 2**60):
        assert dm.exact_gram(rows * scale).tolist() == [[v * scale * scale for v in r] for r in want]
    assert (dm.exact_gram(rows[:100]) + dm.exact_gram(rows[100:])).tolist() == want


def test_solution_is_least_squares_and_ridge_shrinks():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(200, 3)), np.ones(200)])
    y = x @ [1.0, -2.0, 0.5, 4.0] + rng.normal(size=200)
    gram = np.column_stack([x, y]).T @ np.column_stack([x, y])
    assert dm.solve(gram, 0.0) == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.abs(dm.solve(gram, 10.0)[:3]).max() < np.abs(dm.solve(gram, 0.0)[:3]).max() / 3
    twin = np.column_stack([x[:, :1], x])
    gram = np.column_stack([twin, y]).T @ np.column_stack([twin, y])
    both = dm.solve(gram, 0.0)
    assert both[0] == pytest.approx(both[1]) and twin @ both == pytest.approx(x @ np.linalg.lstsq(x, y, rcond=None)[0])
    assert dm.solve(np.zeros((3, 3)), 0.0) is None


CFG = BacktestConfig(windows=4, retrain=2)


def plain_direct(table, shared, calendar, lookback, scale, norm):
    """The direct model for one (window, step), with dense arrays and numpy's least squares."""
    samples = plain_samples(table, shared, lookback, CFG.horizon, CFG.shift)
    values, common = {}, {r["time_index"]: (r["past_x"], r["future_y"]) for r in shared.collect()}
    for r in table.collect():
        values.setdefault(r["series_id"], []).append((r["time_index"], r["value"], r["past_a"], r["future_m"]))
    rows = {r["window"]: r for r in calendar.collect()}
    out = {}

    def limits(seen):
        low, high = min(seen), max(seen)
        return low, (high - low) or 1.0

    def inputs(name, cut, window, h):
        end = rows[window]["train_end_date"]
        known = [v for v in values[name] if v[0] <= end]
        of = [limits([v[j] for v in known]) if scale else (0.0, 1.0) for j in (1, 2, 3)]
        far = [limits([v[j] for t, v in common.items() if t <= end]) if scale else (0.0, 1.0) for j in (0, 1)]
        lags, targets, past, future, px, fy = samples[name, cut]
        if None in px or fy[h] is None or future[h] is None:
            return None
        unit = lambda xs, l: [(x - l[0]) / l[1] for x in xs]
        lags = np.array(unit(lags, of[0]))
        mean, spread = (lags.mean(), math.sqrt(lags.var() + 1e-5)) if norm else (0.0, 1.0)
        x = [*((lags - mean) / spread), *unit(past, of[1]), *unit(px, far[0]), *unit([future[h]], of[2]), *unit([fy[h]], far[1]), 1.0]
        y = None if targets[h] is None else ((targets[h] - of[0][0]) / of[0][1] - mean) / spread
        return x, y, lambda p: (p * spread + mean) * of[0][1] + of[0][0]

    for window, row in rows.items():
        model = window // CFG.retrain * CFG.retrain
        for h in range(CFG.horizon):
            train = [
                inputs(name, cut, model, h)
                for name, cut in samples
                if (cut.year * 12 + cut.month) + CFG.shift + CFG.horizon
                <= rows[model]["train_end_date"].year * 12 + rows[model]["train_end_date"].month
            ]
            train = [s for s in train if s and s[1] is not None]
            coef = np.linalg.lstsq(np.array([s[0] for s in train]), np.array([s[1] for s in train]), rcond=None)[0]
            for name in values:
                found = inputs(name, row["validation_end_date"], window, h) if (name, row["validation_end_date"]) in samples else None
                if found:
                    out[window, name, h] = found[2](float(np.dot(found[0], coef)))
    return out


@pytest.mark.parametrize("scale, norm", [(True, False), (False, False), (True, True)])
def test_direct_model_equals_dense_least_squares(table, shared, scale, norm):
    cfg = BacktestConfig(windows=4, retrain=2, scale=scale)
    calendar = pin_calendar(window_calendar(table, cfg))
    # the constant and the mean-free lags leave the solution unique up to directions that no row has
    model = GlobalDirect(lookback=3, instance_norm=norm, shared=shared, ridge=0.0)
    want = plain_direct(table, shared, calendar, 3, scale, norm)
    starts = {r["window"]: r["forecast_start"] for r in calendar.collect()}
    got = {}
    for r in model.forecast(table, calendar, cfg).collect():
        h = (r["time_index"].year - starts[r["window"]].year) * 12 + r["time_index"].month - starts[r["window"]].month
        got[r["window"], r["series_id"], h] = r["forecast"]
    assert got and got == {k: pytest.approx(v, abs=2e-2) for k, v in want.items() if k in got}
    assert len(got) == len(want)


@pytest.mark.parametrize("model", [GlobalDirect(lookback=6), GlobalRecursive(lookback=6)], ids=lambda m: m.name)
def test_forecasts_do_not_depend_on_partitions(table, model):
    calendar = pin_calendar(window_calendar(table, CFG))
    runs = [sorted(model.forecast(table.repartition(n), calendar, CFG).collect()) for n in (1, 4, 17)]
    assert runs[0] and runs[0] == runs[1] == runs[2]


def test_windows_and_steps_add_no_jobs(spark, table):
    def jobs(cfg, group):
        calendar = pin_calendar(window_calendar(table, cfg))
        spark.sparkContext.setJobGroup(group, group)
        GlobalDirect(lookback=3).forecast(table, calendar, cfg)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    few = jobs(BacktestConfig(windows=1, horizon=1, retrain=True), "few")
    assert jobs(BacktestConfig(windows=6, horizon=4, retrain=True), "many") <= few
