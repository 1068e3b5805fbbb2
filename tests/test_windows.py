from datetime import date

import pytest
from conftest import as_rows, long_frame, month
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.operators import samples as smp
from demandloom.operators import windows as ops

CFG = BacktestConfig(windows=4, tuning_windows=2)


@pytest.fixture(scope="module")
def demand(spark):
    """Two series with different ends and one that starts late."""
    return long_frame(
        spark,
        {"a": range(40), "b": range(100, 137), "late": range(7)},
        {"late": 30},
    )


def test_calendar_uses_the_earliest_end_and_clips(spark, demand):
    rows = ops.window_calendar(demand, CFG).orderBy("window").collect()
    # earliest end is month 36: 36 - (3+1-1) - (4-1)
    assert [r["base_date"] for r in rows] == [month(30 + i) for i in range(4)]
    first, last = rows[0], rows[-1]
    assert first["train_end_date"] == month(26) and first["validation_end_date"] == month(29)
    assert first["forecast_start"] == month(31) and last["forecast_end"] == month(36)
    late = BacktestConfig(windows=2, start_date=month(34))
    clipped = ops.window_calendar(demand, late).orderBy("window").collect()
    assert [r["forecast_end"] for r in clipped] == [month(36), month(36)]


def test_without_validation_train_ends_before_the_base_month(spark, demand):
    cfg = BacktestConfig(windows=1, use_validation=False)
    row = ops.window_calendar(demand, cfg).first()
    assert row["train_end_date"] == row["validation_end_date"] == month(32)


def test_pinned_calendar_equals_the_lazy_one(spark, demand):
    lazy = ops.window_calendar(demand, CFG)
    pinned = ops.pin_calendar(lazy)
    assert pinned.dtypes == lazy.dtypes and as_rows(pinned, *lazy.columns) == as_rows(lazy, *lazy.columns)


def test_tuning_never_reaches_the_backtest(spark, demand):
    backtest = ops.window_calendar(demand, CFG)
    tuning = ops.window_calendar(demand, CFG, "tuning")
    ops.assert_no_leakage(tuning, backtest)
    assert tuning.agg(F.max("forecast_end")).first()[0] == month(29)
    manual = BacktestConfig(windows=4, tuning_windows=2, tuning_start_date=month(26))
    with pytest.raises(ops.LeakageError):
        ops.assert_no_leakage(ops.window_calendar(demand, manual, "tuning"), backtest)
    with pytest.raises(ValueError):
        ops.window_calendar(demand, CFG, "other")


def test_splits_are_nested_prefixes_and_test_follows(spark, demand):
    calendar = ops.window_calendar(demand, CFG)
    parts = {w: ops.split(demand, calendar, w) for w in ("train", "validation", "test", "future")}
    sets = {k: set(as_rows(v, "window", "series_id", "time_index")) for k, v in parts.items()}
    assert sets["train"] < sets["validation"] < sets["future"] and sets["test"] < sets["future"]
    for w in range(4):
        last = max(t for x, _, t in sets["validation"] if x == w)
        assert last < min(t for x, _, t in sets["test"] if x == w)
    with pytest.raises(ValueError):
        ops.split(demand, calendar, "holdout")


def test_expanding_equals_brute_force_even_for_sparse_series(spark):
    sparse = long_frame(spark, {"a": [3, None, None, 1] + [None] * 20 + [9, 2, 7, 4, 8, 1, 5, 6]})
    cfg = BacktestConfig(windows=6, start_date=month(24), use_validation=False)
    calendar = ops.window_calendar(sparse, cfg)
    wanted = {"lo": ("min", "value"), "n": ("count", "value"), "total": ("sum", "value")}
    got = as_rows(ops.expanding(sparse, calendar, wanted), "window", "lo", "n", "total")
    brute = ops.split(sparse, calendar, "train").groupBy("window").agg(
        F.min("value").alias("lo"), F.count("value").alias("n"), F.sum("value").alias("total")
    )
    assert got == as_rows(brute, "window", "lo", "n", "total")


@pytest.mark.parametrize(
    ("frequency", "flags"),
    [(True, [1, 1, 1, 1]), (False, [1, 0, 0, 0]), (3, [1, 0, 0, 1]), (1, [1, 1, 1, 1])],
)
def test_retrain_modes_and_carry_forward(spark, demand, frequency, flags):
    flagged = ops.model_of_window(ops.retrain_flags(ops.window_calendar(demand, CFG), frequency))
    rows = flagged.orderBy("window").collect()
    assert [int(r["retrained"]) for r in rows] == flags
    latest = 0
    for r in rows:
        latest = r["window"] if r["retrained"] else latest
        assert r["model_window"] == latest


def test_retrain_frequency_must_be_positive(spark, demand):
    with pytest.raises(ValueError):
        ops.retrain_flags(ops.window_calendar(demand, CFG), 0)


def test_chunks_and_steps(spark, demand):
    calendar = ops.window_calendar(demand, BacktestConfig(windows=1))
    # train ends at month 29: 30 + 30 months, and none of the late series' zero months
    chunks = smp.chunk_count(demand, calendar, 12)
    assert chunks.first()["total_chunks"] == 2 * (30 - 12 + 1)
    assert smp.step_budget(chunks, 8, 10).first()["total_steps"] == 5 * 10 + 1


def test_samples_hold_lags_and_shifted_targets(spark):
    df = long_frame(spark, {"a": range(10)})
    rows = smp.make_samples(df, 3, 2, 1).orderBy("time_index").collect()
    assert len(rows) == 8
    first = rows[0]
    assert [first[f"lag_{k}"] for k in range(3)] == [2.0, 1.0, 0.0]
    assert (first["y_1"], first["y_2"], first["sample_end"]) == (4.0, 5.0, date(2000, 6, 1))


def test_empty_demand_has_no_calendar(spark):
    with pytest.raises(ValueError, match="empty"):
        ops.pin_calendar(ops.window_calendar(long_frame(spark, {"a": [1]}).limit(0), CFG))
