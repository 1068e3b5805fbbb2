import random

import numpy as np
import pytest
from conftest import as_rows, long_frame, month
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models.pooled import GlobalDirect
from demandloom.operators import scalers
from demandloom.operators import scaling as ops
from demandloom.operators.scaling import apply_minmax, invert_minmax
from demandloom.operators.windows import pin_calendar, split, window_calendar

CFG = BacktestConfig(windows=2)


@pytest.fixture(scope="module")
def demand(spark):
    return long_frame(spark, {"a": [i * 2 for i in range(30)], "flat": [7] * 30})


def test_round_trip_and_constant_series(spark, demand):
    calendar = window_calendar(demand, CFG)
    params = ops.fit_minmax(demand, calendar)
    test = split(demand, calendar, "test")
    scaled = ops.apply_minmax(test, params)
    assert {r["value"] for r in scaled.filter("series_id = 'flat'").collect()} == {0.0}
    back = ops.invert_minmax(scaled, params, "value")
    rounded = back.withColumn("value", F.round("value", 9))
    assert as_rows(rounded, *test.columns) == as_rows(test, *test.columns)


def test_one_pass_scaling_equals_stored_parameters(spark, demand):
    calendar = window_calendar(demand, CFG)
    stored = ops.apply_minmax(split(demand, calendar, "validation"), ops.fit_minmax(demand, calendar))
    fused = ops.scale_split(demand, calendar, "validation")
    assert as_rows(fused, *stored.columns) == as_rows(stored, *stored.columns)


def test_fit_sees_train_rows_only(spark, demand):
    calendar = window_calendar(demand, BacktestConfig(windows=2, start_date=month(20)))
    before = as_rows(ops.fit_minmax(demand, calendar), "window", "series_id", "low", "high")
    cut = calendar.agg(F.max("train_end_date")).first()[0]
    moved = demand.withColumn("value", F.when(F.col("time_index") > cut, -999.0).otherwise(F.col("value")))
    assert as_rows(ops.fit_minmax(moved, calendar), "window", "series_id", "low", "high") == before


def test_scaling_off_passes_rows_through(demand):
    assert ops.apply_minmax(demand, None) is demand and ops.invert_minmax(demand, None) is demand


def test_static_encoding(spark):
    rows = [("a", 10, "red"), ("b", 20, "blue"), ("c", 15, None)]
    dim = spark.createDataFrame(rows, "series_id string, static_n int, static_c string")
    got = as_rows(ops.encode_static(dim, ["static_n"], ["static_c"]), "series_id", "static_n", "static_c")
    assert got == [("a", 0.0, 1.0), ("b", 1.0, 0.0), ("c", 0.5, None)]


def test_instance_norm_undoes_itself(spark, demand):
    normed = ops.instance_norm(demand, 6)
    back = ops.undo_instance_norm(normed.withColumn("x", F.col("value_norm")), "x")
    assert all(abs(r["x"] - r["value"]) < 1e-9 for r in back.collect())
    assert back.filter("series_id = 'a'").count() == 25


def test_scalers_equal_numpy_on_every_window(spark):
    rng = random.Random(9)
    table = {"a": [rng.uniform(0, 9) for _ in range(40)], "flat": [3.0] * 40, "late": [rng.uniform(0, 9) for _ in range(8)]}
    df = long_frame(spark, table, {"late": 32})
    cfg = BacktestConfig(windows=3)
    calendar = pin_calendar(window_calendar(df, cfg))
    ends = {r["window"]: (r["train_end_date"].year - 2000) * 12 + r["train_end_date"].month for r in calendar.collect()}
    plain = {
        "minmax": lambda x: (x.min(), x.max()),
        "standard": lambda x: (x.mean(), x.mean() + x.std()),
        "robust": lambda x: (np.median(x), np.median(x) + np.quantile(x, 0.75) - np.quantile(x, 0.25)),
    }
    for scaler in (scalers.MinMax(), scalers.Standard(), scalers.Robust()):
        got = {(r["window"], r["series_id"]): (r["low"], r["high"]) for r in scalers.fit_scaler(df, calendar, scaler).collect()}
        want = {}
        for window, n in ends.items():
            for name, values in table.items():
                known = np.array(values[: max(0, n - (32 if name == "late" else 0))])
                if len(known):
                    want[window, name] = pytest.approx(plain[scaler.name](known), rel=1e-9)
        assert got == want
        low, high = got[0, "flat"]
        assert low == 3.0 and high == low
    params = scalers.fit_scaler(df, calendar, scaler)
    restored = invert_minmax(apply_minmax(df.withColumn("window", F.lit(0)), params), params, "value")
    assert {(r["series_id"], r["time_index"]): r["value"] for r in restored.collect()} == {
        (r["series_id"], r["time_index"]): pytest.approx(r["value"]) for r in df.collect() if (0, r["series_id"]) in want
    }


@pytest.mark.parametrize("scaler", [scalers.Standard(), scalers.Robust()], ids=lambda s: s.name)
def test_a_scaler_can_be_plugged_into_a_global_model(spark, scaler):
    rng = random.Random(10)
    df = long_frame(spark, {f"s{i}": [10 * (i + 1) + rng.random() + (t % 3) for t in range(40)] for i in range(4)})
    cfg = BacktestConfig(windows=2, use_validation=False)
    calendar = pin_calendar(window_calendar(df, cfg))
    model = GlobalDirect(lookback=3, scaler=scaler, instance_norm=False)
    actual = {(r["series_id"], r["time_index"]): r["value"] for r in df.collect()}
    rows = model.forecast(df, calendar, cfg).collect()
    assert len(rows) == 2 * 4 * 3
    assert all(abs(r["forecast"] - actual[r["series_id"], r["time_index"]]) < 2 for r in rows)


def test_scalers_compute_what_they_share_once(spark):
    """Mean and sorted values are bound, not computed anew for every element or neighbour."""
    values = [float((7 * i) % 31) for i in range(200)]
    row = spark.createDataFrame([(values,)], "v array<double>")
    for scaler, shared, times, want in (
        (scalers.Standard(), "aggregate(", 2, (np.mean(values), np.std(values))),
        (scalers.Robust(), "array_sort(", 1, (np.median(values), np.subtract(*np.quantile(values, (0.75, 0.25))))),
    ):
        offset, width = scaler.limits(F.col("v"))
        assert str(width).count(shared) == times
        assert tuple(row.select(offset, width).first()) == pytest.approx(want, rel=1e-12)
