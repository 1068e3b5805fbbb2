import pytest
from conftest import as_rows, long_frame, month
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models.closed_form import OneLagAR, SeasonalNaive
from demandloom.operators import alignment as al
from demandloom.operators import metrics
from demandloom.operators.windows import retrain_flags, window_calendar
from demandloom.plans.backtest import backtest

PAIRS = "model string, window int, series_id string, time_index date, actual double, forecast double"


def pairs_of(spark, *rows):
    return spark.createDataFrame([("m", *r) for r in rows], PAIRS)


def test_zero_totals_and_zero_actuals_are_undefined(spark):
    pairs = pairs_of(
        spark,
        (0, "a", month(0), 0.0, 3.0), (0, "b", month(0), 0.0, 1.0),
        (0, "a", month(1), 10.0, 8.0), (0, "b", month(1), 0.0, 1.0),
        (1, "a", month(1), 10.0, 5.0), (1, "b", month(1), 10.0, 20.0),
    )
    periods = metrics.wape(pairs)
    assert as_rows(periods.filter("wape IS NOT NULL"), "window", "wape") == [(0, 0.3), (1, 0.75)]
    assert {r["window"]: r["avg_wape_across_periods"] for r in metrics.avg_wape(periods).collect()} == {0: None, 1: 0.75}
    mape = {(r["window"], r["series_id"]): (r["mape"], r["n_undefined"]) for r in metrics.mape(pairs).collect()}
    assert mape[(0, "a")] == (pytest.approx(0.2), 1) and mape[(0, "b")] == (None, 2)


def test_wape_ignores_row_order_and_splitting(spark):
    rows = [(0, f"s{i}", month(i % 3), float(i + 1), float(i * 2)) for i in range(30)]
    one = metrics.wape(pairs_of(spark, *rows))
    other = metrics.wape(pairs_of(spark, *reversed(rows)).repartition(7))
    close = lambda f: [(w, t, pytest.approx(x)) for w, t, x in as_rows(f, "window", "time_index", "wape")]
    assert as_rows(one, "window", "time_index", "wape") == close(other)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(al.clip_nonneg(F.col("x"))).collect()] == [0.0, 2.0, None]


def test_missing_and_unpaired_predictions_fail(spark):
    demand = long_frame(spark, {"a": range(40), "b": range(40)})
    cfg = BacktestConfig(windows=2, use_validation=False)
    calendar = window_calendar(demand, cfg)
    truth = al.actuals(demand, calendar)
    predicted = SeasonalNaive().forecast(demand, calendar, cfg)
    al.assert_aligned(truth, predicted, ["SeasonalNaive"])
    al.assert_paired(truth, predicted)
    holes = predicted.filter(~((F.col("series_id") == "b") & (F.col("window") == 1)))
    assert al.alignment_gaps(truth, holes, ["SeasonalNaive"]).count() == 3
    with pytest.raises(al.AlignmentError):
        al.assert_aligned(truth, holes, ["SeasonalNaive"])
    with pytest.raises(al.AlignmentError):
        al.assert_paired(truth, holes)


def test_result_tables_are_consistent_with_each_other(spark):
    demand = long_frame(spark, {"a": [5 + i % 12 for i in range(40)], "b": [i * i % 17 for i in range(40)]})
    cfg = BacktestConfig(windows=3, use_validation=False)
    calendar = window_calendar(demand, cfg)
    result = backtest(demand, calendar, [SeasonalNaive(), OneLagAR()], cfg, retrain=True,
                      hyperparameters={"AR1": "{'lags': 1}"})
    series = result.series_table().collect()
    assert [r["model"] for r in series] == sorted(r["model"] for r in series)
    assert {(r["series_name"], r["series_index"]) for r in series} == {("a", 0), ("b", 1)}
    for r in series:
        assert min(r["forecast_values"]) >= 0
        for a, f, e in zip(r["actual_values"], r["forecast_values"], r["ape"]):
            assert (e is None and a == 0) or e == pytest.approx(abs(a - f) / a, abs=1e-6)
        defined = [e for e in r["ape"] if e is not None]
        assert r["mape"] == pytest.approx(sum(defined) / len(defined), abs=2e-6)
    for r in result.window_table().collect():
        assert r["avg_wape_across_periods"] == pytest.approx(sum(r["wape_per_period"]) / 3, abs=2e-6)
        assert r["retrained"] is True
        assert r["model_hyperparameters"] == ("{'lags': 1}" if r["model"] == "AR1" else "{}")


def test_window_results_write_false_when_not_retrained(spark):
    pairs = pairs_of(spark, (0, "a", month(1), 1.0, 1.0), (1, "a", month(2), 1.0, 1.0))
    demand = long_frame(spark, {"a": range(30)})
    flags = retrain_flags(window_calendar(demand, BacktestConfig(windows=2)), False)
    table = metrics.window_results(pairs, flags, "d")
    assert as_rows(table, "window", "retrained") == [(0, True), (1, False)]
