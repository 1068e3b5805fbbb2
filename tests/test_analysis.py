import random

import numpy as np
import pytest
from conftest import as_rows, month
from pyspark.sql import functions as F

from demandloom.functions.lists import list_text, parse_list
from demandloom.operators import analysis as ops
from demandloom.sources.results import read_results, read_series_results, read_window_results

WINDOW_CSV = '''backtest_date,model,window,base_date,retrained,forecast_start,forecast_end,avg_wape_across_periods,wape_per_period,model_hyperparameters
20200101_0000,M1,0,2001-01-01,True,2001-02-01,2001-04-01,0.2,"[0.1, 0.2, 0.3]","{'a': 1, 'b': ""x""}"
20200101_0000,M1,1,2001-02-01,,2001-03-01,2001-04-01,0.15,"[0.1, 0.2]","{'a': 1}"
'''
SERIES_CSV = '''backtest_date,model,series_index,series_name,window,base_date,retrained,forecast_start,forecast_end,mape,ape,actual_values,forecast_values,model_hyperparameters
20200101_0000,M1,0,s1,0,2001-01-01,True,2001-02-01,2001-04-01,0.3,[0.40 0.13  0.59 ],"[1.0, 2.0, 3.0]","[1.5, 2.5, 0.0]",{}
20200101_0000,M2,3,s2,0,2001-01-01,False,2001-02-01,2001-04-01,0.2,[0.1 nan],"[4.0, 5.0]","[4.0, 6.0]",{}
'''


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("results")
    (path / "r1_window_results.csv").write_text(WINDOW_CSV)
    (path / "r1_series_results.csv").write_text(SERIES_CSV)
    return str(path)


def test_window_reader_handles_quotes_blanks_and_ragged_lists(spark, folder):
    rows = read_window_results(spark, folder, expand=True).orderBy("window").collect()
    assert rows[0]["model_hyperparameters"] == "{'a': 1, 'b': \"x\"}" and rows[1]["retrained"] is None
    assert [rows[1][f"wape_f{i}"] for i in (1, 2, 3)] == [0.1, 0.2, None]


def test_series_reader_takes_both_notations(spark, folder):
    table = read_series_results(spark, folder)
    assert as_rows(table.fillna(-1.0), "series_name", "ape_f1", "ape_f2", "ape_f3") == [
        ("s1", 0.4, 0.13, 0.59), ("s2", 0.1, -1.0, -1.0),
    ]
    kept = read_series_results(spark, folder, ["ape"])
    assert "actual_values" in kept.columns and "ape_f3" in kept.columns
    windows, series = read_results(spark, folder)
    assert windows.count() == 2 and series.count() == 2


def test_lists_round_trip(spark):
    df = spark.createDataFrame([([1.5, None, 2.0],), ([],)], "a array<double>")
    assert [r[0] for r in df.select(parse_list(list_text(F.col("a")))).collect()] == [[1.5, None, 2.0], []]


def test_quantiles_are_exact_with_ties_and_one_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot", 1.0, i) for i in range(3000)] + [("hot", rng.random(), i) for i in range(1500)]
    rows += [(f"g{i % 5}", rng.gauss(0, 1), i) for i in range(333)] + [("one", 7.0, 0), ("hot", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, id int").repartition(6)
    probabilities = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["p"]): r["quantile"] for r in ops.exact_quantiles(df, "g", "v", probabilities).collect()}
    for g in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == g and r[1] is not None]
        for p in probabilities:
            assert got[(g, p)] == pytest.approx(np.quantile(values, p), abs=1e-12)


def _wide(spark):
    rows = [("m", i, month(i), float(i), *[float(i * 100 + k) for k in range(1, 13)]) for i in range(3)]
    columns = ", ".join(f"wape_f{k} double" for k in range(1, 13))
    return spark.createDataFrame(rows, f"model string, window int, base_date date, avg_wape_across_periods double, {columns}")


def test_more_than_nine_steps_keep_their_numbers(spark):
    long = ops.melt_horizons(_wide(spark), ["window"], "wape_f")
    assert as_rows(long.filter("window = 1"), "step", "label", "value")[-1] == (12, "F12", 112.0)
    assert ops.horizon_means(_wide(spark)).count() == 12


def test_missing_columns_are_errors(spark):
    wide = _wide(spark)
    for bad in (
        lambda: ops.melt_horizons(wide, ["model"], "mase_f"),
        lambda: ops.evolution_frame(wide, y="nothing"),
        lambda: ops.actual_vs_forecast(wide),
        lambda: ops.wape_summary(wide, mode="all"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_wape_summary_modes(spark):
    wide = _wide(spark)
    assert ops.wape_summary(wide, mode="avg").columns == ["model", "avg_wape", "std_avg_wape"]
    per = ops.wape_summary(wide, mode="per_period")
    assert per.columns[:2] == ["model", "wape_f1"] and len(per.columns) == 25
    assert ops.wape_summary(wide).first()["std_avg_wape"] == 1.0


def test_box_whiskers_stop_at_the_last_point_inside(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    rows = [("m", i, v) for i, v in enumerate(values)]
    box = ops.box_frame(spark.createDataFrame(rows, "model string, window int, wape_f1 double")).first()
    assert (box["q1"], box["median"], box["q3"]) == (2.0, 3.0, 4.0)
    assert (box["whisker_low"], box["whisker_high"], box["n_outside"]) == (1.0, 4.0, 1)


def test_timeline_months_and_slices(spark):
    rows = [("m", "s", month(0), 0, month(1), 5.0, 6.0)]
    df = spark.createDataFrame(
        rows, "model string, series_name string, base_date date, window int, forecast_start date, "
        "forecast_values_f1 double, forecast_values_f2 double",
    )
    line = ops.forecast_timeline(df)
    assert as_rows(line, "step", "forecast_period", "forecast_value") == [(1, month(1), 5.0), (2, month(2), 6.0)]
    assert ops.forecast_timeline(df, cutoff="2000-03-01").count() == 1
    assert ops.is_empty(ops.timeline_slice(line, "s", "other", [1]))
    assert not ops.is_empty(ops.timeline_slice(line, "s", "m", [2]))
    assert ("step", "2") in as_rows(ops.timeline_choices(line), "item", "entry")
