from datetime import datetime

import pytest
from conftest import as_rows, long_frame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models.closed_form import SeasonalNaive

from demandloom.operators import tuning as ops
from demandloom.plans.study import tune_and_backtest

TRIALS = ("study_name string, trial_number int, params map<string,string>, value double, "
          "wape_by_window array<double>, started timestamp, completed timestamp")  # fmt: skip


def study(spark, *rows):
    start = datetime(2001, 1, 1)
    return spark.createDataFrame(
        [(s, n, p, v, [v], start, datetime(2001, 1, 1, 0, n + 1)) for s, n, p, v in rows], TRIALS
    )


@pytest.fixture(scope="module")
def trials(spark):
    return study(
        spark,
        ("A_utc_1", 0, {"x": "1", "m": "p"}, 0.5), ("A_utc_1", 1, {"x": "2", "m": "q"}, 0.3),
        ("A_utc_1", 2, {"x": "3", "m": "p"}, None), ("A_utc_2", 0, {"x": "9", "m": "q"}, 0.2),
        ("B_utc_1", 0, {"x": "5", "m": "p"}, 0.1),
    )


SPACE = {
    "cat": {"type": "categorical", "values": [3, 6, 12]},
    "int": {"type": "int", "low": 1, "high": 3},
    "flt": {"type": "float", "low": 0.05, "high": 0.6},
    "log": {"type": "float", "low": 1e-5, "high": 1e-1, "log": True},
}


def test_trials_are_repeatable_and_inside_the_space(spark):
    space = ops.search_space(spark, SPACE)
    drawn = ops.make_trials(space, 50, 7)
    assert as_rows(drawn, *drawn.columns) == as_rows(ops.make_trials(space, 50, 7), *drawn.columns)
    assert as_rows(drawn, *drawn.columns) != as_rows(ops.make_trials(space, 50, 8), *drawn.columns)
    values = {}
    for r in drawn.collect():
        values.setdefault(r["name"], []).append(r["param_value"])
    assert set(values["cat"]) == {"3", "6", "12"} and set(values["int"]) == {"1", "2", "3"}
    assert all(0.05 <= float(v) <= 0.6 for v in values["flt"])
    logs = [float(v) for v in values["log"]]
    assert all(1e-5 <= v <= 1e-1 for v in logs) and sum(v < 1e-3 for v in logs) > 10
    with pytest.raises(ValueError):
        ops.search_space(spark, {"x": {"type": "set"}})


def test_later_entries_override(spark):
    merged = ops.override_space(
        ops.search_space(spark, SPACE),
        ops.search_space(spark, {"int": {"type": "int", "low": 5, "high": 6}, "new": {"type": "int", "low": 0, "high": 1}}),
    )
    assert as_rows(merged.filter("type = 'int'"), "name", "low") == [("int", 5.0), ("new", 0.0)]
    packed = ops.pack_trials(ops.make_trials(merged, 2, 1)).collect()
    assert len(packed) == 2 and set(packed[0]["params"]) == {"cat", "int", "flt", "log", "new"}


def test_appending_continues_each_study(spark, trials, tmp_path):
    path = str(tmp_path / "study")
    assert ops.read_study(spark, path) is None
    ops.append_trials(trials, path)
    ops.append_trials(trials.filter("study_name = 'A_utc_1'"), path)
    stored = as_rows(ops.read_study(spark, path), "study_name", "trial_number")
    assert [n for s, n in stored if s == "A_utc_1"] == [0, 1, 2, 3, 4, 5]
    assert [n for s, n in stored if s == "B_utc_1"] == [0]


def test_best_trial_rules(spark, trials):
    pick = lambda **k: ops.best_trial(trials, **k).first()["value"]
    assert pick(model_name="A") == 0.2 and pick(model_name="A", rank=1) == 0.3
    assert pick(model_name="A", rank=9) == 0.2 and pick(study_name="A_utc_1") == 0.3
    assert pick(model_name="A", direction="maximize") == 0.5
    assert ops.best_trial(trials, study_name="none").count() == 0
    with pytest.raises(ValueError):
        ops.best_trial(trials)
    with pytest.raises(ValueError):
        ops.best_trial(trials, model_name="A", direction="up")


def test_top_trials_and_summary(spark, trials):
    top = as_rows(ops.top_trials(trials, 1), "study_name", "trial_number", "rank", "duration_seconds")
    assert top == [("A_utc_1", 1, 0, 120.0), ("A_utc_2", 0, 0, 60.0), ("B_utc_1", 0, 0, 60.0)]
    summary = as_rows(ops.study_summary(trials), "study_name", "n_trials", "best_value", "best_trial")
    assert summary[0] == ("A_utc_1", 2, 0.3, 1)


def test_params_resolve_to_trial_or_defaults(spark, trials):
    defaults = spark.createDataFrame([("x", "0"), ("k", "1")], "name string, param_value string")
    best = ops.best_trial(trials, model_name="A")
    got = as_rows(ops.resolve_params(defaults, best), "name", "param_value", "origin")
    assert got == [("k", "1", "default"), ("m", "q", "trial"), ("x", "9", "trial")]
    none = ops.best_trial(trials, model_name="Z")
    assert as_rows(ops.resolve_params(defaults, none), "name", "param_value") == [("k", "1"), ("x", "0")]


def test_importance_finds_the_parameter_that_matters(spark):
    rows = [("S", i, {"good": str(i % 2), "noise": str(i // 2 % 2)}, 0.1 + 0.5 * (i % 2)) for i in range(8)]
    got = dict(as_rows(ops.param_importance(study(spark, *rows)), "name", "importance"))
    assert got["good"] == pytest.approx(1.0) and got["noise"] == pytest.approx(0.0)


def test_tuned_backtest_uses_the_best_trial_and_resumes(spark, tmp_path):
    """Seasons of 12 months: the trial with season 12 must win over 5 and 7."""
    demand = long_frame(spark, {s: [10 + (t * 7 + k) % 12 for t in range(60)] for k, s in enumerate("ab")})
    cfg = BacktestConfig(windows=2, tuning_windows=2, use_validation=False)
    build = lambda p: SeasonalNaive(season=int(p["season"]), name="Naive")
    space = ops.search_space(spark, {"season": {"type": "categorical", "values": [5, 7, 12]}})
    path = str(tmp_path / "study")
    run = lambda n: tune_and_backtest(
        demand, demand, cfg, build, space, {"season": "5"}, n, "Naive", "20200101_0000", path
    )
    plain = run(0).window_table().collect()
    assert plain[0]["model_hyperparameters"] == "{'season': '5'}" and plain[0]["avg_wape_across_periods"] > 0
    tuned = run(8).window_table().collect()
    assert {r["avg_wape_across_periods"] for r in tuned} == {0.0}
    assert tuned[0]["model_hyperparameters"] == "{'season': '12'}"
    again = run(0).window_table().collect()
    assert again[0]["model_hyperparameters"] == "{'season': '12'}"
    stored = ops.read_study(spark, path)
    assert stored.count() == 8 and stored.filter(F.col("value").isNull()).count() == 0
    # a resumed study draws on, and the trials' own times are stored
    run(4)
    rows = ops.read_study(spark, path).orderBy("trial_number").collect()
    assert [r["trial_number"] for r in rows] == list(range(12))
    space = ops.search_space(spark, {"season": {"type": "categorical", "values": [5, 7, 12]}})
    drawn = ops.make_trials(space, 12, cfg.random_state).orderBy("trial_number").collect()
    assert [r["params"]["season"] for r in rows] == [r["param_value"] for r in drawn]
    assert all(a["completed"] <= b["started"] for a, b in zip(rows, rows[1:]))
    assert all(r["completed"] > r["started"] for r in rows)
    # a named study, its rank and direction
    worst = tune_and_backtest(
        demand, demand, cfg, build, space, {"season": "5"}, 0, "Naive", "x", path,
        study_name="Naive_utc_20200101_0000", direction="maximize",
    )
    assert worst.window_table().first()["model_hyperparameters"] != "{'season': '12'}"
