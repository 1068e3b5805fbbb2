import math
import random

import pytest
from conftest import as_rows, long_frame, month
from pyspark.sql import functions as F

from demandloom.config import SeriesSpec
from demandloom.operators import series as ops
from demandloom.sources.demand import read_covariates, read_demand


def test_roles_follow_prefixes_and_switches():
    columns = ["series_id", "static_a", "past_b", "future_c", "pastry"]
    found = ops.roles(columns, use_past=False)
    assert found.static == ("static_a",) and found.past == () and found.future == ("future_c",)
    assert ops.roles(columns).past == ("past_b",)


def test_gap_of_three_months_is_filled_inside_own_span_only(spark):
    df = long_frame(spark, {"a": [1, None, None, None, 5], "b": [2, 3]}, {"b": 7})
    filled = ops.fill_months(df)
    assert as_rows(filled, "series_id", "time_index", "value") == [
        ("a", month(0), 1.0), ("a", month(1), 0.0), ("a", month(2), 0.0), ("a", month(3), 0.0),
        ("a", month(4), 5.0), ("b", month(7), 2.0), ("b", month(8), 3.0),
    ]


def test_missing_values_become_the_constant(spark):
    df = long_frame(spark, {"a": [1, math.nan, None, 4]})
    assert [r[0] for r in as_rows(ops.fill_months(df, fill=-1.0).orderBy("time_index"), "value")] == [-1.0, -1.0, 1.0, 4.0]


def test_filled_count_is_the_sum_of_spans(spark):
    random.seed(3)
    histories = {f"s{i}": [random.choice([None, 1, 2]) for _ in range(30)] + [1] for i in range(20)}
    df = long_frame(spark, histories)
    spans = df.groupBy("series_id").agg(
        (F.months_between(F.max("time_index"), F.min("time_index")) + 1).alias("n")
    )
    assert ops.fill_months(df).count() == spans.agg(F.sum("n")).first()[0]


def test_monthly_totals_do_not_depend_on_how_rows_are_split(spark):
    df = long_frame(spark, {"a": [4, 6], "b": [8]})
    halves = df.withColumn("value", F.col("value") / 2)
    assert as_rows(ops.monthly_totals(halves.unionByName(halves)), "series_id", "value") == as_rows(
        ops.monthly_totals(df), "series_id", "value"
    )


def test_wide_needs_one_axis_and_round_trips(spark):
    with pytest.raises(ValueError, match="one time axis"):
        ops.to_wide(long_frame(spark, {"a": [1, 2], "b": [1]}))
    df = long_frame(spark, {"a": [1, 2], "b": [3, 4]})
    back = ops.to_long(ops.to_wide(df))
    assert as_rows(back, *df.columns) == as_rows(df, *df.columns)


def test_static_dim_reports_conflicts(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, None)]
    df = spark.createDataFrame(rows, "series_id string, static_n int, static_t string")
    dim = {r["series_id"]: r["static_consistent"] for r in ops.static_dim(df).collect()}
    assert dim == {"a": True, "b": False}


def test_dense_index_matches_sort_order_over_many_partitions(spark):
    names = [f"k{i:04d}" for i in range(500)]
    shuffled = random.Random(1).sample(names * 2, 1000)
    df = spark.createDataFrame([(n,) for n in shuffled], "k string").repartition(7)
    assert as_rows(ops.dense_index(df, "k", "i"), "k", "i") == [(n, i) for i, n in enumerate(names)]


def test_shared_covariates_fill_their_own_gap(spark):
    rows = [(month(0), 1.0, 1), (month(3), 4.0, 4)]
    cov = spark.createDataFrame(rows, "time_index date, past_x double, future_m int")
    got = as_rows(ops.shared_covariates(cov, use_future=False), "time_index", "past_x")
    assert got == [(month(0), 1.0), (month(1), 0.0), (month(2), 0.0), (month(3), 4.0)]


def test_profile_counts_series_and_axes(spark):
    df = long_frame(spark, {"a": [1, 2], "b": [1, 2], "c": [1]})
    row = ops.profile(df).first()
    assert (row["n_series"], row["n_rows"], row["start_months"]) == (3, 5, "2000-01-01")
    assert row["end_months"] == "2000-01-01,2000-02-01"


def test_readers_rename_prune_and_push_down(spark, tmp_path):
    path = str(tmp_path / "demand")
    spark.sql(
        "SELECT 'a' AS id, timestamp_ntz'2000-01-17 10:00:00' AS ts, 3.0D AS qty, 1 AS static_k, 2 AS past_p"
    ).write.parquet(path)
    spec = SeriesSpec("id", "ts", "qty")
    df = read_demand(spark, path, spec, use_past=False, before="2000-02-01", as_float32=True)
    assert df.columns == ["series_id", "time_index", "value", "static_k"]
    assert dict(df.dtypes)["value"] == "float" and df.first()["time_index"] == month(0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts" in plan and "past_p" not in plan
    cov = read_covariates(spark, path, "ts")
    assert cov.columns == ["time_index", "past_p"]


def test_the_month_of_the_latest_line_is_left_out(spark):
    from demandloom.operators.series import before_last_month

    lines = spark.sql("SELECT id, timestamp_ntz'2001-09-15' + make_interval(0, 0, 0, id * 20) AS time_index FROM range(4)")
    kept = before_last_month(lines)
    assert as_rows(kept, "id") == [(0,), (1,), (2,)]
    assert before_last_month(lines.limit(0)).count() == 0
