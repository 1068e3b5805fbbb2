"""Result files, summaries and chart frames, over the backtest of two models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.catalog import fixtures as fx
from demandloom.catalog import query
from demandloom.catalog import scoring as sc
from demandloom.catalog.fixtures import sql
from demandloom.functions.lists import list_text, parse_list
from demandloom.operators import analysis as ops
from demandloom.plans.storage import scratch_path
from demandloom.sources.results import (
    read_results,
    read_saved,
    read_series_results,
    read_window_results,
    write_results,
)

WINDOW = (*sc.SUPPLIER_PAIRS, sc.WAPE_SQL, sc.WINDOW_RESULT_SQL)
SERIES = (*sc.SUPPLIER_PAIRS, sc.APE_SQL, sc.SERIES_RESULT_SQL)
WIDE_WAPE = ", ".join(f"wape_per_period[{i}] AS wape_f{i}" for i in (1, 2, 3))


def _wide_lists(*names: str) -> str:
    return ", ".join(f"{n}[{i}] AS {n}_f{i}" for n in names for i in (1, 2, 3))


WIDE_WINDOW_SQL = f"wide AS (SELECT * EXCLUDE (wape_per_period), {WIDE_WAPE} FROM window_res)"
WIDE_SERIES_SQL = f"""wide AS (SELECT * EXCLUDE (ape, actual_values, forecast_values),
  {_wide_lists('ape', 'actual_values', 'forecast_values')} FROM series_res)"""
STEPS = "range(1, 4) t(k)"


def window_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Window results with one WAPE column per step."""
    frame = sc.results(spark, sf).window_table()
    return ops.expand_list(frame, "wape_per_period", "wape", fx.LOCAL.horizon)


def series_frame(spark: SparkSession, sf: str, *lists: str) -> DataFrame:
    """Series results with the chosen lists expanded."""
    frame = sc.results(spark, sf).series_table()
    for name in lists:
        frame = ops.expand_list(frame, name, length=fx.LOCAL.horizon)
    return frame


def _saved_csv(spark: SparkSession, sf: str) -> str:
    """A folder with both result tables of the backtest as CSV."""
    folder = scratch_path(spark, "results")
    result = sc.results(spark, sf)
    write_results(result.window_table(False), result.series_table(False), folder, "local_models", sc.DATE, csv=True)
    return folder


_WINDOW_FIELDS = """backtest_date, model, "window", base_date, retrained, forecast_start, forecast_end,
  avg_wape_across_periods, model_hyperparameters"""
_SERIES_FIELDS = """backtest_date, model, series_index, series_name, "window", base_date, retrained,
  forecast_start, forecast_end, mape, model_hyperparameters"""


@query(sql(*WINDOW, WIDE_WINDOW_SQL, f"SELECT {_WINDOW_FIELDS}, wape_f1, wape_f2, wape_f3 FROM wide"))
def load_window_results(spark: SparkSession, sf: str) -> DataFrame:
    return read_window_results(spark, _saved_csv(spark, sf), expand=True)


_APE_ACTUAL = "ape_f1, ape_f2, ape_f3, actual_values_f1, actual_values_f2, actual_values_f3"


@query(sql(*SERIES, WIDE_SERIES_SQL, f"SELECT {_SERIES_FIELDS}, {_APE_ACTUAL} FROM wide"))
def load_series_results(spark: SparkSession, sf: str) -> DataFrame:
    table = read_series_results(spark, _saved_csv(spark, sf), ("ape", "actual_values"))
    return table.drop("forecast_values")


@query(
    sql(
        *SERIES,
        sc.WAPE_SQL,
        sc.WINDOW_RESULT_SQL,
        """SELECT s.model, s."window", w.avg_wape_across_periods, count(*) AS n_series,
  round(sum(s.ape[1]), 6) AS total_ape_f1, round(avg(w.wape_per_period[1]), 6) AS wape_f1
FROM series_res s JOIN window_res w ON w.model = s.model AND w."window" = s."window" GROUP BY ALL""",
    )
)
def load_all_results(spark: SparkSession, sf: str) -> DataFrame:
    windows, series = read_results(spark, _saved_csv(spark, sf), ["ape"])
    per_window = series.groupBy("model", "window").agg(
        F.count(F.lit(1)).alias("n_series"), F.round(F.sum("ape_f1"), 6).alias("total_ape_f1")
    )
    return per_window.join(
        windows.select("model", "window", "avg_wape_across_periods", "wape_f1"), ["model", "window"]
    )


@query(
    sql(
        *SERIES,
        """SELECT model, series_name, "window", mape, ape[1] AS ape_f1, len(actual_values) AS n_steps
FROM series_res WHERE model = 'AR1'""",
    )
)
def save_results_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Saved as Parquet by model; reading one model touches its files only."""
    result = sc.results(spark, sf)
    folder = scratch_path(spark, "saved")
    _, path = write_results(result.window_table(False), result.series_table(False), folder, "local_models", sc.DATE)
    one = read_saved(spark, path).filter(F.col("model") == "AR1")
    return one.select(
        "model", "series_name", "window", "mape", F.element_at("ape", 1).alias("ape_f1"),
        F.size("actual_values").cast("long").alias("n_steps"),
    )


@query(
    sql(
        *SERIES,
        """SELECT model, series_name, "window", k AS step, actual_values[k] AS actual, ape[k] AS ape
FROM series_res, range(1, 4) t(k) WHERE k <= len(ape)""",
    )
)
def parse_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists written as text in both notations and parsed back."""
    frame = sc.results(spark, sf).series_table()
    comma = list_text(F.col("actual_values"))
    spaced = F.regexp_replace(list_text(F.col("ape")), ",", " ")
    text = frame.select("model", "series_name", "window", comma.alias("_a"), spaced.alias("_e"))
    zipped = F.arrays_zip(parse_list(F.col("_a")).alias("a"), parse_list(F.col("_e")).alias("e"))
    long = text.select("model", "series_name", "window", F.posexplode(zipped).alias("step", "_z"))
    return long.select(
        "model", "series_name", "window", (F.col("step") + 1).cast("long").alias("step"),
        F.col("_z.a").alias("actual"), F.col("_z.e").alias("ape"),
    )


@query(sql(*WINDOW, WIDE_WINDOW_SQL, "SELECT * FROM wide"))
def expand_lists(spark: SparkSession, sf: str) -> DataFrame:
    return ops.expand_list(sc.results(spark, sf).window_table(), "wape_per_period", "wape")


@query(
    sql(
        *SERIES,
        """SELECT DISTINCT 'model' AS item, model AS entry FROM series_res
UNION ALL SELECT DISTINCT 'base_date', CAST(base_date AS VARCHAR) FROM series_res
UNION ALL SELECT DISTINCT 'forecast_start', CAST(forecast_start AS VARCHAR) FROM series_res
UNION ALL SELECT DISTINCT 'forecast_end', CAST(forecast_end AS VARCHAR) FROM series_res
UNION ALL SELECT DISTINCT 'series_name', series_name FROM series_res""",
    )
)
def results_overview(spark: SparkSession, sf: str) -> DataFrame:
    frame = sc.results(spark, sf).series_table()
    return ops.overview(frame, ["model", "base_date", "forecast_start", "forecast_end", "series_name"])


@query(
    sql(
        *WINDOW,
        WIDE_WINDOW_SQL,
        "SELECT model, round(avg(avg_wape_across_periods), 4) AS avg_wape, "
        "round(stddev_samp(avg_wape_across_periods), 4) AS std_avg_wape, "
        + ", ".join(
            f"round(avg(wape_f{i}), 4) AS wape_f{i}, round(stddev_samp(wape_f{i}), 4) AS std_wape_f{i}"
            for i in (1, 2, 3)
        )
        + " FROM wide GROUP BY 1",
    )
)
def wape_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.wape_summary(window_frame(spark, sf))


@query(
    sql(
        *SERIES,
        """SELECT model, round(avg(mape), 4) AS "mean_MAPE", round(stddev_samp(mape), 4) AS "std_MAPE",
  round(min(mape), 4) AS "min_MAPE", round(quantile_cont(mape, 0.25), 4) AS "p25_MAPE",
  round(median(mape), 4) AS "median_MAPE", round(quantile_cont(mape, 0.75), 4) AS "p75_MAPE",
  round(max(mape), 4) AS "max_MAPE" FROM series_res GROUP BY 1""",
    )
)
def mape_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.mape_summary(sc.results(spark, sf).series_table())


MELTED_SQL = """melted AS (
  SELECT model, "window", base_date, CAST(k AS INTEGER) AS step, 'F' || k AS label, wape_per_period[k] AS wape
  FROM window_res, range(1, 4) t(k))"""


@query(sql(*WINDOW, MELTED_SQL, "SELECT * FROM melted"))
def melt_horizons(spark: SparkSession, sf: str) -> DataFrame:
    return ops.melt_horizons(window_frame(spark, sf), ["model", "window", "base_date"], "wape_f", "wape")


@query(sql(*WINDOW, MELTED_SQL, 'SELECT label, step, count(*) AS n FROM melted GROUP BY 1, 2'))
def horizon_label(spark: SparkSession, sf: str) -> DataFrame:
    long = ops.melt_horizons(window_frame(spark, sf), ["model", "window"], "wape_f", "wape")
    return long.groupBy("label", "step").agg(F.count(F.lit(1)).alias("n")).orderBy("step")


def _box_sql(value: str, source: str) -> str:
    return f"""q AS (
  SELECT model, quantile_cont({value}, 0.25) AS q1, median({value}) AS med, quantile_cont({value}, 0.75) AS q3
  FROM {source} GROUP BY 1),
placed AS (
  SELECT m.model, {value} AS v, q1, med, q3,
    {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM {source} m JOIN q ON q.model = m.model WHERE {value} IS NOT NULL)"""


@query(
    sql(
        *WINDOW,
        MELTED_SQL,
        _box_sql("wape", "melted"),
        """SELECT model, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median,
  round(any_value(q3), 6) AS q3, min(v) FILTER (WHERE inside) AS whisker_low,
  max(v) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outside
FROM placed GROUP BY 1""",
    )
)
def box_frame(spark: SparkSession, sf: str) -> DataFrame:
    frame = ops.box_frame(window_frame(spark, sf))
    return frame.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(sql(*WINDOW, "SELECT model, base_date, avg_wape_across_periods FROM window_res"))
def evolution_frame(spark: SparkSession, sf: str) -> DataFrame:
    return ops.evolution_frame(sc.results(spark, sf).window_table())


@query(sql(*WINDOW, MELTED_SQL, "SELECT model, step, label, round(avg(wape), 6) AS mean_wape FROM melted GROUP BY 1, 2, 3"))
def horizon_means(spark: SparkSession, sf: str) -> DataFrame:
    return ops.horizon_means(window_frame(spark, sf)).withColumn("mean_wape", F.round("mean_wape", 6))


APE_LONG_SQL = """ape_long AS (
  SELECT model, series_name, "window", ape[k] AS ape FROM series_res, range(1, 4) t(k) WHERE ape[k] IS NOT NULL)"""


@query(
    sql(
        *SERIES,
        APE_LONG_SQL,
        """SELECT model, min(ape) AS min_ape, round(quantile_cont(ape, 0.25), 6) AS q1,
  round(median(ape), 6) AS median, round(quantile_cont(ape, 0.75), 6) AS q3, max(ape) AS max_ape, count(*) AS n
FROM ape_long GROUP BY 1""",
    )
)
def ape_distribution(spark: SparkSession, sf: str) -> DataFrame:
    frame = ops.ape_distribution(series_frame(spark, sf, "ape"))
    return frame.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    sql(
        *SERIES,
        APE_LONG_SQL,
        """SELECT model, CAST(floor(ape / 0.05) AS BIGINT) AS bin, count(*) AS n FROM ape_long GROUP BY 1, 2""",
    )
)
def ape_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return ops.ape_histogram(series_frame(spark, sf, "ape"), 0.05)


SCATTER_SQL = """scatter AS (
  SELECT model, series_name, "window", CAST(k AS INTEGER) AS step, 'F' || k AS forecast_step,
    actual_values[k] AS actual, forecast_values[k] AS forecast FROM series_res, range(1, 4) t(k))"""


def _scatter(spark: SparkSession, sf: str) -> DataFrame:
    return ops.actual_vs_forecast(series_frame(spark, sf, "actual_values", "forecast_values"))


@query(
    sql(
        *SERIES,
        SCATTER_SQL,
        """SELECT model, series_name, "window", step, forecast_step, actual, round(forecast, 4) AS forecast FROM scatter""",
    )
)
def actual_vs_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _scatter(spark, sf).withColumn("forecast", F.round("forecast", 4))


@query(
    sql(
        *SERIES,
        SCATTER_SQL,
        "SELECT round(greatest(max(actual), max(forecast)) + 100, 4) AS axis_limit FROM scatter",
    )
)
def scatter_limits(spark: SparkSession, sf: str) -> DataFrame:
    every = ops.scatter_frame(_scatter(spark, sf))
    return ops.scatter_limit(every).withColumn("axis_limit", F.round("axis_limit", 4))


CUTOFF = "2001-05-01"
TIMELINE_SQL = f"""timeline AS (
  SELECT model, series_name, base_date, "window", CAST(k AS INTEGER) AS step, forecast_values[k] AS forecast_value,
    CAST(forecast_start + (k - 1) * INTERVAL 1 MONTH AS DATE) AS forecast_period FROM series_res, range(1, 4) t(k))"""


def _timeline(spark: SparkSession, sf: str, cutoff: str | None = None) -> DataFrame:
    return ops.forecast_timeline(series_frame(spark, sf, "forecast_values"), cutoff=cutoff)


@query(
    sql(
        *SERIES,
        TIMELINE_SQL,
        f"""SELECT * EXCLUDE (forecast_value), round(forecast_value, 4) AS forecast_value
FROM timeline WHERE forecast_period >= DATE '{CUTOFF}'""",
    )
)
def forecast_timeline(spark: SparkSession, sf: str) -> DataFrame:
    ordered = ops.ordered_timeline(_timeline(spark, sf, CUTOFF))
    return ordered.withColumn("forecast_value", F.round("forecast_value", 4))


@query(
    sql(
        fx.SUPPLIER_ALL_SQL,
        fx.FILLED_SQL,
        """SELECT series_id AS series_name, time_index AS period, value AS actual
FROM filled WHERE time_index >= DATE '2000-01-01'""",
    )
)
def history_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return ops.history_from(fx.supplier_series(spark, sf, whole=True), "2000-01-01")


@query(
    sql(
        *SERIES,
        TIMELINE_SQL,
        """SELECT * EXCLUDE (forecast_value), round(forecast_value, 4) AS forecast_value FROM timeline
WHERE series_name = '7' AND model = 'AR1' AND step IN (1, 3)""",
    )
)
def timeline_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The chart's own selection of one series and model, at two of its steps."""
    chosen = ops.timeline_slice(_timeline(spark, sf), "7", "AR1", [1, 3])
    return chosen.withColumn("forecast_value", F.round("forecast_value", 4))
