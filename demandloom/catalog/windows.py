"""Calendar, splits and retrain schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.catalog import query
from demandloom.catalog import fixtures as fx
from demandloom.catalog.fixtures import sql
from demandloom.config import BacktestConfig
from demandloom.operators import series as series_ops
from demandloom.operators import windows as ops

SUPPLIERS = (fx.SUPPLIER_SQL, fx.FILLED_SQL, fx.CAL_SQL)
THREE_TUNING = BacktestConfig(tuning_windows=3)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        """SELECT CAST(min(b) - 8 * INTERVAL 1 MONTH AS DATE) AS backtest_start, min(b) AS min_end FROM span""",
    )
)
def backtest_start(spark: SparkSession, sf: str) -> DataFrame:
    return ops.backtest_start(fx.supplier_lines(spark, sf), BacktestConfig())


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        """SELECT CAST(min(b) - 8 * INTERVAL 1 MONTH AS DATE) AS backtest_start,
  CAST(min(b) - 14 * INTERVAL 1 MONTH AS DATE) AS tuning_start, min(b) AS min_end FROM span""",
    )
)
def tuning_start(spark: SparkSession, sf: str) -> DataFrame:
    starts = ops.backtest_start(fx.supplier_lines(spark, sf), THREE_TUNING)
    return ops.tuning_start(starts, THREE_TUNING)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.calendar_sql(BacktestConfig(tuning_windows=12), "tuning", "tuning"),
        fx.CAL_SQL,
        """early AS (
  SELECT CAST(min(base_date) - 3 * INTERVAL 1 MONTH AS DATE) AS backtest_start FROM cal)""",
        """SELECT t."window", t.forecast_start, t.forecast_end, backtest_start
FROM tuning t JOIN early ON t.forecast_end >= backtest_start""",
    )
)
def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    """Against a backtest moved three months earlier, so that some tuning windows do leak."""
    lines = fx.supplier_lines(spark, sf)
    tuning = ops.window_calendar(lines, BacktestConfig(tuning_windows=12), "tuning")
    backtest = ops.window_calendar(lines, BacktestConfig())
    early = backtest.withColumn("base_date", F.add_months("base_date", -3))
    return ops.leakage_rows(tuning, early)


@query(sql(*SUPPLIERS, "SELECT * FROM cal"))
def window_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return ops.window_calendar(fx.supplier_lines(spark, sf), BacktestConfig())


def _split(which: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ops.split(fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf), which)

    return run


_SELECT = 'SELECT c."window", f.series_id, f.time_index, f.value FROM filled f JOIN cal c ON '


@query(sql(*SUPPLIERS, _SELECT + "f.time_index <= c.train_end_date"))
def split_train(spark: SparkSession, sf: str) -> DataFrame:
    return _split("train")(spark, sf)


@query(sql(*SUPPLIERS, _SELECT + "f.time_index <= c.validation_end_date"))
def split_validation(spark: SparkSession, sf: str) -> DataFrame:
    return _split("validation")(spark, sf)


@query(sql(*SUPPLIERS, _SELECT + "f.time_index BETWEEN c.forecast_start AND c.forecast_end"))
def split_test(spark: SparkSession, sf: str) -> DataFrame:
    return _split("test")(spark, sf)


@query(
    sql(
        fx.BRAND_FULL_SQL,
        fx.filled_sql("coalesce(d.future_month, 0) AS future_month"),
        fx.CAL_SQL,
        """SELECT c."window", f.series_id, f.time_index, CAST(f.future_month AS DOUBLE) AS future_month
FROM filled f JOIN cal c ON f.time_index <= c.forecast_end""",
    )
)
def split_future_cov(spark: SparkSession, sf: str) -> DataFrame:
    months = fx.brand_month(spark, sf, full=True).select("series_id", "time_index", "future_month")
    future = series_ops.covariate_series(months, "future")
    return ops.split(future, fx.brand_calendar(spark, sf), "future")


_ALL_COLUMNS = """coalesce(d.value, 0) AS value, coalesce(d.past_lines, 0) AS past_lines,
    coalesce(d.past_avg_discount, 0) AS past_avg_discount, coalesce(d.future_month, 0) AS future_month,
    coalesce(d.future_quarter, 0) AS future_quarter"""


@query(
    sql(
        fx.BRAND_FULL_SQL,
        fx.filled_sql(_ALL_COLUMNS),
        fx.CAL_SQL,
        """vars AS (
  SELECT 'main' AS role, 'value' AS variable, series_id, time_index, CAST(value AS DOUBLE) AS value FROM filled
  UNION ALL SELECT 'past', 'past_lines', series_id, time_index, past_lines FROM filled
  UNION ALL SELECT 'past', 'past_avg_discount', series_id, time_index, past_avg_discount FROM filled
  UNION ALL SELECT 'future', 'future_month', series_id, time_index, future_month FROM filled
  UNION ALL SELECT 'future', 'future_quarter', series_id, time_index, future_quarter FROM filled),
tagged AS (
  SELECT c."window", 'train' AS split, v.* FROM vars v JOIN cal c ON time_index <= train_end_date
  UNION ALL SELECT c."window", 'validation', v.* FROM vars v JOIN cal c ON time_index <= validation_end_date
  UNION ALL SELECT c."window", 'test', v.* FROM vars v JOIN cal c
    ON CASE WHEN role = 'future' THEN time_index <= forecast_end
       ELSE time_index BETWEEN forecast_start AND forecast_end END)""",
        """SELECT "window", split, role, variable, count(*) AS n_rows, round(sum(value), 4) AS total
FROM tagged GROUP BY ALL""",
    )
)
def split_all_counts(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.brand_month(spark, sf, full=True)
    names = [c for c in table.columns if c not in ("series_id", "time_index")]
    filled = series_ops.fill_months(table, names)
    found = series_ops.roles(filled.columns)
    tagged = ops.split_all(
        filled.select("series_id", "time_index", "value"),
        fx.brand_calendar(spark, sf),
        filled.select("series_id", "time_index", *found.past),
        filled.select("series_id", "time_index", *found.future),
    )
    return tagged.groupBy("window", "split", "role", "variable").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total")
    )


@query(sql(*SUPPLIERS, 'SELECT *, "window" % 3 = 0 AS retrained FROM cal'))
def retrain_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return ops.retrain_flags(window_calendar(spark, sf), 3)


@query(
    sql(
        *SUPPLIERS,
        'SELECT *, "window" % 4 = 0 AS retrained, "window" - "window" % 4 AS model_window FROM cal',
    )
)
def model_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return ops.model_of_window(ops.retrain_flags(window_calendar(spark, sf), 4))
