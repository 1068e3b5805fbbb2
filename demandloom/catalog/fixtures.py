"""Demand series derived from the shared tables, in Spark and in SQL.

Series are brands (through part) or suppliers (straight from lineitem).  Loading and series
construction read every line; a backtest leaves out the month of the latest line, which is unfinished
(``BacktestConfig.drop_last_month``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.functions.months import month_start
from demandloom.operators.series import fill_months, finished_lines
from demandloom.operators.windows import pin_calendar, window_calendar

LOCAL = BacktestConfig(use_validation=False)
GLOBAL = BacktestConfig(retrain=3)
TUNING = BacktestConfig(use_validation=False, tuning_windows=3)


def lineitem(spark: SparkSession, sf: str, *columns, whole: bool = False) -> DataFrame:
    """Lines that a backtest of the default settings reads, or all of them."""
    table = spark.read.parquet(f"{sf}/lineitem.parquet")
    return (table if whole else finished_lines(table, LOCAL, "l_shipdate")).select(*columns)


def part(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select(*columns)


def with_brand(spark: SparkSession, sf: str, lines: DataFrame, totals, again) -> DataFrame:
    """Lines joined to their brand and aggregated by brand and ``lines``' other keys.

    Lines are totalled per part first (``totals``, combined by ``again``), so a part that holds a third
    of all lines joins as a few dozen rows; how the totals meet the parts is left to Spark.
    """
    brands = part(spark, sf, "p_partkey", F.col("p_brand").alias("series_id"))
    on = F.col("l_partkey") == F.col("p_partkey")
    keys = [c for c in ("time_index",) if c in lines.columns]
    per_part = lines.groupBy("l_partkey", *keys).agg(*totals)
    return per_part.join(brands, on).groupBy("series_id", *keys).agg(*again)


def brand_month(spark: SparkSession, sf: str, full: bool = False, whole: bool = False) -> DataFrame:
    """One row per brand and month that has lines."""
    totals, again = [F.sum("l_quantity").alias("value")], [F.sum("value").alias("value")]
    if full:
        # whole cents, so that the average does not depend on the order of summation
        cents = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
        totals += [F.count(F.lit(1)).alias("lines"), cents.alias("cents")]
        again += [F.sum("lines").alias("lines"), F.sum("cents").alias("cents")]
    columns = ["l_partkey", "l_quantity"] + (["l_discount"] if full else [])
    month = month_start(F.col("l_shipdate")).alias("time_index")
    lines = lineitem(spark, sf, *columns, month, whole=whole)
    out = with_brand(spark, sf, lines, totals, again)
    if not full:
        return out
    return out.select(
        "series_id", "time_index", "value", F.col("lines").alias("past_lines"),
        (F.col("cents") / F.col("lines") / 100).alias("past_avg_discount"),
        F.month("time_index").alias("future_month"), F.quarter("time_index").alias("future_quarter"),
    )


def brand_series(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return fill_months(brand_month(spark, sf, whole=whole))


def brand_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Last shipment per brand: only keys and dates are read."""
    lines = lineitem(spark, sf, "l_partkey", "l_shipdate")
    last, again = F.max("l_shipdate").alias("last"), F.max("last").alias("last")
    return with_brand(spark, sf, lines, [last], [again]).withColumnRenamed("last", "time_index")


def brand_calendar(
    spark: SparkSession, sf: str, cfg: BacktestConfig = BacktestConfig(), mode: str = "backtest"
) -> DataFrame:
    return pin_calendar(window_calendar(brand_ends(spark, sf), cfg, mode))


def supplier_lines(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return lineitem(spark, sf, "l_suppkey", "l_shipdate", "l_quantity", whole=whole).select(
        F.col("l_suppkey").cast("string").alias("series_id"),
        F.col("l_shipdate").alias("time_index"),
        F.col("l_quantity").alias("value"),
    )


def supplier_ids(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_lines(spark, sf).select("series_id").distinct()


def supplier_month(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    month = month_start(F.col("time_index")).alias("time_index")
    return supplier_lines(spark, sf, whole).groupBy("series_id", month).agg(F.sum("value").alias("value"))


def supplier_series(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return fill_months(supplier_month(spark, sf, whole))


def supplier_calendar(
    spark: SparkSession, sf: str, cfg: BacktestConfig = BacktestConfig(), mode: str = "backtest"
) -> DataFrame:
    return pin_calendar(window_calendar(supplier_lines(spark, sf), cfg, mode))


# --- the same in SQL -------------------------------------------------------------------------

_MONTH = "CAST(date_trunc('month', l_shipdate) AS DATE)"

# lines of finished months
_FINISHED = "l_shipdate < (SELECT date_trunc('month', max(l_shipdate)) FROM lineitem)"


def _brand_sql(lines: str) -> str:
    return f"""demand AS (
  SELECT p_brand AS series_id, {_MONTH} AS time_index, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {lines} GROUP BY 1, 2)"""


def _brand_full_sql(lines: str) -> str:
    return f"""demand AS (
  SELECT p_brand AS series_id, {_MONTH} AS time_index, sum(l_quantity) AS value,
    count(*) AS past_lines,
    sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100 AS past_avg_discount,
    CAST(month({_MONTH}) AS INTEGER) AS future_month,
    CAST(quarter({_MONTH}) AS INTEGER) AS future_quarter
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {lines} GROUP BY p_brand, {_MONTH})"""


def _key_sql(key: str, lines: str) -> str:
    return f"""demand AS (
  SELECT CAST({key} AS VARCHAR) AS series_id, {_MONTH} AS time_index, sum(l_quantity) AS value
  FROM lineitem WHERE {lines} GROUP BY 1, 2)"""


BRAND_SQL = _brand_sql(_FINISHED)
BRAND_FULL_SQL = _brand_full_sql(_FINISHED)
SUPPLIER_SQL = _key_sql("l_suppkey", _FINISHED)
BRAND_ALL_SQL = _brand_sql("true")
BRAND_FULL_ALL_SQL = _brand_full_sql("true")
SUPPLIER_ALL_SQL = _key_sql("l_suppkey", "true")
PART_ALL_SQL = _key_sql("l_partkey", "true")


def filled_sql(columns: str = "coalesce(d.value, 0) AS value") -> str:
    return f"""span AS (
  SELECT series_id, min(time_index) AS a, max(time_index) AS b FROM demand GROUP BY 1),
spine AS (
  SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS time_index
  FROM span),
filled AS (
  SELECT s.series_id, s.time_index, {columns}
  FROM spine s LEFT JOIN demand d ON d.series_id = s.series_id AND d.time_index = s.time_index)"""


FILLED_SQL = filled_sql()


def _shift(expr: str, months: str) -> str:
    return f"CAST({expr} + ({months}) * INTERVAL 1 MONTH AS DATE)"


def calendar_sql(
    cfg: BacktestConfig = BacktestConfig(), mode: str = "backtest", name: str = "cal"
) -> str:
    """The calendar table from ``span``."""
    h, s = cfg.horizon, cfg.shift
    back = (h + s - 1) + (cfg.windows - 1)
    count = cfg.windows
    if mode == "tuning":
        back += (h + s) + (cfg.tuning_windows - 1)
        count = cfg.tuning_windows
    start = _shift("(SELECT min(b) FROM span)", f"-{back}")
    return f"""{name}_bases AS (
  SELECT CAST(w AS INTEGER) AS "window", {_shift(start, 'w')} AS base_date
  FROM range({count}) t(w)),
{name} AS (
  SELECT "window", base_date, {_shift('base_date', f'-{cfg.train_lag}')} AS train_end_date,
    {_shift('base_date', '-1')} AS validation_end_date,
    {_shift('base_date', str(s))} AS forecast_start,
    least({_shift('base_date', str(s + h - 1))}, (SELECT min(b) FROM span)) AS forecast_end
  FROM {name}_bases)"""


CAL_SQL = calendar_sql()
LOCAL_CAL_SQL = calendar_sql(LOCAL)


def sql(*parts: str, recursive: bool = False) -> str:
    """CTEs followed by the final select."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]
