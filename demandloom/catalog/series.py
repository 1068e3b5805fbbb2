"""Loading, series construction, covariates, wide and long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.catalog import query
from demandloom.catalog import fixtures as fx
from demandloom.catalog.fixtures import sql
from demandloom.config import SeriesSpec
from demandloom.operators import series as ops
from demandloom.sources.demand import read_covariates, read_demand

SUPPLIER_SPEC = SeriesSpec("l_suppkey", "l_shipdate", "l_quantity")
COVARIATES_SQL = """cov AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS time_index, count(*) AS past_orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS past_revenue
  FROM orders GROUP BY 1)"""


@query(
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS series_id,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS time_index, l_quantity AS value
FROM lineitem"""
)
def load_demand(spark: SparkSession, sf: str) -> DataFrame:
    return read_demand(spark, f"{sf}/lineitem.parquet", SUPPLIER_SPEC)


def month_covariates(spark: SparkSession, sf: str) -> DataFrame:
    revenue = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    totals = {"past_orders": F.count(F.lit(1)), "past_revenue": revenue}
    return read_covariates(spark, f"{sf}/orders.parquet", "o_orderdate", totals)


@query(sql(COVARIATES_SQL, "SELECT *, CAST(month(time_index) AS INTEGER) AS future_month FROM cov"))
def load_covariates(spark: SparkSession, sf: str) -> DataFrame:
    return month_covariates(spark, sf).withColumn("future_month", F.month("time_index"))


@query(
    sql(fx.BRAND_FULL_ALL_SQL, "SELECT series_id, time_index, value, past_lines, past_avg_discount FROM demand")
)
def select_by_role(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.brand_month(spark, sf, full=True, whole=True)
    return ops.select_roles(table, ops.roles(table.columns, use_future=False), "value")


@query(
    f"""SELECT {fx._MONTH} AS time_index, count(*) AS n_lines,
  count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days
FROM lineitem GROUP BY 1"""
)
def month_index(spark: SparkSession, sf: str) -> DataFrame:
    month = fx.month_start(F.col("l_shipdate")).alias("time_index")
    days = F.countDistinct(F.col("l_shipdate").cast("date"))
    return (
        fx.lineitem(spark, sf, "l_shipdate", whole=True)
        .groupBy(month)
        .agg(F.count(F.lit(1)).alias("n_lines"), days.alias("n_days"))
    )


@query(sql(fx.BRAND_ALL_SQL, "SELECT * FROM demand"))
def demand_series(spark: SparkSession, sf: str) -> DataFrame:
    return fx.brand_month(spark, sf, whole=True)


def _part_lines(spark: SparkSession, sf: str) -> DataFrame:
    spec = SeriesSpec("l_partkey", "l_shipdate", "l_quantity")
    return read_demand(spark, f"{sf}/lineitem.parquet", spec, truncate=False)


@query(sql(fx.PART_ALL_SQL, fx.FILLED_SQL, "SELECT series_id, time_index FROM filled"))
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return ops.fill_months(ops.monthly_totals(_part_lines(spark, sf)), ()).select(
        "series_id", "time_index"
    )


@query(
    sql(
        fx.PART_ALL_SQL,
        fx.FILLED_SQL,
        """SELECT series_id, count(*) AS n_months, sum(value) AS total,
  count(*) FILTER (WHERE value = 0) AS n_zero FROM filled GROUP BY 1""",
    )
)
def gap_fill_value(spark: SparkSession, sf: str) -> DataFrame:
    filled = ops.demand_series(_part_lines(spark, sf))
    return filled.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.sum("value").alias("total"),
        F.count(F.when(F.col("value") == 0, 1)).alias("n_zero"),
    )


@query(
    sql(
        fx.BRAND_FULL_ALL_SQL,
        fx.filled_sql(
            "coalesce(d.past_lines, 0) AS past_lines, coalesce(d.past_avg_discount, 0) AS past_avg_discount"
        ),
        "SELECT series_id, time_index, CAST(past_lines AS DOUBLE) AS past_lines, past_avg_discount FROM filled",
    )
)
def past_covariates(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.brand_month(spark, sf, full=True, whole=True)
    return ops.covariate_series(table, "past")


@query(
    sql(
        fx.BRAND_FULL_ALL_SQL,
        fx.filled_sql(
            "coalesce(d.future_month, 0) AS future_month, coalesce(d.future_quarter, 0) AS future_quarter"
        ),
        """SELECT series_id, time_index, CAST(future_month AS DOUBLE) AS future_month,
  CAST(future_quarter AS DOUBLE) AS future_quarter FROM filled""",
    )
)
def future_covariates(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.brand_month(spark, sf, full=True, whole=True)
    return ops.covariate_series(table, "future")


# the columns that SQL has to name; the query finds them in the data
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    sql(
        fx.BRAND_ALL_SQL,
        fx.FILLED_SQL,
        "SELECT time_index, "
        + ", ".join(f"max(value) FILTER (WHERE series_id = '{b}') AS \"{b}\"" for b in BRANDS)
        + " FROM filled GROUP BY 1",
    )
)
def to_multivariate(spark: SparkSession, sf: str) -> DataFrame:
    return ops.to_wide(fx.brand_series(spark, sf, whole=True), check_axis=False)


@query(
    sql(
        COVARIATES_SQL,
        """limits AS (SELECT min(time_index) AS a, max(time_index) AS b FROM cov),
spine AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS time_index FROM limits)""",
        """SELECT time_index, CAST(coalesce(past_orders, 0) AS DOUBLE) AS past_orders,
  coalesce(past_revenue, 0) AS past_revenue
FROM spine LEFT JOIN cov USING (time_index)""",
    )
)
def shared_covariates(spark: SparkSession, sf: str) -> DataFrame:
    return ops.shared_covariates(month_covariates(spark, sf))


def static_part(spark: SparkSession, sf: str) -> DataFrame:
    return fx.part(spark, sf, "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice").select(
        F.col("p_partkey").cast("string").alias("series_id"),
        F.col("p_brand").alias("static_brand"),
        F.col("p_type").alias("static_type"),
        F.col("p_size").alias("static_size"),
        F.col("p_retailprice").alias("static_price"),
    )


@query(
    f"""SELECT CAST(p_partkey AS VARCHAR) AS series_id, p_brand AS static_brand, p_type AS static_type,
  p_size AS static_size, p_retailprice AS static_price, true AS static_consistent
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)"""
)
def static_covariates(spark: SparkSession, sf: str) -> DataFrame:
    keys = fx.lineitem(spark, sf, "l_partkey", whole=True).select(
        F.col("l_partkey").cast("string").alias("series_id")
    )
    return ops.static_dim(static_part(spark, sf).join(keys.distinct(), "series_id", "left_semi"))


@query(
    sql(
        fx.SUPPLIER_ALL_SQL,
        fx.FILLED_SQL,
        "SELECT series_id, time_index, CAST(value AS FLOAT) AS value FROM filled",
    )
)
def cast_float32(spark: SparkSession, sf: str) -> DataFrame:
    return ops.demand_series(fx.supplier_lines(spark, sf, whole=True), as_float32=True)


@query(sql(fx.BRAND_ALL_SQL, fx.FILLED_SQL, "SELECT series_id, time_index, value FROM filled"))
def to_univariate(spark: SparkSession, sf: str) -> DataFrame:
    return ops.to_long(ops.to_wide(fx.brand_series(spark, sf, whole=True), check_axis=False))


@query(
    sql(
        fx.PART_ALL_SQL,
        fx.FILLED_SQL,
        """SELECT (SELECT count(*) FROM span) AS n_series, (SELECT count(*) FROM span) AS n_components,
  (SELECT count(*) FROM filled) AS n_rows,
  (SELECT string_agg(DISTINCT CAST(a AS VARCHAR), ',' ORDER BY CAST(a AS VARCHAR)) FROM span) AS start_months,
  (SELECT string_agg(DISTINCT CAST(b AS VARCHAR), ',' ORDER BY CAST(b AS VARCHAR)) FROM span) AS end_months""",
    )
)
def series_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ops.profile(ops.demand_series(_part_lines(spark, sf)))
