"""Alignment, metrics, result tables and the end-to-end backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.catalog import fixtures as fx
from demandloom.catalog import query
from demandloom.catalog.fixtures import sql
from demandloom.models.base import horizon_months
from demandloom.models.closed_form import LinearTrend, OneLagAR, SeasonalNaive
from demandloom.models.per_series import AutoAR, ExpSmoothing
from demandloom.operators import alignment, metrics
from demandloom.operators.scaling import apply_minmax, fit_minmax
from demandloom.operators.windows import retrain_flags
from demandloom.plans.backtest import backtest, scored_pairs

DATE = "20010101_0000"
MODELS = [SeasonalNaive(), OneLagAR()]

# forecasts of the two models, uncut and unclipped
NAIVE_SQL = """lagged AS (
  SELECT *, lag(value, 12) OVER (PARTITION BY series_id ORDER BY time_index) AS naive FROM filled),
naive_fc AS (
  SELECT 'SeasonalNaive' AS model, c."window", series_id, time_index, naive AS forecast
  FROM lagged JOIN cal c ON time_index BETWEEN forecast_start AND forecast_end)"""
AR_SQL = """xy AS (
  SELECT series_id, time_index, value AS y, lag(value) OVER (PARTITION BY series_id ORDER BY time_index) AS x
  FROM filled),
ar_sums AS (
  SELECT c."window", series_id, CAST(count(x) AS DOUBLE) AS n, sum(x) AS sx, sum(y) FILTER (WHERE x IS NOT NULL) AS sy,
    sum(x * y) AS sxy, sum(x * x) AS sxx, arg_max(y, time_index) AS last_value
  FROM xy JOIN cal c ON time_index <= validation_end_date GROUP BY 1, 2),
ar_slope AS (
  SELECT *, coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0) AS slope FROM ar_sums),
ar_fit AS (SELECT *, coalesce((sy - slope * sx) / n, last_value) AS intercept FROM ar_slope),
ar_1 AS (SELECT *, intercept + slope * last_value AS f1 FROM ar_fit),
ar_2 AS (SELECT *, intercept + slope * f1 AS f2 FROM ar_1),
ar_3 AS (SELECT *, intercept + slope * f2 AS f3 FROM ar_2),
ar_4 AS (SELECT *, intercept + slope * f3 AS f4 FROM ar_3),
ar_fc AS (
  SELECT 'AR1' AS model, a."window", series_id, CAST(forecast_start + k * INTERVAL 1 MONTH AS DATE) AS time_index,
    CASE k WHEN 0 THEN f2 WHEN 1 THEN f3 ELSE f4 END AS forecast
  FROM ar_4 a JOIN cal c ON a."window" = c."window", range(3) t(k)
  WHERE forecast_start + k * INTERVAL 1 MONTH <= forecast_end)"""
PAIRS_SQL = """pairs AS (
  SELECT p.model, p."window", p.series_id, p.time_index, f.value AS actual, greatest(p.forecast, 0) AS forecast
  FROM (SELECT * FROM naive_fc UNION ALL SELECT * FROM ar_fc) p
  JOIN filled f ON f.series_id = p.series_id AND f.time_index = p.time_index)"""
BRAND_PAIRS = (fx.BRAND_SQL, fx.FILLED_SQL, fx.LOCAL_CAL_SQL, NAIVE_SQL, AR_SQL, PAIRS_SQL)
SUPPLIER_PAIRS = (fx.SUPPLIER_SQL, fx.FILLED_SQL, fx.LOCAL_CAL_SQL, NAIVE_SQL, AR_SQL, PAIRS_SQL)
WAPE_SQL = """periods AS (
  SELECT model, "window", time_index, sum(abs(actual - forecast)) / nullif(sum(actual), 0) AS wape
  FROM pairs GROUP BY 1, 2, 3)"""
APE_SQL = """apes AS (SELECT *, abs((actual - forecast) / nullif(actual, 0)) AS ape FROM pairs)"""


def brand_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(
        fx.brand_series(spark, sf), fx.brand_calendar(spark, sf, fx.LOCAL), MODELS, fx.LOCAL
    )


def supplier_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(
        fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL), MODELS, fx.LOCAL
    )


@query(
    sql(
        *SUPPLIER_PAIRS,
        """SELECT model, "window", series_id, time_index, actual, round(forecast, 4) AS forecast FROM pairs""",
    )
)
def align_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_pairs(spark, sf).withColumn("forecast", F.round("forecast", 4))


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """SELECT 'SeasonalNaive' AS model, c."window", series_id, time_index
FROM filled JOIN cal c ON time_index = forecast_end""",
    )
)
def alignment_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts cut one month short, so the last month of every window is a gap."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL)
    short = calendar.withColumn("forecast_end", F.add_months("forecast_end", -1))
    predicted = SeasonalNaive().forecast(series, short, fx.LOCAL)
    truth = alignment.actuals(series, calendar)
    return alignment.alignment_gaps(truth, predicted, ["SeasonalNaive"])


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """SELECT c."window", series_id, time_index, 'predicted_only' AS side
FROM filled JOIN cal c ON time_index = CAST(forecast_start - INTERVAL 1 MONTH AS DATE)
UNION ALL SELECT c."window", series_id, time_index, 'actual_only'
FROM filled JOIN cal c ON time_index = forecast_end""",
    )
)
def pairing_report(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions one month early: both ends of each window stay unpaired."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL)
    early = calendar.withColumns(
        {
            "forecast_start": F.add_months("forecast_start", -1),
            "forecast_end": F.add_months("forecast_end", -1),
        }
    )
    shifted = alignment.actuals(series, early).withColumnRenamed("actual", "forecast")
    return alignment.pairing_report(alignment.actuals(series, calendar), shifted)


@query(
    sql(
        fx.SUPPLIER_ALL_SQL,
        fx.FILLED_SQL,
        """SELECT series_id, time_index, value - 20 AS forecast, greatest(value - 20, 0) AS clipped FROM filled""",
    )
)
def clip_negative(spark: SparkSession, sf: str) -> DataFrame:
    moved = fx.supplier_series(spark, sf, whole=True).select(
        "series_id", "time_index", (F.col("value") - 20).alias("forecast")
    )
    return moved.withColumn("clipped", alignment.clip_nonneg(F.col("forecast")))


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.CAL_SQL,
        NAIVE_SQL,
        """SELECT model, n."window", n.series_id, n.time_index, f.value AS actual, round(greatest(n.forecast, 0), 6) AS forecast
FROM naive_fc n JOIN filled f ON f.series_id = n.series_id AND f.time_index = n.time_index""",
    )
)
def process_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled forecasts through align, inverse scaling and clipping."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf)
    params = fit_minmax(series, calendar)
    predicted = SeasonalNaive().forecast(series, calendar, fx.GLOBAL)
    scaled = apply_minmax(predicted, params, "forecast")
    pairs = alignment.process_predictions(alignment.actuals(series, calendar), scaled, params)
    return pairs.withColumn("forecast", F.round("forecast", 6))


@query(
    sql(
        *SUPPLIER_PAIRS,
        APE_SQL,
        """SELECT model, "window", series_id, time_index, round(ape, 6) AS ape FROM apes""",
    )
)
def ape(spark: SparkSession, sf: str) -> DataFrame:
    scored = metrics.with_ape(supplier_pairs(spark, sf))
    return scored.select("model", "window", "series_id", "time_index", F.round("ape", 6).alias("ape"))


@query(
    sql(
        *SUPPLIER_PAIRS,
        APE_SQL,
        """SELECT model, "window", series_id, round(avg(ape), 6) AS mape,
  count(*) FILTER (WHERE ape IS NULL) AS n_undefined FROM apes GROUP BY 1, 2, 3""",
    )
)
def mape(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mape(supplier_pairs(spark, sf)).withColumn("mape", F.round("mape", 6))


@query(sql(*SUPPLIER_PAIRS, WAPE_SQL, 'SELECT model, "window", time_index, round(wape, 6) AS wape FROM periods'))
def wape_per_period(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.wape(supplier_pairs(spark, sf)).withColumn("wape", F.round("wape", 6))


_AVG = """CASE WHEN count(*) = count(wape) THEN round(avg(wape), 6) END AS avg_wape_across_periods"""


@query(sql(*SUPPLIER_PAIRS, WAPE_SQL, f'SELECT model, "window", {_AVG} FROM periods GROUP BY 1, 2'))
def avg_wape(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.avg_wape(metrics.wape(supplier_pairs(spark, sf)))


WINDOW_RESULT_SQL = f"""window_res AS (
  SELECT '{DATE}' AS backtest_date, p.model, p."window", c.base_date, true AS retrained,
    min(time_index) AS forecast_start, max(time_index) AS forecast_end, {_AVG},
    list(round(wape, 6) ORDER BY time_index) AS wape_per_period, '{{}}' AS model_hyperparameters
  FROM periods p JOIN cal c ON c."window" = p."window" GROUP BY ALL)"""
SERIES_RESULT_SQL = f"""idx AS (
  SELECT series_id, CAST(row_number() OVER (ORDER BY series_id) - 1 AS INTEGER) AS series_index FROM span),
series_res AS (
  SELECT '{DATE}' AS backtest_date, p.model, i.series_index, p.series_id AS series_name, p."window", c.base_date,
    true AS retrained, min(time_index) AS forecast_start, max(time_index) AS forecast_end,
    round(avg(ape), 6) AS mape, count(*) FILTER (WHERE ape IS NULL) AS n_undefined,
    list(round(ape, 6) ORDER BY time_index) AS ape, list(actual ORDER BY time_index) AS actual_values,
    list(forecast ORDER BY time_index) AS forecast_values, '{{}}' AS model_hyperparameters
  FROM apes p JOIN cal c ON c."window" = p."window" JOIN idx i ON i.series_id = p.series_id GROUP BY ALL)"""


def results(spark: SparkSession, sf: str):
    """A backtest of the two models over suppliers."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL)
    ids = fx.supplier_ids(spark, sf)
    return backtest(series, calendar, MODELS, fx.LOCAL, DATE, retrain=True, ids=ids)


@query(
    sql(
        *SUPPLIER_PAIRS,
        WAPE_SQL,
        WINDOW_RESULT_SQL,
        """SELECT * EXCLUDE (wape_per_period), unnest(wape_per_period) AS wape,
  unnest(range(1, len(wape_per_period) + 1)) AS step FROM window_res""",
    )
)
def window_results(spark: SparkSession, sf: str) -> DataFrame:
    frame = results(spark, sf).window_table()
    return frame.select("*", F.posexplode("wape_per_period").alias("step", "wape")).drop(
        "wape_per_period"
    ).withColumn("step", (F.col("step") + 1).cast("long"))


@query(
    sql(
        *SUPPLIER_PAIRS,
        APE_SQL,
        SERIES_RESULT_SQL,
        """SELECT * EXCLUDE (ape, actual_values, forecast_values), unnest(ape) AS ape,
  unnest(actual_values) AS actual, round(unnest(forecast_values), 4) AS forecast,
  unnest(range(1, len(ape) + 1)) AS step FROM series_res""",
    )
)
def series_results(spark: SparkSession, sf: str) -> DataFrame:
    frame = results(spark, sf).series_table()
    zipped = F.arrays_zip("ape", "actual_values", "forecast_values")
    lists = ("ape", "actual_values", "forecast_values")
    exploded = frame.select(
        *[c for c in frame.columns if c not in lists], F.posexplode(zipped).alias("step", "_z")
    )
    return exploded.select(
        *[c for c in exploded.columns if c not in ("step", "_z")],
        (F.col("step") + 1).cast("long").alias("step"),
        F.col("_z.ape").alias("ape"),
        F.col("_z.actual_values").alias("actual"),
        F.round("_z.forecast_values", 4).alias("forecast"),
    )


@query(
    sql(
        *SUPPLIER_PAIRS,
        APE_SQL,
        SERIES_RESULT_SQL,
        """SELECT model, series_index, series_name, "window", mape FROM series_res
ORDER BY model, series_index, "window" """,
    )
)
def ordered_results(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs gathered and ordered."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL)
    flags = retrain_flags(calendar, True)
    ids = fx.supplier_ids(spark, sf)
    runs = [
        metrics.series_results(scored_pairs(series, calendar, [m], fx.LOCAL), flags, DATE, ids=ids)
        for m in MODELS
    ]
    return metrics.order_results(runs, "series").select(
        "model", "series_index", "series_name", "window", "mape"
    )


@query(
    sql(
        fx.BRAND_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        NAIVE_SQL,
        """pairs AS (
  SELECT n.*, f.value AS actual FROM naive_fc n JOIN filled f ON f.series_id = n.series_id AND f.time_index = n.time_index)""",
        WAPE_SQL,
        f"""SELECT model, p."window", c.base_date, min(time_index) AS forecast_start, max(time_index) AS forecast_end, {_AVG}
FROM periods p JOIN cal c ON c."window" = p."window" GROUP BY ALL""",
    )
)
def backtest_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Brand demand, six windows, seasonal naive: WAPE by window."""
    series, calendar = fx.brand_series(spark, sf), fx.brand_calendar(spark, sf, fx.LOCAL)
    pairs = scored_pairs(series, calendar, [SeasonalNaive()], fx.LOCAL)
    frame = metrics.window_results(pairs, retrain_flags(calendar, True), DATE)
    return frame.select(
        "model", "window", "base_date", "forecast_start", "forecast_end", "avg_wape_across_periods"
    )


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """SELECT c."window", series_id, CAST(k - 1 AS INTEGER) AS step,
  CAST(validation_end_date + k * INTERVAL 1 MONTH AS DATE) AS time_index, value AS forecast
FROM filled f JOIN cal c ON f.time_index = c.validation_end_date, range(2, 5) t(k)
WHERE validation_end_date + k * INTERVAL 1 MONTH <= forecast_end""",
    )
)
def offset_discard(spark: SparkSession, sf: str) -> DataFrame:
    """Last value carried over shift + horizon steps, the first ``shift`` of them discarded."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL)
    last = series.select("series_id", F.col("time_index").alias("validation_end_date"), "value")
    steps = horizon_months(calendar, fx.LOCAL, with_offset=True)
    rows = last.join(F.broadcast(steps), "validation_end_date")
    kept = alignment.drop_offset(rows, fx.LOCAL.shift)
    return kept.select("window", "series_id", "step", "time_index", F.col("value").alias("forecast"))


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """SELECT m.model, c."window", count(*) AS n_pairs, CAST(sum(value) AS DOUBLE) AS actual
FROM filled f JOIN cal c ON f.time_index BETWEEN forecast_start AND forecast_end,
  (VALUES ('AR1'), ('AutoAR'), ('ExponentialSmoothing'), ('LinearTrend'), ('SeasonalNaive')) m(model) GROUP BY 1, 2""",
    )
)
def backtest_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Every model is scored on all actuals of every window: pairs with a forecast, and their sum."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL)
    models = [SeasonalNaive(), OneLagAR(), LinearTrend(), AutoAR(), ExpSmoothing()]
    pairs = scored_pairs(series, calendar, models, fx.LOCAL).where("forecast IS NOT NULL")
    return pairs.groupBy("model", "window").agg(
        F.count("*").alias("n_pairs"), F.sum("actual").cast("double").alias("actual")
    )
