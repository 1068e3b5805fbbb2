"""Scaling, encoding, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.catalog import fixtures as fx
from demandloom.catalog import query
from demandloom.catalog.fixtures import sql
from demandloom.catalog.series import COVARIATES_SQL, month_covariates, static_part
from demandloom.config import BacktestConfig
from demandloom.operators import lookback as lb
from demandloom.operators import samples as smp
from demandloom.operators import scalers
from demandloom.operators import scaling as ops
from demandloom.operators import series as series_ops
from demandloom.operators.windows import split

SUPPLIERS = (fx.SUPPLIER_SQL, fx.FILLED_SQL, fx.CAL_SQL)

_FIT_SQL = """fit AS (
  SELECT c."window", series_id, min(value) AS low, max(value) AS high
  FROM filled JOIN cal c ON time_index <= train_end_date GROUP BY 1, 2)"""
_WIDTH = "CASE WHEN high = low THEN 1 ELSE high - low END"


@query(
    sql(
        fx.BRAND_FULL_SQL,
        fx.filled_sql("coalesce(d.value, 0) AS value, coalesce(d.past_lines, 0) AS past_lines"),
        fx.CAL_SQL,
        """SELECT c."window", series_id, 'value' AS variable, min(value) AS low, max(value) AS high
FROM filled JOIN cal c ON time_index <= train_end_date GROUP BY ALL
UNION ALL SELECT c."window", series_id, 'past_lines', min(past_lines), max(past_lines)
FROM filled JOIN cal c ON time_index <= train_end_date GROUP BY ALL""",
    )
)
def minmax_fit(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.brand_month(spark, sf, full=True)
    filled = series_ops.fill_months(table, ["value", "past_lines"])
    return ops.fit_minmax(filled, fx.brand_calendar(spark, sf), ["value", "past_lines"])


@query(
    sql(
        *SUPPLIERS,
        _FIT_SQL,
        f"""SELECT c."window", f.series_id, f.time_index, (f.value - low) / ({_WIDTH}) AS value
FROM filled f JOIN cal c ON f.time_index BETWEEN c.forecast_start AND c.forecast_end
JOIN fit ON fit."window" = c."window" AND fit.series_id = f.series_id""",
    )
)
def minmax_apply(spark: SparkSession, sf: str) -> DataFrame:
    return ops.scale_split(fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf), "test")


@query(
    sql(
        *SUPPLIERS,
        """SELECT c."window", f.series_id, f.time_index, f.value,
  round(f.value, 6) AS restored
FROM filled f JOIN cal c ON f.time_index BETWEEN c.forecast_start AND c.forecast_end""",
    )
)
def minmax_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Scale the test split with stored parameters and restore it."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf)
    params = ops.fit_minmax(series, calendar)
    test = split(series, calendar, "test").withColumn("restored", F.col("value"))
    scaled = ops.apply_minmax(test, params, "restored")
    back = ops.invert_minmax(scaled, params, "restored")
    return back.withColumn("restored", F.round("restored", 6)).select(
        "window", "series_id", "time_index", "value", "restored"
    )


_SCALERS_SQL = """known AS (
  SELECT c."window", series_id, CAST(value AS DOUBLE) AS v FROM filled JOIN cal c ON time_index <= train_end_date),
params AS (
  SELECT 'standard' AS scaler, "window", series_id, avg(v) AS low, avg(v) + stddev_pop(v) AS high FROM known GROUP BY ALL
  UNION ALL
  SELECT 'robust', "window", series_id, quantile_cont(v, 0.5),
    quantile_cont(v, 0.5) + quantile_cont(v, 0.75) - quantile_cont(v, 0.25) FROM known GROUP BY ALL)"""
_SCALERS = (scalers.Standard(), scalers.Robust())


@query(sql(*SUPPLIERS, _SCALERS_SQL, 'SELECT scaler, "window", series_id, round(low, 6) AS low, round(high, 6) AS high FROM params'))
def scaler_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation, median and quartile distance of every window's train months."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf)
    parts = [_fitted(series, calendar, s) for s in _SCALERS]
    return parts[0].unionByName(parts[1])


def _fitted(series: DataFrame, calendar: DataFrame, scaler: scalers.Scaler) -> DataFrame:
    fitted = scalers.fit_scaler(series, calendar, scaler)
    rounded = [F.round(c, 6).alias(c) for c in ("low", "high")]
    return fitted.select(F.lit(scaler.name).alias("scaler"), "window", "series_id", *rounded)


@query(
    sql(
        *SUPPLIERS,
        _SCALERS_SQL,
        """SELECT p.scaler, p."window", p.series_id, f.time_index, round((f.value - low) / (CASE WHEN high = low THEN 1 ELSE high - low END), 6) AS scaled,
  round(f.value, 6) AS restored
FROM params p JOIN cal c ON c."window" = p."window"
JOIN filled f ON f.series_id = p.series_id AND f.time_index BETWEEN c.forecast_start AND c.forecast_end""",
    )
)
def scaler_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The test split scaled with either scaler's parameters and restored."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf)
    test = split(series, calendar, "test")
    parts = []
    for scaler in _SCALERS:
        params = scalers.fit_scaler(series, calendar, scaler)
        scaled = ops.apply_minmax(test, params).withColumnRenamed("value", "scaled")
        back = ops.invert_minmax(scaled.withColumn("restored", F.col("scaled")), params, "restored")
        rounded = [F.round(c, 6).alias(c) for c in ("scaled", "restored")]
        parts.append(back.select(F.lit(scaler.name).alias("scaler"), "window", "series_id", "time_index", *rounded))
    return parts[0].unionByName(parts[1])


@query(
    """WITH lim AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS series_id,
  CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS static_brand,
  CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS static_type,
  (p_size - a) / CAST(b - a AS DOUBLE) AS static_size, (p_retailprice - c) / (d - c) AS static_price
FROM part, lim"""
)
def static_encode(spark: SparkSession, sf: str) -> DataFrame:
    return ops.encode_static(
        static_part(spark, sf),
        numeric=["static_size", "static_price"],
        categorical=["static_brand", "static_type"],
    )


@query(
    sql(
        fx.SUPPLIER_ALL_SQL,
        fx.FILLED_SQL,
        """stats AS (
  SELECT *, avg(value) OVER w AS chunk_mean, sqrt(var_pop(value) OVER w + 1e-5) AS chunk_std, count(*) OVER w AS n
  FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY time_index ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""",
        """SELECT series_id, time_index, value, round(chunk_mean, 6) AS chunk_mean, round(chunk_std, 6) AS chunk_std,
  round((value - chunk_mean) / chunk_std, 6) AS value_norm FROM stats WHERE n = 12""",
    )
)
def instance_norm(spark: SparkSession, sf: str) -> DataFrame:
    normed = ops.instance_norm(fx.supplier_series(spark, sf, whole=True), 12)
    rounded = ("chunk_mean", "chunk_std", "value_norm")
    return normed.withColumns({c: F.round(c, 6) for c in rounded})


_LAGS = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in range(6))
_TARGETS = ", ".join(f"lead(value, {1 + h}) OVER w AS y_{h}" for h in (1, 2, 3))
_W = "WINDOW w AS (PARTITION BY series_id ORDER BY time_index)"
_SAMPLE_SQL = f"""samples AS (
  SELECT series_id, time_index, CAST(time_index + 4 * INTERVAL 1 MONTH AS DATE) AS sample_end,
    row_number() OVER w AS rn, {_LAGS}, {_TARGETS} FROM filled {_W})"""


@query(
    sql(
        *SUPPLIERS,
        _SAMPLE_SQL,
        """SELECT c."window", s.* EXCLUDE (rn) FROM samples s
JOIN cal c ON sample_end <= train_end_date WHERE rn >= 6""",
    )
)
def sliding_samples(spark: SparkSession, sf: str) -> DataFrame:
    samples = smp.make_samples(fx.supplier_series(spark, sf), lookback=6, horizon=3, shift=1)
    return smp.train_samples(samples, fx.supplier_calendar(spark, sf))


_CHUNK_SQL = """lengths AS (
  SELECT c."window", series_id, count(*) AS n FROM filled JOIN cal c ON time_index <= train_end_date GROUP BY 1, 2),
chunks AS (SELECT "window", CAST(sum(greatest(0, n - 12 + 1)) AS BIGINT) AS total_chunks FROM lengths GROUP BY 1)"""


@query(sql(*SUPPLIERS, _CHUNK_SQL, "SELECT * FROM chunks"))
def chunk_count(spark: SparkSession, sf: str) -> DataFrame:
    return smp.chunk_count(fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf), 12)


@query(
    sql(
        *SUPPLIERS,
        _CHUNK_SQL,
        "SELECT *, CAST(ceil(total_chunks / 256.0) AS BIGINT) * 300 + 1 AS total_steps FROM chunks",
    )
)
def step_budget(spark: SparkSession, sf: str) -> DataFrame:
    chunks = smp.chunk_count(fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf), 12)
    return smp.step_budget(chunks, batch_size=256, epochs=300)


_BRAND_STATIC = """brand_static AS (
  SELECT p_brand AS series_id, avg(p_size) AS static_mean_size FROM part GROUP BY 1)"""
_AHEAD = ", ".join(f"lead(future_month, {1 + h}) OVER w AS future_month_h{h}" for h in (1, 2, 3))


@query(
    sql(
        fx.BRAND_FULL_SQL,
        fx.filled_sql(
            """coalesce(d.value, 0) AS value, CAST(coalesce(d.past_lines, 0) AS DOUBLE) AS past_lines,
    coalesce(d.past_avg_discount, 0) AS past_avg_discount,
    CAST(coalesce(d.future_month, 0) AS DOUBLE) AS future_month"""
        ),
        fx.CAL_SQL,
        _BRAND_STATIC,
        f"""samples AS (
  SELECT series_id, time_index, CAST(time_index + 4 * INTERVAL 1 MONTH AS DATE) AS sample_end,
    row_number() OVER w AS rn, {_LAGS}, past_lines, past_avg_discount, {_AHEAD}, {_TARGETS} FROM filled {_W})""",
        """SELECT c."window", s.* EXCLUDE (rn), static_mean_size FROM samples s
JOIN cal c ON sample_end <= train_end_date JOIN brand_static USING (series_id) WHERE rn >= 6""",
    )
)
def sample_features(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.brand_month(spark, sf, full=True).drop("future_quarter")
    names = [c for c in table.columns if c not in ("series_id", "time_index")]
    filled = series_ops.fill_months(table, names)
    found = series_ops.roles(filled.columns)
    samples = smp.make_samples(filled, lookback=6, horizon=3, shift=1, found=found)
    train = smp.train_samples(samples, fx.brand_calendar(spark, sf))
    dim = fx.part(spark, sf, "p_brand", "p_size").groupBy(F.col("p_brand").alias("series_id")).agg(
        F.avg("p_size").alias("static_mean_size")
    )
    return smp.attach_static(train, dim, ["static_mean_size"])


def shared_sql(lookback: int, shift: int, horizon: int) -> str:
    """Lags and leads of the shared covariates at every month, NULL outside their months."""
    lags = [f"lag({c}, {k}) OVER m AS shared_{c}_lag_{k}" for c in ("past_orders", "past_revenue") for k in range(lookback)]
    leads = [f"lead(future_month, {shift + h}) OVER m AS shared_future_month_h{h}" for h in range(1, horizon + 1)]
    return f"""ends AS (SELECT min(time_index) AS a, max(time_index) AS b FROM cov),
months AS (
  SELECT CAST(unnest(generate_series(a - INTERVAL 60 MONTH, b + INTERVAL 60 MONTH, INTERVAL 1 MONTH)) AS DATE) AS time_index, a, b
  FROM ends),
shared AS (
  SELECT time_index, CAST(coalesce(past_orders, 0) AS DOUBLE) AS past_orders, coalesce(past_revenue, 0) AS past_revenue,
    CAST(CASE WHEN past_orders IS NULL THEN 0 ELSE month(time_index) END AS DOUBLE) AS future_month
  FROM months LEFT JOIN cov USING (time_index) WHERE time_index BETWEEN a AND b),
around AS (
  SELECT time_index, {", ".join(lags + leads)}
  FROM months LEFT JOIN shared USING (time_index) WINDOW m AS (ORDER BY time_index))"""


def own_sql(lookback: int, shift: int, horizon: int, past=("past_lines", "past_avg_discount"), future=("future_month",)) -> str:
    """Lags and leads of a series' own columns."""
    cells = [f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in ("value", *past) for k in range(lookback)]
    cells += [f"lead({c}, {shift + h}) OVER w AS {c}_h{h}" for c in future for h in range(1, horizon + 1)]
    cells += [f"lead(value, {shift + h}) OVER w AS y_{h}" for h in range(1, horizon + 1)]
    return f"""samples AS (
  SELECT series_id, time_index, CAST(time_index + {shift + horizon} * INTERVAL 1 MONTH AS DATE) AS sample_end,
    row_number() OVER w AS rn, {", ".join(cells)} FROM filled {_W})"""


COVARIATE_COLUMNS = """CAST(coalesce(d.value, 0) AS DOUBLE) AS value, CAST(coalesce(d.past_lines, 0) AS DOUBLE) AS past_lines,
    coalesce(d.past_avg_discount, 0) AS past_avg_discount, CAST(coalesce(d.future_month, 0) AS DOUBLE) AS future_month"""


def shared_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and revenue by month, gap-filled, with the month known in advance."""
    table = month_covariates(spark, sf).withColumn("future_month", F.month("time_index"))
    return series_ops.shared_covariates(table)


@query(
    sql(
        fx.BRAND_FULL_ALL_SQL,
        fx.filled_sql(COVARIATE_COLUMNS),
        COVARIATES_SQL,
        shared_sql(4, 1, 2),
        own_sql(4, 1, 2),
        "SELECT s.* EXCLUDE (rn), a.* EXCLUDE (time_index) FROM samples s JOIN around a USING (time_index) WHERE rn >= 4",
    )
)
def sample_lookback(spark: SparkSession, sf: str) -> DataFrame:
    """Own and shared covariates over the whole lookback, from month-indexed arrays."""
    table = fx.brand_month(spark, sf, full=True, whole=True).drop("future_quarter")
    names = [c for c in table.columns if c not in ("series_id", "time_index")]
    samples = lb.lookback_samples(series_ops.fill_months(table, names), 4, 2, 1, shared_table(spark, sf))
    return lb.as_columns(samples)


@query(sql(*SUPPLIERS, 'SELECT c."window", f.* FROM filled f JOIN cal c ON f.time_index <= c.train_end_date'))
def scaling_off(spark: SparkSession, sf: str) -> DataFrame:
    """Scaling switched off: the train split keeps its units."""
    cfg = BacktestConfig(scale=False)
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, cfg)
    params = ops.fit_minmax(series, calendar) if cfg.scale else None
    return ops.apply_minmax(split(series, calendar, "train"), params)
