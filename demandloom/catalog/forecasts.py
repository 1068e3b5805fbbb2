"""Forecasters over suppliers and brands; closed forms are checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.catalog import fixtures as fx
from demandloom.catalog import query
from demandloom.catalog import scaling as scale
from demandloom.catalog import scoring as sc
from demandloom.catalog.fixtures import sql
from demandloom.catalog.series import COVARIATES_SQL
from demandloom.models.arima import OrderLimits
from demandloom.models.closed_form import LevelSmoothing, LinearTrend, OneLagAR, SeasonalNaive
from demandloom.models.ets import FORMS, SmoothingLimits
from demandloom.models.factor import FactorModel
from demandloom.models.masked_factor import MaskedFactorModel
from demandloom.models.per_series import AutoAR, ExpSmoothing, FourierTrend
from demandloom.models.pooled import GlobalDirect, GlobalRecursive
from demandloom.operators import metrics
from demandloom.operators.series import fill_months, roles
from demandloom.operators.windows import retrain_flags
from demandloom.plans.backtest import scored_pairs

LOCAL_MODELS = [AutoAR(), ExpSmoothing(), FourierTrend()]

# a supplier without lines in the first months has no demand there, as in its gaps
FACTORS = FactorModel(before=0.0)


def _forecast(model, spark: SparkSession, sf: str, cfg=fx.LOCAL) -> DataFrame:
    rows = model.forecast(fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, cfg), cfg)
    return rows.withColumn("forecast", F.round("forecast", 4))


@query(sql(fx.SUPPLIER_SQL, fx.FILLED_SQL, fx.LOCAL_CAL_SQL, sc.NAIVE_SQL, "SELECT * FROM naive_fc"))
def fc_seasonal_naive(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(SeasonalNaive(), spark, sf)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        sc.AR_SQL,
        """SELECT model, "window", series_id, time_index, round(forecast, 4) AS forecast FROM ar_fc""",
    )
)
def fc_ar1(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(OneLagAR(), spark, sf)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """numbered AS (
  SELECT series_id, time_index, value AS y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY time_index) AS DOUBLE) AS t
  FROM filled),
sums AS (
  SELECT c."window", c.forecast_start, c.forecast_end, series_id, CAST(count(*) AS DOUBLE) AS n,
    sum(y) AS sy, sum(t) AS st, sum(t * y) AS sty, sum(t * t) AS stt
  FROM numbered JOIN cal c ON time_index <= validation_end_date GROUP BY ALL),
slopes AS (SELECT *, coalesce((n * sty - st * sy) / nullif(n * stt - st * st, 0), 0) AS slope FROM sums)""",
        """SELECT 'LinearTrend' AS model, "window", series_id, CAST(forecast_start + k * INTERVAL 1 MONTH AS DATE) AS time_index,
  round((sy - slope * st) / n + slope * (n + 2 + k), 4) AS forecast
FROM slopes, range(3) t(k) WHERE forecast_start + k * INTERVAL 1 MONTH <= forecast_end""",
    )
)
def fc_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(LinearTrend(), spark, sf)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """ordered AS (
  SELECT series_id, time_index, value, row_number() OVER (PARTITION BY series_id ORDER BY time_index) AS n FROM filled),
ses AS (
  SELECT CAST(a AS DOUBLE) / 20 AS alpha, series_id, n, time_index, CAST(value AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS sse
  FROM ordered, range(1, 20) r(a) WHERE n = 1
  UNION ALL
  SELECT alpha, s.series_id, o.n, o.time_index, alpha * o.value + (1.0::DOUBLE - alpha) * level,
    sse + (o.value - level) * (o.value - level)
  FROM ses s JOIN ordered o ON o.series_id = s.series_id AND o.n = s.n + 1),
best AS (
  SELECT c."window", c.forecast_start, c.forecast_end, series_id, level
  FROM ses JOIN cal c ON time_index = validation_end_date
  QUALIFY row_number() OVER (PARTITION BY c."window", series_id ORDER BY sse, alpha) = 1)""",
        """SELECT 'LevelSmoothing' AS model, "window", series_id,
  CAST(forecast_start + k * INTERVAL 1 MONTH AS DATE) AS time_index, round(level, 4) AS forecast
FROM best, range(3) t(k) WHERE forecast_start + k * INTERVAL 1 MONTH <= forecast_end""",
        recursive=True,
    )
)
def fc_exp_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(LevelSmoothing(), spark, sf)


@query()
def fc_auto_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(ExpSmoothing(), spark, sf)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """numbered AS (
  SELECT series_id, time_index, CAST(value AS DOUBLE) AS y, row_number() OVER (PARTITION BY series_id ORDER BY time_index) - 1 AS t FROM filled),
grid AS (
  SELECT '(A,N,N)' AS form, 0 AS place, 3 AS k, a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS phi FROM (VALUES (0.02::DOUBLE), (0.2), (0.6), (0.95)) v(a)
  UNION ALL SELECT '(A,A,N)', 1, 5, a, b, 1.0 FROM (VALUES (0.02::DOUBLE), (0.2), (0.6), (0.95)) v(a), (VALUES (0.05::DOUBLE), (0.4), (0.9)) w(b)
  UNION ALL SELECT '(A,Ad,N)', 2, 6, a, b, phi FROM (VALUES (0.02::DOUBLE), (0.2), (0.6), (0.95)) v(a), (VALUES (0.05::DOUBLE), (0.4), (0.9)) w(b),
    (VALUES (0.85::DOUBLE), (0.97)) x(phi)),
starts AS (
  SELECT series_id, avg(y) FILTER (WHERE t < 12) AS middle,
    (avg(y) FILTER (WHERE t BETWEEN 12 AND 23) - avg(y) FILTER (WHERE t < 12)) / 12 AS rise FROM numbered GROUP BY 1),
fold AS (
  SELECT s.series_id, g.*, 11::BIGINT AS t, CASE WHEN place = 0 THEN middle ELSE middle + rise * 5.5 END AS level,
    CASE WHEN place = 0 THEN 0.0 ELSE rise END AS slope, 0.0::DOUBLE AS sse FROM starts s, grid g
  UNION ALL
  SELECT f.series_id, form, place, k, a, b, phi, n.t, a * y + (1 - a) * (level + phi * slope),
    CASE WHEN place = 0 THEN 0.0 ELSE b * (a * y + (1 - a) * (level + phi * slope) - level) + (1 - b) * phi * slope END,
    sse + (y - level - phi * slope) * (y - level - phi * slope)
  FROM fold f JOIN numbered n ON n.series_id = f.series_id AND n.t = f.t + 1),
known AS (
  SELECT c."window", series_id, max(t) AS t, var_pop(y) AS spread FROM numbered JOIN cal c ON time_index <= validation_end_date GROUP BY 1, 2),
scored AS (
  SELECT k."window", f.*, f.t - 11 AS m,
    (f.t - 11) * ln(greatest(sse / (f.t - 11), 1e-10 * greatest(spread, 1e-12))) AS deviance
  FROM fold f JOIN known k ON k.series_id = f.series_id AND k.t = f.t),
likely AS (
  SELECT *, deviance + 2 * k + 2 * k * (k + 1) / greatest(m - k - 1, 0.5) AS aicc FROM scored
  QUALIFY row_number() OVER (PARTITION BY "window", series_id, place ORDER BY deviance, a, b, phi) = 1),
best AS (
  SELECT * FROM likely QUALIFY row_number() OVER (PARTITION BY "window", series_id ORDER BY aicc, place) = 1)""",
        """SELECT "window", series_id, CAST(forecast_start + h * INTERVAL 1 MONTH AS DATE) AS time_index, form,
  round(level + slope * list_sum(list_transform(range(1, h + 3), lambda j: phi ** j)), 4) AS forecast
FROM best JOIN cal USING ("window"), range(3) t(h) WHERE forecast_start + h * INTERVAL 1 MONTH <= forecast_end""",
        recursive=True,
    )
)
def fc_auto_smoothing_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothing without season from its start weights only: the folds, the likelihood, the choice of the form."""
    limits = SmoothingLimits(forms=FORMS[:3], precision=1.0)
    rows = _forecast(ExpSmoothing(limits), spark, sf)
    return rows.select("window", "series_id", "time_index", "form", "forecast")


@query()
def fc_auto_ar(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(AutoAR(), spark, sf)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """numbered AS (
  SELECT series_id, time_index, CAST(value AS DOUBLE) AS y, lag(CAST(value AS DOUBLE)) OVER s AS x, row_number() OVER s - 1 AS t
  FROM filled WINDOW s AS (PARTITION BY series_id ORDER BY time_index)),
seen AS (
  SELECT c."window", n.*, count(*) OVER w AS n, last_value(y) OVER (w ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
  FROM numbered n JOIN cal c ON time_index <= validation_end_date WINDOW w AS (PARTITION BY c."window", series_id)),
used AS (
  SELECT * FROM seen
  WHERE n >= 8 AND t >= greatest(1, least(CASE WHEN n >= 36 THEN 14 ELSE 1 END, n // 4), CASE WHEN n >= 36 THEN 12 * least(2, n // 36) ELSE 0 END)),
sums AS (
  SELECT "window", series_id, any_value(last) AS last, CAST(count(*) AS DOUBLE) AS m, sum(y) AS sy, sum(x) AS sx, sum(x * y) AS sxy,
    sum(x * x) AS sxx, sum(y * y) AS syy FROM used GROUP BY 1, 2),
slopes AS (
  SELECT *, (m * sxy - sx * sy) / nullif(m * sxx - sx * sx, 0) AS b, sxy / nullif(sxx, 0) AS b0 FROM sums),
fits AS (
  SELECT "window", series_id, last, m, syy, '(0,0,0)(0,0,0)+c' AS form, 1 AS place, 2 AS k, sy / m AS c, 0.0 AS phi, syy - sy * sy / m AS sse FROM slopes
  UNION ALL
  SELECT "window", series_id, last, m, syy, '(1,0,0)(0,0,0)+c', 2, 3, (sy - b * sx) / m, b,
    syy - sy * sy / m - b * (sxy - sx * sy / m) FROM slopes
  UNION ALL SELECT "window", series_id, last, m, syy, '(0,0,0)(0,0,0)', 0, 1, 0.0, 0.0, syy FROM slopes
  UNION ALL SELECT "window", series_id, last, m, syy, '(1,0,0)(0,0,0)', 3, 2, 0.0, b0, syy - b0 * sxy FROM slopes),
scored AS (
  SELECT *, m * ln(greatest(sse / m, 1e-10 * greatest(syy / m, 1e-12))) + 2 * k + 2 * k * (k + 1) / greatest(m - k - 1, 1) AS aicc
  FROM fits WHERE abs(phi) < 1 AND m - k - 1 > 0),
first AS (
  SELECT * FROM scored WHERE place < 3 QUALIFY row_number() OVER (PARTITION BY "window", series_id ORDER BY aicc, place) = 1),
best AS (
  SELECT * FROM (
    SELECT * FROM first
    UNION ALL SELECT s.* FROM scored s JOIN first f ON f."window" = s."window" AND f.series_id = s.series_id
    WHERE s.place = 3 AND f.place IN (0, 2))
  QUALIFY row_number() OVER (PARTITION BY "window", series_id ORDER BY aicc, place) = 1),
ahead AS (SELECT *, c + phi * (c + phi * last) AS f2 FROM best)""",
        """SELECT "window", series_id, CAST(forecast_start + h * INTERVAL 1 MONTH AS DATE) AS time_index, form,
  round(CASE h WHEN 0 THEN f2 WHEN 1 THEN c + phi * f2 ELSE c + phi * (c + phi * f2) END, 4) AS forecast
FROM ahead a JOIN cal USING ("window"), range(3) t(h) WHERE forecast_start + h * INTERVAL 1 MONTH <= forecast_end""",
    )
)
def fc_auto_ar_search(spark: SparkSession, sf: str) -> DataFrame:
    """The order search bounded to one lag without differencing: candidates, AICc, choice and recursion."""
    limits = OrderLimits(max_p=1, max_q=0, max_seasonal_p=0, max_seasonal_q=0, max_d=0, max_seasonal_d=0)
    rows = _forecast(AutoAR(limits), spark, sf)
    return rows.select("window", "series_id", "time_index", "form", "forecast")


@query()
def fc_fourier(spark: SparkSession, sf: str) -> DataFrame:
    additive = _forecast(FourierTrend(), spark, sf)
    product = _forecast(FourierTrend(multiplicative=True, name="FourierProduct"), spark, sf)
    return additive.unionByName(product)


_WAVES = ", ".join(
    f"('{f}_{k}', {f}({k} * 2 * pi() * (year(time_index) * 12 + month(time_index)) / 12))" for k in (1, 2, 3) for f in ("sin", "cos")
)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.LOCAL_CAL_SQL,
        """numbered AS (
  SELECT series_id, time_index, CAST(value AS DOUBLE) AS y, row_number() OVER (PARTITION BY series_id ORDER BY time_index) - 1 AS t
  FROM filled),
seen AS (
  SELECT c."window", n.*, count(*) OVER (PARTITION BY c."window", series_id) AS months
  FROM numbered n JOIN cal c ON time_index <= validation_end_date)""",
        f"""SELECT "window", series_id, x.name AS column, round(sum(y * x.value), 3) + 0.0 AS moment, 0.0::DOUBLE AS residual
FROM seen, (VALUES ('constant', 1.0::DOUBLE), ('trend', t / 12.0::DOUBLE), {_WAVES}) x(name, value)
WHERE months >= 24 OR (months >= 3 AND x.name IN ('constant', 'trend')) GROUP BY ALL""",
    )
)
def fc_fourier_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Normal equations of trend and waves with change points: products with the series, and residuals at right angles to them."""
    found = FourierTrend().moments(fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL))
    residual = F.round(F.abs("residual"), 6)
    return found.withColumns({"moment": F.round("moment", 3) + 0.0, "residual": residual})


@query()
def local_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """The three per-series models over every supplier and window, scored."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.LOCAL)
    pairs = scored_pairs(series, calendar, LOCAL_MODELS, fx.LOCAL)
    table = metrics.window_results(pairs, retrain_flags(calendar, True), sc.DATE)
    return metrics.order_results([table], "window").drop("model_hyperparameters")


def brand_features(spark: SparkSession, sf: str) -> DataFrame:
    """Brand demand with its past and future covariates, gap-filled."""
    table = fx.brand_month(spark, sf, full=True)
    found = roles(table.columns)
    return fill_months(table, ["value", *found.past, *found.future])


def _brand_static(spark: SparkSession, sf: str) -> DataFrame:
    return fx.part(spark, sf, "p_brand", "p_size").groupBy(F.col("p_brand").alias("series_id")).agg(
        (F.avg("p_size") / 50).alias("static_mean_size")
    )


@query()
def fc_global_direct(spark: SparkSession, sf: str) -> DataFrame:
    calendar = fx.brand_calendar(spark, sf, fx.GLOBAL)
    linear = GlobalDirect(static=_brand_static(spark, sf))
    return linear.forecast(brand_features(spark, sf), calendar, fx.GLOBAL)


@query()
def fc_global_recursive(spark: SparkSession, sf: str) -> DataFrame:
    calendar = fx.brand_calendar(spark, sf, fx.GLOBAL)
    return GlobalRecursive().forecast(brand_features(spark, sf), calendar, fx.GLOBAL)


def _fit_sql(lookback: int, shift: int, horizon: int, past=(), future=(), static=(), shared_past=(), shared_future=()):
    """Sums over the training rows of every scaled feature; a least-squares fit leaves no correlation with them."""
    own = ("value", *past, *future)
    limits = lambda names: ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in names)
    unit = lambda cell, c, t: f"(({cell}) - {t}.lo_{c}) / (CASE WHEN {t}.hi_{c} = {t}.lo_{c} THEN 1 ELSE {t}.hi_{c} - {t}.lo_{c} END)"
    steps = []
    for h in range(1, horizon + 1):
        cells = {f"{c}_lag_{k}": unit(f"s.{c}_lag_{k}", c, "l") for c in ("value", *past) for k in range(lookback)}
        cells |= {f"shared_{c}_lag_{k}": unit(f"shared_{c}_lag_{k}", c, "g") for c in shared_past for k in range(lookback)}
        # in fiftieths, as the largest size is 50
        cells |= {c: f"CAST({c} AS DOUBLE) / 50" for c in static}
        cells |= {f"{c}_ahead": unit(f"s.{c}_h{h}", c, "l") for c in future}
        cells |= {f"shared_{c}_ahead": unit(f"shared_{c}_h{h}", c, "g") for c in shared_future}
        cells |= {"constant": "1.0::DOUBLE"}
        pairs = ", ".join(f"{{'feature': '{n}', 'x': {e}}}" for n, e in cells.items())
        present = " AND ".join(f"{e} IS NOT NULL" for e in cells.values())
        steps.append(
            f"""SELECT "window", {h} AS step, f.feature, count(*) AS n, round(sum(f.x), 4) AS sum_x, round(sum(goal), 4) AS sum_y,
  0.0::DOUBLE AS correlation
FROM (SELECT "window", goal, unnest(fs) AS f FROM (
  SELECT l."window", {unit(f's.y_{h}', 'value', 'l')} AS goal, [{pairs}] AS fs FROM trained s WHERE_JOINS
  WHERE s.y_{h} IS NOT NULL AND {present})) GROUP BY ALL"""
        )
    joins = """JOIN lim l ON l."window" = s."window" AND l.series_id = s.series_id"""
    parts = [
        scale.own_sql(lookback, shift, horizon, past, future),
        f"""trained AS (
  SELECT c."window", s.* FROM samples s JOIN cal c ON sample_end <= train_end_date WHERE rn >= {lookback} AND c."window" % 3 = 0)""",
        f"""lim AS (
  SELECT c."window", series_id, {limits(own)} FROM filled JOIN cal c ON time_index <= train_end_date GROUP BY 1, 2)""",
    ]
    if shared_past or shared_future:
        parts += [COVARIATES_SQL, scale.shared_sql(lookback, shift, horizon)]
        parts += [f"""glim AS (
  SELECT c."window", {limits((*shared_past, *shared_future))} FROM shared JOIN cal c ON time_index <= train_end_date GROUP BY 1)"""]
        joins += """ JOIN glim g ON g."window" = s."window" JOIN around a ON a.time_index = s.time_index"""
    if static:
        parts.append(scale._BRAND_STATIC)
        joins += " JOIN brand_static b ON b.series_id = s.series_id"
    return [*parts, "\nUNION ALL ".join(steps).replace("WHERE_JOINS", joins)]


_FEATURE_COLUMNS = scale.COVARIATE_COLUMNS + ", CAST(coalesce(d.future_quarter, 0) AS DOUBLE) AS future_quarter"
_GLOBAL_CAL = fx.calendar_sql(fx.GLOBAL)
_AHEAD = ("future_month", "future_quarter")


def _fit_rows(found: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 4) for c in ("sum_x", "sum_y")}
    return found.withColumns(rounded | {"correlation": F.round(F.abs("correlation"), 3)})


@query(
    sql(
        fx.BRAND_FULL_SQL,
        fx.filled_sql(_FEATURE_COLUMNS),
        _GLOBAL_CAL,
        *_fit_sql(
            6, 1, 3, ("past_lines", "past_avg_discount"), _AHEAD, ("static_mean_size",),
            ("past_orders", "past_revenue"), ("future_month",),
        ),
    )
)
def fc_global_direct_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The direct model's normal equations with all kinds of covariates: training sums, and residuals free of every feature."""
    model = GlobalDirect(
        lookback=6, instance_norm=False, ridge=0.0, static=_brand_static(spark, sf), shared=scale.shared_table(spark, sf)
    )
    return _fit_rows(model.residuals(brand_features(spark, sf), fx.brand_calendar(spark, sf, fx.GLOBAL), fx.GLOBAL))


@query(
    sql(fx.BRAND_FULL_SQL, fx.filled_sql(_FEATURE_COLUMNS), _GLOBAL_CAL, *_fit_sql(12, 0, 1, future=_AHEAD))
)
def fc_global_recursive_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The one-step model's normal equations."""
    model = GlobalRecursive(ridge=0.0)
    return _fit_rows(model.residuals(brand_features(spark, sf), fx.brand_calendar(spark, sf, fx.GLOBAL), fx.GLOBAL))


@query()
def fc_global_trees(spark: SparkSession, sf: str) -> DataFrame:
    """The direct model with boosted trees over brands."""
    calendar = fx.brand_calendar(spark, sf, fx.GLOBAL)
    return GlobalDirect(lookback=6, learner="trees", name="GlobalTrees").forecast(brand_features(spark, sf), calendar, fx.GLOBAL)


@query()
def fc_factor(spark: SparkSession, sf: str) -> DataFrame:
    calendar = fx.supplier_calendar(spark, sf, fx.GLOBAL)
    return FACTORS.forecast(fx.supplier_series(spark, sf), calendar, fx.GLOBAL)


@query()
def fc_masked_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Common factors over observed months only, with a month-level covariate known in advance."""
    calendar = fx.supplier_calendar(spark, sf, fx.GLOBAL)
    model = MaskedFactorModel(shared=scale.shared_table(spark, sf))
    return model.forecast(fx.supplier_series(spark, sf), calendar, fx.GLOBAL)


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.calendar_sql(fx.GLOBAL),
        """SELECT m.model, c."window", count(*) AS n_pairs, CAST(sum(value) AS DOUBLE) AS actual,
  min(time_index) AS first_month, max(time_index) AS last_month
FROM filled f JOIN cal c ON f.time_index BETWEEN forecast_start AND forecast_end,
  (VALUES ('GlobalDirect'), ('GlobalRecursive'), ('FactorModel'), ('MaskedFactorModel')) m(model) GROUP BY 1, 2""",
    )
)
def global_backtest_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Global and joint models are scored on all actuals of every window."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.GLOBAL)
    models = [GlobalDirect(), GlobalRecursive(), FACTORS, MaskedFactorModel()]
    return _complete_pairs(scored_pairs(series, calendar, models, fx.GLOBAL))


def _complete_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("forecast IS NOT NULL").groupBy("model", "window").agg(
        F.count("*").alias("n_pairs"),
        F.sum("actual").cast("double").alias("actual"),
        F.min("time_index").alias("first_month"),
        F.max("time_index").alias("last_month"),
    )


@query()
def global_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Global and joint models over every supplier, scored by window."""
    series, calendar = fx.supplier_series(spark, sf), fx.supplier_calendar(spark, sf, fx.GLOBAL)
    models = [GlobalDirect(), GlobalRecursive(), FACTORS]
    pairs = scored_pairs(series, calendar, models, fx.GLOBAL)
    table = metrics.window_results(pairs, retrain_flags(calendar, fx.GLOBAL.retrain), sc.DATE)
    return metrics.order_results([table], "window").drop("model_hyperparameters")
