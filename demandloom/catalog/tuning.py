"""Trials on the tuning windows: the weight of level smoothing over brand demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.catalog import fixtures as fx
from demandloom.catalog import query
from demandloom.catalog.fixtures import sql
from demandloom.operators import tuning as ops
from demandloom.plans.storage import scratch_path
from demandloom.models.closed_form import SeasonalNaive
from demandloom.models.per_series import FourierTrend
from demandloom.operators.metrics import order_results
from demandloom.plans.study import smoothing_pairs, tune_and_backtest

SEED, N_TRIALS = 42, 20
STUDIES = ["LevelSmoothing_utc_20010101_0000", "LevelSmoothing_utc_20010201_0000"]

# --- search space bounded by the demand itself ------------------------------------------------

_LIMITS_SQL = """lim AS (
  SELECT min(value) AS lo, max(value) AS hi, count(DISTINCT time_index) AS months FROM filled)"""
SPACE_SQL = """space AS (
  SELECT 'alpha' AS name, 'float' AS type, NULL AS vals, 0.05::DOUBLE AS low, 0.95::DOUBLE AS high, false AS log
  UNION ALL SELECT 'ceiling', 'float', NULL, lo + 1, hi + 1, true FROM lim
  UNION ALL SELECT 'lookback', 'int', NULL, 3, months // 2, false FROM lim
  UNION ALL SELECT 'season', 'categorical', ['0', '6', '12'], NULL, NULL, false)"""
OVERRIDE_SQL = """over AS (
  SELECT 'lookback' AS name, 'categorical' AS type, ['3', '6', '9', '12'] AS vals,
    NULL::DOUBLE AS low, NULL::DOUBLE AS high, false AS log
  UNION ALL SELECT 'width', 'int', NULL, 1, months // 4, false FROM lim)"""


def _draw_sql(source: str, trials: str, seed: int) -> str:
    return f"""drawn AS (
  SELECT trial_number, s.*, CAST(('0x' || substr(md5('{seed}|' || trial_number || '|' || name), 1, 8)) AS BIGINT)
    / 4294967296.0 AS u FROM {source} s, {trials}),
trials AS (
  SELECT trial_number, name, type, CASE type
    WHEN 'categorical' THEN vals[CAST(floor(u * len(vals)) AS INTEGER) + 1]
    WHEN 'int' THEN CAST(CAST(low + floor(u * (high - low + 1)) AS BIGINT) AS VARCHAR)
    ELSE CAST(round(CASE WHEN log THEN exp(ln(low) + u * (ln(high) - ln(low))) ELSE low + u * (high - low) END, 10)
      AS VARCHAR) END AS param_value
  FROM drawn)"""


TRIAL_NUMBERS = f"(SELECT CAST(r AS INTEGER) AS trial_number FROM range({N_TRIALS}) t(r))"
# text of numbers differs between engines, so numbers are compared as numbers
_TRIAL_SELECT = """SELECT trial_number, name, CASE WHEN type = 'categorical' THEN param_value END AS chosen,
  CASE WHEN type <> 'categorical' THEN round(CAST(param_value AS DOUBLE), 6) END AS number FROM trials"""


def demand_space(spark: SparkSession, sf: str) -> DataFrame:
    """A space whose ceiling and lookback range come from the demand."""
    limits = fx.brand_series(spark, sf, whole=True).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.countDistinct("time_index").alias("months"),
    )
    texts = F.lit(None).cast("array<string>")

    def entry(name, kind, low, high, log=False, values=texts):
        return F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("type"), values.alias("values"),
            low.cast("double").alias("low"), high.cast("double").alias("high"),
            F.lit(log).alias("log"),
        )

    none = F.lit(None)
    seasons = F.array(*[F.lit(v) for v in ("0", "6", "12")])
    rows = F.array(
        entry("alpha", "float", F.lit(0.05), F.lit(0.95)),
        entry("ceiling", "float", F.col("lo") + 1, F.col("hi") + 1, True),
        entry("lookback", "int", F.lit(3), F.floor(F.col("months") / 2)),
        entry("season", "categorical", none, none, False, seasons),
    )
    return limits.select(F.inline(rows))


def demand_overrides(spark: SparkSession, sf: str) -> DataFrame:
    months = fx.brand_series(spark, sf, whole=True).agg(F.countDistinct("time_index").alias("months"))
    none = F.lit(None).cast("double")
    lookbacks = F.array(*[F.lit(v) for v in ("3", "6", "9", "12")])
    rows = F.array(
        F.struct(
            F.lit("lookback").alias("name"), F.lit("categorical").alias("type"),
            lookbacks.alias("values"), none.alias("low"), none.alias("high"),
            F.lit(False).alias("log"),
        ),
        F.struct(
            F.lit("width").alias("name"), F.lit("int").alias("type"),
            F.lit(None).cast("array<string>").alias("values"), F.lit(1.0).alias("low"),
            F.floor(F.col("months") / 4).cast("double").alias("high"), F.lit(False).alias("log"),
        ),
    )
    return months.select(F.inline(rows))


def _readable(trials: DataFrame, space: DataFrame) -> DataFrame:
    typed = trials.join(space.select("name", "type"), "name")
    is_text = F.col("type") == "categorical"
    return typed.select(
        "trial_number",
        "name",
        F.when(is_text, F.col("param_value")).alias("chosen"),
        F.when(~is_text, F.round(F.col("param_value").cast("double"), 6)).alias("number"),
    )


@query(sql(fx.BRAND_ALL_SQL, fx.FILLED_SQL, _LIMITS_SQL, SPACE_SQL, _draw_sql("space", TRIAL_NUMBERS, SEED), _TRIAL_SELECT))
def make_trials(spark: SparkSession, sf: str) -> DataFrame:
    space = demand_space(spark, sf)
    return _readable(ops.make_trials(space, N_TRIALS, SEED), space)


@query(
    sql(
        fx.BRAND_ALL_SQL,
        fx.FILLED_SQL,
        _LIMITS_SQL,
        SPACE_SQL,
        OVERRIDE_SQL,
        """merged AS (SELECT * FROM space WHERE name NOT IN (SELECT name FROM over) UNION ALL SELECT * FROM over)""",
        """SELECT name, type, array_to_string(vals, ',') AS options, low, high, log FROM merged""",
    )
)
def space_override(spark: SparkSession, sf: str) -> DataFrame:
    merged = ops.override_space(demand_space(spark, sf), demand_overrides(spark, sf))
    return merged.select(
        "name", "type", F.array_join("values", ",").alias("options"), "low", "high", "log"
    )


# --- objective of each trial on the tuning windows ---------------------------------------------

_ALPHA_SQL = f"""alphas AS (
  SELECT trial_number, round(0.05 + CAST(('0x' || substr(md5('{SEED}|' || trial_number || '|alpha'), 1, 8)) AS BIGINT)
    / 4294967296.0 * (0.95 - 0.05), 10) AS alpha FROM {TRIAL_NUMBERS}),
ordered AS (SELECT series_id, time_index, value, row_number() OVER (PARTITION BY series_id ORDER BY time_index) AS n FROM filled),
ses AS (
  SELECT trial_number, alpha, series_id, n, time_index, CAST(value AS DOUBLE) AS level FROM ordered, alphas WHERE n = 1
  UNION ALL
  SELECT s.trial_number, s.alpha, s.series_id, o.n, o.time_index, s.alpha * o.value + (1.0 - s.alpha) * s.level
  FROM ses s JOIN ordered o ON o.series_id = s.series_id AND o.n = s.n + 1)"""
SCORES_SQL = f"""trial_periods AS (
  SELECT s.trial_number, c."window", f.time_index, sum(abs(f.value - greatest(s.level, 0))) / nullif(sum(f.value), 0) AS wape
  FROM ses s JOIN cal c ON s.time_index = c.validation_end_date
  JOIN filled f ON f.series_id = s.series_id AND f.time_index BETWEEN c.forecast_start AND c.forecast_end
  GROUP BY ALL),
trial_windows AS (
  SELECT trial_number, "window", CASE WHEN count(*) = count(wape) THEN round(avg(wape), 6) END AS w
  FROM trial_periods GROUP BY 1, 2),
scores AS (
  SELECT w.trial_number, a.alpha, CASE WHEN count(*) = count(w.w) THEN avg(w.w) END AS value,
    list(w.w ORDER BY "window") AS wape_by_window
  FROM trial_windows w JOIN alphas a ON a.trial_number = w.trial_number GROUP BY 1, 2)"""
SCORED = (
    fx.BRAND_SQL,
    fx.FILLED_SQL,
    fx.calendar_sql(fx.TUNING, "tuning"),
    _ALPHA_SQL,
    SCORES_SQL,
)


def scored_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Objective, WAPE by window and alpha of every trial, in one job."""
    space = ops.search_space(spark, {"alpha": {"type": "float", "low": 0.05, "high": 0.95}})
    trials = ops.make_trials(space, N_TRIALS, SEED).select(
        "trial_number", F.col("param_value").cast("double").alias("alpha")
    )
    calendar = fx.brand_calendar(spark, sf, fx.TUNING, "tuning")
    pairs = smoothing_pairs(fx.brand_series(spark, sf), calendar, trials, fx.TUNING)
    return ops.trial_scores(pairs).join(trials, "trial_number")


@query(
    sql(
        *SCORED,
        """SELECT trial_number, alpha, round(value, 8) AS value, wape_by_window[1] AS wape_w0,
  wape_by_window[2] AS wape_w1, wape_by_window[3] AS wape_w2 FROM scores""",
        recursive=True,
    )
)
def trial_objective(spark: SparkSession, sf: str) -> DataFrame:
    scores = scored_trials(spark, sf)
    by_window = [F.element_at("wape_by_window", i + 1).alias(f"wape_w{i}") for i in range(3)]
    return scores.select("trial_number", "alpha", F.round("value", 8).alias("value"), *by_window)


# --- a study table of two studies: all trials, and the first half --------------------------------

# trials start one hour apart and take trial_number + 1 minutes; the last trial is unfinished
STUDY_SQL = f"""study AS (
  SELECT s.study_name, c.trial_number, c.alpha, CASE WHEN c.trial_number < {N_TRIALS - 1} THEN round(c.value, 8) END AS value,
    c.wape_by_window, (c.trial_number + 1) * 60.0 AS seconds
  FROM scores c JOIN (SELECT '{STUDIES[0]}' AS study_name, {N_TRIALS} AS n UNION ALL SELECT '{STUDIES[1]}', {N_TRIALS // 2}) s
    ON c.trial_number < s.n)"""


def study_table(spark: SparkSession, sf: str) -> DataFrame:
    scores = scored_trials(spark, sf)
    sizes = F.array(
        F.struct(F.lit(STUDIES[0]).alias("study_name"), F.lit(N_TRIALS).alias("n")),
        F.struct(F.lit(STUDIES[1]).alias("study_name"), F.lit(N_TRIALS // 2).alias("n")),
    )
    started = F.make_timestamp_ntz(
        F.lit(2001), F.lit(1), F.lit(1), F.col("trial_number") % 24, F.lit(0), F.lit(0)
    ).cast("timestamp")
    minutes = F.make_dt_interval(mins=F.col("trial_number") + 1)
    done = F.col("trial_number") < N_TRIALS - 1
    return (
        scores.select("*", F.inline(sizes))
        .filter(F.col("trial_number") < F.col("n"))
        .select(
            "study_name",
            "trial_number",
            F.create_map(F.lit("alpha"), F.col("alpha").cast("string")).alias("params"),
            F.when(done, F.round("value", 8)).alias("value"),
            "wape_by_window",
            started.alias("started"),
            (started + minutes).alias("completed"),
        )
    )


@query(
    sql(
        *SCORED,
        STUDY_SQL,
        f"""SELECT study_name, CAST(trial_number + k * n AS INTEGER) AS trial_number, value
FROM study JOIN (SELECT '{STUDIES[0]}' AS study_name, {N_TRIALS} AS n UNION ALL SELECT '{STUDIES[1]}', {N_TRIALS // 2}) USING (study_name),
  range(2) t(k)""",
        recursive=True,
    )
)
def study_append(spark: SparkSession, sf: str) -> DataFrame:
    """The same trials appended twice: numbering goes on after the first run."""
    path = scratch_path(spark, "study")
    trials = study_table(spark, sf)
    ops.append_trials(trials, path)
    ops.append_trials(trials, path)
    return ops.read_study(spark, path).select("study_name", "trial_number", "value")


_RANKED = """SELECT *, row_number() OVER (PARTITION BY study_name ORDER BY value, study_name, trial_number) - 1 AS rank
  FROM study WHERE value IS NOT NULL"""


@query(
    sql(
        *SCORED,
        STUDY_SQL,
        f"ranked AS ({_RANKED})",
        """SELECT study_name, trial_number, round(alpha, 6) AS alpha, value, CAST(rank AS INTEGER) AS rank,
  CAST(seconds AS DOUBLE) AS duration_seconds FROM ranked WHERE rank < 3""",
        recursive=True,
    )
)
def top_trials(spark: SparkSession, sf: str) -> DataFrame:
    return ops.top_trials(study_table(spark, sf), 3).select(
        "study_name",
        "trial_number",
        F.round(F.element_at("params", "alpha").cast("double"), 6).alias("alpha"),
        "value",
        "rank",
        "duration_seconds",
    )


@query(
    sql(
        *SCORED,
        STUDY_SQL,
        """ranked AS (SELECT *, row_number() OVER (ORDER BY value, study_name, trial_number) - 1 AS rank
  FROM study WHERE value IS NOT NULL)""",
        """SELECT 'rank 1' AS asked, study_name, trial_number, value FROM ranked WHERE rank = 1
UNION ALL SELECT 'rank 999', study_name, trial_number, value FROM ranked WHERE rank = 0""",
        recursive=True,
    )
)
def best_trial(spark: SparkSession, sf: str) -> DataFrame:
    """Second-best trial of the model over both studies, and the fall-back of a rank too large."""
    trials = study_table(spark, sf)
    second = ops.best_trial(trials, model_name="LevelSmoothing", rank=1)
    beyond = ops.best_trial(trials, model_name="LevelSmoothing", rank=999)
    return (
        second.withColumn("asked", F.lit("rank 1"))
        .unionByName(beyond.withColumn("asked", F.lit("rank 999")))
        .select("asked", "study_name", "trial_number", "value")
    )


@query(
    sql(
        *SCORED,
        STUDY_SQL,
        f"""best AS (SELECT alpha FROM study WHERE study_name = '{STUDIES[1]}' AND value IS NOT NULL
  ORDER BY value, trial_number LIMIT 1)""",
        """SELECT 'alpha' AS name, round(alpha, 6) AS number, 'trial' AS origin FROM best
UNION ALL SELECT 'season', 12, 'default'""",
        recursive=True,
    )
)
def resolve_params(spark: SparkSession, sf: str) -> DataFrame:
    trials = study_table(spark, sf)
    defaults = spark.createDataFrame(
        [("alpha", "0.5"), ("season", "12")], "name string, param_value string"
    )
    resolved = ops.resolve_params(defaults, ops.best_trial(trials, study_name=STUDIES[1]))
    number = F.round(F.col("param_value").cast("double"), 6)
    return resolved.select("name", number.alias("number"), "origin")


@query(
    sql(
        *SCORED,
        STUDY_SQL,
        """done AS (SELECT * FROM study WHERE value IS NOT NULL),
lim AS (
  SELECT study_name, min(alpha) AS lo, max(alpha) AS hi, var_pop(value) AS total, avg(value) AS mean, count(*) AS n
  FROM done GROUP BY 1),
grouped AS (
  SELECT d.study_name, least(floor((alpha - lo) / (hi - lo) * 4), 3) AS g, avg(value) AS m, count(*) AS k,
    any_value(mean) AS mean, any_value(total) AS total, any_value(n) AS n
  FROM done d JOIN lim USING (study_name) GROUP BY 1, 2)""",
        """SELECT study_name, 'alpha' AS name,
  round(sum(k * (m - mean) * (m - mean)) / any_value(n) / any_value(total), 6) AS importance FROM grouped GROUP BY 1""",
        recursive=True,
    )
)
def param_importance(spark: SparkSession, sf: str) -> DataFrame:
    shares = ops.param_importance(study_table(spark, sf))
    return shares.withColumn("importance", F.round("importance", 6))


@query(
    sql(
        *SCORED,
        STUDY_SQL,
        """best AS (SELECT study_name, arg_min(trial_number, (value, trial_number)) AS best_trial, count(*) AS n_trials
  FROM study WHERE value IS NOT NULL GROUP BY 1)""",
        """SELECT b.study_name, b.n_trials, s.value AS best_value, b.best_trial, s.wape_by_window[1] AS wape_w0
FROM best b JOIN study s ON s.study_name = b.study_name AND s.trial_number = b.best_trial""",
        recursive=True,
    )
)
def study_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = ops.study_summary(study_table(spark, sf))
    first = F.element_at("wape_by_window", 1).alias("wape_w0")
    return summary.select("study_name", "n_trials", "best_value", "best_trial", first)


def _fourier(params: dict[str, str]) -> FourierTrend:
    return FourierTrend(params["mode"] == "multiplicative", int(params["waves"]))


def _tuned(spark: SparkSession, sf: str):
    """Trend-and-waves model tuned on the windows before the backtest, then scored in it; the study's path beside it."""
    path = scratch_path(spark, "study")
    space = ops.search_space(
        spark,
        {
            "waves": {"type": "int", "low": 1, "high": 4},
            "mode": {"type": "categorical", "values": ["additive", "multiplicative"]},
        },
    )
    result = tune_and_backtest(
        fx.supplier_series(spark, sf),
        fx.supplier_lines(spark, sf),
        fx.TUNING,
        _fourier,
        space,
        {"waves": "3", "mode": "additive"},
        n_trials=4,
        model_name="FourierTrend",
        timestamp="20010101_0000",
        study_path=path,
        baselines=[SeasonalNaive()],
    )
    return result, path


@query()
def tuned_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """The tuned model beside the seasonal naive, scored by window."""
    return order_results([_tuned(spark, sf)[0].window_table()], "window")


@query(
    sql(
        fx.SUPPLIER_SQL,
        fx.FILLED_SQL,
        fx.calendar_sql(fx.TUNING),
        """SELECT 'backtest ' || m.model AS run, c."window", count(*) AS n_pairs, CAST(sum(value) AS DOUBLE) AS actual
FROM filled f JOIN cal c ON f.time_index BETWEEN forecast_start AND forecast_end,
  (VALUES ('FourierTrend'), ('SeasonalNaive')) m(model) GROUP BY ALL
UNION ALL
SELECT 'trial', CAST(r AS INTEGER), 3, NULL FROM range(4) t(r)""",
    )
)
def tuned_backtest_complete(spark: SparkSession, sf: str) -> DataFrame:
    """The tuned model and its baseline are scored on all actuals; every trial has a score for each tuning window."""
    result, path = _tuned(spark, sf)
    pairs = result.pairs.where("forecast IS NOT NULL").groupBy("model", "window").agg(
        F.count("*").alias("n_pairs"), F.sum("actual").cast("double").alias("actual")
    )
    scored = F.size(F.filter("wape_by_window", lambda w: w.isNotNull())).cast("long").alias("n_pairs")
    trials = ops.read_study(spark, path).where("value IS NOT NULL AND completed > started").select(
        F.lit("trial").alias("run"), F.col("trial_number").alias("window"), scored, F.lit(None).cast("double").alias("actual")
    )
    return pairs.select(F.concat(F.lit("backtest "), "model").alias("run"), "window", "n_pairs", "actual").unionByName(trials)
