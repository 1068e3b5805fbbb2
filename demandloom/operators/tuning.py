"""Hyperparameter trials as DataFrames.

A search space has one row per parameter: ``name, type, values, low, high, log`` with type
categorical, int or float.  Trials are long (one row per trial and parameter) or packed (one row
per trial with ``params`` as a map).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.functions.draws import uniform_draw
from demandloom.functions.errors import avg_if_complete
from demandloom.operators.metrics import wape

SPACE_SCHEMA = (
    "name string, type string, values array<string>, low double, high double, log boolean"
)
PARAM_TYPES = ("categorical", "int", "float")


def search_space(spark: SparkSession, space: dict[str, dict]) -> DataFrame:
    """A space from ``{name: {'type': .., 'values': [..]} | {'type': .., 'low': .., 'high': ..}}``."""
    unknown = {p["type"] for p in space.values()} - set(PARAM_TYPES)
    if unknown:
        raise ValueError(f"unknown parameter types {sorted(unknown)}")
    rows = [
        (
            name,
            p["type"],
            [str(v) for v in p["values"]] if "values" in p else None,
            float(p["low"]) if "low" in p else None,
            float(p["high"]) if "high" in p else None,
            bool(p.get("log", False)),
        )
        for name, p in space.items()
    ]
    return spark.createDataFrame(rows, SPACE_SCHEMA)


def override_space(space: DataFrame, overrides: DataFrame) -> DataFrame:
    """Entries of ``overrides`` replace those of the same name; new names are added."""
    kept = space.join(overrides.select("name"), "name", "left_anti")
    return kept.unionByName(overrides)


def make_trials(space: DataFrame, n_trials: int, seed: int, first_trial: int = 0) -> DataFrame:
    """Draw ``n_trials`` values per parameter; the same seed always gives the same trials."""
    numbered = space.select(
        F.explode(F.sequence(F.lit(first_trial), F.lit(first_trial + n_trials - 1))).alias(
            "trial_number"
        ),
        "*",
    )
    u = uniform_draw(seed, F.col("trial_number"), F.col("name"))
    low, high = F.col("low"), F.col("high")
    position = F.floor(u * F.size("values")).cast("int")
    whole = (low + F.floor(u * (high - low + 1))).cast("long").cast("string")
    linear = low + u * (high - low)
    logarithmic = F.exp(F.log(low) + u * (F.log(high) - F.log(low)))
    value = (
        F.when(F.col("type") == "categorical", F.get("values", position))
        .when(F.col("type") == "int", whole)
        .when(F.coalesce(F.col("log"), F.lit(False)), F.round(logarithmic, 10).cast("string"))
        .otherwise(F.round(linear, 10).cast("string"))
    )
    return numbered.select("trial_number", "name", value.alias("param_value"))


def pack_trials(trials: DataFrame, *keys: str) -> DataFrame:
    """One row per trial with its parameters as ``map<string,string>``."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "param_value")))
    return trials.groupBy(*keys, "trial_number").agg(F.map_from_entries(pairs).alias("params"))


def trial_scores(pairs: DataFrame, decimals: int = 6) -> DataFrame:
    """Objective per trial: the mean over windows of the rounded window averages.

    ``pairs`` carries ``trial_number``.  The windows' own WAPE stay with the trial in window order.
    """
    periods = wape(pairs, ("trial_number", "window", "time_index"))
    windows = periods.groupBy("trial_number", "window").agg(
        F.round(avg_if_complete(F.col("wape")), decimals).alias("_w")
    )
    ordered = F.array_sort(F.collect_list(F.struct("window", "_w")))
    return windows.groupBy("trial_number").agg(
        avg_if_complete(F.col("_w")).alias("value"),
        F.transform(ordered, lambda p: p["_w"]).alias("wape_by_window"),
    )


def append_trials(trials: DataFrame, path: str) -> None:
    """Append to a study table; numbering of each study continues after its last trial."""
    spark = trials.sparkSession
    found = read_study(spark, path)
    if found is not None:
        last = found.groupBy("study_name").agg(F.max("trial_number").alias("_last"))
        lowest = trials.groupBy("study_name").agg(F.min("trial_number").alias("_low"))
        moved = lowest.join(last, "study_name", "left")
        base = F.coalesce(F.col("_last") + 1, F.col("_low")) - F.col("_low")
        shifts = moved.select("study_name", base.cast("int").alias("_move"))
        trials = (
            trials.join(shifts, "study_name")
            .withColumn("trial_number", F.col("trial_number") + F.col("_move"))
            .drop("_move")
        )
    trials.write.mode("append").partitionBy("study_name").parquet(path)


def read_study(spark: SparkSession, path: str) -> DataFrame | None:
    """The study table, or None when nothing has been stored yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def completed(trials: DataFrame) -> DataFrame:
    return trials.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _ranked(trials: DataFrame, keys: Sequence[str], direction: str) -> DataFrame:
    if direction not in ("minimize", "maximize"):
        raise ValueError("direction must be 'minimize' or 'maximize'")
    objective = F.col("value").asc() if direction == "minimize" else F.col("value").desc()
    # filters on this rank let Spark keep only the leading rows of each group before the shuffle
    order = Window.partitionBy(*keys).orderBy(objective, "study_name", "trial_number")
    return completed(trials).withColumn("_rank", F.row_number().over(order))


def top_trials(trials: DataFrame, n: int, direction: str = "minimize") -> DataFrame:
    """The n best trials of each study with their rank from zero and duration in seconds."""
    seconds = F.unix_micros("completed") - F.unix_micros("started")
    return (
        _ranked(trials, ["study_name"], direction)
        .filter(F.col("_rank") <= n)
        .withColumn("rank", F.col("_rank") - 1)
        .withColumn("duration_seconds", seconds / 1e6)
        .drop("_rank")
    )


def best_trial(
    trials: DataFrame,
    study_name: str | None = None,
    model_name: str | None = None,
    rank: int = 0,
    direction: str = "minimize",
) -> DataFrame:
    """One completed trial: of a named study, or over all studies of a model (``<model>_utc...``).

    ``rank`` 0 is the best; a rank beyond the trials available falls back to the best.
    """
    if study_name is None and model_name is None:
        raise ValueError("give study_name or model_name")
    wanted = (
        F.col("study_name") == study_name
        if study_name
        else F.col("study_name").startswith(f"{model_name}_utc")
    )
    ranked = _ranked(trials.filter(wanted).withColumn("_all", F.lit(1)), ["_all"], direction)
    leading = ranked.filter(F.col("_rank") <= rank + 1).filter(F.col("_rank").isin(1, rank + 1))
    # at most two rows are left: the requested one, if it exists, and the best
    return leading.orderBy(F.col("_rank").desc()).limit(1).drop("_rank", "_all")


def resolve_params(defaults: DataFrame, best: DataFrame) -> DataFrame:
    """Default parameters (name, param_value), overridden by those of the best trial if there is one."""
    tuned = best.select(F.explode("params").alias("name", "_tuned"))
    return defaults.join(tuned, "name", "full_outer").select(
        "name",
        F.coalesce("_tuned", "param_value").alias("param_value"),
        F.when(F.col("_tuned").isNull(), F.lit("default"))
        .otherwise(F.lit("trial"))
        .alias("origin"),
    )


def param_importance(trials: DataFrame, bins: int = 4) -> DataFrame:
    """Share of the objective's variance between the groups formed by each parameter.

    Numeric values are cut into ``bins`` equal widths per study, other values are groups as they are.
    """
    long = completed(trials).select(
        "study_name", "value", F.explode("params").alias("name", "param_value")
    )
    numbers = long.withColumn("_x", F.col("param_value").try_cast("double"))
    limits = numbers.groupBy("study_name", "name").agg(
        F.min("_x").alias("_lo"),
        F.max("_x").alias("_hi"),
        F.var_pop("value").alias("_total"),
        F.avg("value").alias("_mean"),
        F.count(F.lit(1)).alias("_n"),
        F.count("_x").alias("_numeric"),
    )
    part = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    bin_text = F.least(F.floor(part * bins), F.lit(bins - 1)).cast("string")
    is_number = (F.col("_numeric") == F.col("_n")) & (F.col("_hi") > F.col("_lo"))
    grouped = (
        numbers.join(limits, ["study_name", "name"])
        .withColumn("_group", F.when(is_number, bin_text).otherwise(F.col("param_value")))
        .groupBy("study_name", "name", "_group")
        .agg(
            F.avg("value").alias("_m"),
            F.count(F.lit(1)).alias("_k"),
            F.first("_mean").alias("_mean"),
            F.first("_total").alias("_total"),
            F.first("_n").alias("_n"),
        )
    )
    between = F.sum(F.col("_k") * F.pow(F.col("_m") - F.col("_mean"), 2)) / F.first("_n")
    total = F.first("_total")
    return grouped.groupBy("study_name", "name").agg(
        F.when(total > 0, between / total).otherwise(F.lit(0.0)).alias("importance")
    )


def study_summary(trials: DataFrame, direction: str = "minimize") -> DataFrame:
    """Trials, best value and the best trial's WAPE by window, per study."""
    done = completed(trials)
    sign = 1 if direction == "minimize" else -1
    best = F.min(F.struct((F.col("value") * sign).alias("v"), "trial_number", "wape_by_window"))
    return done.groupBy("study_name").agg(
        F.count(F.lit(1)).alias("n_trials"), best.alias("_b")
    ).select(
        "study_name",
        "n_trials",
        (F.col("_b.v") * sign).alias("best_value"),
        F.col("_b.trial_number").alias("best_trial"),
        F.col("_b.wape_by_window").alias("wape_by_window"),
    )
