"""Summaries of stored results and the frames behind the charts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.quantiles import radix_quantiles, sorted_quantiles
from demandloom.plans.storage import cut_lineage


def _number(column: str) -> int:
    """The step number at the end of a column name, of any length."""
    return int(re.search(r"(\d+)$", column).group(1))


def step_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns ``<prefix><number>`` in step order; an error if there are none."""
    found = [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)]
    if not found:
        raise ValueError(f"no columns starting with {prefix!r}")
    return sorted(found, key=_number)


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")


def expand_list(
    df: DataFrame, column: str, prefix: str | None = None, length: int | None = None
) -> DataFrame:
    """An array column to ``<prefix>_f1 .. _fn``; entries beyond a shorter list are NULL.

    ``length`` is the longest list, looked up once when not given.
    """
    if length is None:
        length = df.agg(F.max(F.size(column))).first()[0] or 0
    prefix = prefix or column
    cells = [
        F.try_element_at(column, F.lit(i)).cast("double").alias(f"{prefix}_f{i}")
        for i in range(1, length + 1)
    ]
    return df.select(*[c for c in df.columns if c != column], *cells)


def expand_lists(df: DataFrame, columns: Sequence[str], length: int | None = None) -> DataFrame:
    """:func:`expand_list` over several columns; their longest lists are looked up in one pass."""
    lengths = dict.fromkeys(columns, length)
    if length is None and columns:
        lengths = df.agg(*[F.max(F.size(c)).alias(c) for c in columns]).first().asDict()
    for c in columns:
        df = expand_list(df, c, length=lengths[c] or 0)
    return df


def overview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column as (item, entry) rows."""
    parts = [
        df.select(F.lit(c).alias("item"), F.col(c).cast("string").alias("entry")) for c in columns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def wape_summary(
    df: DataFrame,
    group: str = "model",
    prefix: str = "wape_f",
    avg_col: str = "avg_wape_across_periods",
    mode: str = "both",
) -> DataFrame:
    """Mean and sample deviation of the window averages and of each horizon, best group first."""
    if mode not in ("avg", "per_period", "both"):
        raise ValueError("mode must be 'avg', 'per_period' or 'both'")
    stats: list[Column] = []
    names: list[str] = []
    if mode != "per_period" and avg_col in df.columns:
        stats += [_mean(avg_col, "avg_wape"), _std(avg_col, "std_avg_wape")]
        names.append("avg_wape")
    if mode != "avg":
        steps = step_columns(df, prefix)
        stats += [_mean(c, c) for c in steps] + [_std(c, f"std_{c}") for c in steps]
        names.append(steps[0])
    return df.groupBy(group).agg(*stats).orderBy(names[0], group)


def _mean(column: str, name: str) -> Column:
    return F.round(F.avg(column), 4).alias(name)


def _std(column: str, name: str) -> Column:
    return F.round(F.stddev_samp(column), 4).alias(name)


def group_values(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, value), materialised: a group and a value per row, read by every pass of the quantiles."""
    return cut_lineage(df.select(group, F.col(column).cast("double").alias("value")))


def exact_quantiles(df: DataFrame, group: str, column: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles of a column per group, as (group, p, quantile); NULL values do not count.

    Few groups are read by radix selection, more of them by one sort.
    """
    values = group_values(df, group, column)
    found = radix_quantiles(values, group, probabilities)
    return sorted_quantiles(values, group, probabilities) if found is None else found


def group_quantiles(values: DataFrame, group: str, named: dict[str, float]) -> DataFrame:
    """:func:`exact_quantiles` of :func:`group_values`, with one column per probability."""
    found = radix_quantiles(values, group, list(named.values()))
    if found is None:
        found = sorted_quantiles(values, group, list(named.values()))
    picks = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in named.items()]
    return found.groupBy(group).agg(*picks)


def mape_summary(df: DataFrame, group: str = "model", column: str = "mape") -> DataFrame:
    """Mean, sample deviation, extremes and quartiles of MAPE, best group first."""
    values = group_values(df, group, column)
    moments = values.groupBy(group).agg(
        _mean("value", "mean_MAPE"),
        _std("value", "std_MAPE"),
        F.round(F.min("value"), 4).alias("min_MAPE"),
        F.round(F.max("value"), 4).alias("max_MAPE"),
    )
    quartiles = group_quantiles(values, group, {"p25_MAPE": 0.25, "median_MAPE": 0.5, "p75_MAPE": 0.75})
    rounded = quartiles.select(
        F.col(group).alias("_group"), *[F.round(c, 4).alias(c) for c in ("p25_MAPE", "median_MAPE", "p75_MAPE")]
    )
    order = ["mean_MAPE", "std_MAPE", "min_MAPE", "p25_MAPE", "median_MAPE", "p75_MAPE", "max_MAPE"]
    joined = moments.join(rounded, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.select(group, *order).orderBy("mean_MAPE", group)


def melt_horizons(
    df: DataFrame, ids: Sequence[str], prefix: str, value_name: str = "value"
) -> DataFrame:
    """Wide step columns to long with the step number and its label ``F<n>``."""
    _require(df, ids)
    wide = step_columns(df, prefix)
    cells = F.array(
        *[
            F.struct(
                F.lit(_number(c)).alias("step"),
                F.lit(f"F{_number(c)}").alias("label"),
                F.col(c).alias(value_name),
            )
            for c in wide
        ]
    )
    return df.select(*ids, F.inline(cells))


def horizon_means(df: DataFrame, group: str = "model", prefix: str = "wape_f") -> DataFrame:
    """Mean per group and horizon."""
    long = melt_horizons(df, [group], prefix)
    return long.groupBy(group, "step", "label").agg(F.avg("value").alias("mean_wape"))


def box_frame(df: DataFrame, group: str = "model", prefix: str = "wape_f") -> DataFrame:
    """Quartiles, whiskers (last points within 1.5 box heights) and points outside, per group."""
    long = melt_horizons(df, [group], prefix).filter(F.col("value").isNotNull())
    values = group_values(long, group, "value")
    quartiles = group_quantiles(values, group, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    boxes = quartiles.withColumnRenamed(group, "_group")
    joined = values.join(boxes, F.col(group).eqNullSafe(F.col("_group")))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outside"),
    )


def evolution_frame(
    df: DataFrame,
    x: str = "base_date",
    y: str = "avg_wape_across_periods",
    group: str = "model",
) -> DataFrame:
    """A metric over the windows, one line per group."""
    _require(df, [x, y, group])
    return df.select(group, x, y).orderBy(group, x)


def ape_long(df: DataFrame, group: str = "model", series: str = "series_name") -> DataFrame:
    ids = [group, series] + [c for c in ("window",) if c in df.columns]
    return melt_horizons(df, ids, "ape_f", "ape")


def ape_histogram(df: DataFrame, width: float = 0.05, group: str = "model") -> DataFrame:
    """Fixed-width histogram of APE per group."""
    long = ape_long(df, group).filter(F.col("ape").isNotNull())
    return long.groupBy(group, F.floor(F.col("ape") / width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def ape_distribution(df: DataFrame, group: str = "model") -> DataFrame:
    """Quartiles and count of APE per group."""
    values = group_values(ape_long(df, group).filter(F.col("ape").isNotNull()), group, "ape")
    named = {"min_ape": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max_ape": 1.0}
    counts = values.groupBy(F.col(group).alias("_group")).agg(F.count("value").alias("n"))
    quantiles = group_quantiles(values, group, named)
    return quantiles.join(counts, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def actual_vs_forecast(
    df: DataFrame,
    ids: Sequence[str] = ("model", "series_name", "window"),
    actual_prefix: str = "actual_values_f",
    forecast_prefix: str = "forecast_values_f",
) -> DataFrame:
    """Actual and forecast of every step side by side, in one pass over the wide table."""
    _require(df, ids)
    forecasts = {_number(c): c for c in step_columns(df, forecast_prefix)}
    actuals = {_number(c): c for c in step_columns(df, actual_prefix)}
    steps = sorted(forecasts.keys() & actuals.keys())
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("step"),
                F.lit(f"F{n}").alias("forecast_step"),
                F.col(actuals[n]).alias("actual"),
                F.col(forecasts[n]).alias("forecast"),
            )
            for n in steps
        ]
    )
    return df.select(*ids, F.inline(cells))


def scatter_frame(pairs: DataFrame, series: str | None = None) -> DataFrame:
    """Pairs of one series, or of all when ``series`` is None."""
    return pairs if series is None else pairs.filter(F.col("series_name") == series)


def scatter_limit(pairs: DataFrame, padding: float = 100.0) -> DataFrame:
    """Common axis limit: the largest actual or forecast plus padding."""
    return pairs.agg((F.greatest(F.max("actual"), F.max("forecast")) + padding).alias("axis_limit"))


def forecast_timeline(
    df: DataFrame, prefix: str = "forecast_values_f", cutoff: str | None = None
) -> DataFrame:
    """Forecasts in long form with the month of each step, from ``cutoff`` on."""
    ids = ["model", "series_name", "base_date", "window", "forecast_start"]
    long = melt_horizons(df, ids, prefix, "forecast_value").withColumn(
        "forecast_period", F.add_months("forecast_start", F.col("step") - 1)
    )
    if cutoff is not None:
        long = long.filter(F.col("forecast_period") >= F.lit(cutoff).cast("date"))
    return long.select(
        "model", "series_name", "base_date", "window", "step", "forecast_value", "forecast_period"
    )


def ordered_timeline(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy("model", "series_name", "base_date", "step")


def history_from(df: DataFrame, cutoff: str) -> DataFrame:
    """History under its chart names, from ``cutoff`` on (inclusive)."""
    return df.filter(F.col("time_index") >= F.lit(cutoff).cast("date")).select(
        F.col("series_id").alias("series_name"),
        F.col("time_index").alias("period"),
        F.col("value").alias("actual"),
    )


def timeline_slice(
    timeline: DataFrame, series: str, model: str, steps: Sequence[int]
) -> DataFrame:
    """One series and model at the chosen steps."""
    return timeline.filter(
        (F.col("series_name") == series)
        & (F.col("model") == model)
        & F.col("step").isin(*steps)
    )


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def timeline_choices(timeline: DataFrame) -> DataFrame:
    """The series, models and steps one can pick."""
    return overview(timeline, ["series_name", "model", "step"])
