"""Window calendar, splits, retrain schedule.

A calendar has one row per window (a handful, fixed by the configuration), so it is always
broadcast.  Splits are tags on the long table, never copies on disk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.functions.months import month_start


class LeakageError(ValueError):
    """A tuning window reaches into the backtest."""


def earliest_end(df: DataFrame) -> DataFrame:
    """The earliest last month over all series, as one row.

    Also accepts raw transactions: the month is taken after the maximum, so only the key and the
    timestamp are read.
    """
    ends = df.groupBy("series_id").agg(F.max("time_index").alias("_last"))
    return ends.agg(month_start(F.min("_last")).alias("min_end"))


def backtest_start(df: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """First base month such that the last window still ends inside every series."""
    back = (cfg.horizon + cfg.shift - 1) + (cfg.windows - 1)
    start = F.lit(cfg.start_date) if cfg.start_date else F.add_months("min_end", -back)
    return earliest_end(df).select(start.alias("backtest_start"), "min_end")


def tuning_start(starts: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """First tuning base month: the last tuning forecast ends before the backtest starts."""
    back = (cfg.horizon + cfg.shift) + (cfg.tuning_windows - 1)
    start = (
        F.lit(cfg.tuning_start_date)
        if cfg.tuning_start_date
        else F.add_months("backtest_start", -back)
    )
    return starts.select("backtest_start", start.alias("tuning_start"), "min_end")


def window_calendar(df: DataFrame, cfg: BacktestConfig, mode: str = "backtest") -> DataFrame:
    """One row per window with its base month, cut months and forecast period."""
    if mode == "backtest":
        starts, first, count = backtest_start(df, cfg), "backtest_start", cfg.windows
    elif mode == "tuning":
        starts, first = tuning_start(backtest_start(df, cfg), cfg), "tuning_start"
        count = cfg.tuning_windows
    else:
        raise ValueError(f"mode must be 'backtest' or 'tuning', not {mode!r}")
    numbered = starts.select(
        F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("window"), first, "min_end"
    )
    based = numbered.withColumn("base_date", F.add_months(first, F.col("window")))
    forecast_start = F.add_months("base_date", cfg.shift)
    return based.select(
        "window",
        "base_date",
        F.add_months("base_date", -cfg.train_lag).alias("train_end_date"),
        F.add_months("base_date", -1).alias("validation_end_date"),
        forecast_start.alias("forecast_start"),
        F.least(F.add_months(forecast_start, cfg.horizon - 1), F.col("min_end")).alias("forecast_end"),
    )


def pin_calendar(calendar: DataFrame) -> DataFrame:
    """The calendar as literal rows.

    A calendar derived from the data is a full pass over the demand; every use of it in a plan would
    repeat that pass.  Its size is fixed by the configuration (one row per window), so it is
    evaluated once and travels as constants from then on.
    """
    dates = ", ".join(f"CAST({c} AS DATE) AS {c}" for c in calendar.columns if c != "window")
    found = calendar.collect()
    if not found or any(v is None for row in found for v in row):
        raise ValueError("the demand is empty, so it has no calendar")
    rows = ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in found
    )
    names = ", ".join(calendar.columns)
    return calendar.sparkSession.sql(f"SELECT window, {dates} FROM VALUES {rows} AS c({names})")


def leakage_rows(tuning: DataFrame, backtest: DataFrame) -> DataFrame:
    """Tuning windows whose forecast period reaches the first backtest base month."""
    first = backtest.agg(F.min("base_date").alias("backtest_start"))
    return tuning.join(F.broadcast(first), F.col("forecast_end") >= F.col("backtest_start")).select(
        "window", "forecast_start", "forecast_end", "backtest_start"
    )


def assert_no_leakage(tuning: DataFrame, backtest: DataFrame) -> None:
    bad = leakage_rows(tuning, backtest).take(1)
    if bad:
        raise LeakageError(
            f"tuning window {bad[0]['window']} forecasts until {bad[0]['forecast_end']}, "
            f"the backtest starts at {bad[0]['backtest_start']}"
        )


def _in_split(which: str) -> Column:
    t = F.col("time_index")
    conditions = {
        "train": t <= F.col("train_end_date"),
        "validation": t <= F.col("validation_end_date"),
        "test": t.between(F.col("forecast_start"), F.col("forecast_end")),
        "future": t <= F.col("forecast_end"),
    }
    if which not in conditions:
        raise ValueError(f"unknown split {which!r}")
    return conditions[which]


def split(df: DataFrame, calendar: DataFrame, which: str, *calendar_cols: str) -> DataFrame:
    """Rows of one split, tagged with their window.

    ``train`` and ``validation`` are both prefixes of the series, so validation contains train;
    ``future`` is the test split of covariates that are known in advance.
    """
    joined = df.join(F.broadcast(calendar), _in_split(which))
    return joined.select("window", *calendar_cols, *df.columns)


def split_all(
    main: DataFrame,
    calendar: DataFrame,
    past: DataFrame | None = None,
    future: DataFrame | None = None,
) -> DataFrame:
    """Train, validation and test rows of main, past and future variables under one calendar.

    Every variable is unpivoted to ``variable`` and ``value``; a row carries the list of splits it
    belongs to, so it is read and joined once.
    """
    parts = [_long_variables(main, "main")]
    parts += [_long_variables(past, "past")] if past is not None else []
    parts += [_long_variables(future, "future")] if future is not None else []
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    known = F.when(F.col("role") == "future", _in_split("future")).otherwise(_in_split("test"))
    tags = F.array_compact(
        F.array(
            F.when(_in_split("train"), F.lit("train")),
            F.when(_in_split("validation"), F.lit("validation")),
            F.when(known, F.lit("test")),
        )
    )
    tagged = rows.join(F.broadcast(calendar), F.col("time_index") <= F.col("forecast_end"))
    return tagged.select(
        "window", F.explode(tags).alias("split"), "role", "variable", "series_id", "time_index", "value"
    )


def _long_variables(df: DataFrame, role: str) -> DataFrame:
    names = [c for c in df.columns if c not in ("series_id", "time_index")]
    as_double = df.select("series_id", "time_index", *[F.col(c).cast("double") for c in names])
    return as_double.unpivot(["series_id", "time_index"], names, "variable", "value").withColumn(
        "role", F.lit(role)
    )


def expanding(
    df: DataFrame,
    calendar: DataFrame,
    aggregates: dict[str, tuple[str, str]],
    keys: Sequence[str] = ("series_id",),
    cut: str = "train_end_date",
) -> DataFrame:
    """Aggregates of each series over all rows up to each window's cut month.

    ``aggregates`` maps an output name to (function, column) with function min, max, sum or count.
    A row is aggregated once, into the first cut that contains it; running aggregates over the few cuts
    of a series do the rest.  Rows are never repeated per window.  The calendar may be any part of a
    calendar: results carry its own window ids.
    """
    if cut not in ("train_end_date", "validation_end_date"):
        raise ValueError(f"cannot expand up to {cut!r}")
    # one entry per window, ordered by cut
    ordered = F.array_sort(F.collect_list(F.struct(F.col(cut).alias("cut"), "window")))
    bounds = calendar.agg(ordered.alias("_cuts")).select(
        F.transform("_cuts", lambda c: c["cut"]).alias("_cuts"),
        F.element_at("_cuts", -1)["cut"].alias("_last_cut"),
        (F.size("_cuts") - 1).alias("_last"),
        F.transform("_cuts", lambda c: c["window"]).alias("_windows"),
    )
    first_window = F.size(F.filter("_cuts", lambda c: c < F.col("time_index")))
    once = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    again = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
    placed = (
        df.join(F.broadcast(bounds), F.col("time_index") <= F.col("_last_cut"))
        .withColumn("_window", first_window)
        .groupBy(*keys, "_window")
        .agg(
            F.first("_last").alias("_last"),
            F.first("_windows").alias("_windows"),
            *[once[f](c).alias(name) for name, (f, c) in aggregates.items()],
        )
    )
    in_order = Window.partitionBy(*keys).orderBy("_window")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("_window").over(in_order) - 1, F.col("_last"))
    running = placed.select(
        *keys,
        "_window",
        until.alias("_until"),
        "_windows",
        *[again[f](name).over(so_far).alias(name) for name, (f, _) in aggregates.items()],
    )
    served = F.slice("_windows", F.col("_window") + 1, F.col("_until") - F.col("_window") + 1)
    return running.select(F.explode(served).alias("window"), *keys, *aggregates)


def retrain_flags(calendar: DataFrame, frequency: bool | int) -> DataFrame:
    """Which windows train a model: all, the first only, or every n-th."""
    if frequency is True:
        flag = F.lit(True)
    elif frequency is False:
        flag = F.col("window") == 0
    elif frequency > 0:
        flag = F.pmod(F.col("window"), F.lit(frequency)) == 0
    else:
        raise ValueError("frequency must be True, False or a positive number of windows")
    return calendar.withColumn("retrained", flag)


def model_of_window(flagged: DataFrame) -> DataFrame:
    """The window whose model serves each window: the latest one trained so far."""
    # one row per window, bounded by the configuration
    order = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    trained = F.last(F.when(F.col("retrained"), F.col("window")), ignorenulls=True).over(order)
    return flagged.withColumn("model_window", trained)
