"""Per-series forecasters that are plain DataFrame expressions.

Each one passes over a series once for all windows: windows expand by a month at a time, so running
values read off at the cut months give every window's fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.functions.months import months_apart
from demandloom.models.base import FORECAST_COLUMNS, horizon_months
from demandloom.operators.alignment import drop_offset
from demandloom.operators.series import series_arrays, spread_series


@dataclass(frozen=True)
class SeasonalNaive:
    """The value of the same month in the latest season known at the cut."""

    season: int = 12
    name: str = "SeasonalNaive"

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        ahead = months_apart(F.col("time_index"), F.col("validation_end_date"))
        back = F.ceil(ahead / self.season).cast("int") * self.season
        targets = horizon_months(calendar, cfg).select(
            "window", "time_index", F.add_months("time_index", -back).alias("_source")
        )
        source = series.select("series_id", F.col("time_index").alias("_source"), "value")
        return source.join(F.broadcast(targets), "_source").select(
            F.lit(self.name).alias("model"), "window", "series_id", "time_index",
            F.col("value").cast("double").alias("forecast"),
        )


def _expand_steps(
    fits: DataFrame, calendar: DataFrame, cfg: BacktestConfig, name: str, forecast: Column
) -> DataFrame:
    """Forecast ``shift + horizon`` steps from the cut and discard the first ``shift``."""
    steps = horizon_months(calendar, cfg, with_offset=True)
    rows = fits.join(F.broadcast(steps.select("window", "step", "time_index")), "window")
    kept = drop_offset(rows.withColumn("forecast", forecast), cfg.shift)
    return kept.withColumn("model", F.lit(name)).select(*FORECAST_COLUMNS)


@dataclass(frozen=True)
class OneLagAR:
    """y(t) = a + b y(t-1) by least squares, iterated; falls back to the mean of constant input."""

    name: str = "AR1"

    def fits(self, series: DataFrame, calendar: DataFrame) -> DataFrame:
        """Intercept, slope and last value per window and series, from running sums."""
        order = Window.partitionBy("series_id").orderBy("time_index")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        pairs = series.select(
            "series_id", "time_index", F.col("value").cast("double").alias("y")
        ).withColumn("x", F.lag("y").over(order))
        known = F.col("x").isNotNull()
        sums = {
            "n": F.when(known, F.lit(1.0)),
            "sx": F.col("x"),
            "sy": F.when(known, F.col("y")),
            "sxy": F.col("x") * F.col("y"),
            "sxx": F.col("x") * F.col("x"),
        }
        running = pairs.select(
            "series_id",
            F.col("time_index").alias("validation_end_date"),
            F.col("y").alias("last_value"),
            *[F.sum(c).over(so_far).alias(name) for name, c in sums.items()],
        )
        cuts = calendar.select("window", "validation_end_date")
        at_cut = running.join(F.broadcast(cuts), "validation_end_date")
        spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
        slope = F.coalesce(
            (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"))
            / F.when(spread != 0, spread),
            F.lit(0.0),
        )
        with_slope = at_cut.withColumn("slope", slope)
        intercept = F.coalesce(
            (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"), F.col("last_value")
        )
        return with_slope.select(
            "window", "series_id", "last_value", intercept.alias("intercept"), "slope"
        )

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        iterated = F.aggregate(
            F.sequence(F.lit(1), F.col("step")),
            F.col("last_value"),
            lambda y, _: F.col("intercept") + F.col("slope") * y,
        )
        return _expand_steps(self.fits(series, calendar), calendar, cfg, self.name, iterated)


@dataclass(frozen=True)
class LinearTrend:
    """y(t) = a + b t by least squares over the months known so far."""

    name: str = "LinearTrend"

    def fits(self, series: DataFrame, calendar: DataFrame) -> DataFrame:
        order = Window.partitionBy("series_id").orderBy("time_index")
        timed = series.select(
            "series_id",
            F.col("time_index").alias("validation_end_date"),
            F.col("value").cast("double").alias("y"),
            F.row_number().over(order).cast("double").alias("t"),
        ).withColumns({"ty": F.col("t") * F.col("y")})
        by_cut = Window.partitionBy("series_id").orderBy("validation_end_date")
        so_far = by_cut.rowsBetween(Window.unboundedPreceding, 0)
        running = timed.select(
            "series_id", "validation_end_date", F.col("t").alias("n"),
            F.sum("y").over(so_far).alias("sy"), F.sum("ty").over(so_far).alias("sty"),
        )
        cuts = calendar.select("window", "validation_end_date")
        at_cut = running.join(F.broadcast(cuts), "validation_end_date")
        # sums of t and t*t over 1..n
        st = F.col("n") * (F.col("n") + 1) / 2
        stt = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 6
        spread = F.col("n") * stt - st * st
        slope = F.coalesce(
            (F.col("n") * F.col("sty") - st * F.col("sy")) / F.when(spread != 0, spread), F.lit(0.0)
        )
        fitted = at_cut.withColumn("slope", slope)
        return fitted.select(
            "window", "series_id", "n", "slope",
            ((F.col("sy") - F.col("slope") * st) / F.col("n")).alias("intercept"),
        )

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        line = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step"))
        return _expand_steps(self.fits(series, calendar), calendar, cfg, self.name, line)


def smoothing_levels(series: DataFrame, calendar: DataFrame, weights: DataFrame) -> DataFrame:
    """Level and one-step squared error at each window's cut, for every smoothing weight.

    ``weights`` has a column ``alpha`` (and any others to carry along); it is a grid or a set of
    trials, fixed by the configuration, hence broadcast.  One fold per series and weight serves all
    windows.
    """
    bounds = calendar.agg(
        F.min("validation_end_date").alias("_first_cut"),
        F.max("validation_end_date").alias("_last_cut"),
    )
    arrays = spread_series(series_arrays(series)).join(
        F.broadcast(bounds), F.col("first_month") <= F.col("_last_cut")
    )
    known_first = months_apart(F.col("_first_cut"), F.col("first_month")) + 1
    known_last = months_apart(F.col("_last_cut"), F.col("first_month")) + 1
    placed = arrays.select(
        "series_id",
        "_first_cut",
        F.slice("history", 1, known_last).alias("_y"),
        F.greatest(known_first, F.lit(1)).alias("_from"),
        (F.greatest(known_first, F.lit(1)) - known_first).alias("_skipped"),
    )
    carried = weights.columns
    grid = placed.join(F.broadcast(weights), F.col("alpha").isNotNull())
    y = lambda v: v.cast("double")
    start = F.struct(
        y(F.element_at("_y", 1)).alias("level"), F.lit(0.0).alias("sse"), F.lit(1).alias("n"),
        F.when(
            F.col("_from") == 1,
            F.array(F.struct(y(F.element_at("_y", 1)).alias("level"), F.lit(0.0).alias("sse"))),
        ).otherwise(F.array().cast("array<struct<level:double,sse:double>>")).alias("cuts"),
    )

    def step(state: Column, value: Column) -> Column:
        level = F.col("alpha") * y(value) + (F.lit(1.0) - F.col("alpha")) * state["level"]
        error = y(value) - state["level"]
        sse = state["sse"] + error * error
        n = state["n"] + 1
        cut = F.array(F.struct(level.alias("level"), sse.alias("sse")))
        cuts = F.when(n >= F.col("_from"), F.concat(state["cuts"], cut)).otherwise(state["cuts"])
        return F.struct(level.alias("level"), sse.alias("sse"), n.alias("n"), cuts.alias("cuts"))

    later = F.slice("_y", F.lit(2), F.greatest(F.size("_y") - 1, F.lit(0)))
    folded = grid.select(
        *carried, "series_id", "_skipped", "_first_cut", F.aggregate(later, start, step, lambda s: s["cuts"]).alias("_cuts")
    )
    # never empty; the outer form keeps Spark from testing that by folding once more
    exploded = folded.select(
        *carried, "series_id", "_skipped", "_first_cut", F.posexplode_outer("_cuts").alias("_i", "_c")
    )
    month = F.add_months("_first_cut", F.col("_i") + F.col("_skipped"))
    levels = exploded.select(
        *carried,
        "series_id",
        month.alias("validation_end_date"),
        F.col("_c.level").alias("level"),
        F.col("_c.sse").alias("sse"),
    )
    # months between the calendar's cuts drop out here
    cuts = F.broadcast(calendar.select("window", "validation_end_date"))
    return levels.join(cuts, "validation_end_date").select(*carried, "series_id", "window", "level", "sse")


@dataclass(frozen=True)
class LevelSmoothing:
    """Simple exponential smoothing; the weight with the least one-step squared error per window."""

    grid_steps: int = 20
    name: str = "LevelSmoothing"

    def weights(self, df: DataFrame) -> DataFrame:
        numbers = df.sparkSession.range(1, self.grid_steps)
        return numbers.select((F.col("id").cast("double") / self.grid_steps).alias("alpha"))

    def fits(self, series: DataFrame, calendar: DataFrame) -> DataFrame:
        levels = smoothing_levels(series, calendar, self.weights(series))
        best = F.min(F.struct("sse", "alpha", "level"))
        return levels.groupBy("window", "series_id").agg(best.alias("_b")).select(
            "window", "series_id", "_b.alpha", "_b.level", "_b.sse"
        )

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        return _expand_steps(self.fits(series, calendar), calendar, cfg, self.name, F.col("level"))
