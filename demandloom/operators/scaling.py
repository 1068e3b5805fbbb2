"""Min-max scaling fitted on train only, static encoding, instance normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.series import dense_index
from demandloom.operators.windows import _in_split, expanding


def _width(low: Column, high: Column) -> Column:
    """The scale's range; a constant series is divided by one."""
    return F.when(high == low, F.lit(1.0)).otherwise(high - low)


def fit_minmax(
    df: DataFrame, calendar: DataFrame, variables: Sequence[str] = ("value",)
) -> DataFrame:
    """Minimum and maximum per window, variable and series over the train split."""
    wanted = {f"_lo_{v}": ("min", v) for v in variables} | {f"_hi_{v}": ("max", v) for v in variables}
    found = expanding(df, calendar, wanted)
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable"),
                F.col(f"_lo_{v}").cast("double").alias("low"),
                F.col(f"_hi_{v}").cast("double").alias("high"),
            )
            for v in variables
        ]
    )
    return found.select("window", "series_id", F.inline(rows))


def scale_split(
    df: DataFrame, calendar: DataFrame, which: str, variables: Sequence[str] = ("value",)
) -> DataFrame:
    """Fit on train and scale one split in a single pass over each series.

    The limits of all windows are taken over the series' rows as they are, side by side; only rows
    of the split itself are then repeated per window.  No fitted table is stored or joined.
    """
    # one entry per window
    cuts = {r["window"]: r["train_end_date"] for r in calendar.collect()}
    place = F.create_map(*(F.lit(x) for pair in zip(cuts, range(len(cuts))) for x in pair))
    whole = Window.partitionBy("series_id")
    limits = {}
    for v in variables:
        seen = [F.when(F.col("time_index") <= F.lit(cut), F.col(v)) for cut in cuts.values()]
        limits[f"_lo_{v}"] = F.array(*[F.min(x).over(whole) for x in seen])
        limits[f"_hi_{v}"] = F.array(*[F.max(x).over(whole) for x in seen])
    rows = df.withColumns(limits).join(F.broadcast(calendar), _in_split(which))

    def scaled(v: str) -> Column:
        low, high = F.col(f"_lo_{v}")[place[F.col("window")]], F.col(f"_hi_{v}")[place[F.col("window")]]
        return ((F.col(v) - low) / _width(low, high)).alias(v)

    return rows.select("window", *[scaled(c) if c in variables else c for c in df.columns])


def apply_minmax(
    rows: DataFrame, params: DataFrame | None, column: str = "value", variable: str = "value"
) -> DataFrame:
    """Scale ``column`` with stored parameters; without parameters (scaling off) rows pass as is."""
    if params is None:
        return rows
    p = params.filter(F.col("variable") == variable).drop("variable")
    scaled = (F.col(column) - F.col("low")) / _width(F.col("low"), F.col("high"))
    return rows.join(p, ["window", "series_id"]).withColumn(column, scaled).drop("low", "high")


def invert_minmax(
    rows: DataFrame, params: DataFrame | None, column: str = "forecast", variable: str = "value"
) -> DataFrame:
    """Scaled values back to original units."""
    if params is None:
        return rows
    p = params.filter(F.col("variable") == variable).drop("variable")
    restored = F.col(column) * _width(F.col("low"), F.col("high")) + F.col("low")
    return rows.join(p, ["window", "series_id"]).withColumn(column, restored).drop("low", "high")


def encode_static(
    dim: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()
) -> DataFrame:
    """Static covariates as numbers across all series: min-max or position among sorted values."""
    out = dim
    if numeric:
        limits = dim.agg(
            *[F.min(c).cast("double").alias(f"_lo_{c}") for c in numeric],
            *[F.max(c).cast("double").alias(f"_hi_{c}") for c in numeric],
        )
        # one row of limits; the condition holds for every series with an id
        out = out.join(F.broadcast(limits), F.col("series_id").isNotNull()).withColumns(
            {c: (F.col(c) - F.col(f"_lo_{c}")) / _width(F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
             for c in numeric}
        )
    for c in categorical:
        out = out.join(dense_index(dim, c, f"_code_{c}"), c, "left").withColumn(
            c, F.col(f"_code_{c}").cast("double")
        )
    return out.select(dim.columns)


def instance_norm(df: DataFrame, lookback: int, eps: float = 1e-5) -> DataFrame:
    """Each value relative to mean and spread of its own lookback chunk (itself and the months
    before); ``chunk_mean`` and ``chunk_std`` undo it.  Incomplete chunks are left out."""
    chunk = Window.partitionBy("series_id").orderBy("time_index").rowsBetween(1 - lookback, 0)
    stats = df.select(
        "*",
        F.avg("value").over(chunk).alias("chunk_mean"),
        F.sqrt(F.var_pop("value").over(chunk) + F.lit(eps)).alias("chunk_std"),
        F.count("value").over(chunk).alias("_n"),
    )
    normed = (F.col("value") - F.col("chunk_mean")) / F.col("chunk_std")
    return stats.filter(F.col("_n") == lookback).withColumn("value_norm", normed).drop("_n")


def undo_instance_norm(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.col(column) * F.col("chunk_std") + F.col("chunk_mean"))
