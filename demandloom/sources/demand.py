"""Readers for demand and covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.config import SeriesSpec
from demandloom.functions.months import month_start
from demandloom.operators.series import cast_float32, monthly_totals, roles


def read_demand(
    spark: SparkSession,
    path: str,
    spec: SeriesSpec = SeriesSpec(),
    use_static: bool = True,
    use_past: bool = True,
    use_future: bool = True,
    before: str | None = None,
    truncate: bool = True,
    as_float32: bool = False,
) -> DataFrame:
    """Long demand from Parquet under the canonical names, with the role columns switched on.

    ``before`` filters the raw time column, so it reaches the scan.  ``truncate`` moves times to
    their month start; leave it off when ``monthly_totals`` follows.
    """
    table = spark.read.parquet(path)
    if before is not None:
        table = table.filter(F.col(spec.time_index) < F.lit(before).cast("timestamp_ntz"))
    found = roles(table.columns, use_static, use_past, use_future)
    time = F.col(spec.time_index)
    long = table.select(
        F.col(spec.series_id).cast("string").alias("series_id"),
        (month_start(time) if truncate else time).alias("time_index"),
        F.col(spec.value).alias("value"),
        *found.all,
    )
    return cast_float32(long, ["value", *found.past, *found.future]) if as_float32 else long


def read_covariates(
    spark: SparkSession,
    path: str,
    time_index: str = "time_index",
    aggregates: dict[str, Column] | None = None,
    columns: Sequence[str] | None = None,
    before: str | None = None,
) -> DataFrame:
    """Month-level covariates: role columns as stored, or ``aggregates`` over transactions."""
    table = spark.read.parquet(path)
    if before is not None:
        table = table.filter(F.col(time_index) < F.lit(before).cast("timestamp_ntz"))
    if aggregates is not None:
        return monthly_totals(table.withColumn("time_index", F.col(time_index)), aggregates, keys=())
    names = columns or roles(table.columns, use_static=False).all
    return table.select(month_start(F.col(time_index)).alias("time_index"), *names)
