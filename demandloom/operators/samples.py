"""Supervised samples: lookback inputs, shifted targets, covariates, step budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.series import Roles
from demandloom.operators.windows import expanding


def lag_names(lookback: int) -> list[str]:
    return [f"lag_{k}" for k in range(lookback)]


def target_names(horizon: int) -> list[str]:
    return [f"y_{h}" for h in range(1, horizon + 1)]


def make_samples(
    df: DataFrame, lookback: int, horizon: int, shift: int, found: Roles | None = None
) -> DataFrame:
    """One row per series and cut month t with a complete lookback.

    ``lag_k`` is the value k months before t, ``y_h`` the value ``shift + h`` months after t (NULL
    past the end).  With roles, past covariates are taken at t and future covariates at each target
    month, as ``<name>_h<h>``.  Samples are built once per series; a window uses those whose
    ``sample_end`` lies in its train split.
    """
    by_series = Window.partitionBy("series_id").orderBy("time_index")
    past = found.past if found else ()
    future = found.future if found else ()
    ahead = [
        F.lead(c, shift + h).over(by_series).alias(f"{c}_h{h}")
        for c in future
        for h in range(1, horizon + 1)
    ]
    wide = df.select(
        "series_id",
        "time_index",
        F.add_months("time_index", shift + horizon).alias("sample_end"),
        F.row_number().over(by_series).alias("_row"),
        *[F.lag("value", k).over(by_series).alias(n) for k, n in enumerate(lag_names(lookback))],
        *past,
        *ahead,
        *[
            F.lead("value", shift + h).over(by_series).alias(n)
            for h, n in enumerate(target_names(horizon), 1)
        ],
    )
    return wide.filter(F.col("_row") >= lookback).drop("_row")


def train_samples(samples: DataFrame, calendar: DataFrame) -> DataFrame:
    """Samples of each window's train split: targets included, nothing after the cut."""
    cuts = calendar.select("window", "train_end_date")
    return samples.join(F.broadcast(cuts), F.col("sample_end") <= F.col("train_end_date")).drop(
        "train_end_date"
    )


def predict_samples(samples: DataFrame, calendar: DataFrame) -> DataFrame:
    """The one sample per series and window that ends at the latest month known."""
    cuts = calendar.select("window", "forecast_start", F.col("validation_end_date").alias("time_index"))
    return samples.join(F.broadcast(cuts), "time_index")


def attach_static(samples: DataFrame, dim: DataFrame, names: Sequence[str]) -> DataFrame:
    return samples.join(dim.select("series_id", *names), "series_id")


def chunk_count(df: DataFrame, calendar: DataFrame, lookback: int) -> DataFrame:
    """Sliding chunks in each window's train split, summed over series."""
    lengths = expanding(df, calendar, {"_n": ("count", "value")})
    chunks = F.greatest(F.lit(0).cast("long"), F.col("_n") - lookback + 1)
    return lengths.groupBy("window").agg(F.sum(chunks).alias("total_chunks"))


def step_budget(chunks: DataFrame, batch_size: int, epochs: int) -> DataFrame:
    """Optimiser steps per window: ceil(chunks / batch) * epochs + 1."""
    per_epoch = F.ceil(F.col("total_chunks") / batch_size)
    return chunks.withColumn("total_steps", per_epoch * epochs + 1)
