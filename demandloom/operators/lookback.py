"""Samples sliced from month-indexed arrays: the whole lookback of every covariate, own and shared.

A series is one row with an array per variable, indexed by the months since its first one; covariates
shared by all series are one row of arrays indexed by calendar month.  A sample is a set of slices at its cut
month, so the plan has the same size for a lookback of 3 months or 300 and no window or join is needed per lag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.months import month_number
from demandloom.operators.scalers import MinMax, Scaler, safe_width
from demandloom.operators.series import Roles, month_arrays, roles

# months that a shared table may have and still be broadcast (two thousand years)
MAX_SHARED_MONTHS = 24_000


def shared_arrays(cov: DataFrame, names: Sequence[str]) -> DataFrame:
    """Month-level covariates as one row: ``shared_no`` (its first month) and an array ``shared_<name>`` each.

    The number of months is checked, as the row is sent to every task.
    """
    months = cov.agg(F.count(F.lit(1))).first()[0]
    if months > MAX_SHARED_MONTHS:
        raise ValueError(f"{months} rows are too many for a table with one row per month")
    entry = F.struct("time_index", *[F.col(c).cast("double").alias(c) for c in names])
    one = cov.agg(F.min("time_index").alias("_first"), F.array_sort(F.collect_list(entry)).alias("_rows"))
    arrays = [F.transform("_rows", lambda r: r[c]).alias(f"shared_{c}") for c in names]
    return one.select(month_number(F.col("_first")).alias("shared_no"), *arrays)


def with_shared(arrays: DataFrame, cov: DataFrame, found: Roles) -> DataFrame:
    """Series arrays with the shared arrays beside them (one row, of a checked number of months)."""
    one = shared_arrays(cov, [*found.past, *found.future])
    return arrays.join(F.broadcast(one), F.col("first_no").isNotNull())


def with_limits(
    arrays: DataFrame, names: Sequence[str], train_ends: Sequence[int], scaler: Scaler = MinMax()
) -> DataFrame:
    """Offset and width of every variable and window over its train months: ``low`` and ``width``, windows outermost.

    ``train_ends`` are month numbers.  NULL where a window knows no month of a variable.
    """

    def seen(name: str, end: int) -> Column:
        start = F.col("shared_no") if name.startswith("shared_") else F.col("first_no")
        return F.slice(name, 1, F.greatest(F.lit(end) - start + 1, F.lit(0)))

    parts = [scaler.limits(seen(name, end)) for end in train_ends for name in names]
    low, width = [offset for offset, _ in parts], [safe_width(w) for _, w in parts]
    return arrays.select("*", F.array(*low).alias("low"), F.array(*width).alias("width"))


def sliced(arrays: DataFrame, lookback: int, horizon: int, shift: int, found: Roles, common: Roles) -> list[Column]:
    """The slices of a sample whose cut is month ``_at`` of its series.

    ``value_lags`` and ``<past>_lags`` have ``lookback`` entries, the newest first; ``targets`` and ``<future>_ahead`` have
    ``horizon`` entries from month ``shift`` + 1 after the cut on, NULL where the series doesn't reach.  Shared covariates are
    ``shared_<name>_lags`` and ``shared_<name>_ahead``, NULL outside their months.
    """

    def back(name: str, at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(lookback - 1)), lambda k: F.get(name, at - k))

    def ahead(name: str, at: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.get(name, at + shift + h))

    own, month = F.col("_at"), F.col("_at") + F.col("first_no")
    columns = [back("value", own).alias("value_lags"), ahead("value", own).alias("targets")]
    columns += [back(c, own).alias(f"{c}_lags") for c in found.past]
    columns += [ahead(c, own).alias(f"{c}_ahead") for c in found.future]
    if common.past or common.future:
        since = month - F.col("shared_no")
        columns += [back(f"shared_{c}", since).alias(f"shared_{c}_lags") for c in common.past]
        columns += [ahead(f"shared_{c}", since).alias(f"shared_{c}_ahead") for c in common.future]
    return columns


def cut_positions(lookback: int) -> Column:
    """Every position of a series at which the lookback is complete; no row for a shorter series."""
    last = F.size("value") - 1
    return F.explode(F.when(last >= lookback - 1, F.sequence(F.lit(lookback - 1), last)))


def lookback_samples(
    df: DataFrame, lookback: int, horizon: int, shift: int, shared: DataFrame | None = None
) -> DataFrame:
    """One row per series and cut month with a complete lookback, all inputs as arrays.

    Own covariates are found by their prefixes in ``df``, shared ones in ``shared`` (one row per month, gap-free).
    Past covariates never reach beyond the cut; future ones are those of the target months.  ``sample_end`` is the last target
    month: a window trains on the samples whose ``sample_end`` lies in its train split.
    """
    found = roles(df.columns, use_static=False)
    common = roles(shared.columns if shared is not None else [], use_static=False)
    arrays = month_arrays(df, ["value", *found.past, *found.future])
    if shared is not None:
        arrays = with_shared(arrays, shared, common)
    placed = arrays.select("*", cut_positions(lookback).alias("_at"))
    cut = F.add_months("first_month", F.col("_at"))
    return placed.select(
        "series_id",
        cut.alias("time_index"),
        F.add_months(cut, shift + horizon).alias("sample_end"),
        *sliced(arrays, lookback, horizon, shift, found, common),
    )


def as_columns(samples: DataFrame) -> DataFrame:
    """Arrays spread out: ``<name>_lag_<k>`` from 0, ``<name>_h<h>`` and ``y_<h>`` from 1."""
    sizes = [c for c, t in samples.dtypes if t.startswith("array")]
    # arrays of one column are equally long in all rows
    first = samples.select(*[F.size(c).alias(c) for c in sizes]).first()
    out = []
    for c in samples.columns:
        if c not in sizes:
            out.append(F.col(c))
            continue
        n = first[c] if first else 0
        if c.endswith("_lags"):
            out += [F.get(c, F.lit(k)).alias(f"{c[:-1]}_{k}") for k in range(n)]
        else:
            name = "y_" if c == "targets" else f"{c.removesuffix('_ahead')}_h"
            out += [F.get(c, F.lit(h)).alias(f"{name}{h + 1}") for h in range(n)]
    return samples.select(*out)
