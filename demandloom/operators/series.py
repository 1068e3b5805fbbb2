"""Series construction: roles, monthly totals, gap fill, covariates, wide and long form.

The canonical form is long: one row per (series_id, time_index).  After ``monthly_totals`` a series
holds at most one row per calendar month, so windows and arrays over one series stay small however
many raw rows that series had.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.functions.months import month_number, month_sequence, month_start
from demandloom.plans.storage import cut_lineage

PREFIXES = {"static": "static_", "past": "past_", "future": "future_"}


@dataclass(frozen=True)
class Roles:
    static: tuple[str, ...]
    past: tuple[str, ...]
    future: tuple[str, ...]

    @property
    def all(self) -> tuple[str, ...]:
        return self.static + self.past + self.future


def roles(
    columns: Sequence[str], use_static: bool = True, use_past: bool = True, use_future: bool = True
) -> Roles:
    """Covariate roles from column-name prefixes; a role switched off is empty."""

    def having(role: str, wanted: bool) -> tuple[str, ...]:
        return tuple(c for c in columns if c.startswith(PREFIXES[role])) if wanted else ()

    return Roles(having("static", use_static), having("past", use_past), having("future", use_future))


def select_roles(df: DataFrame, found: Roles, *extra: str) -> DataFrame:
    """Keys, ``extra`` columns and the columns of the given roles; the rest is never scanned."""
    return df.select("series_id", "time_index", *extra, *found.all)


def monthly_totals(
    df: DataFrame, aggregates: dict[str, Column] | None = None, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Transactions to one row per key and month.

    The sum is combined on the map side, so a key that holds a third of all rows sends one row per
    month and task to the shuffle.
    """
    aggregates = aggregates or {"value": F.sum("value")}
    month = month_start(F.col("time_index")).alias("time_index")
    return df.groupBy(*keys, month).agg(*[c.alias(n) for n, c in aggregates.items()])


def before_last_month(lines: DataFrame, time_index: str = "time_index") -> DataFrame:
    """Rows before the month of the latest one, which may still be unfinished.

    The latest time is read first (one column), so the condition is a constant that reaches the scan.
    An empty table stays empty.
    """
    last = lines.agg(F.trunc(F.max(time_index), "MM")).first()[0]
    return lines if last is None else lines.filter(F.col(time_index) < F.lit(last).cast("timestamp_ntz"))


def finished_lines(lines: DataFrame, cfg: BacktestConfig, time_index: str = "time_index") -> DataFrame:
    """The lines that a backtest reads: without the latest month where ``cfg.drop_last_month`` says so."""
    return before_last_month(lines, time_index) if cfg.drop_last_month else lines


def fill_months(
    df: DataFrame,
    value_cols: Sequence[str] = ("value",),
    fill: float = 0.0,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Insert the months missing between each series' own first and last month.

    Each row is stretched up to the month before the next one: one window over the series and no
    join against a calendar.  Inserted and missing values become ``fill``.
    """
    by_series = Window.partitionBy(*keys).orderBy("time_index")
    until = F.coalesce(F.add_months(F.lead("time_index").over(by_series), -1), F.col("time_index"))
    stretched = df.select(*keys, "time_index", *value_cols, until.alias("_until")).select(
        *keys,
        *value_cols,
        F.posexplode(month_sequence(F.col("time_index"), F.col("_until"))).alias("_pos", "_month"),
    )
    return stretched.select(
        *keys,
        F.col("_month").alias("time_index"),
        *[
            F.when(F.col("_pos") == 0, fill_missing(df, c, fill)).otherwise(F.lit(fill)).alias(c)
            for c in value_cols
        ],
    )


def fill_missing(df: DataFrame, column: str, fill: float) -> Column:
    """NULL and NaN become ``fill``."""
    missing = F.col(column).isNull()
    if dict(df.dtypes)[column] in ("double", "float"):
        missing = missing | F.isnan(column)
    return F.when(missing, F.lit(fill)).otherwise(F.col(column))


def demand_series(df: DataFrame, fill: float = 0.0, as_float32: bool = False) -> DataFrame:
    """Transactions to gap-free monthly series."""
    filled = fill_months(monthly_totals(df), fill=fill)
    return cast_float32(filled, ["value"]) if as_float32 else filled


def cast_float32(df: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in value_cols})


def covariate_series(df: DataFrame, role: str, fill: float = 0.0) -> DataFrame:
    """Past or future covariates per series, gap-filled like the main series."""
    names = getattr(roles(df.columns), role)
    if not names:
        raise ValueError(f"no column starts with {PREFIXES[role]!r}")
    return fill_months(df, names, fill)


def shared_covariates(
    cov: DataFrame, use_past: bool = True, use_future: bool = True, fill: float = 0.0
) -> DataFrame:
    """Month-level covariates as one gap-free series shared by all series.

    The table has one row per month; its calendar spine comes from a one-row aggregate.
    """
    found = roles(cov.columns, use_static=False, use_past=use_past, use_future=use_future)
    names = found.past + found.future
    spine = cov.agg(F.min("time_index").alias("_a"), F.max("time_index").alias("_b")).select(
        F.explode(month_sequence(F.col("_a"), F.col("_b"))).alias("time_index")
    )
    joined = spine.join(cov.select("time_index", *names), "time_index", "left")
    return joined.select("time_index", *[fill_missing(cov, c, fill).alias(c) for c in names])


def static_dim(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row of static covariates per series; ``static_consistent`` is false when values differ."""
    names = list(names or roles(df.columns).static)
    firsts = [F.min(c).alias(c) for c in names]
    same = [F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(0, F.count(F.lit(1))) for c in names]
    consistent = same[0] if same else F.lit(True)
    for s in same[1:]:
        consistent = consistent & s
    return df.groupBy("series_id").agg(*firsts, consistent.alias("static_consistent"))


def axis_report(df: DataFrame) -> DataFrame:
    """Distinct (first month, last month, months) with the number of series on each axis."""
    spans = df.groupBy("series_id").agg(
        F.min("time_index").alias("first_month"),
        F.max("time_index").alias("last_month"),
        F.count(F.lit(1)).alias("n_months"),
    )
    return spans.groupBy("first_month", "last_month", "n_months").agg(
        F.count(F.lit(1)).alias("n_series")
    )


def common_span(df: DataFrame) -> DataFrame:
    """The months that every series has: from the latest first to the earliest last one."""
    ends = df.groupBy("series_id").agg(F.min("time_index").alias("_a"), F.max("time_index").alias("_b"))
    # one row
    span = ends.agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"))
    return df.join(F.broadcast(span), F.col("time_index").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def to_wide(
    df: DataFrame, series_ids: Sequence[str] | None = None, check_axis: bool = True
) -> DataFrame:
    """One column per series over the union of their months; NULL where a series has no month.

    Width is bounded by Spark's own ``spark.sql.pivotMaxValues``; beyond it the long form is the
    only form.  With ``check_axis`` series of different spans raise instead of leaving holes.
    """
    if check_axis and len(axis_report(df).take(2)) > 1:
        raise ValueError("series do not share one time axis; cut them to a common span first")
    pivoted = df.groupBy("time_index").pivot("series_id", list(series_ids) if series_ids else None)
    return pivoted.agg(F.first("value"))


def to_long(wide: DataFrame) -> DataFrame:
    """Wide form back to one row per series and month; the NULLs of months that a series lacks go."""
    names = [c for c in wide.columns if c != "time_index"]
    long = wide.unpivot("time_index", names, "series_id", "value")
    return long.where(F.col("value").isNotNull()).select("series_id", "time_index", "value")


def profile(df: DataFrame, components: int = 1) -> DataFrame:
    """Number of series, components, rows, and the distinct first and last months as text."""
    axes = axis_report(df)
    months = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return axes.agg(
        F.sum("n_series").alias("n_series"),
        (F.sum("n_series") * components).alias("n_components"),
        F.sum(F.col("n_series") * F.col("n_months")).alias("n_rows"),
        months("first_month").alias("start_months"),
        months("last_month").alias("end_months"),
    )


def series_arrays(df: DataFrame) -> DataFrame:
    """One row per series: first month and the values in month order (at most one per month)."""
    ordered = F.array_sort(F.collect_list(F.struct("time_index", "value")))
    return df.groupBy("series_id").agg(
        F.min("time_index").alias("first_month"),
        F.transform(ordered, lambda p: p["value"]).alias("history"),
    )


def month_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per series: its first month and one array per column in month order.

    ``df`` is gap-free, so an array has one entry per month and is as long as the series.
    """
    entry = F.struct("time_index", *[F.col(c).cast("double").alias(c) for c in columns])
    grouped = df.groupBy("series_id").agg(
        F.min("time_index").alias("first_month"), F.array_sort(F.collect_list(entry)).alias("_rows")
    )
    arrays = [F.transform("_rows", lambda r: r[c]).alias(c) for c in columns]
    return grouped.select("series_id", "first_month", month_number(F.col("first_month")).alias("first_no"), *arrays)


def spread_series(arrays: DataFrame) -> DataFrame:
    """One-row-per-series arrays over all shuffle partitions.

    Fits cost far more per byte than the scans that adaptive execution sizes partitions for, so
    they are spread by count.  What moves is one row per series.
    """
    n = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrays.repartition(n, "series_id")


def sorted_slots(df: DataFrame, *order: str) -> DataFrame:
    """Rows in global sort order with their zero-based ``_rank``.

    A global rank without a global task: rows are range-partitioned and sorted, positions are taken
    inside each partition, and one count per partition turns them into global positions.  The
    placed rows are materialised so that the counts and the rows see the same partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.monotonically_increasing_id()
    placed = cut_lineage(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_slot", slot)
    )
    # the slot's upper bits number the partition, its lower 33 bits the row in it
    numbered = placed.withColumns(
        {
            "_part": F.shiftright("_slot", 33),
            "_pos": F.col("_slot").bitwiseAND((1 << 33) - 1),
        }
    )
    # one row per partition, so this window is bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return numbered.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_pos")).alias("_rank")
    )


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of ``column`` with their zero-based position in sort order; NULL is no value."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = sorted_slots(values, column)
    return ranked.select(column, F.col("_rank").cast("int").alias(name))
