"""Result tables: Parquet with arrays, or CSV with lists as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.lists import list_text, parse_list
from demandloom.operators.analysis import expand_list, expand_lists

WINDOW_SCHEMA = (
    "backtest_date string, model string, window int, base_date date, retrained boolean, "
    "forecast_start date, forecast_end date, avg_wape_across_periods double, "
    "wape_per_period string, model_hyperparameters string"
)
SERIES_SCHEMA = (
    "backtest_date string, model string, series_index int, series_name string, window int, "
    "base_date date, retrained boolean, forecast_start date, forecast_end date, mape double, "
    "ape string, actual_values string, forecast_values string, model_hyperparameters string"
)
LIST_COLUMNS = ("ape", "actual_values", "forecast_values")


def _read_csv(spark: SparkSession, folder: str, level: str, schema: str) -> DataFrame:
    """Files named for the level, and folders of that name written by Spark."""
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
    )
    return reader.csv(f"{folder}/*{level}_results.csv")


def read_window_results(
    spark: SparkSession, folder: str, expand: bool = False, length: int | None = None
) -> DataFrame:
    """All ``*window_results.csv`` of a folder; WAPE lists as arrays or as ``wape_f1..n``."""
    raw = _read_csv(spark, folder, "window", WINDOW_SCHEMA)
    parsed = raw.withColumn("wape_per_period", parse_list(F.col("wape_per_period")))
    return expand_list(parsed, "wape_per_period", "wape", length) if expand else parsed


def read_series_results(
    spark: SparkSession,
    folder: str,
    cols_to_split: Sequence[str] = LIST_COLUMNS,
    length: int | None = None,
) -> DataFrame:
    """All ``*series_results.csv`` of a folder, the chosen list columns as ``<name>_f1..n``.

    The other list columns stay text.
    """
    out = _read_csv(spark, folder, "series", SERIES_SCHEMA)
    out = out.withColumns({c: parse_list(F.col(c)) for c in cols_to_split})
    return expand_lists(out, cols_to_split, length)


def read_results(
    spark: SparkSession, folder: str, cols_to_split: Sequence[str] = LIST_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """Window-level and series-level results together."""
    return (
        read_window_results(spark, folder, expand=True),
        read_series_results(spark, folder, cols_to_split),
    )


def write_results(
    window_df: DataFrame,
    series_df: DataFrame,
    folder: str,
    model: str,
    timestamp: str,
    csv: bool = False,
) -> tuple[str, str]:
    """Save both levels as ``<timestamp>_utc_<model>_backtest_<level>_results``.

    Parquet is partitioned by model and keeps arrays; ``csv`` writes lists as text instead, as a
    folder ending in ``.csv`` that the readers above accept.
    """
    names = []
    for level, df in (("window", window_df), ("series", series_df)):
        target = f"{folder}/{timestamp}_utc_{model}_backtest_{level}_results"
        if csv:
            target += ".csv"
            fields = [f.strip().split(" ")[0] for f in _schema(level).split(",")]
            lists = [c for c, t in df.dtypes if t.startswith("array")]
            text = df.withColumns({c: list_text(F.col(c)) for c in lists}).select(*fields)
            text.write.option("header", True).option("escape", '"').csv(target)
        else:
            df.write.partitionBy("model").parquet(target)
        names.append(target)
    return names[0], names[1]


def _schema(level: str) -> str:
    return WINDOW_SCHEMA if level == "window" else SERIES_SCHEMA


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet result table; a filter on ``model`` reads only that model's files."""
    return spark.read.parquet(path)
