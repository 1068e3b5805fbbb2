import os
import sys
from datetime import date

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(n: int) -> date:
    """Month n counted from January 2000."""
    return date(2000 + n // 12, n % 12 + 1, 1)


def long_frame(spark, histories: dict, starts: dict | None = None):
    """Long table from {series: values}; None leaves a month out."""
    rows = [
        (s, month((starts or {}).get(s, 0) + i), float(v))
        for s, values in histories.items()
        for i, v in enumerate(values)
        if v is not None
    ]
    return spark.createDataFrame(rows, "series_id string, time_index date, value double")


def as_rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
