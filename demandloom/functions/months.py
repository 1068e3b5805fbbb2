"""Month arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(ts: Column) -> Column:
    """First day of the month as DATE, also for TIMESTAMP_NTZ input."""
    return F.trunc(ts.cast("date"), "MM")


def month_number(d: Column) -> Column:
    """Months since year 0 as an int, so that differences count whole months."""
    return F.year(d) * 12 + F.month(d)


def months_apart(later: Column, earlier: Column) -> Column:
    return month_number(later) - month_number(earlier)


def month_sequence(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 1 month"))
