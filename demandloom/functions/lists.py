"""Lists stored as text in result files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list(text: Column) -> Column:
    """``[a, b, c]`` or ``[a b c]`` to ``array<double>``; None entries and nan become NULL."""
    parts = F.split(F.regexp_replace(text, r"[\[\]]", ""), r"[\s,]+")
    kept = F.filter(parts, lambda p: p != "")
    return F.transform(kept, lambda p: F.nanvl(p.try_cast("double"), F.lit(None).cast("double")))


def list_text(values: Column, decimals: int | None = None) -> Column:
    """``array<double>`` to the comma form; NULL entries are written as ``nan``."""
    number = (lambda v: F.round(v, decimals)) if decimals is not None else (lambda v: v)
    cells = F.transform(values, lambda v: F.coalesce(number(v).cast("string"), F.lit("nan")))
    return F.concat(F.lit("["), F.array_join(cells, ", "), F.lit("]"))
