"""Deterministic uniform draws: equal inputs give equal values on any cluster and any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**32: the number of values eight hexadecimal digits can take
_RANGE = 4294967296.0


def uniform_draw(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1) from the md5 of the seed and the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(_RANGE)
