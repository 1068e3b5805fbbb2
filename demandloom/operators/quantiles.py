"""Exact quantiles per group, without sorting or moving rows where groups are few.

Radix selection: a first pass counts the values of every group by sign and power of two, the next ones split
only the brackets that hold a wanted rank into equal bins, until a bracket holds one value.  A pass is one aggregation that
is combined on the map side: what is shuffled and sent to the driver are counts by bin, whatever the number of rows, and a group
that holds a third of all rows costs no more than another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators.series import sorted_slots

# bins of the passes after the first one
BINS = 4096
# counted (group, power) pairs up to which the brackets are kept on the driver
MAX_COUNTS = 20_000

# powers of two of the doubles, the smallest ones included, lie within this distance of zero
_POWERS = 1200
_ZERO = 2 * _POWERS


def _power_bin(value: Column) -> Column:
    """A number that never falls with the value: its sign and power of two, infinities and NaN in bins of their own."""
    power = F.floor(F.log2(F.abs(value))) + _POWERS
    # the larger a negative value's size, the smaller its bin
    return (
        F.when(F.isnan(value), F.lit(2 * _ZERO + 1))
        .when(value == float("inf"), F.lit(2 * _ZERO))
        .when(value == float("-inf"), F.lit(0))
        .when(value == 0, F.lit(_ZERO))
        .when(value > 0, F.lit(_ZERO) + power)
        .otherwise(F.lit(_ZERO) - power)
        .cast("int")
    )


def _counted(rows: DataFrame, *keys: str) -> list:
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return grouped.collect()


def radix_quantiles(
    values: DataFrame, group: str, probabilities: Sequence[float], max_counts: int = MAX_COUNTS
) -> DataFrame | None:
    """(group, p, quantile) of ``values(group, value)``, linearly interpolated; NULL values don't count, NaN is the largest.

    None where the groups are too many for counts on the driver (more than ``max_counts`` pairs of group and power).
    """
    present = values.where(F.col("value").isNotNull())
    powers = present.groupBy(group, _power_bin(F.col("value")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    first = powers.limit(max_counts + 1).collect()
    if len(first) > max_counts:
        return None
    by_group: dict = {}
    for r in sorted(first, key=lambda r: r["bin"]):
        by_group.setdefault(r[group], []).append(r)
    # (group, rank) -> value, once it is known, or its bracket (lowest, highest, rank inside)
    found: dict = {}
    brackets: dict = {}
    wanted = []
    for name, bins in by_group.items():
        size = sum(r["n"] for r in bins)
        for p in probabilities:
            at = float(p) * (size - 1)
            wanted.append((name, float(p), math.floor(at), math.ceil(at), at - math.floor(at)))
            for rank in (math.floor(at), math.ceil(at)):
                _narrow(found, brackets, (name, rank), rank, bins)
    while brackets:
        spans = sorted({(name, lo, hi) for (name, _), (lo, hi, _) in brackets.items()}, key=repr)
        bins = _split(present, group, spans)
        before, brackets = brackets, {}
        for (name, rank), (lo, hi, inside) in before.items():
            _narrow(found, brackets, (name, rank), inside, bins[spans.index((name, lo, hi))])
    rows = [(name, p, _between(found[name, a], found[name, b], share)) for name, p, a, b, share in wanted]
    schema = T.StructType(values.select(group).schema.fields).add("p", T.DoubleType()).add("quantile", T.DoubleType())
    return values.sparkSession.createDataFrame(rows, schema)


def _between(low: float, high: float, share: float) -> float:
    return low if low == high or share == 0 else low + (high - low) * share


def _narrow(found: dict, brackets: dict, key: tuple, rank: int, bins: list) -> None:
    """The bin that holds a rank: its value if it has only one, its bracket otherwise."""
    for r in bins:
        if rank < r["n"]:
            # NaN, alone in its bin, is equal to nothing
            if r["lo"] == r["hi"] or math.isnan(r["lo"]):
                found[key] = r["lo"]
            else:
                brackets[key] = (r["lo"], r["hi"], rank)
            return
        rank -= r["n"]
    raise AssertionError("a rank lies beyond its group")


def _split(present: DataFrame, group: str, spans: list) -> list[list]:
    """Counts of every span's values in equal bins, in order; spans of a group don't overlap."""
    schema = T.StructType(present.select(group).schema.fields).add("_place", T.IntegerType())
    schema = schema.add("_lo", T.DoubleType()).add("_hi", T.DoubleType())
    # two spans per group and probability at most
    table = present.sparkSession.createDataFrame([(n, i, lo, hi) for i, (n, lo, hi) in enumerate(spans)], schema)
    table = table.withColumnRenamed(group, "_group")
    inside = F.col(group).eqNullSafe(F.col("_group")) & F.col("value").between(F.col("_lo"), F.col("_hi"))
    share = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    bin_of = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    placed = present.join(F.broadcast(table), inside).select("_place", bin_of, "value")
    out: list[list] = [[] for _ in spans]
    for r in sorted(_counted(placed, "_place", "bin"), key=lambda r: r["bin"]):
        out[r["_place"]].append(r)
    return out


def sorted_quantiles(values: DataFrame, group: str, probabilities: Sequence[float]) -> DataFrame:
    """(group, p, quantile) from a range-partitioned sort, for any number of groups."""
    spread = F.xxhash64(F.monotonically_increasing_id()).alias("_hash")
    rows = values.where(F.col("value").isNotNull()).select(group, "value", spread)
    ranked = sorted_slots(rows, group, "value", "_hash").drop("_hash")
    sizes = ranked.groupBy(group).agg(F.min("_rank").alias("_first"), F.count("value").alias("_n"))
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    targets = sizes.select(group, "_first", "_n", ps).withColumn("_at", F.col("p") * (F.col("_n") - 1))
    low = (F.col("_first") + F.floor("_at")).cast("long")
    high = (F.col("_first") + F.ceil("_at")).cast("long")
    wanted = targets.select("p", "_at", F.explode(F.array_distinct(F.array(low, high))).alias("_rank"))
    # ranks are unique, so this is an equi-join that keeps two rows per group and probability
    hits = ranked.join(wanted, "_rank")
    share = F.first("_at") - F.floor(F.first("_at"))
    low, high = F.min("value"), F.max("value")
    return hits.groupBy(group, "p").agg(F.when(low == high, low).otherwise(low + (high - low) * share).alias("quantile"))
