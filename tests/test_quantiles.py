import math
import random

import numpy as np
import pytest

from demandloom.operators import quantiles as qt

PS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def linear(values, p):
    """Linear interpolation over the order in which NaN is the largest."""
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    at = p * (len(ordered) - 1)
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return low if low == high or at == math.floor(at) else low + (high - low) * (at - math.floor(at))


def found(df):
    return {(r["g"], r["p"]): r["quantile"] for r in df.collect()}


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(8)
    return {
        "ties": [1.0] * 500 + [2.0] * 3,
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(700)],
        "close": [1.0 + i * 2.0**-52 for i in range(400)],
        "tiny": [5e-324, 1e-323, 0.0, -0.0, -5e-324, 2.2e-308],
        "ends": [math.inf, -math.inf, 0.0, 1.0, math.nan, math.nan, 3.0],
        "one": [-7.25],
        None: [3.0, 1.0, 2.0],
    }


def test_every_kind_of_value(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values] + [("ties", None), ("empty", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    for got in (found(qt.radix_quantiles(df, "g", PS)), found(qt.sorted_quantiles(df, "g", PS))):
        assert set(got) == {(g, p) for g in groups for p in PS}
        for (g, p), value in got.items():
            want = linear(groups[g], p)
            assert value == want or (math.isnan(value) and math.isnan(want)) or value == pytest.approx(want, rel=1e-12)


def test_many_groups_are_left_to_the_sort(spark):
    df = spark.createDataFrame([(i, float(i * k)) for i in range(50) for k in range(3)], "g int, value double")
    assert qt.radix_quantiles(df, "g", [0.5], max_counts=40) is None
    assert found(qt.sorted_quantiles(df, "g", [0.5])) == {(i, 0.5): float(i) for i in range(50)}


def test_rows_are_not_shuffled(spark):
    """What the passes exchange are partial counts."""
    df = spark.createDataFrame([("a", float(v)) for v in np.random.default_rng(2).normal(size=3000)], "g string, value double")
    grouped = df.groupBy("g", qt._power_bin(df["value"]).alias("bin")).count()
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan
    assert found(qt.radix_quantiles(df, "g", [0.5]))["a", 0.5] == np.quantile([r["value"] for r in df.collect()], 0.5)


def test_no_rows(spark):
    assert qt.radix_quantiles(spark.createDataFrame([], "g string, value double"), "g", PS).count() == 0
