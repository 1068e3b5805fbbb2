"""From raw predictions to scored pairs: align, check, inverse-scale, clip.

Predictions carry (model, window, series_id, time_index, forecast); actuals carry
(window, series_id, time_index, actual).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.errors import clip_nonneg
from demandloom.operators.scaling import invert_minmax
from demandloom.operators.windows import split

KEYS = ["window", "series_id", "time_index"]


class AlignmentError(ValueError):
    """Predictions and actuals do not cover the same series and months."""


def actuals(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """The test split as actuals."""
    return split(df, calendar, "test").select(*KEYS, F.col("value").alias("actual"))


def align(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs of the months both sides have."""
    return predicted.join(actual, KEYS)


def align_all(actual: DataFrame, predicted: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every actual once per model; the forecast is NULL where the model has none.  A column ``fallback`` is kept."""
    wanted = actual.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), *KEYS, "actual")
    more = [c for c in ("fallback",) if c in predicted.columns]
    return wanted.join(predicted.select("model", *KEYS, "forecast", *more), ["model", *KEYS], "left")


def assert_complete(pairs: DataFrame) -> None:
    """Raise for a pair without a forecast."""
    bad = pairs.where(F.col("forecast").isNull()).select("model", *KEYS).take(1)
    if bad:
        raise AlignmentError(f"no prediction for {bad[0].asDict()}")


def drop_offset(steps: DataFrame, shift: int) -> DataFrame:
    """For models without a native shift: forget the first ``shift`` of ``shift + horizon`` steps."""
    return steps.filter(F.col("step") > shift).withColumn("step", F.col("step") - shift)


def alignment_gaps(actual: DataFrame, predicted: DataFrame, models: Sequence[str]) -> DataFrame:
    """Actual months without a prediction, per model."""
    wanted = actual.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), *KEYS)
    return wanted.join(predicted.select("model", *KEYS), ["model", *KEYS], "left_anti")


def assert_aligned(actual: DataFrame, predicted: DataFrame, models: Sequence[str]) -> None:
    bad = alignment_gaps(actual, predicted, models).take(1)
    if bad:
        raise AlignmentError(f"no prediction for {bad[0].asDict()}")


def pairing_report(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Series and months present on one side only."""
    a = actual.select(*KEYS, F.lit(True).alias("_a"))
    p = predicted.select(*KEYS).distinct().withColumn("_p", F.lit(True))
    both = a.join(p, KEYS, "full_outer")
    side = F.when(F.col("_a").isNull(), F.lit("predicted_only")).otherwise(F.lit("actual_only"))
    return both.filter(F.col("_a").isNull() | F.col("_p").isNull()).select(*KEYS, side.alias("side"))


def assert_paired(actual: DataFrame, predicted: DataFrame) -> None:
    bad = pairing_report(actual, predicted).take(1)
    if bad:
        raise AlignmentError(f"unpaired row {bad[0].asDict()}")


def process_predictions(
    actual: DataFrame, predicted: DataFrame, params: DataFrame | None = None, check: bool = True
) -> DataFrame:
    """Align, inverse-scale (when parameters are given) and clip at zero, in that order.

    An actual that any of the models has no prediction for raises, unless ``check`` is off.
    """
    if check:
        # one row per model
        assert_aligned(actual, predicted, [r["model"] for r in predicted.select("model").distinct().collect()])
    pairs = invert_minmax(align(actual, predicted), params)
    return pairs.withColumn("forecast", clip_nonneg(F.col("forecast")))
