"""Joint forecaster: common factors of all series, and each series regressed on them.

Series are rows and months are columns, so the principal components have as many entries as there
are months; any number of series only adds rows to a distributed covariance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.functions.months import month_number
from demandloom.models.base import FORECAST_COLUMNS, horizon_months
from demandloom.models.pooled import model_windows
from demandloom.operators.alignment import drop_offset
from demandloom.operators.scaling import _width
from demandloom.operators.series import series_arrays
from demandloom.plans.storage import cut_lineage


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


@dataclass(frozen=True)
class FactorModel:
    """Series must start in the same month, unless ``before`` or ``common_span`` says what to do where they don't.

    ``before`` is the value of the months before a series' first one (zero where a month without lines is one without
    demand, as in the gaps), so nothing is cut; with ``common_span`` all are cut to the latest start.
    """

    factors: int = 3
    common_span: bool = False
    before: float | None = None
    name: str = "FactorModel"

    def forecast(self, series: DataFrame, calendar: DataFrame, cfg: BacktestConfig) -> DataFrame:
        rows = {r["window"]: r for r in calendar.collect()}
        total = cfg.shift + cfg.horizon
        # read once per fit and again for every aggregate, so it is written once
        arrays = cut_lineage(
            series_arrays(series).select(
                "series_id", month_number(F.col("first_month")).alias("first_no"), "history"
            )
        )
        earliest, latest = arrays.agg(F.min("first_no"), F.max("first_no")).first()
        if earliest != latest and not self.common_span and self.before is None:
            raise ValueError(
                "series start in different months; set before to fill the months that some lack, or common_span to cut "
                "them to the latest start"
            )
        origin = latest if self.common_span else earliest
        if origin != latest:
            lead = F.array_repeat(F.lit(float(self.before)), F.col("first_no") - origin)
            values = F.concat(lead, F.transform("history", lambda v: v.cast("double")))
            arrays = arrays.select("series_id", F.lit(origin).alias("first_no"), values.alias("history"))
        parts = []
        for window, windows in model_windows(calendar, cfg).items():
            cut_no = _number(rows[window]["train_end_date"])
            last_no = max(_number(rows[w]["validation_end_date"]) for w in windows)
            parts.append(self._served(arrays, origin, cut_no, last_no, windows, rows, total))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        months = horizon_months(calendar, cfg, with_offset=True).select("window", "step", "time_index")
        dated = out.join(F.broadcast(months), ["window", "step"]).withColumn("model", F.lit(self.name))
        return drop_offset(dated, cfg.shift).select(*FORECAST_COLUMNS)

    def _served(self, arrays, origin, cut_no, last_no, windows, rows, total) -> DataFrame:
        """Forecasts of the windows that use the model trained up to ``cut_no``."""
        n_train, n_all = cut_no - origin + 1, last_no - origin + 1
        if n_train <= total:
            raise ValueError("the common span is too short to train on")
        # every series on the months origin..last
        on_axis = F.slice("history", F.lit(origin) - F.col("first_no") + 1, F.lit(n_all))
        placed = arrays.select(
            "series_id", F.transform(on_axis, lambda v: v.cast("double")).alias("_x")
        )
        train = F.slice("_x", 1, n_train)
        limits = placed.select(
            "series_id", "_x", F.array_min(train).alias("_lo"), F.array_max(train).alias("_hi")
        )
        width = _width(F.col("_lo"), F.col("_hi"))
        scaled = limits.withColumn("_width", width).select(
            "series_id", "_lo", "_width",
            F.transform("_x", lambda v: (v - F.col("_lo")) / F.col("_width")).alias("_z"),
        )
        scaled = scaled.withColumn("_train", array_to_vector(F.slice("_z", 1, n_train)))
        k = min(self.factors, n_train)
        model = PCA(k=k, inputCol="_train", outputCol="_score").fit(scaled)
        # the loadings meet every month of their series below, so they are computed once
        loaded = cut_lineage(
            model.transform(scaled).select(
                "series_id", "_lo", "_width", "_z", vector_to_array("_score").alias("_score")
            )
        )
        levels = self._factor_levels(loaded, k)
        cuts = {w: _number(rows[w]["validation_end_date"]) - origin for w in windows}
        weights = self._weights(levels, n_train, cuts, total)
        table = arrays.sparkSession.createDataFrame(weights, "window int, step int, weights array<double>")
        history = F.slice("_z", 1, n_train)
        value = _dot(history, F.col("weights")) * F.col("_width") + F.col("_lo")
        # weights: one row per window and step
        return loaded.join(F.broadcast(table), F.col("series_id").isNotNull()).select(
            "window", "series_id", "step", value.alias("forecast")
        )

    def _factor_levels(self, loaded: DataFrame, k: int) -> np.ndarray:
        """Factor values per month: each month's values regressed on the series' loadings.

        Two aggregates of fixed size (months x k and k x k) reach the driver.
        """
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        gram_row = loaded.agg(
            *[F.sum(F.col("_score")[a] * F.col("_score")[b]).alias(f"g_{a}_{b}") for a, b in pairs]
        ).first()
        gram = np.zeros((k, k))
        for a, b in pairs:
            gram[a, b] = gram[b, a] = gram_row[f"g_{a}_{b}"] or 0.0
        monthly = loaded.select("_score", F.posexplode("_z").alias("_t", "_v")).groupBy("_t").agg(
            *[F.sum(F.col("_score")[a] * F.col("_v")).alias(f"m_{a}") for a in range(k)]
        )
        moments = np.array([[r[f"m_{a}"] for a in range(k)] for r in monthly.orderBy("_t").collect()])
        return moments @ np.linalg.pinv(gram)

    def _weights(self, levels: np.ndarray, n_train: int, cuts: dict[int, int], total: int):
        """Least squares of a series on lagged factors is linear in the series' own history, with the
        same weights for every series: one weight vector per window and step."""
        design = np.column_stack([np.ones(len(levels)), levels])
        out = []
        for window, at in cuts.items():
            for step in range(1, total + 1):
                solver = np.linalg.pinv(design[: n_train - step])
                vector = np.concatenate([np.zeros(step), design[at] @ solver])
                out.append((window, step, [float(v) for v in vector]))
        return out


def _number(month) -> int:
    return month.year * 12 + month.month
