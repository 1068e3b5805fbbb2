"""Regression on arrays of samples: scaled design matrices, exact normal equations, their solution.

Rows arrive as Arrow batches; Spark has partitioned them.  Features and targets are rounded to multiples of
2^-16 of their scaled unit before they are multiplied, so sums of products are whole numbers and exact:
the equations, and with them the model, don't depend on how the rows are partitioned or ordered.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# the fits travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUANTUM = 1 << 16
_EPS = 1e-5


@dataclass(frozen=True)
class Design:
    """Which arrays of a sample make its features, and how they are scaled.

    ``scaled`` names the variables of the limits in order, the value first.  ``norm`` makes value lags and
    targets relative to the lookback's mean and spread.
    """

    lookback: int
    steps: int
    past: tuple[str, ...] = ()
    future: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    shared_past: tuple[str, ...] = ()
    shared_future: tuple[str, ...] = ()
    scale: bool = True
    norm: bool = False

    @property
    def scaled(self) -> tuple[str, ...]:
        return ("value", *self.past, *self.future, *self.shared_past, *self.shared_future)

    def names(self) -> list[str]:
        """Features of a step in order; the last one is the constant."""
        lags = [f"{c}_lag_{k}" for c in ("value", *self.past, *self.shared_past) for k in range(self.lookback)]
        return [*lags, *self.static, *(f"{c}_ahead" for c in (*self.future, *self.shared_future)), "constant"]

    def block(self, batch: pa.RecordBatch, window: int) -> Block:
        """The batch scaled with one window's limits."""
        n = batch.num_rows
        low, width = (_dense(batch, c, None).reshape(n, -1, len(self.scaled)) for c in ("low", "width"))

        def unit(column: str, variable: str, size: int) -> np.ndarray:
            values = _dense(batch, column, size)
            if not self.scale:
                return values
            j = self.scaled.index(variable)
            return (values - low[:, window, j, None]) / width[:, window, j, None]

        lags, targets = unit("value_lags", "value", self.lookback), unit("targets", "value", self.steps)
        mean, spread = np.zeros((n, 1)), np.ones((n, 1))
        if self.norm:
            mean = lags.mean(axis=1, keepdims=True)
            spread = np.sqrt(((lags - mean) ** 2).mean(axis=1, keepdims=True) + _EPS)
            lags, targets = (lags - mean) / spread, (targets - mean) / spread
        fixed = [unit(f"{c}_lags", c, self.lookback) for c in (*self.past, *self.shared_past)]
        fixed += [batch.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in self.static]
        ahead = [unit(f"{c}_ahead", c, self.steps) for c in (*self.future, *self.shared_future)]
        base = (low[:, window, 0], width[:, window, 0]) if self.scale else (np.zeros(n), np.ones(n))
        return Block(lags, targets, fixed, ahead, mean[:, 0], spread[:, 0], *base)


@dataclass
class Block:
    lags: np.ndarray
    targets: np.ndarray
    fixed: list[np.ndarray]
    ahead: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    low: np.ndarray
    width: np.ndarray

    def features(self, step: int) -> np.ndarray:
        """Rows of features for a zero-based step."""
        known = [a[:, step : step + 1] for a in self.ahead]
        return np.hstack([self.lags, *self.fixed, *known, np.ones((len(self.lags), 1))])

    def units(self, predicted: np.ndarray) -> np.ndarray:
        """Predictions back in the series' own units."""
        return (predicted * self.spread + self.mean) * self.width + self.low


def _dense(batch: pa.RecordBatch, column: str, size: int | None) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(batch.num_rows, size if size else -1)


def complete(features: np.ndarray) -> np.ndarray:
    return np.isfinite(features).all(axis=1)


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """rows' @ rows of whole numbers, exactly."""
    largest = float(np.abs(rows).max(initial=0.0))
    if largest * largest * len(rows) < 2**53:
        return (rows.T @ rows).astype(np.int64).astype(object)
    if largest * largest * len(rows) < 2**62:
        whole = rows.astype(np.int64)
        return (whole.T @ whole).astype(object)
    whole = np.array([[int(v) for v in row] for row in rows], dtype=object).reshape(rows.shape)
    return whole.T @ whole


def training_rows(design: Design, batch: pa.RecordBatch, windows: dict[int, int], step: int, place: int):
    """(block, features, goal, usable rows) of a trained window: its samples end in its train split."""
    block = design.block(batch, place)
    features, goal = block.features(step), block.targets[:, step]
    ended = batch.column("sample_end_no").to_numpy() <= windows[place]
    return block, features, goal, ended & complete(features) & np.isfinite(goal)


def gram_task(design: Design, train_ends: dict[int, int], steps: range):
    """A task's packed triangles per (window place, step), one set for all its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for place in train_ends:
                for step in steps:
                    _, features, goal, usable = training_rows(design, batch, train_ends, step, place)
                    rows = np.rint(np.column_stack([features, goal])[usable] * QUANTUM)
                    found = exact_gram(rows)
                    sums[place, step] = sums[place, step] + found if (place, step) in sums else found
        for (place, step), gram in sums.items():
            packed = [int(v) for v in gram[np.triu_indices(len(gram))]]
            n = len(packed)
            columns = [pa.array([place] * n, pa.int32()), pa.array([step] * n, pa.int32())]
            columns += [pa.array(range(n), pa.int32()), pa.array(packed, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "step", "entry", "total"])

    return run


GRAM = "place int, step int, entry int, total decimal(38,0)"


def unpacked(entries: dict[int, int], size: int) -> np.ndarray:
    """The symmetric matrix of a packed triangle, in units."""
    gram = np.zeros((size, size))
    upper = np.triu_indices(size)
    gram[upper] = [entries.get(i, 0) / QUANTUM**2 for i in range(len(upper[0]))]
    return gram + gram.T - np.diag(np.diag(gram))


def solve(gram: np.ndarray, ridge: float) -> np.ndarray | None:
    """Coefficients from the normal equations; the last feature is the constant, the last column the goal.

    ``ridge`` is relative to the features' variances.  Features that others determine share their weight
    (least norm).  None without rows.
    """
    n = gram[-2, -2]
    if n <= 0:
        return None
    left, right = gram[:-1, :-1].copy(), gram[:-1, -1]
    variance = np.diag(left) / n - (left[-1] / n) ** 2
    left[np.diag_indices(len(left) - 1)] += ridge * n * np.maximum(variance[:-1], 0.0)
    size = np.sqrt(np.maximum(np.diag(left), 1e-30))
    even = left / np.outer(size, size)
    return np.linalg.pinv(even, rcond=1e-9, hermitian=True) @ (right / size) / size


def predict_task(design: Design, weights: dict[tuple[int, int], list[float] | None], steps: range, recursive: bool):
    """Forecasts of every sample for the window it stands for; incomplete rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("place").to_numpy()
            for place in np.unique(places):
                part = batch.filter(pa.array(places == place))
                block = design.block(part, int(place))
                known = weights[int(place), 0]
                for step in steps:
                    coef = known if recursive else weights[int(place), step]
                    if coef is None:
                        continue
                    features = block.features(step)
                    # a sum of products per row, so that a forecast doesn't depend on its batch
                    predicted = (features * np.array(coef)).sum(axis=1)
                    if recursive:
                        block.lags = np.column_stack([predicted, block.lags[:, :-1]])
                    usable = complete(features)
                    n = int(usable.sum())
                    columns = [
                        pa.array([int(place)] * n, pa.int32()),
                        part.column("series_id").filter(pa.array(usable)),
                        pa.array([step + 1] * n, pa.int32()),
                        pa.array(block.units(predicted)[usable]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["place", "series_id", "step", "forecast"])

    return run


def residual_task(design: Design, train_ends: dict[int, int], weights: dict, steps: range):
    """Per (window place, step, feature): sums over the training rows of the feature, the goal and the residual."""
    names = design.names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in train_ends:
                for step in steps:
                    coef = weights[place, step]
                    if coef is None:
                        continue
                    _, features, goal, usable = training_rows(design, batch, train_ends, step, place)
                    x, y = features[usable], goal[usable]
                    left = y - x @ np.array(coef)
                    k = len(names)
                    columns = [pa.array([place] * k, pa.int32()), pa.array([step + 1] * k, pa.int32()), pa.array(names)]
                    columns += [pa.array([len(x)] * k, pa.int64()), pa.array(x.sum(axis=0)), pa.array([float(y.sum())] * k)]
                    columns += [pa.array(v) for v in (x.T @ left, (x * x).sum(axis=0), np.full(k, left @ left))]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESIDUALS.split(", ")])

    return run


RESIDUALS = "place int, step int, feature string, n long, sum_x double, sum_y double, xr double, xx double, rr double"


def learner_task(design: Design, places: dict[int, int] | None, steps: range):
    """Feature rows for a learner of Spark ML: of the training samples, or (without places) of the samples to predict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("place").to_numpy() if places is None else None
            for place in np.unique(own) if places is None else places:
                part = batch.filter(pa.array(own == place)) if places is None else batch
                block = design.block(part, int(place))
                for step in steps:
                    features, goal = block.features(step)[:, :-1], block.targets[:, step]
                    if places is None:
                        usable = complete(features)
                    else:
                        ended = part.column("sample_end_no").to_numpy() <= places[place]
                        usable = ended & complete(features) & np.isfinite(goal)
                    n, keep = int(usable.sum()), pa.array(usable)
                    columns = [pa.array([int(place)] * n, pa.int32()), pa.array([step] * n, pa.int32())]
                    columns += [part.column(c).filter(keep) for c in ("series_id", "sample_end_no")]
                    columns += [pa.array(list(features[usable]), pa.list_(pa.float64())), pa.array(goal[usable])]
                    scale, base = block.spread * block.width, block.mean * block.width + block.low
                    columns += [pa.array(v[usable]) for v in (scale, base)]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in LEARNER.split(", ")])

    return run


LEARNER = (
    "place int, step int, series_id string, sample_end_no int, features array<double>, goal double, scale double, base double"
)
