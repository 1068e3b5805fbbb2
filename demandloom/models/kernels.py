"""Trend with change points and yearly waves by least squares, for a batch of series at once.

A batch is a matrix with one left-aligned series per row (NaN after its last month).  ``known`` says
how many months of each series are known at each window's cut.  Results have shape (series, windows, ..);
rows with nothing known are NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEASON = 12


@dataclass(frozen=True)
class Waves:
    """Bounds of the fit: the trend may bend every ``knot_every`` months in the first ``knot_share`` of the months known
    (0: never), against a penalty of ``ridge`` on the squared bends.  Below ``min_seasonal`` months there are no waves and no
    bends, below ``min_history`` the mean."""

    waves: int = 3
    multiplicative: bool = False
    knot_every: int = 0
    knot_share: float = 0.8
    ridge: float = 5.0
    min_seasonal: int = 2 * SEASON
    min_history: int = 3


def _fill_by_level(y: np.ndarray, known: np.ndarray, steps: int) -> np.ndarray:
    """Mean of the known months: what remains for series too short for a model."""
    seen = np.arange(y.shape[1]) < known[:, :, None]
    total = np.where(seen, np.nan_to_num(y)[:, None, :], 0.0).sum(axis=2)
    level = np.where(known > 0, total / np.maximum(known, 1), np.nan)
    return np.repeat(level[:, :, None], steps, axis=2)


def _design(first_month: np.ndarray, months: int, cfg: Waves) -> tuple[np.ndarray, np.ndarray]:
    """(columns, months of the knots): constant, trend, waves, then one hinge per knot."""
    time = np.arange(months)
    angle = 2 * np.pi * (first_month[:, None] + time[None, :]) / SEASON
    columns = [np.ones_like(angle), np.broadcast_to(time / SEASON, angle.shape)]
    for k in range(1, cfg.waves + 1):
        columns += [np.sin(k * angle), np.cos(k * angle)]
    knots = np.arange(cfg.knot_every, months, cfg.knot_every) if cfg.knot_every else np.zeros(0, dtype=int)
    columns += [np.broadcast_to(np.maximum(0, time - knot) / SEASON, angle.shape) for knot in knots]
    return np.stack(columns, axis=2), knots


def _coefficients(design: np.ndarray, target: np.ndarray, known: np.ndarray, knots: np.ndarray, cfg: Waves) -> np.ndarray:
    """Coefficients (series, windows, columns); columns that a window doesn't have are zero.

    The normal equations are running sums over the months: a window adds the months since the cut before.
    """
    series, windows = known.shape
    size, plain = design.shape[2], design.shape[2] - len(knots)
    out = np.zeros((series, windows, size))
    gram, right = np.zeros((series, size, size)), np.zeros((series, size))
    before = np.zeros(series, dtype=np.int64)
    for w in np.argsort(known.max(axis=0), kind="stable"):
        if (known[:, w] < before).any():
            raise ValueError("cuts must be in the same order for all series")
        months = np.arange(before.min(initial=0), known[:, w].max(initial=0))
        new = (months >= before[:, None]) & (months < known[:, w, None])
        part = design[:, months] * new[:, :, None]
        gram += np.einsum("stp,stq->spq", part, design[:, months])
        right += np.einsum("stp,st->sp", part, target[:, months])
        before = known[:, w]
        seasonal = before >= cfg.min_seasonal
        has = np.zeros((series, size), dtype=bool)
        has[:, :2] = (before >= cfg.min_history)[:, None]
        has[:, 2:plain] = seasonal[:, None]
        has[:, plain:] = seasonal[:, None] & (knots < cfg.knot_share * before[:, None])
        penalty = np.where(np.arange(size) >= plain, cfg.ridge, 0.0)
        left = np.where(has[:, :, None] & has[:, None, :], gram, 0.0)
        left[:, np.arange(size), np.arange(size)] += np.where(has, penalty, 0.0)
        inverse = np.linalg.pinv(left, rcond=1e-10, hermitian=True)
        out[:, w] = np.einsum("spq,sq->sp", inverse, np.where(has, right, 0.0))
    return out


def _target(y: np.ndarray, cfg: Waves) -> np.ndarray:
    return np.nan_to_num(np.log1p(np.maximum(y, 0.0)) if cfg.multiplicative else y)


def trend_and_waves(y: np.ndarray, known: np.ndarray, steps: int, first_month: np.ndarray, cfg: Waves = Waves()):
    """(forecasts, forms, fallbacks) of every series and window.

    ``first_month`` (any month count) fixes the season of each row.  Multiplicative seasonality is an additive fit of
    log(1 + y).  Forms are ``trend+waves``, ``trend`` and ``mean``; the latter two are fall-backs of short histories.
    """
    length = y.shape[1]
    out = _fill_by_level(y, known, steps)
    design, knots = _design(first_month, length + steps, cfg)
    coef = _coefficients(design, _target(y, cfg), known, knots, cfg)
    rows = np.arange(len(y))[:, None]
    for w in range(known.shape[1]):
        future = design[rows, known[:, w, None] + np.arange(steps)[None, :]]
        path = np.einsum("shp,sp->sh", future, coef[:, w])
        able = known[:, w] >= cfg.min_history
        out[able, w] = (np.expm1(path) if cfg.multiplicative else path)[able]
    form = np.where(known >= cfg.min_seasonal, "trend+waves", np.where(known >= cfg.min_history, "trend", "mean"))
    form = np.where(known > 0, form, "").astype(object)
    return out, form, np.where(form == "trend+waves", "", form).astype(object)


def fourier(
    y: np.ndarray,
    known: np.ndarray,
    steps: int,
    first_month: np.ndarray,
    waves: int = 3,
    multiplicative: bool = False,
) -> np.ndarray:
    """Forecasts of a straight trend with yearly waves."""
    return trend_and_waves(y, known, steps, first_month, Waves(waves, multiplicative))[0]


def moments(y: np.ndarray, known: np.ndarray, first_month: np.ndarray, cfg: Waves) -> tuple[np.ndarray, np.ndarray]:
    """Per (series, window, unpenalised column): the column's product with the target over the known months, and its
    correlation with the residual, which is zero for a least-squares fit."""
    design, knots = _design(first_month, y.shape[1], cfg)
    target = _target(y, cfg)
    coef = _coefficients(design, target, known, knots, cfg)
    inside = (np.arange(y.shape[1]) < known[:, :, None]).astype(float)
    left = (target[:, None, :] - np.einsum("stp,swp->swt", design, coef)) * inside
    plain = design[:, :, : design.shape[2] - len(knots)]
    products = np.einsum("swt,st,stp->swp", inside, target, plain)
    sizes = np.sqrt(np.einsum("swt,stp->swp", inside, plain**2) * np.einsum("swt,st->sw", inside, target**2)[:, :, None])
    return products, np.einsum("swt,stp->swp", left, plain) / np.maximum(sizes, 1e-12)
