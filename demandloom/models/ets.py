"""Exponential smoothing with fitted weights, all forms at once, for a batch of histories.

Forms are an additive or multiplicative season (or none) with no, a linear or a damped trend.  The weights of every form
and history are found by a bounded pattern search on its likelihood: all weights of a form are moved up and down at once,
each history takes its best move, and halves its step when none helps.  AICc picks the form.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# the fits travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Form:
    """``trend``: N, A or Ad; ``season``: N, A or M (with errors relative to the level's and season's product)."""

    trend: str
    season: str

    @property
    def label(self) -> str:
        return f"({'M' if self.season == 'M' else 'A'},{self.trend},{self.season})"

    @property
    def weights(self) -> list[int]:
        """Which of level, trend, season and damping weights the form has."""
        return [0] + [1] * (self.trend != "N") + [2] * (self.season != "N") + [3] * (self.trend == "Ad")

    def starts(self) -> np.ndarray:
        """Combinations of the form's own weights; the others stay at their first value."""
        return np.array(list(itertools.product(*(s if i in self.weights else s[:1] for i, s in enumerate(STARTS)))))

    def parameters(self, season: int) -> int:
        """Weights, first states and the error's variance."""
        return len(self.weights) + 2 + (self.trend != "N") + season * (self.season != "N")


FORMS = tuple(Form(t, s) for s in ("N", "A", "M") for t in ("N", "A", "Ad"))


@dataclass(frozen=True)
class SmoothingLimits:
    """Bounds and precision of the search.  Histories below ``min_history`` months get their mean, and those
    below ``min_seasonal`` no season."""

    season: int = 12
    forms: tuple[Form, ...] = FORMS
    low: tuple[float, float, float, float] = (0.01, 0.01, 0.01, 0.8)
    high: tuple[float, float, float, float] = (0.99, 0.99, 0.99, 0.98)
    first_step: float = 0.25
    precision: float = 0.02
    min_history: int = 15
    min_seasonal: int = 24


# weights of level, trend, season and damping from which the search starts: the best combination is refined
STARTS = ((0.02, 0.2, 0.6, 0.95), (0.05, 0.4, 0.9), (0.05, 0.3), (0.85, 0.97))


# (row, variant) states that are folded together
BLOCK = 8192


class _Fold:
    """One form over a batch of histories of one length, from first states taken from the first seasons."""

    def __init__(self, z: np.ndarray, form: Form, season: int) -> None:
        self.z, self.form, self.season = z, form, season
        self.spread = z.var(axis=1)
        first = z[:, :season]
        middle = first.mean(axis=1)
        self.slope = np.zeros(len(z))
        if form.trend != "N" and z.shape[1] >= 2 * season:
            self.slope = (z[:, season : 2 * season].mean(axis=1) - middle) / season
        # the first season's months lie around a line through its middle
        line = middle[:, None] + self.slope[:, None] * (np.arange(season) - (season - 1) / 2)
        self.level = line[:, -1]
        self.seasons = first - line if form.season == "A" else first / np.where(np.abs(line) > 1e-9, line, 1.0)

    def run(self, weights: np.ndarray, rows: np.ndarray):
        """(deviance, level, slope, seasons) after the history, for weights of shape (rows, variants, 4).

        Rows are taken in blocks whose states stay in the processor's cache.
        """
        block = max(1, BLOCK // weights.shape[1])
        parts = [self._run(weights[at : at + block], rows[at : at + block]) for at in range(0, len(rows), block)]
        if len(parts) == 1:
            return parts[0]
        return tuple(np.concatenate(p) if p[0] is not None else None for p in zip(*parts))

    def _run(self, weights: np.ndarray, rows: np.ndarray):
        # variants outermost: a month's values are the same for all of them
        a, b, c = (np.ascontiguousarray(weights[:, :, i].T) for i in range(3))
        damped = self.form.trend == "Ad"
        phi = np.ascontiguousarray(weights[:, :, 3].T) if damped else 1.0
        trended, seasonal, product = self.form.trend != "N", self.form.season != "N", self.form.season == "M"
        shape = a.shape
        kept_a, kept_b, kept_c = 1 - a, (1 - b) * phi, 1 - c
        level = np.broadcast_to(self.level[rows], shape).copy()
        slope = np.broadcast_to(self.slope[rows], shape).copy()
        # months of the season first, so that one month's states lie together
        seasons = np.broadcast_to(self.seasons[rows].T[:, None, :], (self.season, *shape)).copy() if seasonal else None
        errors, logs = np.zeros(shape), np.zeros(shape)
        z, n = np.ascontiguousarray(self.z[rows].T), self.z.shape[1]
        before, gone, own, rise = (np.empty(shape) for _ in range(4))
        with np.errstate(all="ignore"):
            for t in range(self.season, n):
                y = z[t]
                if damped:
                    np.multiply(phi, slope, out=rise)
                elif trended:
                    rise[...] = slope
                if trended:
                    np.add(level, rise, out=before)
                else:
                    before[...] = level
                if product:
                    old = seasons[t % self.season]
                    mean = np.multiply(before, old, out=own)
                    np.subtract(y, mean, out=gone)
                    gone /= mean
                    np.multiply(gone, gone, out=gone)
                    errors += gone
                    np.abs(mean, out=mean)
                    np.log(mean, out=mean)
                    logs += mean
                    np.divide(y, old, out=level)
                    level *= a
                    level += np.multiply(kept_a, before, out=gone)
                    np.divide(y, before, out=gone)
                    gone *= c
                    old *= kept_c
                    old += gone
                else:
                    np.subtract(y, before, out=gone)
                    if seasonal:
                        old = seasons[t % self.season]
                        np.subtract(gone, old, out=own)
                        np.multiply(own, own, out=own)
                        errors += own
                        np.subtract(y, old, out=level)
                        level *= a
                        gone *= c
                        old *= kept_c
                        old += gone
                    else:
                        np.multiply(gone, gone, out=gone)
                        errors += gone
                        np.multiply(a, y, out=level)
                    level += np.multiply(kept_a, before, out=gone)
                if trended:
                    # ``before`` is the old level plus the damped slope
                    np.subtract(level, before, out=gone)
                    gone += rise
                    gone *= b
                    slope *= kept_b
                    slope += gone
            count = n - self.season
            scale = 1.0 if product else np.maximum(self.spread[rows], 1e-12)
            deviance = count * np.log(np.maximum(errors / count, 1e-10 * scale)) + 2 * logs
        last = seasons.transpose(2, 1, 0) if seasonal else None
        return np.where(np.isfinite(deviance), deviance, np.inf).T, level.T, slope.T, last

    def search(self, limits: SmoothingLimits) -> tuple[np.ndarray, np.ndarray]:
        """(weights, deviance) of every history."""
        low, high = np.array(limits.low), np.array(limits.high)
        every, moves = np.arange(len(self.z)), self.form.weights
        starts = self.form.starts()
        found = self.run(np.broadcast_to(starts[None], (len(self.z), *starts.shape)), every)[0]
        pick = found.argmin(axis=1)
        weights, best = starts[pick].copy(), found[every, pick]
        step = np.full(len(self.z), limits.first_step)
        signs = np.zeros((2 * len(moves), 4))
        for i, m in enumerate(moves):
            signs[2 * i, m], signs[2 * i + 1, m] = 1.0, -1.0
        # the move that would take a row back to where it was
        back = np.full(len(self.z), -1)
        while (active := np.flatnonzero((step >= limits.precision) & np.isfinite(best))).size:
            wanted = weights[active, None] + signs[None] * step[active, None, None] * (high - low)
            tried = np.clip(wanted, low, high)
            # no move at a bound, and none back, can be better
            useful = (tried != weights[active, None]).any(axis=2)
            useful &= np.arange(len(signs)) != back[active, None]
            at, move = np.nonzero(useful)
            found = np.full(useful.shape, np.inf)
            found[at, move] = self.run(tried[at, move][:, None], active[at])[0][:, 0] if len(at) else 0.0
            pick, every = found.argmin(axis=1), np.arange(len(active))
            value = found[every, pick]
            better = value < best[active] - 1e-9
            moved, taken = active[better], pick[better]
            whole = (tried[better, taken] == wanted[better, taken]).all(axis=1)
            weights[moved], best[moved] = tried[better, taken], value[better]
            back[active] = -1
            back[moved[whole]] = taken[whole] ^ 1
            step[active[~better]] /= 2
        return weights, best

    def forecast(self, weights: np.ndarray, rows: np.ndarray, steps: int) -> np.ndarray:
        _, level, slope, seasons = self.run(weights[:, None], rows)
        n, phi = self.z.shape[1], weights[:, 3] if self.form.trend == "Ad" else np.ones(len(rows))
        out = np.empty((len(rows), steps))
        reach = np.zeros(len(rows))
        for h in range(steps):
            reach = reach + phi ** (h + 1)
            value = level[:, 0] + reach * slope[:, 0] if self.form.trend != "N" else level[:, 0]
            if self.form.season != "N":
                own = seasons[:, 0, (n + h) % self.season]
                value = value * own if self.form.season == "M" else value + own
            out[:, h] = value
        return out


def fit(z: np.ndarray, n: np.ndarray, steps: int, limits: SmoothingLimits = SmoothingLimits()):
    """(forecasts, forms, fallbacks) of every row of ``z``, known up to ``n``.

    A form is written ``(error,trend,season)``.  Rows of fewer months than ``min_history``, or that no form fits in finite
    numbers, get their mean and ``mean`` as their fallback; rows without any are NaN.  Multiplicative seasons need positive histories.
    """
    out = np.full((len(z), steps), np.nan)
    forms, fallbacks = np.full(len(z), "", dtype=object), np.full(len(z), "", dtype=object)
    for length in sorted(set(n.tolist()) - {0}):
        rows = np.flatnonzero(n == length)
        known = np.nan_to_num(z[rows, :length])
        if length < limits.min_history:
            out[rows] = known.mean(axis=1)[:, None]
            forms[rows] = fallbacks[rows] = "mean"
            continue
        best, count = np.full(len(rows), np.inf), length - limits.season
        for form in limits.forms:
            if form.season != "N" and length < limits.min_seasonal:
                continue
            able = np.flatnonzero((known > 0).all(axis=1)) if form.season == "M" else np.arange(len(rows))
            k = form.parameters(limits.season)
            if not len(able):
                continue
            fold = _Fold(known[able], form, limits.season)
            weights, deviance = fold.search(limits)
            aicc = deviance + 2 * k + 2 * k * (k + 1) / max(count - k - 1, 0.5)
            better = aicc < best[able] - 1e-9
            if better.any():
                own = np.flatnonzero(better)
                best[able[own]] = aicc[own]
                out[rows[able[own]]] = fold.forecast(weights[own], own, steps)
                forms[rows[able[own]]] = form.label
        left = rows[~np.isfinite(best)]
        out[left] = known[~np.isfinite(best)].mean(axis=1)[:, None]
        forms[left] = fallbacks[left] = "mean"
    return out, forms, fallbacks
