"""Seasonal autoregressions with moving-average terms and automatic orders, for a batch of histories.

A history is one row of a matrix, known up to its own length.  The order of differencing comes from the strength of
the season and a unit-root test.  The moving-average terms are made linear in two stages: a long autoregression gives the
shocks, and their lags are regressors beside those of the series.  Every candidate is then one least-squares fit on the same
months, and a stepwise search walks over (p, q, P, Q, constant) by AICc, all histories at once: rows that ask for the same
candidate are solved together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# the fits travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: 5 % point of the level-stationarity statistic; share of variance from which a season is differenced
KPSS_5_PERCENT = 0.463
STRONG_SEASON = 0.64
# months over which a candidate's impulse response must not grow
HORIZON = 48

Candidate = tuple[int, int, int, int, int]


@dataclass(frozen=True)
class OrderLimits:
    """Bounds of the search; ``max_order`` bounds p + q + P + Q.  Histories below ``min_history`` get their mean."""

    season: int = 12
    max_p: int = 5
    max_q: int = 5
    max_seasonal_p: int = 2
    max_seasonal_q: int = 2
    max_order: int = 20
    max_d: int = 2
    max_seasonal_d: int = 1
    min_history: int = 8


def _span(rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = np.arange(rows.shape[1])
    return ((at >= first[:, None]) & (at < end[:, None])).astype(float)


def season_strength(z: np.ndarray, n: np.ndarray, season: int) -> np.ndarray:
    """1 - variance of what is left after trend and monthly means, over that after the trend alone; at least 0."""
    inside = _span(z, np.zeros_like(n), n)
    t = np.arange(z.shape[1]) * inside
    count = np.maximum(n, 1)[:, None]
    centred_t = (t - t.sum(axis=1, keepdims=True) / count) * inside
    centred = (z - (z * inside).sum(axis=1, keepdims=True) / count) * inside
    slope = (centred_t * centred).sum(axis=1) / np.maximum((centred_t**2).sum(axis=1), 1e-30)
    flat = centred - slope[:, None] * centred_t
    left = flat.copy()
    for phase in range(season):
        own = slice(phase, None, season)
        mean = flat[:, own].sum(axis=1) / np.maximum(inside[:, own].sum(axis=1), 1)
        left[:, own] = (flat[:, own] - mean[:, None]) * inside[:, own]
    left -= left.sum(axis=1, keepdims=True) / count * inside
    whole = (flat**2).sum(axis=1)
    return np.where(whole > 1e-12, np.maximum(0.0, 1 - (left**2).sum(axis=1) / np.maximum(whole, 1e-30)), 0.0)


def level_statistic(w: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Test statistic against level stationarity; zero for a constant or empty history."""
    inside, n = _span(w, first, end), np.maximum(end - first, 1)
    e = (w - (w * inside).sum(axis=1, keepdims=True) / n[:, None]) * inside
    width = np.floor(4 * (n / 100) ** 0.25)
    long_run = (e**2).sum(axis=1) / n
    for j in range(1, int(width.max(initial=0)) + 1):
        share = np.maximum(0.0, 1 - j / (width + 1))
        long_run += 2 * share * (e[:, j:] * e[:, :-j]).sum(axis=1) / n
    walked = (np.cumsum(e, axis=1) * inside) ** 2
    return np.where(long_run > 1e-12, walked.sum(axis=1) / n**2 / np.maximum(long_run, 1e-30), 0.0)


def difference_orders(z: np.ndarray, n: np.ndarray, limits: OrderLimits) -> tuple[np.ndarray, np.ndarray]:
    """(d, D) per row: D by the strength of the season, d by repeated unit-root tests on what is left."""
    season = limits.season
    seasonal = np.zeros(len(z), dtype=int)
    if limits.max_seasonal_d:
        seasonal = ((n >= 3 * season) & (season_strength(z, n, season) > STRONG_SEASON)).astype(int)
    w, first = _differenced(z, seasonal, season)
    d = np.zeros(len(z), dtype=int)
    for _ in range(limits.max_d):
        more = (n - first >= limits.min_history) & (d == d.max(initial=0)) & (level_statistic(w, first, n) > KPSS_5_PERCENT)
        if not more.any():
            break
        moved = np.zeros_like(w)
        moved[:, 1:] = w[:, 1:] - w[:, :-1]
        w, first, d = np.where(more[:, None], moved, w), first + more, d + more
    return d, seasonal


def _differenced(z: np.ndarray, seasonal: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    moved = np.zeros_like(z)
    moved[:, season:] = z[:, season:] - z[:, :-season] if z.shape[1] > season else 0.0
    return np.where(seasonal[:, None] > 0, moved, z), seasonal * season


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    if k < x.shape[1]:
        out[:, k:] = x[:, : x.shape[1] - k] if k else x
    return out


def _least_squares(columns: list[np.ndarray], target: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, residuals) per row over the used months; columns that others determine share their weight."""
    if not columns:
        return np.zeros((len(target), 0)), target * used
    design = np.stack(columns, axis=2) * used[:, :, None]
    gram = np.einsum("stp,stq->spq", design, design)
    right = np.einsum("stp,st->sp", design, target)
    coef = np.einsum("spq,sq->sp", np.linalg.pinv(gram, rcond=1e-10, hermitian=True), right)
    return coef, (target - np.einsum("stp,sp->st", design, coef)) * used


def _lags(candidate: Candidate, season: int) -> tuple[list[int], list[int]]:
    p, q, seasonal_p, seasonal_q, _ = candidate
    own = [*range(1, p + 1), *(season * k for k in range(1, seasonal_p + 1))]
    shocks = [*range(1, q + 1), *(season * k for k in range(1, seasonal_q + 1))]
    return own, shocks


def _stable(weights: np.ndarray, lags: list[int]) -> np.ndarray:
    """Whether the impulse response of these lags has died down to its start's size after ``HORIZON`` months."""
    # weights whose sizes add up to less than one can't grow
    ok = np.abs(weights).sum(axis=1) < 1 - 1e-9
    open_rows = np.flatnonzero(~ok)
    if not len(open_rows):
        return ok
    # months outermost, after as many zeros as the longest lag
    reach = max(lags)
    path = np.zeros((reach + HORIZON + 1, len(open_rows)))
    path[reach] = 1.0
    shares, back = np.ascontiguousarray(weights[open_rows].T), np.array(lags)
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(reach + 1, reach + HORIZON + 1):
            path[t] = (shares * path[t - back]).sum(axis=0)
    ok[open_rows] = np.abs(path[-reach:]).max(axis=0) < 1.0
    return ok


class _Group:
    """Rows of one differencing order and one set of bounds, with the regressors they share."""

    def __init__(self, z: np.ndarray, n: np.ndarray, d: int, seasonal_d: int, limits: OrderLimits) -> None:
        self.z, self.n, self.d, self.seasonal_d, self.season = z, n, d, seasonal_d, limits.season
        self.levels = [z]
        w, first = _differenced(z, np.full(len(z), seasonal_d), self.season)
        self.levels.append(w)
        for _ in range(d):
            moved = np.zeros_like(w)
            moved[:, 1:] = w[:, 1:] - w[:, :-1]
            w, first = moved, first + 1
            self.levels.append(w)
        self.w, self.first = w, first
        valid = int((n - first).min())
        self.seasonal = int(n.min()) >= 3 * self.season and valid >= 2 * self.season + 6
        longest = max(1, min(self.season + 2 if self.seasonal else limits.max_p, valid // 4))
        back = min(2, valid // (3 * self.season)) if self.seasonal else 0
        self.bounds = (
            min(limits.max_p, longest),
            min(limits.max_q, longest),
            min(limits.max_seasonal_p, back),
            min(limits.max_seasonal_q, back),
        )
        self.max_order = limits.max_order
        self.drift = int(d + seasonal_d <= 1)
        # every candidate is scored on the same months
        self.used = _span(w, first + max(longest, self.season * back), n)
        ones = [np.ones_like(w)]
        _, shocks = _least_squares(ones + [_lagged(w, k) for k in range(1, longest + 1)], w, _span(w, first + longest, n))
        self.shocks = shocks

    def columns(self, candidate: Candidate, rows: np.ndarray) -> list[np.ndarray]:
        own, shocks = _lags(candidate, self.season)
        out = [np.ones_like(self.w[rows])] * candidate[4]
        out += [_lagged(self.w[rows], k) for k in own]
        return out + [_lagged(self.shocks[rows], k) for k in shocks]

    def score(self, candidate: Candidate, rows: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(AICc, coefficients): infinite for an unstable fit or one with too few months, or where it isn't below ``limit``."""
        used = self.used[rows]
        coef, left = _least_squares(self.columns(candidate, rows), self.w[rows], used)
        count, k = used.sum(axis=1), coef.shape[1] + 1
        own, shocks = _lags(candidate, self.season)
        c = candidate[4]
        scale = np.maximum((self.w[rows] ** 2 * used).sum(axis=1) / np.maximum(count, 1), 1e-12)
        error = np.maximum((left**2).sum(axis=1) / np.maximum(count, 1), 1e-10 * scale)
        aicc = count * np.log(error) + 2 * k + 2 * k * (k + 1) / np.maximum(count - k - 1, 1)
        # the roots are looked at where it matters
        able = np.flatnonzero((count - k - 1 > 0) & (aicc < limit))
        able = able[_stable(coef[able, c : c + len(own)], own)]
        able = able[_stable(-coef[able, c + len(own) :], shocks)]
        out = np.full(len(rows), np.inf)
        out[able] = aicc[able]
        return out, coef

    def allowed(self, candidate: Candidate) -> bool:
        orders, c = candidate[:4], candidate[4]
        within = all(0 <= o <= b for o, b in zip(orders, self.bounds)) and sum(orders) <= self.max_order
        return within and 0 <= c <= self.drift

    def starts(self) -> list[Candidate]:
        wanted = [(2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)]
        clipped = [tuple(min(o, b) for o, b in zip(w, self.bounds)) for w in wanted]
        return list(dict.fromkeys([(*c, self.drift) for c in clipped] + [(0, 0, 0, 0, 0)]))

    def neighbours(self, candidate: Candidate) -> Iterator[Candidate]:
        moves = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)]
        for move in moves:
            for sign in (-1, 1):
                yield (*(o + sign * m for o, m in zip(candidate, move)), candidate[4])
        yield (*candidate[:4], 1 - candidate[4])

    def search(self) -> tuple[list[Candidate], list[np.ndarray]]:
        """The best candidate of every row and its coefficients."""
        size = len(self.z)
        best, chosen, coefs = np.full(size, np.inf), [(0, 0, 0, 0, 0)] * size, [np.zeros(0)] * size
        tried: list[set[Candidate]] = [set() for _ in range(size)]
        asked = {c: list(range(size)) for c in self.starts() if self.allowed(c)}
        while asked:
            moved = set()
            for candidate, rows in sorted(asked.items()):
                for r in rows:
                    tried[r].add(candidate)
                scores, found = self.score(candidate, np.array(rows), best[rows] - 1e-9)
                for i in np.flatnonzero(np.isfinite(scores)):
                    r = rows[i]
                    best[r], chosen[r], coefs[r] = scores[i], candidate, found[i]
                    moved.add(r)
            asked = {}
            for r in sorted(moved):
                for candidate in self.neighbours(chosen[r]):
                    if self.allowed(candidate) and candidate not in tried[r]:
                        asked.setdefault(candidate, []).append(r)
        return chosen, coefs

    def forecast(self, candidate: Candidate, rows: np.ndarray, coef: np.ndarray, steps: int) -> np.ndarray:
        """The recursion continued without new shocks, and the differences undone."""
        own, shocks = _lags(candidate, self.season)
        reach = max([*own, *shocks, self.season]) if self.season else 1
        n = self.n[rows]
        tail = n[:, None] - reach + np.arange(reach)
        take = lambda x: np.where(tail >= 0, np.take_along_axis(x[rows], np.maximum(tail, 0), axis=1), 0.0)
        w = np.hstack([take(self.w), np.zeros((len(rows), steps))])
        e = np.hstack([take(self.shocks), np.zeros((len(rows), steps))])
        c = candidate[4]
        for h in range(reach, reach + steps):
            value = coef[:, 0].copy() if c else np.zeros(len(rows))
            for i, k in enumerate(own):
                value += coef[:, c + i] * w[:, h - k]
            for i, k in enumerate(shocks):
                value += coef[:, c + len(own) + i] * e[:, h - k]
            w[:, h] = value
        path = w[:, reach:]
        for level in reversed(self.levels[1:-1] if self.d else []):
            last = np.take_along_axis(level[rows], n[:, None] - 1, axis=1)
            path = last + np.cumsum(path, axis=1)
        if self.seasonal_d:
            history = take(self.z)[:, -self.season :]
            out = np.hstack([history, np.zeros((len(rows), steps))])
            for h in range(steps):
                out[:, self.season + h] = out[:, h] + path[:, h]
            path = out[:, self.season :]
        return path


def label(candidate: Candidate, d: int, seasonal_d: int) -> str:
    p, q, seasonal_p, seasonal_q, c = candidate
    return f"({p},{d},{q})({seasonal_p},{seasonal_d},{seasonal_q}){'+c' if c else ''}"


def fit(z: np.ndarray, n: np.ndarray, steps: int, limits: OrderLimits = OrderLimits()):
    """(forecasts, forms, fallbacks) of every row of ``z``, known up to ``n``.

    A form is ``(p,d,q)(P,D,Q)`` with ``+c`` for a constant.  Rows of fewer months than ``min_history`` get their mean, with
    ``mean`` as their fallback; rows without any are NaN.
    """
    out = np.full((len(z), steps), np.nan)
    forms, fallbacks = np.full(len(z), "", dtype=object), np.full(len(z), "", dtype=object)
    known = np.where(np.arange(z.shape[1]) < n[:, None], np.nan_to_num(z), 0.0)
    short = (n > 0) & (n < limits.min_history)
    out[short] = (known[short].sum(axis=1) / n[short])[:, None]
    forms[short] = fallbacks[short] = "mean"
    able = np.flatnonzero(n >= limits.min_history)
    if not len(able):
        return out, forms, fallbacks
    d, seasonal_d = difference_orders(known[able], n[able], limits)
    # bounds follow from the length, so a group has one length
    for key in sorted(set(zip(n[able].tolist(), d.tolist(), seasonal_d.tolist()))):
        rows = able[(n[able] == key[0]) & (d == key[1]) & (seasonal_d == key[2])]
        group = _Group(known[rows, : key[0]], n[rows], key[1], key[2], limits)
        chosen, coefs = group.search()
        for candidate in sorted(set(chosen)):
            own = np.array([i for i, c in enumerate(chosen) if c == candidate])
            coef = np.stack([coefs[i] for i in own])
            out[rows[own]] = group.forecast(candidate, own, coef, steps)
            forms[rows[own]] = label(candidate, key[1], key[2])
    return out, forms, fallbacks
