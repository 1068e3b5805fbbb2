"""The batched per-series fits against plain loops over one series at a time."""

import itertools
import math

import numpy as np
import pytest
from conftest import long_frame
from pyspark.sql import functions as F

from demandloom.config import BacktestConfig
from demandloom.models import arima, ets, kernels
from demandloom.models.closed_form import SeasonalNaive
from demandloom.models.per_series import AutoAR, ExpSmoothing, FourierTrend, fit_batches
from demandloom.operators import tuning
from demandloom.operators.alignment import AlignmentError
from demandloom.operators.windows import pin_calendar, window_calendar
from demandloom.plans.backtest import backtest, backtest_lines
from demandloom.plans.study import run_trials, smoothing_pairs


def histories(seed=1):
    """Noise, season, trend, random walk, autoregression, constants, short ones and one with zeros."""
    rng = np.random.default_rng(seed)
    t = np.arange(72)
    walk = np.cumsum(rng.normal(0, 3, 72)) + 60
    ar = [50.0]
    for _ in range(71):
        ar.append(20 + 0.6 * ar[-1] + rng.normal(0, 2))
    out = [
        50 + rng.normal(0, 5, 72),
        60 + 20 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 2, 72),
        (20 + 2.0 * t) * (1 + 0.6 * np.cos(2 * np.pi * t / 12)) * np.exp(rng.normal(0, 0.03, 72)),
        walk,
        np.array(ar[:72]),
        np.full(50, 7.0),
        10 + rng.normal(0, 1, 30),
        5 + rng.normal(0, 1, 16),
        np.array([3.0, 5.0, 4.0]),
        np.array([9.0]),
        np.maximum(0, rng.normal(2, 3, 60)),
    ]
    y = np.full((len(out), 72), np.nan)
    for i, h in enumerate(out):
        y[i, : len(h)] = h
    return y, np.array([len(h) for h in out])


# --- seasonal autoregression ----------------------------------------------------------------------


def plain_kpss(w):
    n, e = len(w), np.array(w) - np.mean(w)
    width = math.floor(4 * (n / 100) ** 0.25)
    long_run = sum(e * e) / n + 2 * sum((1 - j / (width + 1)) * sum(e[j:] * e[:-j]) / n for j in range(1, width + 1))
    return sum(np.cumsum(e) ** 2) / n**2 / long_run if long_run > 1e-12 else 0.0


def plain_strength(z):
    t = np.arange(len(z))
    flat = z - np.polyval(np.polyfit(t, z, 1), t)
    left = flat - np.array([flat[m % 12 :: 12].mean() for m in t])
    left = left - left.mean()
    return max(0.0, 1 - sum(left**2) / sum(flat**2)) if sum(flat**2) > 1e-12 else 0.0


def plain_arima(z, steps):
    """One history by the rules of the module, written as loops."""
    n = len(z)
    if n < 8:
        return [float(np.mean(z))] * steps, "mean"
    seasonal_d = int(n >= 36 and plain_strength(z) > 0.64)
    levels = [list(z)]
    levels.append([None] * 12 + [z[t] - z[t - 12] for t in range(12, n)] if seasonal_d else list(z))
    first, d = 12 * seasonal_d, 0
    while d < 2 and n - first >= 8 and plain_kpss(levels[-1][first:]) > 0.463:
        last = levels[-1]
        levels.append([None] * (first + 1) + [last[t] - last[t - 1] for t in range(first + 1, n)])
        first, d = first + 1, d + 1
    w, valid = levels[-1], n - first
    seasonal = n >= 36 and valid >= 30
    longest = max(1, min(14 if seasonal else 5, valid // 4))
    back = min(2, valid // 36) if seasonal else 0
    bounds = (min(5, longest), min(5, longest), back, back)
    get = lambda t, k: w[t - k] if t - k >= first else 0.0

    def regression(rows, columns, target):
        x = np.array([[c(t) for c in columns] for t in rows]).reshape(len(rows), len(columns))
        goal = np.array([target(t) for t in rows])
        coef = np.linalg.lstsq(x, goal, rcond=1e-10)[0] if columns else np.zeros(0)
        return coef, goal - x @ coef

    rows = range(first + longest, n)
    _, shocks = regression(rows, [lambda t: 1.0, *[lambda t, k=k: get(t, k) for k in range(1, longest + 1)]], lambda t: w[t])
    e = dict(zip(rows, shocks))
    used = range(first + max(longest, 12 * back), n)

    def lags(c):
        own = [*range(1, c[0] + 1), *(12 * k for k in range(1, c[2] + 1))]
        return own, [*range(1, c[1] + 1), *(12 * k for k in range(1, c[3] + 1))]

    def stable(weights, ks):
        path = [1.0]
        for t in range(1, 49):
            path.append(sum(a * path[t - k] for a, k in zip(weights, ks) if k <= t))
        return not ks or max(abs(v) for v in path[-max(ks) :]) < 1

    def score(c):
        own, hit = lags(c)
        columns = [lambda t: 1.0] * c[4] + [lambda t, k=k: get(t, k) for k in own] + [lambda t, k=k: e.get(t - k, 0.0) for k in hit]
        coef, left = regression(used, columns, lambda t: w[t])
        count, k = len(used), len(columns) + 1
        ok = count - k - 1 > 0 and stable(coef[c[4] : c[4] + len(own)], own) and stable(-coef[c[4] + len(own) :], hit)
        floor = 1e-10 * max(np.mean([w[t] ** 2 for t in used]), 1e-12)
        aicc = count * math.log(max(np.mean(left**2), floor)) + 2 * k + 2 * k * (k + 1) / max(count - k - 1, 1)
        return (aicc if ok else math.inf), coef

    drift = int(d + seasonal_d <= 1)
    inside = lambda c: all(0 <= o <= b for o, b in zip(c, bounds)) and 0 <= c[4] <= drift
    starts = [(*(min(o, b) for o, b in zip(s, bounds)), drift) for s in ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))]
    asked, tried, best = {*starts, (0, 0, 0, 0, 0)}, set(), (math.inf, (0, 0, 0, 0, 0), np.zeros(0))
    while asked:
        moved = False
        for c in sorted(asked):
            tried.add(c)
            value, coef = score(c)
            if value < best[0] - 1e-9:
                best, moved = (value, c, coef), True
        asked = set()
        if moved:
            c = best[1]
            moves = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)]
            near = [(*(o + s * m for o, m in zip(c, move)), c[4]) for move in moves for s in (-1, 1)] + [(*c[:4], 1 - c[4])]
            asked = {x for x in near if inside(x)} - tried
    _, c, coef = best
    own, hit = lags(c)
    path = {t: v for t, v in enumerate(w) if v is not None}
    for h in range(n, n + steps):
        value = coef[0] if c[4] else 0.0
        value += sum(a * path.get(h - k, 0.0) for a, k in zip(coef[c[4] :], own))
        path[h] = value + sum(a * e.get(h - k, 0.0) for a, k in zip(coef[c[4] + len(own) :], hit))
    ahead = [path[h] for h in range(n, n + steps)]
    for level in reversed(levels[1:-1]):
        ahead = list(level[-1] + np.cumsum(ahead))
    if seasonal_d:
        whole = list(z)
        for v in ahead:
            whole.append(whole[-12] + v)
        ahead = whole[n:]
    return ahead, f"({c[0]},{d},{c[1]})({c[2]},{seasonal_d},{c[3]}){'+c' if c[4] else ''}"


def test_orders_and_forecasts_equal_plain_loops():
    y, n = histories()
    out, forms, fallbacks = arima.fit(y, n, 4)
    for i in range(len(y)):
        want, form = plain_arima(y[i, : n[i]], 4)
        assert forms[i] == form
        assert out[i] == pytest.approx(want, rel=1e-5, abs=1e-5)
        assert fallbacks[i] == ("mean" if n[i] < 8 else "")
    assert len(set(forms)) > 5 and any(",1," in f for f in forms)


def test_a_walk_is_differenced_and_a_season_too():
    y, n = histories()
    forms = arima.fit(y, n, 1)[1]
    assert forms[1].split(")(")[1].split(",")[1] == "1"
    assert forms[3].split(",")[1] == "1"
    assert forms[0].startswith("(") and forms[0].split(",")[1] == "0"


def test_batches_don_t_matter():
    y, n = histories()
    whole = arima.fit(y, n, 3)
    alone = [arima.fit(y[i : i + 1], n[i : i + 1], 3) for i in range(len(y))]
    assert [f[1][0] for f in alone] == whole[1].tolist()
    assert np.allclose(np.vstack([f[0] for f in alone]), whole[0], equal_nan=True)


def test_nothing_known_gives_nothing():
    y, n = histories()
    for fit in (arima.fit, ets.fit):
        out, forms, _ = fit(y, np.zeros_like(n), 2)
        assert np.isnan(out).all() and set(forms) == {""}


# --- exponential smoothing ------------------------------------------------------------------------


def plain_fold(z, form, weights, steps=0):
    a, b, c, phi = weights
    phi = phi if form.trend == "Ad" else 1.0
    middle, n = float(np.mean(z[:12])), len(z)
    slope = (np.mean(z[12:24]) - middle) / 12 if form.trend != "N" and n >= 24 else 0.0
    line = [middle + slope * (t - 5.5) for t in range(12)]
    level = line[-1]
    season = [v - m if form.season == "A" else v / (m if abs(m) > 1e-9 else 1.0) for v, m in zip(z, line)]
    errors = logs = 0.0
    for t in range(12, n):
        before = level + phi * slope if form.trend != "N" else level
        old = season[t % 12]
        if form.season == "M":
            mean = before * old
            errors, logs = errors + ((z[t] - mean) / mean) ** 2, logs + math.log(abs(mean))
            level, season[t % 12] = a * z[t] / old + (1 - a) * before, c * z[t] / before + (1 - c) * old
        else:
            old = old if form.season == "A" else 0.0
            errors += (z[t] - before - old) ** 2
            level = a * (z[t] - old) + (1 - a) * before
            if form.season == "A":
                season[t % 12] = c * (z[t] - before) + (1 - c) * old
        if form.trend != "N":
            slope = b * (level - before + phi * slope) + (1 - b) * phi * slope
    floor = 1e-10 * (1.0 if form.season == "M" else max(np.var(z), 1e-12))
    deviance = (n - 12) * math.log(max(errors / (n - 12), floor)) + 2 * logs
    out = []
    for h in range(1, steps + 1):
        value = level + sum(phi**k for k in range(1, h + 1)) * slope if form.trend != "N" else level
        own = season[(n + h - 1) % 12]
        out.append(value * own if form.season == "M" else value + own if form.season == "A" else value)
    return deviance, out


def plain_search(z, form):
    """The pattern search of one form."""
    low, high = (0.01, 0.01, 0.01, 0.8), (0.99, 0.99, 0.99, 0.98)
    values = [(0.02, 0.2, 0.6, 0.95), (0.05, 0.4, 0.9), (0.05, 0.3), (0.85, 0.97)]
    starts = list(itertools.product(*(v if i in form.weights else v[:1] for i, v in enumerate(values))))
    best, weights = min((plain_fold(z, form, s)[0], i, s) for i, s in enumerate(starts))[::2]
    step = 0.25
    while step >= 0.02:
        tried = []
        for m in form.weights:
            for sign in (1, -1):
                moved = list(weights)
                moved[m] = min(max(moved[m] + sign * step * (high[m] - low[m]), low[m]), high[m])
                tried.append((plain_fold(z, form, moved)[0], len(tried), moved))
        value, _, moved = min(tried)
        if value < best - 1e-9:
            best, weights = value, moved
        else:
            step /= 2
    return best, weights


def plain_smoothing(z, steps):
    n, best = len(z), None
    if n < 15:
        return [float(np.mean(z))] * steps, "mean"
    for form in ets.FORMS:
        if form.season != "N" and n < 24 or form.season == "M" and min(z) <= 0:
            continue
        deviance, weights = plain_search(z, form)
        k = form.parameters(12)
        aicc = deviance + 2 * k + 2 * k * (k + 1) / max(n - 12 - k - 1, 0.5)
        if best is None or aicc < best[0] - 1e-9:
            best = (aicc, plain_fold(z, form, weights, steps)[1], form.label)
    return best[1:]


def test_forms_and_forecasts_of_smoothing_equal_plain_loops():
    y, n = histories()
    out, forms, fallbacks = ets.fit(y, n, 4)
    for i in range(len(y)):
        want, form = plain_smoothing(y[i, : n[i]], 4)
        assert (forms[i], fallbacks[i]) == (form, "mean" if n[i] < 15 else "")
        assert out[i] == pytest.approx(want, rel=1e-6)
    assert forms[2].startswith("(M,") and forms[1].endswith(",A)")


def test_fitted_weights_are_as_likely_as_a_fine_grid():
    y, n = histories()
    for i, form in itertools.product((0, 3, 4), ets.FORMS[:3]):
        z = y[i, : n[i]]
        found = ets._Fold(z[None], form, 12).search(ets.SmoothingLimits())[1][0]
        grid = [0.01, *np.arange(0.1, 1, 0.1), 0.99]
        best = min(plain_fold(z, form, (a, b, 0.1, p))[0] for a in grid for b in grid[::3] for p in (0.8, 0.9, 0.98))
        # in units of the information criterion
        assert found <= best + 1.0


# --- trend with change points and waves ------------------------------------------------------------


def plain_waves(z, first, steps, cfg):
    n = len(z)
    if n < 3:
        return [float(np.mean(z))] * steps
    t = np.arange(n + steps)
    columns, knots = [np.ones(n + steps), t / 12], []
    if n >= 24:
        for k in range(1, cfg.waves + 1):
            columns += [f(2 * np.pi * k * (first + t) / 12) for f in (np.sin, np.cos)]
        if cfg.knot_every:
            knots = [k for k in range(cfg.knot_every, n, cfg.knot_every) if k < cfg.knot_share * n]
    x = np.column_stack(columns + [np.maximum(0, t - k) / 12 for k in knots])
    goal = np.log1p(np.maximum(z, 0)) if cfg.multiplicative else z
    penalty = np.diag([0.0] * len(columns) + [cfg.ridge] * len(knots))
    coef = np.linalg.solve(x[:n].T @ x[:n] + penalty, x[:n].T @ goal)
    path = x[n:] @ coef
    return np.expm1(path) if cfg.multiplicative else path


@pytest.mark.parametrize("cfg", [kernels.Waves(), kernels.Waves(2, True, 6), kernels.Waves(3, False, 12)])
def test_windows_as_prefixes_equal_fits_of_their_own(cfg):
    y, n = histories()
    known = np.maximum(n[:, None] - np.array([6, 3, 1, 0]), 0)
    first = np.arange(len(y)) + 5
    out, forms, fallbacks = kernels.trend_and_waves(y, known, 3, first, cfg)
    for i in range(len(y)):
        for w in range(4):
            if known[i, w]:
                assert out[i, w] == pytest.approx(plain_waves(y[i, : known[i, w]], first[i], 3, cfg), rel=1e-6, abs=1e-6)
            else:
                assert np.isnan(out[i, w]).all()
    assert {"mean", "trend", "trend+waves"} <= set(forms.ravel())
    assert ((fallbacks == "") == ((forms == "trend+waves") | (forms == ""))).all()


def test_a_trend_that_bends_is_followed():
    t = np.arange(72)
    y = np.where(t < 36, 100 + 2.0 * t, 172 - 1.0 * (t - 36))[None]
    known, first = np.array([[72]]), np.array([0])
    straight = kernels.trend_and_waves(y, known, 3, first)[0][0, 0]
    bent = kernels.trend_and_waves(y, known, 3, first, kernels.Waves(knot_every=12))[0][0, 0]
    true = 172 - (np.arange(72, 75) - 36)
    assert np.abs(bent - true).max() < 8 < 20 < np.abs(straight - true).max()


# --- in Spark ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    y, n = histories(3)
    table = {f"s{i}": y[i, : n[i]].tolist() for i in range(5)} | {"late": [4.0, 6.0, 5.0, 7.0, 6.0, 5.0, 6.0, 7.0, 5.0, 6.0]}
    return long_frame(spark, table, {"late": 62}).cache()


LOCAL = BacktestConfig(windows=3, use_validation=False)


def test_forms_and_fallbacks_come_with_the_forecasts(mixed):
    calendar = pin_calendar(window_calendar(mixed, LOCAL))
    for model in (ExpSmoothing(), AutoAR(), FourierTrend()):
        rows = model.forecast(mixed, calendar, LOCAL).collect()
        assert {r["fallback"] for r in rows if r["series_id"] != "late"} == {None}
        assert {r["fallback"] for r in rows if r["series_id"] == "late"} <= {"mean", "trend"}
        assert all(r["form"] for r in rows)


def test_fallbacks_are_counted_in_the_result_tables(mixed):
    calendar = pin_calendar(window_calendar(mixed, LOCAL))
    result = backtest(mixed, calendar, [ExpSmoothing(), SeasonalNaive()], LOCAL, check=False)
    by_window = {(r["model"], r["window"]): r["n_fallback"] for r in result.window_table().collect()}
    assert all(by_window["ExponentialSmoothing", w] == 3 and by_window["SeasonalNaive", w] == 0 for w in range(3))
    by_series = result.series_table().where("n_fallback > 0").collect()
    assert {r["series_name"] for r in by_series} == {"late"} and {r["n_fallback"] for r in by_series} == {3}


def test_models_share_one_pass(spark, mixed):
    calendar = pin_calendar(window_calendar(mixed, LOCAL))
    waves = {f"w{k}": FourierTrend(waves=k, name=f"w{k}") for k in (1, 2, 3)}
    together = fit_batches(mixed, calendar, LOCAL, {n: m.kernel() for n, m in waves.items()})
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") <= 1
    got = {(r["model"], r["window"], r["series_id"], r["time_index"]): r["forecast"] for r in together.collect()}
    for model in waves.values():
        for r in model.forecast(mixed, calendar, LOCAL).collect():
            assert got[model.name, r["window"], r["series_id"], r["time_index"]] == pytest.approx(r["forecast"])


@pytest.mark.parametrize("model", [ExpSmoothing(), AutoAR(), FourierTrend()], ids=lambda m: m.name)
def test_fits_do_not_depend_on_partitions(mixed, model):
    calendar = pin_calendar(window_calendar(mixed, LOCAL))
    runs = [sorted(model.forecast(mixed.repartition(n), calendar, LOCAL).collect()) for n in (1, 4, 17)]
    for run in runs[1:]:
        assert [(r["series_id"], r["form"]) for r in run] == [(r["series_id"], r["form"]) for r in runs[0]]
        assert [r["forecast"] for r in run] == pytest.approx([r["forecast"] for r in runs[0]], rel=1e-9)


def test_trials_add_no_jobs_and_equal_single_runs(spark, mixed):
    calendar = pin_calendar(window_calendar(mixed.where("series_id <> 'late'"), LOCAL))
    series = mixed.where("series_id <> 'late'")
    build = lambda p: FourierTrend(waves=int(p["waves"]))

    def study(n):
        rows = [(k, {"waves": str(1 + k % 4)}) for k in range(n)]
        packed = spark.createDataFrame(rows, "trial_number int, params map<string,string>")
        spark.sparkContext.setJobGroup(f"study{n}", "study")
        found = run_trials(series, calendar, LOCAL, build, packed, "s").collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"study{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, jobs

    (two, few), (eight, many) = study(2), study(8)
    assert many == few
    assert [r["trial_number"] for r in eight] == list(range(8))
    assert eight[0]["value"] == eight[4]["value"] == two[0]["value"] and eight[0]["value"] != eight[1]["value"]
    assert all(r["completed"] > r["started"] for r in eight)


def test_a_late_series_is_in_every_trial_or_raises(spark):
    y, n = histories(3)
    df = long_frame(spark, {"a": y[0].tolist(), "b": y[1].tolist(), "late": [1.0, 2.0, 3.0, 4.0]}, {"late": 68})
    cfg = BacktestConfig(windows=1, use_validation=False, tuning_windows=3)
    trials = spark.createDataFrame([(0, 0.2), (1, 0.7)], "trial_number int, alpha double")
    tuned = pin_calendar(window_calendar(df, cfg, "tuning"))
    known = smoothing_pairs(df.where("series_id <> 'late'"), tuned, trials, cfg)
    assert known.count() == 2 * 3 * 2 * 3
    assert tuning.trial_scores(known).count() == 2
    # its first months are after the cuts, within the forecast months
    early = df.where("series_id <> 'late'").unionByName(long_frame(spark, {"late": [1.0] * 9}, {"late": 63}))
    with pytest.raises(AlignmentError):
        smoothing_pairs(early, tuned, trials, cfg)


@pytest.mark.parametrize("drop", [True, False])
def test_the_latest_month_counts_as_asked(spark, drop):
    y, _ = histories(3)
    lines = long_frame(spark, {"a": y[0].tolist(), "b": y[1].tolist()}).withColumn("time_index", F.col("time_index").cast("timestamp_ntz"))
    cfg = BacktestConfig(windows=2, use_validation=False, drop_last_month=drop)
    result = backtest_lines(lines, [SeasonalNaive()], cfg)
    last = result.pairs.agg(F.max("time_index")).first()[0]
    assert (last.year - 2000) * 12 + last.month - 1 == (70 if drop else 71)


def test_smoothing_folds_no_move_that_cannot_help(monkeypatch):
    """A move stopped by a bound is where the history is already; it is not folded again."""
    rng = np.random.default_rng(8)
    fold, run, best = ets._Fold(50 + rng.normal(0, 4, (1, 60)), ets.Form("A", "A"), 12), ets._Fold.run, []

    def watched(self, weights, rows):
        out = run(self, weights, rows)
        points = [(d, tuple(w)) for d, w in zip(out[0].ravel(), weights.reshape(-1, 4))]
        assert not best or min(best)[1] not in [w for _, w in points]
        best.extend(points)
        return out

    monkeypatch.setattr(ets._Fold, "run", watched)
    weights, deviance = fold.search(ets.SmoothingLimits())
    assert 0.01 in weights and deviance == min(best)[0]


def test_smoothing_is_the_same_in_blocks_of_any_size(monkeypatch):
    z = 50 + 10 * np.sin(np.arange(60) / 3) + np.random.default_rng(8).normal(0, 4, (9, 60))
    whole = [ets._Fold(z, form, 12).search(ets.SmoothingLimits()) for form in ets.FORMS]
    monkeypatch.setattr(ets, "BLOCK", 5)
    for form, want in zip(ets.FORMS, whole):
        assert all(np.array_equal(a, b) for a, b in zip(want, ets._Fold(z, form, 12).search(ets.SmoothingLimits())))


def test_stability_is_decided_on_the_impulse_response():
    rng = np.random.default_rng(9)
    for lags in ([], [1], [1, 2, 12], [12, 24]):
        weights = rng.normal(0, 0.6, (200, len(lags)))
        path = np.zeros((200, arima.HORIZON + 1))
        path[:, 0] = 1.0
        for t in range(1, arima.HORIZON + 1):
            for i, k in enumerate(lags):
                path[:, t] += weights[:, i] * path[:, t - k] if k <= t else 0.0
        want = np.abs(path[:, -max(lags) :]).max(axis=1) < 1.0 if lags else np.ones(200, dtype=bool)
        assert np.array_equal(arima._stable(weights, lags), want)
