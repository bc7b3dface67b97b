"""Forecast models against plain twins, and on series whose answer is known."""

import numpy as np
import pytest

from sparkloom.operators import forecast as M
from sparkloom.operators import models as N


def series(seed=0, n=60):
    rng = np.random.default_rng(seed)
    return 100 + np.cumsum(rng.normal(0.5, 2, n))


@pytest.mark.parametrize("error, trend", N.ETS_FORMS)
def test_smoothing_runs_like_the_plain_recursion(error, trend):
    y, alpha, beta, phi = series(), 0.3, 0.2 if trend != "N" else 0.0, 0.9 if trend == "Ad" else 1.0
    e, mean, level, slope = N.ets_run(y, error, trend, *(np.array([x]) for x in (alpha, beta, phi)))
    first = y[:10]
    b, a = np.polyfit(range(10), first, 1) if trend != "N" else (0.0, first[:3].mean())
    lv, sl = a - b if trend != "N" else a, b
    for k, value in enumerate(y):
        want = lv + phi * sl
        assert mean[0, k] == pytest.approx(want)
        assert e[0, k] == pytest.approx((value - want) / (want if error == "M" else 1))
        lv, sl = want + alpha * (value - want), phi * sl + alpha * beta * (value - want)
    assert (level[0], slope[0]) == pytest.approx((lv, sl))


def test_smoothing_finds_good_parameters():
    """No set of a fine grid is much better than the one found."""
    y = series(3)
    score, _ = N.ets_fit(y, "A", "A")
    a, b = (x.ravel() for x in np.meshgrid(np.linspace(0.01, 0.99, 60), np.linspace(0, 1, 60)))
    e, mean, _, _ = N.ets_run(y, "A", "A", a, b, np.ones(len(a)))
    assert score <= N.ets_criterion(e, mean, "A", "A").min() + 0.2


def test_known_series():
    line, flat = 5 + 2.0 * np.arange(40), np.full(40, 7.0)
    assert N.ets(line, 3)[0] == pytest.approx([85, 87, 89], abs=0.5)
    for model in ("naive", "mean", "ets", "arima", "nnar"):
        path, sd = N.MODELS[model](flat, 4)
        assert path == pytest.approx([7.0] * 4, abs=1e-3) and (sd >= 0).all()
    assert N.drift(line, 2)[0] == pytest.approx([85, 87])


def test_steps_reach_what_the_full_search_finds():
    for seed in range(6):
        y = np.diff(series(seed, 120))
        arma = N.Arma(y, 5)
        whole = arma.fit(*arma.best(5, 5, (False, True), stepwise=False))[0]
        steps = arma.fit(*arma.best(5, 5, (False, True), stepwise=True))[0]
        assert whole <= steps <= whole + 8


def test_arma_fit_equals_plain_least_squares():
    y = np.diff(series(2, 80))
    arma = N.Arma(y, 2)
    score, w, _ = arma.fit(2, 0, True)
    start = arma.long + 2
    x = np.array([[1, y[t - 1], y[t - 2]] for t in range(start, len(y))])
    assert w == pytest.approx(np.linalg.solve(x.T @ x, x.T @ y[start:]))
    sse, m = ((y[start:] - x @ w) ** 2).sum(), len(y) - start
    assert score == pytest.approx(m * np.log(sse / m) + 2 * 4 + 2 * 4 * 5 / (m - 5))


def test_autoregression_is_recovered():
    rng = np.random.default_rng(1)
    y = [0.0, 0.0]
    for _ in range(400):
        y.append(0.6 * y[-1] + 0.3 * rng.normal() + 1)
    p, d, q, _ = N.arima_order(np.array(y[50:]))
    assert d == 0 and p + q >= 1
    path, sd = N.arima(np.array(y[50:]), 30)
    assert path[-1] == pytest.approx(2.5, abs=0.3) and sd[0] < sd[5]


def test_nets_learn_a_curve():
    """Trained nets beat the linear autoregression on the logistic map."""
    y = [0.3]
    for _ in range(150):
        y.append(3.8 * y[-1] * (1 - y[-1]))
    y = np.array(y)
    own = N.Nets(10, 1, 4, 1)
    x = N._lagged(y, 1)
    before = ((y[1:] - own.run(own.w, x)[0]) ** 2).mean()
    own.train(x, y[1:], 60)
    after = ((y[1:] - own.run(own.w, x)[0].mean(axis=0)) ** 2).mean()
    line = ((y[1:] - x @ np.linalg.lstsq(x, y[1:], rcond=None)[0]) ** 2).mean()
    assert after < 0.05 * line < before


@pytest.mark.parametrize("model", list(N.MODELS))
@pytest.mark.parametrize("h", [1, 3])
def test_rolling_errors_refit_at_each_origin(model, h):
    y = series(4, 30)
    found = N.rolling_errors(y, model, h, 20)
    want = [y[i + h - 1] - N.MODELS[model](y[:i], h)[0][-1] for i in range(20, len(y) - h + 1)]
    assert found == pytest.approx(want) and not len(N.rolling_errors(y[:3], model, h, 20))


def test_jobs_equal_the_models(spark):
    ys = {k: series(k, 40) for k in range(3)}
    df = spark.createDataFrame([(k, t, float(v)) for k, y in ys.items() for t, v in enumerate(y)], "series_id long, t long, y double")
    for name in N.MODELS:
        rows = M.forecast_model(df, name, 3).orderBy("series_id", "h").collect()
        for k, y in ys.items():
            path, sd = N.MODELS[name](y, 3)
            own = [r for r in rows if r["series_id"] == k]
            assert [r["forecast"] for r in own] == pytest.approx(path)
            assert [r["hi"] - r["lo"] for r in own] == pytest.approx(2 * 1.96 * sd)
            assert [r["t"] for r in own] == [40, 41, 42]
    cv = M.rolling_cv(df, "ets", least=30).orderBy("series_id", "origin").collect()
    assert [r["error"] for r in cv if r["series_id"] == 1] == pytest.approx(N.rolling_errors(ys[1], "ets", 1, 30))
    assert [r["origin"] for r in cv if r["series_id"] == 1] == list(range(29, 39))


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_short_series(n):
    for name, run in N.MODELS.items():
        path, sd = run(np.arange(1.0, n + 1), 2)
        assert np.isfinite(path).all() and np.isfinite(sd).all(), name
