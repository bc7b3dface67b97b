"""Forecast models of one series, in numpy: (values, horizon) in, path and spread out.

Small helpers of the panel jobs in :mod:`forecast`; Spark deals the series. Each
model returns its forecasts and the standard deviation of each step's error.
Fits follow published rules, so results are repeatable; they are not those of any
other package digit by digit.
"""

from __future__ import annotations

import numpy as np

Path = tuple[np.ndarray, np.ndarray]

# ------------------------------------------------------------ exponential smoothing

#: Forms (error, trend) of series without season: additive or multiplicative
#: errors; no, additive or damped additive trend.
ETS_FORMS = tuple((error, trend) for error in "AM" for trend in ("N", "A", "Ad"))


def ets_run(y: np.ndarray, error: str, trend: str, alpha: np.ndarray, beta: np.ndarray, phi: np.ndarray):
    """Run one form with many parameter sets at once: errors relative to the
    form (sets x values), one-step means, and the last level and slope."""
    early = y[: min(10, len(y))]
    slope0, level0 = np.polyfit(np.arange(len(early)), early, 1) if trend != "N" else (0.0, early[:3].mean())
    level = np.full(len(alpha), level0 - slope0 if trend != "N" else level0)
    slope = np.full(len(alpha), slope0)
    out, mean = np.empty((len(alpha), len(y))), np.empty((len(alpha), len(y)))
    for k, value in enumerate(y):
        drift = phi * slope
        mean[:, k] = level + drift
        e = value - mean[:, k]
        level, slope = mean[:, k] + alpha * e, drift + alpha * beta * e
        out[:, k] = e / mean[:, k] if error == "M" else e
    return out, mean, level, slope


def ets_criterion(e: np.ndarray, mean: np.ndarray, error: str, trend: str) -> np.ndarray:
    """AICc of each parameter set."""
    n, k = e.shape[1], {"N": 3, "A": 5, "Ad": 6}[trend]
    if n - k - 1 <= 0:
        return np.full(len(e), np.inf)
    fit = n * np.log(np.maximum((e * e).mean(axis=1), 1e-12))
    if error == "M":
        fit = np.where((mean > 0).all(axis=1), fit + 2 * np.log(np.maximum(mean, 1e-12)).sum(axis=1), np.inf)
    return fit + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def ets_fit(y: np.ndarray, error: str, trend: str, zooms: int = 4) -> tuple[float, tuple[float, float, float]]:
    """Least AICc and (alpha, beta, phi) of a form; the grid closes in on the
    best set a few times."""
    low, high = np.array([0.01, 0.0, 0.8]), np.array([0.99, 1.0, 0.98])
    best, at = np.inf, (0.5, 0.0, 1.0)
    span = high - low
    centre = (low + high) / 2
    for _ in range(zooms):
        axes = [np.unique(np.clip(c + np.linspace(-0.5, 0.5, 7) * s, a, b)) for c, s, a, b in zip(centre, span, low, high)]
        if trend == "N":
            axes[1:] = [np.zeros(1), np.ones(1)]
        elif trend == "A":
            axes[2] = np.ones(1)
        sets = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 3)
        with np.errstate(all="ignore"):
            e, mean, _, _ = ets_run(y, error, trend, *sets.T)
            found = np.nan_to_num(ets_criterion(e, mean, error, trend), nan=np.inf)
        k = int(found.argmin())
        if found[k] < best:
            best, at = float(found[k]), tuple(sets[k].tolist())
        centre, span = np.array(at), span / 3
    return best, at


def ets(y: np.ndarray, h: int) -> Path:
    """The form and parameters of least AICc (ties by order of ETS_FORMS)."""
    if len(y) < 5:
        return naive(y, h)
    forms = [(e, t) for e, t in ETS_FORMS if e == "A" or (y > 0).all()]
    fits = [(*ets_fit(y, *form), form) for form in forms]
    score, (alpha, beta, phi), (error, trend) = min(fits, key=lambda f: f[0])
    if not np.isfinite(score):
        return naive(y, h)
    e, _, level, slope = ets_run(y, error, trend, *(np.array([x]) for x in (alpha, beta, phi)))
    damped = np.cumsum(phi ** np.arange(1, h + 1)) if trend != "N" else np.zeros(h)
    path = level[0] + slope[0] * damped
    weights = alpha * (1 + beta * np.concatenate(([0.0], damped[:-1]))) if trend != "N" else np.full(h, alpha)
    grown = np.sqrt(1 + np.concatenate(([0.0], np.cumsum(weights[1:] ** 2))))
    sd = np.sqrt((e[0] ** 2).mean()) * (np.abs(path) if error == "M" else 1.0)
    return path, sd * grown


# ------------------------------------------------------------------------- ARIMA

#: Fixed value: 5 % critical value of the level-stationarity statistic.
KPSS_CRITICAL = 0.463


def kpss_statistic(y: np.ndarray, lags: int = 3) -> float:
    """Level-stationarity statistic with Bartlett weights; 0 if constant."""
    e = y - y.mean()
    total = e @ e + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, min(lags, len(y) - 1) + 1))
    return float((np.cumsum(e) ** 2).sum() / len(y) ** 2 / (total / len(y))) if total > 0 else 0.0


def differences(y: np.ndarray) -> int:
    for d in (0, 1):
        if len(y) - d < 4 or kpss_statistic(np.diff(y, d)) < KPSS_CRITICAL:
            return d
    return 2


class Arma:
    """Least-squares fits (long autoregression first) of one series; all orders
    are judged on the same values, so their AICc can be compared."""

    def __init__(self, y: np.ndarray, most: int) -> None:
        self.y, n = y, len(y)
        self.long = min(8, max(1, n // 4))
        self.most = max(0, min(most, n - self.long - 10))
        lagged = np.column_stack([np.ones(n - self.long)] + [y[self.long - i : n - i] for i in range(1, self.long + 1)])
        self.e = np.zeros(n)
        if n > 2 * self.long + 1:
            self.e[self.long :] = y[self.long :] - lagged @ np.linalg.lstsq(lagged, y[self.long :], rcond=None)[0]
        self.fits: dict[tuple[int, int, bool], tuple[float, np.ndarray, np.ndarray]] = {}

    def fit(self, p: int, q: int, constant: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """AICc, coefficients (constant, AR, MA) and residuals."""
        key = (p, q, constant)
        if key in self.fits:
            return self.fits[key]
        y, e, n = self.y, self.e, len(self.y)
        start = self.long + self.most
        m, k = n - start, p + q + 1 + constant
        if max(p, q) > self.most or m - k - 1 <= 0:
            return np.inf, np.zeros(1 + p + q), e
        x = np.column_stack(
            [np.full(m, float(constant))]
            + [y[start - i : n - i] for i in range(1, p + 1)]
            + [e[start - i : n - i] for i in range(1, q + 1)]
        )
        w = np.linalg.lstsq(x, y[start:], rcond=None)[0]
        out = e.copy()
        out[start:] = y[start:] - x @ w
        sse = max(float((out[start:] ** 2).sum()), 1e-12)
        score = m * np.log(sse / m) + 2 * k + 2 * k * (k + 1) / (m - k - 1)
        self.fits[key] = (score, w, out)
        return self.fits[key]

    def best(self, max_p: int, max_q: int, constants: tuple[bool, ...], stepwise: bool) -> tuple[int, int, bool]:
        """The order of least AICc: of all, or by steps to better neighbours."""
        inside = lambda p, q: 0 <= p <= max_p and 0 <= q <= max_q
        if not stepwise:
            tried = [(p, q, c) for p in range(max_p + 1) for q in range(max_q + 1) for c in constants]
            return min(tried, key=lambda o: (self.fit(*o)[0], sum(o[:2]), o))
        tried = [(p, q, c) for p, q in ((2, 2), (0, 0), (1, 0), (0, 1)) if inside(p, q) for c in constants]
        at = min(tried, key=lambda o: (self.fit(*o)[0], sum(o[:2]), o))
        while True:
            p, q, c = at
            steps = [(p + a, q + b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and inside(p + a, q + b)]
            steps += [(p, q, x) for x in constants if x != c]
            better = min(steps, key=lambda o: (self.fit(*o)[0], sum(o[:2]), o), default=at)
            if self.fit(*better)[0] >= self.fit(*at)[0]:
                return at
            at = better


def arima_order(y: np.ndarray, max_p: int = 5, max_q: int = 5, stepwise: bool = True) -> tuple[int, int, int, bool]:
    """(p, d, q, constant); a constant after one difference is a drift, and after
    two there is none."""
    d = differences(y)
    arma = Arma(np.diff(y, d), max(max_p, max_q))
    p, q, constant = arma.best(max_p, max_q, (False, True) if d < 2 else (False,), stepwise)
    return p, d, q, constant


def arima(y: np.ndarray, h: int, max_p: int = 5, max_q: int = 5, stepwise: bool = True) -> Path:
    if len(y) < 12:
        return naive(y, h)
    p, d, q, constant = arima_order(y, max_p, max_q, stepwise)
    z = np.diff(y, d)
    score, w, e = Arma(z, max(max_p, max_q)).fit(p, q, constant)
    if not np.isfinite(score):
        return naive(y, h)
    values, errors = z.tolist(), e.tolist()
    for _ in range(h):
        step = w[0] + sum(w[i] * values[-i] for i in range(1, p + 1)) + sum(w[p + i] * errors[-i] for i in range(1, q + 1))
        values.append(float(step))
        errors.append(0.0)
    path = np.array(values[len(z) :])
    # how far one shock reaches: the weights of the moving-average form, summed d times
    psi = np.zeros(h)
    for j in range(h):
        psi[j] = (1.0 if j == 0 else w[p + j] if j <= q else 0.0) + sum(w[i] * psi[j - i] for i in range(1, min(p, j) + 1))
    for level in range(d, 0, -1):
        path = np.diff(y, level - 1)[-1] + np.cumsum(path)
        psi = np.cumsum(psi)
    sigma = np.sqrt((e[len(e) // 3 :] ** 2).mean())
    return path, sigma * np.sqrt(np.cumsum(psi**2))


# --------------------------------------------------------------- neural autoregression


class Nets:
    """Many small nets of one hidden layer (logistic units, linear output), trained
    together from random starts by damped Gauss-Newton steps."""

    def __init__(self, nets: int, lags: int, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.shape = (lags + 1, hidden)
        self.w = rng.uniform(-0.7, 0.7, size=(nets, (lags + 1) * hidden + hidden + 1))

    def run(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outputs (nets x rows), hidden values and output weights."""
        inner = w[:, : self.shape[0] * self.shape[1]].reshape(len(w), *self.shape)
        outer = w[:, self.shape[0] * self.shape[1] :]
        hidden = 1 / (1 + np.exp(-np.clip(np.einsum("...rl,nlk->nrk", x, inner), -30, 30)))
        return np.einsum("nrk,nk->nr", hidden, outer[:, 1:]) + outer[:, :1], hidden, outer

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 25) -> None:
        """``x`` has a first column of ones."""
        damp = np.full(len(self.w), 1e-2)
        out, hidden, outer = self.run(self.w, x)
        loss = ((y - out) ** 2).sum(axis=1)
        for _ in range(steps):
            slope = hidden * (1 - hidden) * outer[:, None, 1:]
            inner = (x[None, :, :, None] * slope[:, :, None, :]).reshape(len(self.w), len(y), -1)
            jacobian = np.concatenate([inner, np.ones((*out.shape, 1)), hidden], axis=2)
            square = np.einsum("nri,nrj->nij", jacobian, jacobian)
            pull = np.einsum("nri,nr->ni", jacobian, y - out)
            square += damp[:, None, None] * np.eye(square.shape[1])
            tried = self.w + np.linalg.solve(square, pull[:, :, None])[:, :, 0]
            new = self.run(tried, x)
            new_loss = ((y - new[0]) ** 2).sum(axis=1)
            good = new_loss < loss
            self.w[good] = tried[good]
            damp = np.clip(np.where(good, damp / 3, damp * 5), 1e-8, 1e8)
            out, hidden, outer = self.run(self.w, x)
            loss = np.where(good, new_loss, loss)


def _lagged(z: np.ndarray, lags: int) -> np.ndarray:
    return np.column_stack([np.ones(len(z) - lags)] + [z[lags - i : len(z) - i] for i in range(1, lags + 1)])


def autoregression_order(z: np.ndarray, most: int = 5) -> int:
    """Lags (1 at least) of the linear autoregression of least AIC."""
    most, best = max(1, min(most, len(z) // 4)), (np.inf, 1)
    for p in range(1, most + 1):
        x, y = _lagged(z, p)[most - p :], z[most:]
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        best = min(best, (len(y) * np.log(max((rest @ rest) / len(y), 1e-12)) + 2 * (p + 1), p))
    return best[1]


def nnar(y: np.ndarray, h: int, nets: int = 20, seed: int = 1, paths: int = 200) -> Path:
    """Averaged nets on lagged, scaled values; spread by simulated paths."""
    if len(y) < 8:
        return naive(y, h)
    mean, scale = y.mean(), y.std() or 1.0
    z = (y - mean) / scale
    lags = autoregression_order(z)
    own = Nets(nets, lags, max(1, (lags + 1) // 2), seed)
    x = _lagged(z, lags)
    own.train(x, z[lags:])
    spread = np.sqrt(((z[lags:] - own.run(own.w, x)[0].mean(axis=0)) ** 2).mean())
    noise = np.random.default_rng(seed + 1).normal(scale=spread, size=(paths + 1, h))
    noise[0] = 0.0  # the forecast itself
    past = np.tile(z[-lags:], (paths + 1, 1))
    out = np.empty((paths + 1, h))
    for k in range(h):
        now = np.column_stack([np.ones(paths + 1), past[:, ::-1]])
        out[:, k] = np.clip(own.run(own.w, now)[0].mean(axis=0), -10, 10) + noise[:, k]
        past = np.column_stack([past[:, 1:], out[:, k]])
    return out[0] * scale + mean, out[1:].std(axis=0) * scale


# -------------------------------------------------------------------- closed forms


def naive(y: np.ndarray, h: int) -> Path:
    change = np.diff(y)
    sd = np.sqrt((change**2).mean()) if len(change) else 0.0
    return np.repeat(y[-1], h), sd * np.sqrt(np.arange(1, h + 1))


def average(y: np.ndarray, h: int) -> Path:
    return np.repeat(y.mean(), h), np.repeat(y.std() * np.sqrt(1 + 1 / len(y)), h)


def drift(y: np.ndarray, h: int) -> Path:
    step, steps = (y[-1] - y[0]) / max(len(y) - 1, 1), np.arange(1, h + 1)
    sd = np.diff(y).std() if len(y) > 1 else 0.0
    return y[-1] + steps * step, sd * np.sqrt(steps * (1 + steps / max(len(y) - 1, 1)))


MODELS = {"naive": naive, "mean": average, "drift": drift, "ets": ets, "arima": arima, "nnar": nnar}


# ----------------------------------------------------- errors over all origins at once


def naive_errors(y: np.ndarray, h: int, least: int) -> np.ndarray:
    return y[least + h - 1 :] - y[least - 1 : len(y) - h]


def average_errors(y: np.ndarray, h: int, least: int) -> np.ndarray:
    means = np.cumsum(y) / np.arange(1, len(y) + 1)
    return y[least + h - 1 :] - means[least - 1 : len(y) - h]


def drift_errors(y: np.ndarray, h: int, least: int) -> np.ndarray:
    at = np.arange(least - 1, len(y) - h)
    return y[at + h] - (y[at] + h * (y[at] - y[0]) / np.maximum(at, 1))


#: Models whose errors from all origins need a single pass.
WHOLE_SERIES = {"naive": naive_errors, "mean": average_errors, "drift": drift_errors}


def rolling_errors(y: np.ndarray, model: str, h: int, least: int) -> np.ndarray:
    """Error of the h-th step from each origin least..len(y)-h; other models are
    fitted anew at each origin."""
    if len(y) < least + h:
        return np.zeros(0)
    if model in WHOLE_SERIES:
        return WHOLE_SERIES[model](y, h, least)
    run = MODELS[model]
    return np.array([y[i + h - 1] - run(y[:i], h)[0][-1] for i in range(least, len(y) - h + 1)])
