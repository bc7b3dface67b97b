"""Forecasting many series at once: (series_id, t, y) in, one row per result out.

Naive forecasts, smoothing on a fixed grid and the one-step errors of the closed
forms are columns, windows, scans and higher-order functions; optimised smoothing, ARIMA and the neural autoregression
are fitted by numpy (:mod:`models`), one series per group. Seeds are fixed, so
results are repeatable; they are not those of any other package.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import models
from .ordered import seasonal_lag
from .scans import Previous, RunningSum, affine_scan, segmented


def _series() -> WindowSpec:
    return Window.partitionBy("series_id")


def _in_time() -> WindowSpec:
    return _series().orderBy("t")


def _valued(df: DataFrame) -> DataFrame:
    """Rows with a value: models are fitted to these, and forecasts follow the last
    one. A series without any has no rows."""
    return df.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))


def forecast_naive(df: DataFrame, h: int, m: int = 1) -> DataFrame:
    """(series_id, h, t, forecast): the last m values repeated over h steps."""
    newest = df.withColumn("rn", F.row_number().over(_series().orderBy(F.desc("t")))).where(F.col("rn") <= m)
    newest = newest.withColumn("last_t", F.max("t").over(_series()))
    steps = newest.select("series_id", "rn", "last_t", "y", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h"))
    rows = steps.where((F.lit(m) - (F.col("h") - 1) % m) == F.col("rn"))
    return rows.select("series_id", "h", (F.col("last_t") + F.col("h")).alias("t"), F.col("y").alias("forecast"))


def forecast_intervals(df: DataFrame, h: int, z: float = 1.96) -> DataFrame:
    """Naive forecasts with bounds that widen with the square root of h; the
    spread is that of the one-step changes."""
    spread = seasonal_lag(df).groupBy("series_id").agg(F.sqrt(F.avg(F.col("change") * F.col("change"))).alias("sd"))
    wide = F.lit(z) * F.col("sd") * F.sqrt(F.col("h"))
    return forecast_naive(df, h).join(spread, "series_id").select(
        "series_id", "h", "t", "forecast", (F.col("forecast") - wide).alias("lo"), (F.col("forecast") + wide).alias("hi")
    )


def decompose(df: DataFrame, k: int = 2) -> DataFrame:
    """``trend``: centred mean of 2k + 1 values (null at the ends), ``remainder``."""
    around = _in_time().rowsBetween(-k, k)
    whole = F.count("y").over(around) == 2 * k + 1
    out = df.withColumn("trend", F.when(whole, F.avg("y").over(around)))
    return out.withColumn("remainder", F.col("y") - F.col("trend"))


#: Neighbours on each side of the three local fits of :func:`smooth_trend`.
SPANS = (2, 6, 18)


def smooth_trend(df: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """``trend``: local straight lines of the span that suits each point best, and
    ``remainder``.

    For each span a line is fitted to the values within that many rows, and the
    error at its middle is what it would be had that value been left out. The span of
    least absolute error, averaged over the middle span, is taken (ties: the
    narrower). Ends have one-sided fits; points without a fit of three values have
    no trend. Nulls are no values but may have a trend.
    """
    t, y, out = F.col("t").cast("double"), F.col("y").cast("double"), df
    near = lambda k: _in_time().rowsBetween(-k, k)
    for i, k in enumerate(spans):
        w = near(k)
        n, sxx = F.regr_count(y, t).over(w), F.regr_sxx(y, t).over(w)
        from_middle = t - F.regr_avgx(y, t).over(w)
        fit = F.regr_avgy(y, t).over(w) + F.regr_slope(y, t).over(w) * from_middle
        weight = 1 / n + from_middle * from_middle / sxx  # of the point in its own fit
        fitted = (n >= 3) & (sxx > 0)
        out = out.withColumn(f"_fit{i}", F.when(fitted, fit))
        out = out.withColumn(f"_error{i}", F.when(fitted & (weight < 0.999), F.abs(y - F.col(f"_fit{i}")) / (1 - weight)))
    middle = near(spans[len(spans) // 2])
    for i in range(len(spans)):
        # rounded, so that sums in another order choose alike
        out = out.withColumn(f"_mean{i}", F.round(F.avg(f"_error{i}").over(middle), 6))
    choices = [F.struct(F.col(f"_mean{i}").alias("error"), F.lit(i).alias("span"), F.col(f"_fit{i}").alias("fit")) for i in range(len(spans))]
    usable = F.filter(F.array(*choices), lambda c: c["error"].isNotNull() & c["fit"].isNotNull())
    out = out.withColumn("trend", F.array_min(usable)["fit"]).withColumn("remainder", F.col("y") - F.col("trend"))
    return out.drop(*(f"_{c}{i}" for c in ("fit", "error", "mean") for i in range(len(spans))))


#: The grid of smoothing forms: (form, alpha, beta, phi), 9 + 18 + 18 rows.
ALPHAS = tuple(round(0.1 * i, 1) for i in range(1, 10))
ETS_GRID = tuple(
    [("level", a, 0.0, 1.0) for a in ALPHAS]
    + [("trend", a, b, 1.0) for a in ALPHAS for b in (0.1, 0.3)]
    + [("damped", a, b, 0.9) for a in ALPHAS for b in (0.1, 0.3)]
)
#: Fitted numbers of each form (parameters and starting states).
ETS_PARAMETERS = {"level": 2, "trend": 4, "damped": 5}


def _ets_state(level: Column, slope: Column, sse: Column, error: Column) -> Column:
    return F.struct(level.cast("double").alias("level"), slope.cast("double").alias("slope"), sse.cast("double").alias("sse"), error.cast("double").alias("error"))


def _ets_step(s: Column, y: Column) -> Column:
    """One step of additive-error smoothing with the row's parameters."""
    drift = s["slope"] * F.col("phi")
    error = y - s["level"] - drift
    return _ets_state(
        s["level"] + drift + F.col("alpha") * error,
        drift + F.col("alpha") * F.col("beta") * error,
        s["sse"] + error * error,
        error,
    )


def ets_fits(df: DataFrame, grid: Sequence[tuple] = ETS_GRID) -> DataFrame:
    """Every form of the grid run over every series: final states and AICc.

    Series are panel-sized arrays; the grid is a list of literals.
    """
    arrays = df.groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("ys"),
        F.max("t").alias("last_t"),
        F.count("*").alias("n"),
    )
    rows = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("form", "alpha", "beta", "phi"), g))) for g in grid]
    fits = arrays.where("n >= 8").select("*", F.inline(F.array(*rows)))
    first, zero = F.col("ys")[0], F.lit(0.0)
    slope = F.when(F.col("form") == "level", 0.0).otherwise(F.col("ys")[1] - first)
    rest = F.slice("ys", 2, F.size("ys"))
    fits = fits.withColumn("end", F.aggregate(rest, _ets_state(first, slope, zero, zero), _ets_step))
    k = F.create_map(*(F.lit(x) for pair in ETS_PARAMETERS.items() for x in pair))[F.col("form")] + 1
    n = F.col("n") - 1
    fits = fits.where(n - k - 1 > 0)
    aicc = n * F.log(F.greatest(F.col("end.sse") / n, F.lit(1e-12))) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    return fits.select("series_id", "form", "alpha", "beta", "phi", "last_t", "end.level", "end.slope", "end.sse", aicc.alias("aicc"))


def best_ets(df: DataFrame) -> DataFrame:
    """The fit of least AICc of each series (ties by form and parameters)."""
    order = F.struct(F.round("aicc", 6), "form", "alpha", "beta")
    fits = ets_fits(df)
    row = F.struct(*fits.columns)
    return fits.groupBy("series_id").agg(F.min_by(row, order).alias("best")).select("best.*")


def forecast_ets(df: DataFrame, h: int) -> DataFrame:
    """(series_id, form, alpha, beta, h, t, forecast) of the best smoothing form."""
    rows = best_ets(df).select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h"))
    damped = F.aggregate(
        F.sequence(F.lit(1), F.col("h")), F.lit(0.0), lambda s, i: s + F.pow(F.col("phi"), i)
    )
    value = F.col("level") + F.col("slope") * damped
    return rows.select("series_id", "form", "alpha", "beta", "h", (F.col("last_t") + F.col("h")).alias("t"), value.alias("forecast"))


def kpss(df: DataFrame, lags: int = 3) -> DataFrame:
    """(series_id, eta): level-stationarity statistic with Bartlett weights; 0
    for a constant series."""
    rows = df.withColumn("e", F.col("y") - F.avg("y").over(_series()))
    rows = rows.withColumn("s", F.sum("e").over(_in_time()))
    for j in range(1, lags + 1):
        rows = rows.withColumn(f"g{j}", F.col("e") * F.lag("e", j).over(_in_time()))
    total = F.sum(F.col("e") * F.col("e"))
    for j in range(1, lags + 1):
        total = total + 2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(f"g{j}"), F.lit(0.0))
    n = F.count("*")
    eta = F.try_divide(F.sum(F.col("s") * F.col("s")) / (n * n), total / n)
    return rows.groupBy("series_id").agg(F.coalesce(eta, F.lit(0.0)).alias("eta"))


def differencing_order(df: DataFrame) -> DataFrame:
    """(series_id, d): 0, 1 or 2 differences until the statistic is not critical."""
    once = seasonal_lag(df).where("change is not null").select("series_id", "t", F.col("change").alias("y"))
    a = kpss(df).withColumnRenamed("eta", "eta0")
    b = kpss(once).withColumnRenamed("eta", "eta1")
    d = F.when(F.col("eta0") < models.KPSS_CRITICAL, 0).when(F.col("eta1") < models.KPSS_CRITICAL, 1).otherwise(2)
    return a.join(b, "series_id").select("series_id", "eta0", "eta1", d.alias("d"))


def forecast_arima(df: DataFrame, h: int, max_p: int = 5, max_q: int = 5, stepwise: bool = True) -> DataFrame:
    """(series_id, p, d, q, drift, h, t, forecast): the order of least AICc, found
    by steps to better neighbours or by trying all of them."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, steps = pdf["y"].to_numpy(dtype=float), np.arange(1, h + 1)
        p, d, q, drift = models.arima_order(y, max_p, max_q, stepwise) if len(y) >= 12 else (0, 1, 0, False)
        path, _ = models.arima(y, h, max_p, max_q, stepwise)
        rows = {"series_id": pdf["series_id"].iloc[0], "p": p, "d": d, "q": q, "drift": drift}
        return pd.DataFrame(rows | {"h": steps, "t": pdf["t"].max() + steps, "forecast": path})

    kind = df.schema["series_id"].dataType.simpleString()
    schema = f"series_id {kind}, p int, d int, q int, drift boolean, h int, t long, forecast double"
    return _valued(df).groupBy("series_id").applyInPandas(fit, schema)


def forecast_nnar(df: DataFrame, h: int, nets: int = 20, seed: int = 1) -> DataFrame:
    """(series_id, h, t, forecast): trained nets on lagged values, averaged; all
    nets of a series are fitted in one group."""
    rows = forecast_model(df, lambda y, steps: models.nnar(y, steps, nets, seed), h)
    return rows.select("series_id", "h", "t", "forecast")


def forecast_model(df: DataFrame, model: str | Callable, h: int, z: float = 1.96) -> DataFrame:
    """(series_id, h, t, forecast, lo, hi) of a model: a name of models.MODELS, or
    a function of values and horizon that returns forecasts and their spread."""
    run = models.MODELS[model] if isinstance(model, str) else model

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        path, sd = run(pdf["y"].to_numpy(dtype=float), h)
        steps = np.arange(1, h + 1)
        rows = {"series_id": pdf["series_id"].iloc[0], "h": steps, "t": pdf["t"].max() + steps}
        return pd.DataFrame(rows | {"forecast": path, "lo": path - z * sd, "hi": path + z * sd})

    kind = df.schema["series_id"].dataType.simpleString()
    schema = f"series_id {kind}, h int, t long, forecast double, lo double, hi double"
    return _valued(df).groupBy("series_id").applyInPandas(fit, schema)


def align(forecasts: DataFrame, test: DataFrame) -> DataFrame:
    """Forecasts beside the held-out values of the same time."""
    return forecasts.join(test.select("series_id", "t", F.col("y").alias("actual")), ["series_id", "t"])


def stack_models(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables, with the table's name as ``model``."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("model"), "series_id", "t", "forecast")
        out = rows if out is None else out.unionByName(rows)
    return out


def accuracy(forecasts: DataFrame, test: DataFrame, train: DataFrame, m: int = 1) -> DataFrame:
    """ME, RMSE, MAE, MPE, MAPE and MASE of each model on the held-out values;
    MASE is scaled by the mean absolute m-step change of the training values.
    Ratios to zero are left out of their mean."""
    scale = seasonal_lag(train, m).groupBy("series_id").agg(F.avg(F.abs("change")).alias("scale"))
    rows = align(forecasts, test).join(scale, "series_id")
    e = F.col("actual") - F.col("forecast")
    return rows.groupBy("series_id", "model").agg(
        F.avg(e).alias("me"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.try_divide(100 * e, F.col("actual"))).alias("mpe"),
        F.avg(F.abs(F.try_divide(100 * e, F.col("actual")))).alias("mape"),
        F.try_divide(F.avg(F.abs(e)), F.max("scale")).alias("mase"),
    )


def round_report(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rank_models(report: DataFrame, measure: str) -> DataFrame:
    """``rank`` of each model of a series by a measure, least first."""
    order = _series().orderBy(F.col(measure).asc_nulls_last(), "model")
    return report.withColumn("rank", F.row_number().over(order))


def best_model(report: DataFrame, measure: str = "mse") -> DataFrame:
    """The model of least measure of each series, ties by name."""
    return report.groupBy("series_id").agg(F.min_by("model", F.struct(measure, "model")).alias("model"))


def rolling_cv(df: DataFrame, forecaster: str, h: int = 1, least: int = 1) -> DataFrame:
    """(series_id, model, origin, error): each series forecast h steps ahead from
    every origin with ``least`` values. One-step errors of the closed forms (CLOSED,
    and ``level_<alpha>``) are scans in columns; other models of models.MODELS are
    fitted anew at each origin, one series per task."""
    if h == 1 and (forecaster in CLOSED or forecaster.startswith("level_")):
        if forecaster in CLOSED:
            return CLOSED[forecaster](df, least)
        return rolling_smoothing(df, float(forecaster.removeprefix("level_")), least)

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        found = models.rolling_errors(pdf["y"].to_numpy(dtype=float), forecaster, h, least)
        origin = pdf["t"].to_numpy()[least - 1 :][: len(found)]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "model": forecaster, "origin": origin, "error": found})

    kind = df.schema["series_id"].dataType.simpleString()
    return _valued(df).groupBy("series_id").applyInPandas(errors, f"series_id {kind}, model string, origin long, error double")


#: Steps of t of a bucket in which sums of one-step errors are run.
STEPS = 4096


def _one_step(df: DataFrame, model: str, forecast: dict, error: Column, least: int, prepare: dict | None = None) -> DataFrame:
    """Errors against a forecast that is known one row before; ``_n`` values had come
    by then. Null values are no values; their rows have null errors."""
    known = {"_n": RunningSum(F.col("y").isNotNull().cast("long")), **(prepare or {})}
    before = {"origin": Previous(F.col("t")), "_seen": Previous(F.col("_n")), **forecast}
    rows = segmented(df.select("series_id", "t", "y"), ["series_id"], ["t"], F.floor(F.col("t") / STEPS), known, before)
    rows = rows.where(F.col("origin").isNotNull() & (F.col("_seen") >= least))
    return rows.select("series_id", F.lit(model).alias("model"), F.col("origin").cast("long").alias("origin"), error.alias("error"))


def rolling_naive(df: DataFrame, least: int = 1) -> DataFrame:
    """One-step errors of the naive forecast."""
    return _one_step(df, "naive", {"_last": Previous(F.col("y"))}, F.col("y") - F.col("_last"), least)


def rolling_mean(df: DataFrame, least: int = 1) -> DataFrame:
    """One-step errors of the mean of all values so far."""
    mean = F.try_divide(F.col("_before"), F.col("_seen"))
    return _one_step(df, "mean", {"_before": Previous(F.col("_total"))}, F.col("y") - mean, least, {"_total": RunningSum(F.col("y").cast("double"))})


def rolling_smoothing(df: DataFrame, alpha: float, least: int = 1) -> DataFrame:
    """One-step errors of level smoothing with a fixed alpha, from the first value
    on. The recursion is an affine map of the level, so all rows of a series are
    worked out by :func:`affine_scan`, over many tasks; a null leaves the level."""
    y = F.col("y")
    rows = segmented(df.select("series_id", "t", "y"), ["series_id"], ["t"], F.floor(F.col("t") / STEPS), {"_n": RunningSum(y.isNotNull().cast("long"))})
    first = F.col("_n") == 1
    m = F.when(y.isNull(), 1.0).when(first, 0.0).otherwise(1 - alpha)
    c = F.when(y.isNull(), 0.0).when(first, y).otherwise(alpha * y)
    levels = affine_scan(rows, ["series_id"], "t", m, c, "_level")
    before = {"origin": Previous(F.col("t")), "_seen": Previous(F.col("_n")), "_last": Previous(F.col("_level"))}
    out = segmented(levels, ["series_id"], ["t"], F.floor(F.col("t") / STEPS), before).where(F.col("origin").isNotNull() & (F.col("_seen") >= least))
    return out.select("series_id", F.lit(f"level_{alpha:g}").alias("model"), F.col("origin").cast("long").alias("origin"), (y - F.col("_last")).alias("error"))


#: One-step errors in columns by the name of the model.
CLOSED: dict[str, Callable[[DataFrame, int], DataFrame]] = {"naive": rolling_naive, "mean": rolling_mean}


def cv_mse(errors: DataFrame) -> DataFrame:
    """Mean squared error of each model of a series; null errors are left out."""
    return errors.groupBy("series_id", "model").agg(F.avg(F.col("error") * F.col("error")).alias("mse"))
