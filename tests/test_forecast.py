"""Forecasts: rules that hold on any series, and small worked cases."""

import numpy as np
import pytest

from sparkloom.operators import forecast as M


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = [("up", t, 10.0 + 2 * t) for t in range(40)] + [("noise", t, float(v)) for t, v in enumerate(rng.normal(50, 3, 40))]
    return spark.createDataFrame(rows, "series_id string, t long, y double").cache()


def by_step(df, series):
    return [r["forecast"] for r in df.where(f"series_id = '{series}'").orderBy("h").collect()]


def test_naive_repeats(panel):
    assert by_step(M.forecast_naive(panel, 3), "up") == [88.0] * 3
    assert by_step(M.forecast_naive(panel, 3, 2), "up") == [86.0, 88.0, 86.0]


def test_smoothing_finds_the_trend(panel):
    assert by_step(M.forecast_ets(panel, 3), "up") == pytest.approx([90.0, 92.0, 94.0], abs=1e-6)


def test_arima_and_net_follow_a_trend(panel):
    for df in (M.forecast_arima(panel, 3), M.forecast_nnar(panel, 3)):
        assert by_step(df, "up")[0] == pytest.approx(90.0, abs=3.0)


def test_net_is_repeatable(panel):
    a, b = (by_step(M.forecast_nnar(panel, 4, nets=3), "noise") for _ in range(2))
    assert a == b


def test_stationary_noise_is_not_differenced(panel):
    d = {r["series_id"]: r["d"] for r in M.differencing_order(panel).collect()}
    assert d["noise"] == 0 and d["up"] >= 1


def test_rolling_naive_is_the_first_difference(panel):
    own = {(r["series_id"], r["origin"]): r["error"] for r in M.rolling_naive(panel).collect()}
    called = {(r["series_id"], r["origin"]): r["error"] for r in M.rolling_cv(panel, "naive").collect()}
    assert own == called and len(own) == 78
    assert all(e == 2.0 for (s, _), e in own.items() if s == "up")


def test_best_model_ties_by_name(spark):
    df = spark.createDataFrame([("s", "b", 1.0), ("s", "a", 1.0), ("s", "c", 2.0)], "series_id string, model string, mse double")
    assert M.best_model(df).first()["model"] == "a"


def test_accuracy_of_a_perfect_forecast(panel):
    train, test = panel.where("t < 30"), panel.where("t >= 30")
    perfect = test.selectExpr("'m' model", "series_id", "t", "y forecast")
    row = M.accuracy(perfect, test, train).where("series_id = 'up'").first()
    assert (row["rmse"], row["mase"]) == (0.0, 0.0)
