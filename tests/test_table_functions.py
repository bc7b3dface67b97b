"""Table functions in SQL, smooth trends, sparse slots."""

import random

import pytest

from sparkloom.functions.table_functions import register
from sparkloom.operators import forecast as M
from sparkloom.operators import pixels as P


@pytest.fixture(scope="module")
def views(spark):
    register(spark)
    rng = random.Random(3)
    rows = [(k, t, None if t % 9 == 4 else rng.uniform(0, 9)) for k in ("a", "b", None) for t in range(30)] + [("one", 1, 5.0)]
    spark.createDataFrame(rows, "series_id string, t long, y double").repartition(3).createOrReplaceTempView("own_series")
    spark.createDataFrame([(1, [1.0, None, 3.0]), (2, []), (3, None)], "image_id long, pixels array<double>").createOrReplaceTempView("own_images")


@pytest.mark.parametrize("model", ["naive", "mean", "level_0.3"])
def test_rolled_as_in_columns(spark, views, model):
    got = spark.sql(f"SELECT * FROM rolling_errors(TABLE(own_series) PARTITION BY (series_id) ORDER BY (t), '{model}')").collect()
    want = M.rolling_cv(spark.table("own_series"), model, least=0).collect()
    if model == "naive":  # in columns the value before is the forecast, here the last value known
        want = [r for r in want if r["error"] is not None]
        got = [r for r in got if any(r["series_id"] == w["series_id"] and r["origin"] == w["origin"] for w in want)]
    assert {(r["series_id"], r["origin"]): r["error"] for r in got} == pytest.approx({(r["series_id"], r["origin"]): r["error"] for r in want}, nan_ok=True)
    assert len(got) == len(want) > 50


def test_image_stats(spark, views):
    rows = spark.sql("SELECT * FROM image_stats(TABLE(own_images), 1, 2.5D)").collect()
    assert sorted(map(tuple, rows)) == [(1, 1.0, 3.0, 1), (2, None, None, 0), (3, None, None, 0)]


@pytest.mark.parametrize(
    "call, problem",
    [("TABLE(own_images), 'naive'", "no column"), ("TABLE(own_series), 'other'", "unknown forecaster"), ("TABLE(own_series), 3", "constant name"), ("1, 'naive'", "TABLE")],
)
def test_wrong_calls(spark, views, call, problem):
    with pytest.raises(Exception, match=problem):
        spark.sql(f"SELECT * FROM rolling_errors({call})").collect()


def test_trend_follows_lines_and_chooses_spans(spark):
    rng = random.Random(1)
    line = [("line", t, 3.0 * t - 7) for t in range(40)]
    kink = [("kink", t, float(abs(t - 30) * 10) + rng.gauss(0, 0.01)) for t in range(60)]
    noise = [("noise", t, rng.gauss(0, 1)) for t in range(120)]
    gaps = [("gaps", t, None if t % 5 == 0 else 2.0 * t) for t in range(40)] + [("short", 1, 5.0), ("short", 2, 6.0)]
    rows = M.smooth_trend(spark.createDataFrame(line + kink + noise + gaps, "series_id string, t long, y double")).collect()
    at = {(r["series_id"], r["t"]): r for r in rows}
    assert all(at["line", t]["trend"] == pytest.approx(3.0 * t - 7) for t in range(40))
    assert all(at["gaps", t]["trend"] == pytest.approx(2.0 * t) for t in range(40)) and at["gaps", 5]["remainder"] is None
    assert at["short", 1]["trend"] is None and rows[0].asDict().keys() == {"series_id", "t", "y", "trend", "remainder"}
    assert abs(at["kink", 20]["trend"] - 100) < 1 and abs(at["kink", 30]["trend"]) < 15
    smooth = [at["noise", t]["trend"] for t in range(20, 100)]
    assert max(map(abs, smooth)) < 1.5


def test_nulls_do_not_end_a_fit(spark):
    rng = random.Random(2)
    rows = [("a", t, None if t in (3, 17) else float("nan") if t == 9 else 50 + t + rng.gauss(0, 1)) for t in range(40)] + [("none", t, None) for t in range(20)]
    df = spark.createDataFrame(rows, "series_id string, t long, y double")
    for out in (M.forecast_arima(df, 2), M.forecast_model(df, "ets", 2), M.forecast_nnar(df, 2, nets=2)):
        found = out.collect()
        assert {r["series_id"] for r in found} == {"a"} and all(abs(r["forecast"] - 90) < 15 for r in found) and {r["t"] for r in found} == {40, 41}


def test_slots(spark):
    tiles = spark.createDataFrame([(2, 7), (5, None), (5, 8), (9000, 1), (None, 3), (-4, 9)], "tile_no long, v int")
    got = sorted(tuple(r) for r in P.pad_last_slice(tiles, 7).collect())
    assert [r[0] for r in got] == sorted([5, *range(9002)]) and P.pad_last_slice(tiles, 7).dtypes == tiles.dtypes
    assert [r for r in got if r[1]] == [(2, 7), (5, 8), (9000, 1)]
    assert P.pad_last_slice(tiles.limit(0), 7).count() == 0
