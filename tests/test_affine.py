"""Affine scans and one-step errors against plain recursions."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import forecast as M
from sparkloom.operators import scans as S


def recursion(rows):
    """(t, m, c) in order of t: x = m x + c."""
    out, x = {}, 0.0
    for t, m, c in sorted(rows):
        x = m * x + c
        out[t] = x
    return out


@pytest.mark.parametrize("width", [2, 5, 32])
def test_affine_scan(spark, width):
    rng = random.Random(width)
    rows = [(k, t, rng.uniform(-1.1, 1.1), rng.uniform(-5, 5), "x") for k in (None, "a", "b") for t in rng.sample(range(-150, 250), 60)]
    df = spark.createDataFrame(rows, "k string, t long, m double, c double, part string").repartition(3)
    got = S.affine_scan(df, ["k"], "t", F.col("m"), F.col("c"), width=width)
    assert got.columns == [*df.columns, "value"]
    for k in (None, "a", "b"):
        want = recursion([r[1:4] for r in rows if r[0] == k])
        assert {r["t"]: r["value"] for r in got.where(F.col("k").eqNullSafe(k)).collect()} == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_long_series(spark):
    df = spark.range(0, 30_000, 1, 4).selectExpr("id AS t", "CAST(id % 17 AS DOUBLE) AS y")
    got = S.affine_scan(df, [], "t", F.lit(0.75), F.col("y")).where("t % 997 = 0").collect()
    want = recursion([(t, 0.75, float(t % 17)) for t in range(30_000)])
    assert all(r["value"] == pytest.approx(want[r["t"]], rel=1e-12) for r in got) and len(got) > 30


def plain_errors(y, model, least=1):
    """(index of the origin, error) of one-step forecasts; None is no value."""
    out, seen, level = [], [], None
    for i, v in enumerate(y):
        if i and len(seen) >= least:
            forecast = {"naive": y[i - 1], "mean": sum(seen) / len(seen) if seen else None}.get(model, level)
            out.append((i - 1, None if v is None or forecast is None else v - forecast))
        if v is not None:
            seen.append(v)
            level = v if level is None else level + 0.3 * (v - level)
    return out


@pytest.mark.parametrize("model", ["naive", "mean", "level_0.3"])
@pytest.mark.parametrize("least", [1, 4])
def test_one_step_errors(spark, model, least):
    rng = random.Random(8)
    series = {"a": [rng.uniform(0, 50) for _ in range(90)], "b": [None, None, 3.0, None, 5.0, 6.0, 7.0, None, 2.0], "c": [1.0], "d": [None, None]}
    rows = [(k, 10 * t - 40, v) for k, ys in series.items() for t, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "series_id string, t long, y double").repartition(3)
    found = M.rolling_cv(df, model, least=least).collect()
    got = {(r["series_id"], r["origin"]): r["error"] for r in found}
    want = {(k, 10 * i - 40): e for k, ys in series.items() for i, e in plain_errors(ys, model, least)}
    assert {r["model"] for r in found} == {model} and len(found) == len(want) and set(got) == set(want)
    for k, e in want.items():
        assert got[k] == (None if e is None else pytest.approx(e, abs=1e-9))
