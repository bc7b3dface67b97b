"""Exact quantiles against sorted lists, on the path for groups of any size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import quantiles as Q

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def plain(values, probs=PROBS):
    values = sorted(min(max(v, -Q.LARGEST), Q.LARGEST) for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    out = []
    for p in probs:
        at = p * (len(values) - 1)
        low, high = math.floor(at), math.ceil(at)
        out.append(values[low] if low == high else (high - at) * values[low] + (at - low) * values[high])
    return out


def made():
    rng = random.Random(2)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(900)],
        "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-30, 30) for _ in range(400)],
        "outliers": [float(rng.randrange(5)) for _ in range(600)] + [1e300, -1e300, math.inf, -math.inf],
        "ties": [1.5] * 700 + [2.5],
        "close": [1.0 + k * 2.0**-52 for k in range(300)],
        "small": [3.0, 1.0, 2.0],
        "tiny": [k * 5e-324 for k in range(100)],
        "nan": [math.nan, 1.0, None, 2.0] * 100,
        "none": [None, math.nan],
        None: [float(k) for k in range(500)],
    }
    return {k: v for k, v in groups.items()}


@pytest.mark.parametrize("held, buckets", [(60, 64), (10_000, 512)])
def test_against_sorted_lists(spark, held, buckets):
    groups = made()
    rows = [(k, v, "x", 1) for k, vs in groups.items() for v in vs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value double, key string, rank int").repartition(5)
    got = {r["g"]: r["q"] for r in Q.exact_quantiles(df, ["g"], "value", PROBS, held, buckets).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        want = plain(vs)
        assert got[k] == want or got[k] == pytest.approx(want, rel=1e-15), k


def test_many_intervals_go_by_salt(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_BROADCAST", 3)
    df = spark.range(2000).selectExpr("id % 8 AS g", "CAST(id * 7919 % 4001 AS DOUBLE) AS v")
    got = {r["g"]: r["q"] for r in Q.exact_quantiles(df, ["g"], "v", (0.5,), held=100, buckets=32).collect()}
    values = {g: [float(i * 7919 % 4001) for i in range(2000) if i % 8 == g] for g in range(8)}
    assert got == {g: plain(v, (0.5,)) for g, v in values.items()}


def test_one_group_of_all_rows_stays_spread(spark):
    """No task of the selection gets more than a histogram or few values."""
    df = spark.range(0, 200_000, 1, 8).selectExpr("CAST(id * 104729 % 200003 AS DOUBLE) AS v")
    got = Q.exact_quantiles(df, [], "v", (0.25, 0.5), held=5000, buckets=64)
    assert got.collect()[0]["q"] == plain([float(i * 104729 % 200003) for i in range(200_000)], (0.25, 0.5))


def test_no_rows_and_integers(spark):
    empty = spark.createDataFrame([], "g int, v int")
    assert Q.exact_quantiles(empty, ["g"], "v", (0.5,)).count() == 0
    rows = spark.createDataFrame([(1, 5), (1, 8)], "g int, v int")
    assert Q.exact_quantiles(rows, ["g"], "v", (0.5,)).select(F.col("q")[0]).collect()[0][0] == 6.5
