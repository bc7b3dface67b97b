"""Windows, gaps and series: worked cases, plain-loop models, edge cases."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import ordered as O
from sparkloom.sources.tables import contiguous_prefix

KS = (1, 2, 3, 4, 5, 6)


def counters(states: str, k: int) -> list[int]:
    out, n = [], 0
    for s in states:
        n = n % k + 1 if s == "W" else 0
        out.append(n)
    return out


def windows(spark, runs: list[str]):
    rows = [(i, j, s) for i, run in enumerate(runs) for j, s in enumerate(run)]
    df = spark.createDataFrame(rows or [(0, 0, "D")], "key int, t int, state string")
    return df if rows else df.limit(0)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="WD", min_size=1, max_size=25), min_size=1, max_size=8))
def test_counters_follow_a_plain_loop(spark, runs):
    df = windows(spark, runs)
    for out in (
        O.weather_windows(df, KS, ["key"], ["t"]),
        O.weather_windows_in_buckets(df, KS, ["key"], ["t"], F.floor(F.col("t") / 4)),
    ):
        got = {(r["key"], r["t"]): [r[f"win{k}"] for k in KS] for r in out.collect()}
        for i, run in enumerate(runs):
            for j, row in enumerate(zip(*(counters(run, k) for k in KS))):
                assert got[i, j] == list(row)


def test_worked_windows(spark):
    rows = O.weather_windows(windows(spark, ["WWWWDWD", "WWWD"]), (2, 3), ["key"], ["t"]).orderBy("key", "t").collect()
    assert [r["win3"] for r in rows[:7]] == [1, 2, 3, 1, 0, 1, 0]
    assert [r["win2"] for r in rows[7:]] == [1, 2, 1, 0]


def test_empty_table(spark):
    assert O.weather_windows(windows(spark, []), (4,), ["key"], ["t"]).count() == 0


def test_state_of_null_is_null(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (None,)], "h double")
    assert [r["state"] for r in O.weather_state(df, "h").collect()] == ["W", "D", None]


def test_prefix_ends_at_first_null(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 6.0), (2, 1, None)], "k int, t int, v double")
    assert [tuple(r) for r in contiguous_prefix(df, ["k"], ["t"], "v").collect()] == [(1, 1, 5.0)]


def test_daily_new(spark):
    df = spark.createDataFrame([("r", i, c) for i, c in enumerate([1, 3, 3, 2, 9])], "region string, day_index int, cases long")
    assert [r["new_cases"] for r in O.daily_new(df).orderBy("day_index").collect()] == [0, 2, 0, 0, 7]


def test_gap_classes_at_the_bounds(spark):
    t0 = dt.datetime(2024, 1, 1)
    steps = [0, 300, 301, 36000, 35999]
    rows, now = [], t0
    for i, s in enumerate(steps):
        now += dt.timedelta(seconds=s)
        rows.append(("d", i, now))
    df = O.classify_gaps(O.time_gaps(spark.createDataFrame(rows, "dir string, path int, ts timestamp"), ["dir"], "ts", "path"))
    out = O.sessions(df, ["dir"], ["ts", "path"]).orderBy("path").collect()
    assert [r["gap_class"] for r in out] == ["normal", "normal", "outlier", "day_break", "outlier"]
    assert [r["session"] for r in out] == [0, 0, 0, 1, 1]


def test_streak_and_mastery(spark):
    rows = [(1, i, c) for i, c in enumerate([True, True, False, True, True, True])]
    out = O.streaks(spark.createDataFrame(rows, "u int, t int, correct boolean"), ["u"], ["t"]).orderBy("t").collect()
    assert [r["streak"] for r in out] == [1, 2, 0, 1, 2, 3]
    assert [r["mastered"] for r in out] == [False] * 5 + [True]


def test_global_numbers(spark):
    df = spark.range(0, 1000, 3, 7)
    rows = O.global_number(df, ["id"], F.floor(F.col("id") / 50)).orderBy("id").collect()
    assert [r["row_no"] for r in rows] == list(range(len(rows)))


def test_series_of_another_length_raises(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "series_id string, o int")
    assert O.index_series(df, ["series_id"], ["o"], 1900, length=2).count() == 2
    with pytest.raises(Exception, match="another length"):
        O.index_series(df, ["series_id"], ["o"], 1900, length=3).collect()


@pytest.mark.parametrize("n, test", [(198, 8), (74, 10), (43, 7)])
def test_hold_out_sizes(spark, n, test):
    train, rest = O.split_at(spark.range(1, n + 1).withColumnRenamed("id", "t"), n - test)
    assert (train.count(), rest.count()) == (n - test, test)
