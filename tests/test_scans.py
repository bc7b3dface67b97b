"""Scans by bucket: the same as windows and as plain loops, whatever the buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import ordered as O
from sparkloom.operators import scans as S
from sparkloom.sources.tables import contiguous_prefix

BUCKETS = {"one": "0", "each": "t", "wide": "t div 7", "skewed": "if(t < 60, 0, t)"}


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(5), []
    for k in (None, "a", "b", "c", "d"):
        for t in rng.sample(range(100), {"d": 1}.get(k, 70)):
            value = None if rng.random() < 0.15 else rng.randrange(-9, 9)
            ok = None if rng.random() < 0.1 else rng.random() < 0.7
            rows.append((k, t, value, ok, "W" if rng.random() < 0.7 else rng.choice(["D", None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=t * t), "x"))
    rng.shuffle(rows)
    schema = "k string, t int, v int, correct boolean, state string, ts timestamp, `_skey` string"
    return spark.createDataFrame(rows, schema).repartition(3)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("name", list(BUCKETS))
def test_as_windows(table, name):
    w = Window.partitionBy("k").orderBy("t")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    got = S.segmented(
        table, ["k"], ["t"], F.expr(BUCKETS[name]),
        {"before": S.Previous(F.col("v")), "total": S.RunningSum(F.col("v")), "most": S.RunningMax(F.col("v"))},
        {"again": S.RunningSum(F.col("total"))},
    )
    want = table.withColumns({"before": F.lag("v").over(w), "total": F.coalesce(F.sum("v").over(rows), F.lit(0)), "most": F.max("v").over(rows)})
    same(got, want.withColumn("again", F.sum("total").over(rows)))


@pytest.mark.parametrize("name", list(BUCKETS))
def test_operators_as_without_buckets(table, name):
    key, order, bucket = ["k"], ["t"], F.expr(BUCKETS[name])
    same(O.weather_windows(table, (1, 3), key, order, bucket), O.weather_windows(table, (1, 3), key, order))
    same(O.streaks(table, key, order, 2, bucket), O.streaks(table, key, order, 2))
    same(contiguous_prefix(table, key, order, "v", bucket), contiguous_prefix(table, key, order, "v"))
    same(O.daily_new(table, key, order, "v", bucket), O.daily_new(table, key, order, "v"))
    gaps = O.time_gaps(table, key, "ts", "t")
    same(O.time_gaps(table, key, "ts", "t", bucket), gaps)
    same(O.sessions(gaps, key, order, 30 * O.MINUTE_US, bucket), O.sessions(gaps, key, order, 30 * O.MINUTE_US))


def test_range_buckets_are_even_and_rise(spark):
    df = spark.range(0, 20_000, 1, 6).selectExpr("if(id % 10 = 0, 'rare', 'long') AS k", "20000 - id AS t")
    rows = S.range_buckets(df, ["k"], ["t"], 1000)
    sizes = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    assert len(sizes) >= 15 and max(sizes.values()) < 2500
    ordered = rows.groupBy("k", "bucket").agg(F.min("t").alias("low"), F.max("t").alias("high")).orderBy("k", "bucket").collect()
    assert all(a["high"] < b["low"] for a, b in zip(ordered, ordered[1:]) if a["k"] == b["k"])
    same(O.daily_new(rows, ["k"], ["t"], "t", "bucket"), O.daily_new(rows, ["k"], ["t"], "t"))


def test_no_task_holds_a_long_key(spark):
    """The window's partitions are buckets: one key's rows spread over the tasks."""
    df = spark.range(0, 40_000, 1, 4).selectExpr("'k' AS k", "id AS t", "id % 5 > 0 AS correct")
    out = O.streaks(df, ["k"], ["t"], 3, F.floor(F.col("t") / 1000)).withColumn("task", F.spark_partition_id())
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, False)  # these few bytes would be put into one task
    try:
        held = out.groupBy("task").count().collect()
    finally:
        spark.conf.unset(small)
    assert len(held) > 1 and max(r["count"] for r in held) < 30_000
    assert out.agg(F.max("streak"), F.sum("streak")).collect()[0] == (4, 80_000)


def test_no_rows(spark, table):
    assert O.streaks(table.limit(0), ["k"], ["t"], 3, F.col("t")).count() == 0
    assert S.range_buckets(table.limit(0), ["k"], ["t"]).count() == 0
