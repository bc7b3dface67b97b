"""Ordered, keyed rows: weather windows, gaps, sessions, daily changes, streaks.

The windows here are partitioned by a key; many keys spread over many tasks. For
few, very long keys give ``bucket``, a column that rises with the order (or that of
:func:`sparkloom.operators.scans.range_buckets`): the same values are then worked
out bucket by bucket with carries (:mod:`sparkloom.operators.scans`), and no task
holds a key. :func:`global_number` numbers a whole table in that way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sparkloom.operators.quantiles import exact_quantiles
from sparkloom.operators.scans import Previous, RunLength, RunningMax, RunningSum, segmented

Names = Sequence[str]
Bucket = Column | str | None


def _over(key: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def weather_state(df: DataFrame, value: str, limit: float = 1.5) -> DataFrame:
    """``state``: W below the limit, else D; null for a null value."""
    state = F.when(F.col(value) < limit, "W").when(F.col(value) >= limit, "D")
    return df.withColumn("state", state)


def split_timestamp(df: DataFrame, ts: str) -> DataFrame:
    """Display strings ``date_part`` (m/d/yyyy) and ``time_part`` (h:mm:ss AM/PM)."""
    return df.withColumn("date_part", F.date_format(ts, "M/d/yyyy")).withColumn("time_part", F.date_format(ts, "h:mm:ss a"))


def counter(position: Column, k: int) -> Column:
    return F.when(F.col("state") == "W", (position - 1) % k + 1).otherwise(0).cast("int")


def run_positions(df: DataFrame, key: Names, order: Names, bucket: Bucket = None) -> DataFrame:
    """``run_pos``: 1, 2, ... within each run of W rows of a key, else 0."""
    is_w = F.col("state").eqNullSafe("W")
    if bucket is not None:
        out = segmented(df, key, order, bucket, {"run_pos": RunLength(is_w, ~is_w)})
        return out.withColumn("run_pos", F.col("run_pos").cast("int"))
    w = _over(key, order)
    counted = df.withColumn("_w", F.coalesce(F.sum((F.col("state") == "W").cast("int")).over(w), F.lit(0)))
    at_break = F.max(F.when(is_w, F.lit(None)).otherwise(F.col("_w"))).over(w)
    position = F.when(F.col("state") == "W", F.col("_w") - F.coalesce(at_break, F.lit(0))).otherwise(0)
    return counted.withColumn("run_pos", position.cast("int")).drop("_w")


def weather_windows(df: DataFrame, ks: Sequence[int], key: Names, order: Names, bucket: Bucket = None) -> DataFrame:
    """Counters ``win<k>`` that run 1..k over each run of W rows and are 0 on D."""
    out = run_positions(df, key, order, bucket)
    for k in ks:
        out = out.withColumn(f"win{k}", counter(F.col("run_pos"), k))
    return out.drop("run_pos")


def weather_windows_in_buckets(df: DataFrame, ks: Sequence[int], key: Names, order: Names, bucket: Column) -> DataFrame:
    """The same for few, very long keys; ``bucket`` must rise with ``order``."""
    return weather_windows(df, ks, key, order, bucket)


def scale_stops(df: DataFrame, columns: Names) -> DataFrame:
    """Lowest, median and highest value of each of the columns, one row each."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x"))
    q = exact_quantiles(rows.select("x.*"), ["counter"], "v", (0.0, 0.5, 1.0))
    return q.select("counter", *(F.col("q")[i].alias(c) for i, c in enumerate(("lowest", "middle", "highest"))))


def global_number(df: DataFrame, order: Names, bucket: Column) -> DataFrame:
    """``row_no`` from 0 in the order given, without one task seeing all rows:
    rows are numbered inside buckets (``bucket`` must rise with the order), and
    running counts of the buckets are added."""
    local = df.withColumn("_bucket", bucket)
    local = local.withColumn("_local", F.row_number().over(_over(["_bucket"], order)))
    sizes = local.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    out = local.join(starts, "_bucket").withColumn("row_no", F.col("_start") + F.col("_local") - 1)
    return out.drop("_bucket", "_local", "_start")


def index_series(df: DataFrame, key: Names, order: Names, start: int, step: int = 1, length: int | None = None) -> DataFrame:
    """``t`` = start, start + step, ... in order within each key; with ``length``
    a key of another number of rows raises an error when it is read."""
    number = F.row_number().over(_over(key, order))
    out = df.withColumn("t", F.lit(start) + (number - 1) * step)
    if length is not None:
        out = out.withColumn("_rows", F.count("*").over(Window.partitionBy(*key)))
        right = F.assert_true(F.col("_rows") == length, F.lit("series of another length")).isNull()
        out = out.where(right).drop("_rows")
    return out


def split_at(df: DataFrame, cut, t: str = "t") -> tuple[DataFrame, DataFrame]:
    """Rows up to the cut, and rows after it."""
    return df.where(F.col(t) <= cut), df.where(F.col(t) > cut)


def seasonal_lag(df: DataFrame, m: int = 1, key: Names = ("series_id",), order: Names = ("t",), value: str = "y") -> DataFrame:
    """``lagged``: the value m rows earlier, and ``change`` from it."""
    earlier = F.lag(value, m).over(_over(key, order))
    return df.withColumn("lagged", earlier).withColumn("change", F.col(value) - F.col("lagged"))


def _before(df: DataFrame, key: Names, order: Names, value: str, bucket: Bucket) -> DataFrame:
    """``_before``: the value of the row before."""
    if bucket is not None:
        return segmented(df, key, order, bucket, {"_before": Previous(F.col(value))})
    return df.withColumn("_before", F.lag(value).over(_over(key, order)))


def daily_new(
    df: DataFrame, key: Names = ("region",), order: Names = ("day_index",), value: str = "cases", bucket: Bucket = None
) -> DataFrame:
    """``new_cases``: rise since the row before, not below 0; the first is 0."""
    rise = F.greatest(F.col(value) - F.col("_before"), F.lit(0))
    return _before(df, key, order, value, bucket).withColumn("new_cases", F.coalesce(rise, F.lit(0))).drop("_before")


def day_to_date(df: DataFrame, first_day: str, day: str = "day_index") -> DataFrame:
    return df.withColumn("day", F.date_add(F.to_date(F.lit(first_day)), F.col(day).cast("int")))


def time_gaps(df: DataFrame, key: Names, ts: str, tie: str, bucket: Bucket = None) -> DataFrame:
    """``gap_us``: microseconds since the row before of the same key (null for
    the first); rows at the same time are ordered by ``tie``."""
    gap = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col(ts))
    return _before(df, key, [ts, tie], ts, bucket).withColumn("gap_us", gap).drop("_before")


MINUTE_US = 60_000_000


def classify_gaps(df: DataFrame, low_us: int = 5 * MINUTE_US, high_us: int = 600 * MINUTE_US) -> DataFrame:
    """``gap_class``: outlier above the low and below the high bound, day_break
    from the high bound on, else normal (also for a first row)."""
    gap = F.col("gap_us")
    return df.withColumn(
        "gap_class", F.when(gap >= high_us, "day_break").when(gap > low_us, "outlier").otherwise("normal")
    )


def sessions(df: DataFrame, key: Names, order: Names, high_us: int = 600 * MINUTE_US, bucket: Bucket = None) -> DataFrame:
    """``session``: 0, 1, ... rising at each gap of at least the high bound."""
    breaks = F.coalesce((F.col("gap_us") >= high_us).cast("int"), F.lit(0))
    if bucket is not None:
        return segmented(df, key, order, bucket, {"session": RunningSum(breaks)})
    return df.withColumn("session", F.sum(breaks).over(_over(key, order)))


def streaks(log: DataFrame, key: Names, order: Names, n: int = 3, bucket: Bucket = None) -> DataFrame:
    """``streak``: right answers in a row (0 on a miss), and ``mastered`` from
    the row on where a streak first reached n. A null answer is neither."""
    reached = (F.col("streak") >= n).cast("int")
    if bucket is not None:
        run = RunLength(F.col("correct"), ~F.col("correct"))
        out = segmented(log, key, order, bucket, {"streak": run}, {"mastered": RunningMax(reached)})
        return out.withColumn("mastered", F.col("mastered") == 1)
    w = _over(key, order)
    out = log.withColumn("_misses", F.coalesce(F.sum((~F.col("correct")).cast("int")).over(w), F.lit(0)))
    inside = _over([*key, "_misses"], order)
    out = out.withColumn("streak", F.coalesce(F.sum(F.col("correct").cast("int")).over(inside), F.lit(0)))
    return out.withColumn("mastered", F.max(reached).over(w) == 1).drop("_misses")
