"""Exact quantiles of groups of any size by distributed selection.

Spark's ``percentile`` keeps every distinct value of a group in one state. Here a
group of more than ``held`` values is narrowed instead: a histogram over an interval
of values tells which bucket holds the wanted rank, and only that bucket's values
are counted again, until one value is left or so few that they can be sorted. Each
round reads the rows once, for all groups and ranks, and sends one small row per
bucket and task; no task ever holds a group. Buckets are even on the values or on
their logarithm by turns, so that neither outliers nor wide ranges need many rounds.

Quantiles are linear between neighbours: of n sorted values that of p lies at
p * (n - 1). Nulls and NaN are left out; a group without values has null quantiles.
Infinite values count as the largest finite ones. Groups may have null keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.scratch import scratch_path

#: Values of a group that are sorted at once; buckets of a histogram.
HELD, BUCKETS = 10_000, 512
#: Intervals that are broadcast; more are joined by key and salt.
MOST_BROADCAST, SALTS = 50_000, 32
LARGEST = 1.7976931348623157e308


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _share(v: Column, low: Column, high: Column, by_logarithm: bool) -> Column:
    """Where v lies between low (0) and high (1); never falls as v rises."""
    half = F.when(high - low <= LARGEST, (v - low) / (high - low)).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))
    if not by_logarithm:
        return half
    log = lambda x: F.signum(x) * F.log1p(F.abs(x))
    width = log(high) - log(low)
    return F.when(width > 0, (log(v) - log(low)) / width).otherwise(half)


def _counted(rows: DataFrame, intervals: DataFrame, buckets: int, by_logarithm: bool) -> DataFrame:
    """n, least and most of each bucket of each interval (key, low, high)."""
    if intervals.count() <= MOST_BROADCAST:
        met = rows.join(F.broadcast(intervals), "key")
    else:
        salted = intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, ["key", "salt"])
    v, low, high = (F.col(c) for c in ("v", "low", "high"))
    bucket = F.least(F.floor(_share(v, low, high, by_logarithm) * buckets), F.lit(buckets - 1)).cast("int")
    return (
        met.where((v >= low) & (v <= high))
        .groupBy("key", "low", "high", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    )


def select_ranks(rows: DataFrame, wanted: DataFrame, held: int = HELD, buckets: int = BUCKETS) -> DataFrame:
    """``value`` of each wanted (key, rank, low, high): the value that has ``rank``
    smaller ones or equals among the v of its key, which lie within low and high."""
    done = []
    asked = _written(wanted.withColumn("within", F.col("rank")))
    by_logarithm = True
    while True:
        same = asked.where("low = high")
        done.append(same.select("key", "rank", F.col("low").alias("value")))
        asked = asked.where("low < high")
        if asked.isEmpty():
            break
        counts = _counted(rows, asked.select("key", "low", "high").distinct(), buckets, by_logarithm)
        # at most ``buckets`` rows of each interval
        so_far = Window.partitionBy("key", "low", "high").orderBy("bucket")
        placed = counts.withColumn("before", F.sum("n").over(so_far) - F.col("n"))
        hit = (F.col("within") >= F.col("before")) & (F.col("within") < F.col("before") + F.col("n"))
        found = _written(
            asked.join(placed, ["key", "low", "high"]).where(hit)
            .select("key", "rank", (F.col("within") - F.col("before")).alias("within"), F.col("least").alias("low"), F.col("most").alias("high"), "n")
        )
        few = found.where((F.col("n") <= held) & (F.col("low") < F.col("high")))
        if not few.isEmpty():
            done.append(_sorted(rows, few))
        asked = found.where((F.col("n") > held) | (F.col("low") == F.col("high"))).drop("n")
        by_logarithm = not by_logarithm
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _sorted(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Ranks within intervals of few values, by sorting these."""
    own = few.select("key", "low", "high").distinct()
    if own.count() <= MOST_BROADCAST:
        own = F.broadcast(own)
    inside = rows.join(own, "key").where("v >= low AND v <= high").groupBy("key", "low", "high").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return few.join(inside, ["key", "low", "high"]).select("key", "rank", F.get("vs", F.col("within").cast("int")).alias("value"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], held: int = HELD, buckets: int = BUCKETS) -> DataFrame:
    """keys and ``q``, the quantiles of ``value`` in the order of ``probs``."""
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    v = F.col(value).cast("double")
    finite = F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST))
    rows = df.select(key.alias("key"), F.when(v.isNotNull() & ~F.isnan(v), finite).alias("v"))
    sizes = _written(rows.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    rows = rows.where("v is not null")
    spread = sizes.where(F.col("n") > held)
    place = F.array(*(F.lit(float(p)) * (F.col("n") - 1) for p in probs))
    flat = lambda column: column.select("key.*", "q") if keys else column.select("q")
    if spread.isEmpty():
        return flat(rows.groupBy("key").agg(F.percentile("v", F.array(*(F.lit(float(p)) for p in probs))).alias("q")).join(sizes, "key", "right").select("key", "q"))
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda x: F.array(F.floor(x), F.ceil(x)))))
    wanted = spread.select("key", F.explode(ranks).alias("rank"), "low", "high")
    chosen = select_ranks(rows, wanted, held, buckets).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    at = lambda x: F.col("at")[x.cast("long")]
    # as ``percentile`` weighs two neighbours
    between = lambda x: F.when(F.floor(x) == F.ceil(x), at(F.floor(x))).otherwise((F.ceil(x) - x) * at(F.floor(x)) + (x - F.floor(x)) * at(F.ceil(x)))
    large = spread.join(chosen, "key").select("key", F.transform(place, between).alias("q"))
    rest = sizes.where(F.col("n") <= held)
    most = rest.select("key")
    if spread.count() <= MOST_BROADCAST:
        own = rows.join(F.broadcast(spread.select("key")), "key", "left_anti")
    else:
        own = rows.join(most, "key", "left_semi")
    small = own.groupBy("key").agg(F.percentile("v", F.array(*(F.lit(float(p)) for p in probs))).alias("q"))
    return flat(large.unionByName(most.join(small, "key", "left").select("key", "q")))
