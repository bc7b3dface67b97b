"""Running values over few, very long keys: scans by bucket with carries.

A window over a key puts all rows of that key into one task. Here the rows of a key
are cut into buckets that rise with their order. Each bucket is scanned on its own,
one summary row per bucket is scanned per key, and what earlier buckets hand on
(the carry) is joined to the rows of a bucket and combined with their local values.
Rows are shuffled once, by (key, bucket); a task holds the largest bucket at most.

Any running value of an associative kind fits. Given here: the value of the row
before (:class:`Previous`), running sums and maxima (:class:`RunningSum`,
:class:`RunningMax`), and the length of the run of rows for which a condition holds
(:class:`RunLength`).

Buckets come from the caller (a column that never falls as the order rises), or
from :func:`range_buckets`, which cuts the whole table into ranges of about equal
numbers of rows, so that neither a long key nor a full day makes a large bucket.

Keys may be null (a key of their own). Rows of equal order within a key are taken in
any order, as by a window; name a tie-breaker in ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sparkloom.plans.scratch import scratch_path

#: Rows of a range bucket.
ROWS = 1_000_000


@dataclass(frozen=True)
class Previous:
    """The value of the row before; null for the first row of a key."""

    value: Column

    def local(self, df: DataFrame, w: WindowSpec, n: list[str]) -> DataFrame:
        own = F.struct(self.value.alias("v"))
        return df.withColumn(n[0], F.lag(own).over(w)).withColumn(n[1], F.row_number().over(w))

    def summary(self, n: list[str]) -> list[Column]:
        return [F.max_by(F.struct(self.value.alias("v")), n[1]), F.max(n[1])]

    def carry(self, sums: DataFrame, w: WindowSpec, n: list[str]) -> DataFrame:
        return sums.withColumn(n[0], F.lag(n[0]).over(w))

    def result(self, n: list[str], c: list[str]) -> Column:
        return F.coalesce(n[0], c[0])["v"]


@dataclass(frozen=True)
class RunningSum:
    """Sum of a value up to and with the row; nulls add nothing."""

    value: Column

    def local(self, df: DataFrame, w: WindowSpec, n: list[str]) -> DataFrame:
        return df.withColumn(n[0], F.coalesce(F.sum(self.value).over(_rows(w)), F.lit(0)))

    def summary(self, n: list[str]) -> list[Column]:
        return [F.coalesce(F.sum(self.value), F.lit(0)), F.lit(None)]

    def carry(self, sums: DataFrame, w: WindowSpec, n: list[str]) -> DataFrame:
        return sums.withColumn(n[0], F.coalesce(F.sum(n[0]).over(_earlier(w)), F.lit(0)))

    def result(self, n: list[str], c: list[str]) -> Column:
        return F.col(n[0]) + F.col(c[0])


@dataclass(frozen=True)
class RunningMax:
    """Greatest value up to and with the row; null before the first value."""

    value: Column

    def local(self, df: DataFrame, w: WindowSpec, n: list[str]) -> DataFrame:
        return df.withColumn(n[0], F.max(self.value).over(_rows(w)))

    def summary(self, n: list[str]) -> list[Column]:
        return [F.max(self.value), F.lit(None)]

    def carry(self, sums: DataFrame, w: WindowSpec, n: list[str]) -> DataFrame:
        return sums.withColumn(n[0], F.max(n[0]).over(_earlier(w)))

    def result(self, n: list[str], c: list[str]) -> Column:
        return F.greatest(n[0], c[0])


@dataclass(frozen=True)
class RunLength:
    """Rows that ``counts`` holds for since the last row that ``breaks`` holds for,
    which is 0 where one breaks. Null counts nothing and breaks nothing."""

    counts: Column
    breaks: Column

    def local(self, df: DataFrame, w: WindowSpec, n: list[str]) -> DataFrame:
        so_far = F.coalesce(F.sum(self.counts.cast("long")).over(_rows(w)), F.lit(0))
        at_break = F.max(F.when(self.breaks, F.col(n[0]))).over(_rows(w))  # counts never fall: the greatest is the last
        return df.withColumn(n[0], so_far).withColumn(n[1], at_break)

    def summary(self, n: list[str]) -> list[Column]:
        return [F.max(n[0]), F.max(n[1])]

    def carry(self, sums: DataFrame, w: WindowSpec, n: list[str]) -> DataFrame:
        sums = sums.withColumns({n[0]: F.coalesce(F.sum(n[0]).over(_earlier(w)), F.lit(0)), n[1]: F.col(n[1])})
        return sums.withColumn(n[1], F.max(F.col(n[0]) + F.col(n[1])).over(_earlier(w)))

    def result(self, n: list[str], c: list[str]) -> Column:
        last = F.greatest(F.col(n[1]) + F.col(c[0]), F.col(c[1]))
        return F.col(n[0]) + F.col(c[0]) - F.coalesce(last, F.lit(0))


def _rows(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


Scan = Previous | RunningSum | RunningMax | RunLength


def segmented(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column | str, *stages: dict[str, Scan]) -> DataFrame:
    """``df`` with a column for each scan. Scans of a later stage may use columns of
    an earlier one; all stages share one shuffle."""
    columns, mark = list(df.columns), "_s"
    while any(c.lower().startswith(mark) for c in columns):
        mark = "_" + mark
    # a struct is not null where a key column is: such rows are a key of their own
    whole = F.struct(*(F.col(k) for k in key)) if key else F.struct(F.lit(0).alias("all"))
    at, part = mark + "key", mark + "bucket"
    out = df.withColumns({at: whole, part: F.col(bucket) if isinstance(bucket, str) else bucket})
    within, over = Window.partitionBy(at, part).orderBy(*order), Window.partitionBy(at).orderBy(part)
    for number, stage in enumerate(stages):
        scans = {name: (scan, [f"{mark}{number}_{i}_{j}" for j in (0, 1)]) for i, (name, scan) in enumerate(stage.items())}
        for scan, n in scans.values():
            out = scan.local(out, within, n)
        parts = [c.alias(n[j]) for scan, n in scans.values() for j, c in enumerate(scan.summary(n))]
        sums = out.groupBy(at, part).agg(*parts)
        for scan, n in scans.values():
            sums = scan.carry(sums, over, n)
        carries = sums.select(at, part, *(F.col(x).alias(x + "c") for _, n in scans.values() for x in n))
        out = out.join(carries, [at, part])
        out = out.withColumns({name: scan.result(n, [x + "c" for x in n]) for name, (scan, n) in scans.items()})
    return out.select(*columns, *dict.fromkeys(name for stage in stages for name in stage))


def range_buckets(df: DataFrame, key: Sequence[str], order: Sequence[str], rows: int = ROWS, name: str = "bucket") -> DataFrame:
    """``df``, written once, with a ``bucket`` that rises with (key, order) and has
    about ``rows`` rows, whatever the keys are."""
    parts = max(1, -(-df.count() // rows))
    path = scratch_path(df.sparkSession)
    # the number of a partition is fixed by writing it; equal order values stay together
    df.repartitionByRange(parts, *key, *order).withColumn(name, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a key that are composed one by one; more are composed level by level.
WIDTH = 32


def _composed(maps: Column) -> Column:
    """x -> m x + c for maps applied one after the other."""
    none = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("c"))
    return F.aggregate(maps, none, lambda f, g: F.struct((g["m"] * f["m"]).alias("m"), (g["m"] * f["c"] + g["c"]).alias("c")))


def _before(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(at, i, step, before): ``before`` is the composition of the steps of smaller i."""
    own = Window.partitionBy("at", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("part", F.expr(f"i div {width}")).withColumn("before", _composed(F.collect_list("step").over(own)))
    if most < width:
        return local.drop("part")
    whole = _composed(F.array("before", "step"))
    sums = local.groupBy("at", F.col("part").alias("i")).agg(F.max_by(whole, "i").alias("step"))
    path = scratch_path(rows.sparkSession)
    sums.write.parquet(path)  # a row for each ``width`` rows: read again for every level above
    upper = _before(rows.sparkSession.read.parquet(path), width, most // width)
    carry = upper.select("at", F.col("i").alias("part"), F.col("before").alias("carry"))
    return local.join(carry, ["at", "part"]).withColumn("before", _composed(F.array("carry", "before"))).drop("part", "carry")


def affine_scan(df: DataFrame, key: Sequence[str], t: str, m: Column, c: Column, name: str = "value", width: int = WIDTH) -> DataFrame:
    """``name`` of each row is m * (``name`` of the row before) + c, from 0 on.

    Affine maps compose to affine maps, so stretches of ``width`` numbers of ``t`` are
    composed in parallel, then stretches of stretches, as often as the range of t
    needs: a series of 10**7 rows takes five levels of ever fewer rows. ``t`` is an
    integer, once for each row of a key; it need not be without gaps.
    """
    low, high = df.agg(F.min(t), F.max(t)).first()
    low, high = low or 0, high or 0
    columns = list(df.columns)
    whole = F.struct(*(F.col(k) for k in key)) if key else F.struct(F.lit(0).alias("all"))
    step = F.struct(m.cast("double").alias("m"), c.cast("double").alias("c"))
    held = F.struct(*(F.col(x) for x in columns)).alias("held")
    rows = df.select(whole.alias("at"), (F.col(t).cast("long") - low).alias("i"), step.alias("step"), held)
    out = _before(rows, width, high - low)
    return out.select("held.*", (F.col("step.m") * F.col("before.c") + F.col("step.c")).alias(name))
