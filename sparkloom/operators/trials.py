"""Quiz logs: answer keys, scoring and totals per phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stimulus, answer in phase 1, answer in phase 2.
KEY_ROWS = (
    ("puppy", "cute", "scary"),
    ("panda", "cute", "scary"),
    ("spider", "scary", "cute"),
    ("bat", "scary", "cute"),
)


def answer_key(spark: SparkSession) -> DataFrame:
    """(phase, stimulus, expected): eight rows, flipped in phase 2."""
    rows = [F.struct(F.lit(p).alias("phase"), F.lit(r[0]).alias("stimulus"), F.lit(r[p]).alias("expected")) for p in (1, 2) for r in KEY_ROWS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def score_trials(log: DataFrame, key: DataFrame) -> DataFrame:
    """The log with ``expected`` and ``correct``; case matters. The key is one
    row per phase and stimulus (eight here), hence broadcast."""
    scored = log.join(F.broadcast(key), ["phase", "stimulus"])
    return scored.withColumn("correct", F.col("answer").eqNullSafe(F.col("expected")))


def phase_score(trials: DataFrame, key: tuple[str, ...] = ("user_id", "phase")) -> DataFrame:
    """Right answers and tries of each user in each phase."""
    return trials.groupBy(*key).agg(
        F.sum(F.col("correct").cast("int")).alias("n_correct"), F.count("*").alias("n_tries")
    )


def chosen(number: Column, values: tuple[str, ...]) -> Column:
    """The value at ``number`` modulo the number of values."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))
