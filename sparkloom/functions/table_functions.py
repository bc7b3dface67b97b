"""Table functions for SQL: a forecaster rolled over series, a function of images.

    register(spark)
    SELECT * FROM rolling_errors(TABLE(series) PARTITION BY (series_id) ORDER BY (t), 'mean')
    SELECT * FROM image_stats(TABLE(images), 0.0, 0.5)

Spark gathers and orders the rows of a partition; a function keeps a state of fixed
size and hands out rows as they come. ``FORECASTERS`` is the registry of the first: a
class that is told each value (``add``) and says what it expects next (``forecast``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Naive:
    last: float | None = None

    def add(self, y: float) -> None:
        self.last = y

    def forecast(self) -> float | None:
        return self.last


class Mean:
    total, n = 0.0, 0

    def add(self, y: float) -> None:
        self.total, self.n = self.total + y, self.n + 1

    def forecast(self) -> float | None:
        return self.total / self.n if self.n else None


class Level:
    """Level smoothing; the share of the newest value follows the name."""

    def __init__(self, alpha: float = 0.3) -> None:
        self.alpha, self.level = alpha, None

    def add(self, y: float) -> None:
        self.level = y if self.level is None else self.level + self.alpha * (y - self.level)

    def forecast(self) -> float | None:
        return self.level


FORECASTERS = {"naive": Naive, "mean": Mean, "level": Level}


def forecaster(name: str):
    """By name; ``level_0.2`` gives the share."""
    kind, _, alpha = name.partition("_")
    if kind not in FORECASTERS or (alpha and kind != "level"):
        raise ValueError(f"unknown forecaster {name!r}")
    return FORECASTERS[kind](float(alpha)) if alpha else FORECASTERS[kind]()


def _need(table: AnalyzeArgument, columns: tuple[str, ...]) -> dict[str, T.DataType]:
    if not table.isTable:
        raise ValueError("the first argument is TABLE(...)")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [c for c in columns if c not in kinds]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return kinds


class RollingErrors:
    """One-step errors of a forecaster over each partition of (series_id, t, y), in
    order: (series_id, model, origin, error). A null y is no value and has no error."""

    @staticmethod
    def analyze(table: AnalyzeArgument, model: AnalyzeArgument) -> AnalyzeResult:
        kinds = _need(table, ("series_id", "t", "y"))
        if not model.isConstantExpression or not isinstance(model.value, str):
            raise ValueError("the forecaster is a constant name")
        forecaster(model.value)
        return AnalyzeResult(
            T.StructType().add("series_id", kinds["series_id"]).add("model", T.StringType()).add("origin", kinds["t"]).add("error", T.DoubleType())
        )

    def __init__(self) -> None:
        self.own, self.origin = None, None

    def eval(self, row: Row, model: str) -> Iterator[tuple]:
        if self.own is None:
            self.own = forecaster(model)
        else:
            expected = self.own.forecast()
            yield row["series_id"], model, self.origin, None if row["y"] is None or expected is None else float(row["y"]) - expected
        if row["y"] is not None:
            self.own.add(float(row["y"]))
        self.origin = row["t"]


class ImageStats:
    """Least and greatest value of each image (image_id, pixels) and how many lie
    between the bounds, both included; nulls are no values."""

    @staticmethod
    def analyze(table: AnalyzeArgument, low: AnalyzeArgument, high: AnalyzeArgument) -> AnalyzeResult:
        kinds = _need(table, ("image_id", "pixels"))
        schema = T.StructType().add("image_id", kinds["image_id"])
        return AnalyzeResult(schema.add("least", T.DoubleType()).add("greatest", T.DoubleType()).add("within", T.LongType()))

    def eval(self, row: Row, low: float, high: float) -> Iterator[tuple]:
        values = [float(v) for v in row["pixels"] or () if v is not None]
        yield row["image_id"], min(values, default=None), max(values, default=None), sum(float(low) <= v <= float(high) for v in values)


def register(spark: SparkSession) -> None:
    """Makes ``rolling_errors`` and ``image_stats`` known to SQL."""
    for name, function in (("rolling_errors", RollingErrors), ("image_stats", ImageStats)):
        spark.udtf.register(name, udtf(function))
