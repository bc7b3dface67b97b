"""Quality score by compression against dictionaries of good and bad text.

Two zstandard dictionaries are built from labelled text, one per class. A text
is compressed block by block with each; the block form keeps a long text from
outgrowing the dictionaries. The difference of the two compressed sizes,
normalised by their sum and by the length of the text, goes through a logistic
calibration. That is fitted on every labelled row of the sample, by dictionaries
of the other half of the sample, which have not seen the row.

Defined results: null and empty texts have no blocks and get the calibrated
score of a zero difference; a repeated document counts once in the training
sample per row kept by :func:`clean_labels`; with labels of one class only, the
score is that class's share after smoothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, clean_labels, fold, slices, table

#: Bounds of the labelled sample: rows and bytes of each class, bytes of a text.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 12 << 20
SAMPLE_TEXT = 256 << 10
BLOCK = 1024
LEVEL = 3
DICTIONARY_BYTES = 96 << 10


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the raw text where there is too little to train."""
    blocks = [b for t in texts for b in _blocks(t)]
    if len(blocks) < 16:
        return b"".join(blocks)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


class _Sizes:
    """Compressed sizes of a text with the bad and the good dictionary."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self._packers = [self._packer(d) for d in (bad, good)]

    @staticmethod
    def _packer(content: bytes) -> zstandard.ZstdCompressor:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) < 8:
            return zstandard.ZstdCompressor(level=LEVEL, **plain)
        data = zstandard.ZstdCompressionDict(content)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **plain)

    def features(self, text: bytes) -> tuple[float, ...]:
        blocks = _blocks(text)
        bad, good = (sum(len(p.compress(b)) for b in blocks) for p in self._packers)
        if not blocks:
            return (0.0, 0.0)
        return ((bad - good) / (bad + good), (bad - good) / (len(text) + 64))


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the weights of the calibration (all bounded)."""

    bad: bytes
    good: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def scores(self, texts: list[bytes], sizes: _Sizes | None = None) -> np.ndarray:
        sizes = sizes or _Sizes(self.bad, self.good)
        x = np.array([sizes.features(t) for t in texts], dtype=float).reshape(-1, 2)
        z = (x - self.mean) / self.scale @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> dict[int, list[bytes]]:
    """Texts of a bounded sample per class, in hash order of the ids.

    The ids are drawn from the labels alone (a top-k by hash), so at most
    2 * ``most`` ids are joined to the documents by broadcast. Of each text at
    most SAMPLE_TEXT bytes are taken, in Spark, so the driver gets a bounded
    number of bytes.
    """
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    classes = [labels.where(F.col("label") == c).orderBy(*order).limit(most) for c in (0, 1)]
    ids = classes[0].unionByName(classes[1])
    rows = (
        docs.select("doc_id", F.substring(F.col("text").cast("binary"), 1, SAMPLE_TEXT).alias("text"))
        .where(F.col("text").isNotNull())
        .join(F.broadcast(ids), "doc_id")
    )
    size = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(size, F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    out: dict[int, list[bytes]] = {0: [], 1: []}
    for row in rows.orderBy(*order, "text").select("label", "text").toLocalIterator():
        out[row["label"]].append(bytes(row["text"]))
    return out


def train_quality_model(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on every labelled row given, up to the bounds of the sample.

    Each half of the sample is calibrated by dictionaries of the other half; the
    dictionaries of the model come from the whole sample.
    """
    texts = labelled_sample(docs, labels)
    bad, good = (_dictionary(texts[c]) for c in (0, 1))
    x, y = [], []
    for half in (0, 1):
        sizes = _Sizes(*(_dictionary(texts[c][half::2]) for c in (0, 1)))
        for c in (0, 1):
            x += [sizes.features(t) for t in texts[c][1 - half :: 2]]
            y += [c] * (len(x) - len(y))
    if not x:
        return QualityModel(bad, good, (0.0,) * 2, (1.0,) * 2, (0.0,) * 3)
    x, y = np.array(x, dtype=float), np.array(y, dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    return QualityModel(bad, good, tuple(mean), tuple(scale), tuple(w))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with a ``quality_score`` in 0..1 for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 0.2 MB
    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizes = _Sizes(own.bad, own.good)
        for batch in slices(batches, "text"):
            found = own.scores(as_bytes(batch.column("text")), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(score, schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = clean_labels(table(spark, sf_dir, "labels"), "quality").where(fold(F.col("doc_id")) != 2)
    scored = score_quality(docs, train_quality_model(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
