"""What the corpus operators share: table access, shared scratch, batch slicing."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and Python. Texts are long, and each
#: task holds a batch on both sides.
ARROW_BYTES = "2m"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for this session, unless the cluster sets a bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> tempfile.TemporaryDirectory:
    """A folder of this process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="spark-", ignore_cleanup_errors=True)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). It may
    be unset only where both are one process; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file://{_own_folder().name}"
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Scratch tables hold rows of up to a megabyte. Parquet would look at the sizes of
#: pages and row groups after 100 rows only, and its codecs and readers keep buffers
#: of that many; so sizes are looked at from the first row, and row groups are small.
PARQUET_BOUNDS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**PARQUET_BOUNDS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a hash filter for each hash, and the fewest and most of all (128 MB).
FILTER_BITS, FEWEST_BITS, MOST_BITS = 16, 1 << 23, 1 << 30


def hash_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of bounded size of a column of 64-bit hashes, summed up in
    Spark. It never misses a hash; with more of them than it is good for, it lets
    more others through."""
    wanted = min(MOST_BITS, max(FEWEST_BITS, FILTER_BITS * hashes.count()))
    size = 1 << (wanted - 1).bit_length()
    h, most = F.col(column), F.lit(size - 1)
    places = F.array(h.bitwiseAND(most), F.shiftrightunsigned(h, 32).bitwiseAND(most))
    words = hashes.select(F.explode(places).alias("bit")).select(
        F.expr("bit div 64").cast("int").alias("word"), F.expr("shiftleft(1L, int(bit % 64))").alias("mask")
    )
    summed = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[summed.column("word").to_numpy()] = summed.column("mask").to_numpy()
    return bits


def may_be_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    found, most = np.full(len(hashes), True), len(bits) * 64 - 1
    for place in (hashes & most, (hashes >> 32) & most):
        found &= (bits[place >> 6] >> (place & 63)) & 1 == 1
    return found


def split_by_ids(rows: DataFrame, ids: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(may be among the ids, surely not): both parts of ``rows``, unshuffled.

    The filter is broadcast, so long texts need not be shuffled to be told apart
    by their ids (``doc_id``, or other columns). The first part still has to be
    joined to the ids.
    """
    columns = columns or ("doc_id",)
    bits = hash_filter(ids.select(F.xxhash64(*columns).alias("hash")), "hash")
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    names, mark = rows.columns, fresh(rows, "hash")
    hashed = rows.withColumn(mark, F.xxhash64(*columns))

    def part(inside: bool) -> DataFrame:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = may_be_in(shared.value, batch.column(mark).to_numpy())
                yield batch.select(names).filter(pa.array(found == inside))

        return hashed.mapInArrow(pick, rows.schema)

    return part(True), part(False)


def text_key() -> Column:
    """A 64-bit hash of ``text``, to tell rows of one doc_id apart."""
    return F.xxhash64("text")


def without_rows(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those that ``listed`` names by (doc_id, text_key,
    stays): all rows of that id and text go, or all but one where ``stays``. A
    null id is compared like any other; only rows in doubt are shuffled."""
    key = fresh(docs, "text_key")
    listed = stored(listed.select("doc_id", F.col("text_key").alias(key), "stays"))
    doubt, clear = split_by_ids(docs.withColumn(key, text_key()), listed, "doc_id", key)
    own = listed.toDF("own_id", "own_key", "own_stays")
    same = doubt["doc_id"].eqNullSafe(own["own_id"]) & doubt[key].eqNullSafe(own["own_key"])
    out = clear.unionByName(doubt.join(own, same, "left_anti"))
    one = own.where("own_stays")
    if not one.isEmpty():
        out = out.unionByName(doubt.join(one, same, "left_semi").dropDuplicates(["doc_id", key]))
    return out.drop(key)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out (a null id
    counts as remainder 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """One (doc_id, label 0/1) row per document; null or contradictory labels
    are left out, repeated rows count once."""
    return (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("_other"))
        .where("label = _other")
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )


@functools.cache
def _trim():
    """The C library's call that gives freed memory back, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


#: Called before memory is given back, to free what this worker keeps for one stage.
_forgetters: list[Callable[[], None]] = []


def forget_with(forget: Callable[[], None]) -> None:
    _forgetters.append(forget)


def release_memory() -> None:
    """Give freed memory back: workers of a finished stage live on."""
    for forget in _forgetters:
        forget()
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes in each
    (a single longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
        release_memory()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(pc.cast(column, pa.binary()), b"").to_pylist()
