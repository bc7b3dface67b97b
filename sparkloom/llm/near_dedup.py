"""Near-duplicate groups by HyperMinHash sketches, confirmed on full sets.

A document's set holds the hashes of its distinct 5-word shingles (64 bits; the
words lower-cased in A-Z only). Documents with equal sets form a class, and one
row per class goes on. For each of 252 buckets a sketch keeps the minimum of a
keyed hash, compressed to the count of its leading zeros (6 bits) and 10
mantissa bits. Bands of registers make candidates, and the threshold sets them: at
85 % 36 bands of 7, at 80 % 42 bands of 6. A pair at the threshold misses all bands
with a chance of 0.9 (85 %) or 2.9 (80 %) in a million.

* A band bucket of up to SMALL classes gives all its pairs.
* A larger one gives a star around its most typical class; then what is still
  in different components there is compared in full, in groups of bounded size
  whose pairs never leave their task.
* Among the members of large buckets, the shingles that no other of them has
  are counted first. Two such classes share at most the lesser number of their
  other shingles, and what this rules out is not compared: in a large group of
  near copies each copy's own edits set most of them apart.
* Pairs whose sizes rule the threshold out go; then those whose
  collision-corrected estimate is more than six standard errors too low; all
  others are confirmed on the full sets. Nothing is capped.

Groups are connected components of confirmed links, found by label propagation
with pointer jumping; each round is written to the shared folder.

Defined results: a document without words has an empty set and is alone; one of
fewer than five words has its whole word sequence as single shingle; repeated
rows count as copies and keep their rows; the smallest doc_id of a group names
it; different texts under one doc_id are grouped each on its own; rows without
doc_id are alone under a null id. Extra columns are ignored.

The pipeline stage removes single rows, told apart by doc_id and text: of each
group one row of the smallest doc_id stays, and of repeated rows one. All rows
without doc_id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, hash_filter, may_be_in, slices, stored, table, text_key, without_rows
from .kernels import LOWER, mix64, shingle_sets

SHINGLE = 5
#: Links need 100 * intersection >= percent * union; this is the default.
PERCENT = 85
REGISTERS = 252
#: Chance that a pair at the threshold may miss all bands.
MISSED = 5e-6
MANTISSA_BITS = 10
SMALL = 16
#: Members of a large bucket that one task compares with each other.
GROUP = 500
#: Chance that registers of different minima agree, for the mantissa in use.
COLLISION = 0.17 / (1 << MANTISSA_BITS)
#: Sets below this size skip the estimate; comparing them in full is cheap.
ESTIMATED = 64

_STREAM = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP, _FACTOR = _STREAM[:REGISTERS], _STREAM[REGISTERS:] | np.uint64(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers (uint16) of a non-empty set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        keyed = (shingles[i : i + 1024, None] ^ _FLIP) * _FACTOR
        np.minimum(least, keyed.min(axis=0), out=least)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = (64 - exponent).astype(np.uint16) & np.uint16(63)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA_BITS)) | (mantissa & np.uint16((1 << MANTISSA_BITS) - 1))


def estimate(agreeing: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers."""
    return (agreeing / REGISTERS - COLLISION) / (1 - COLLISION)


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    a = mix64(shingles).sum(dtype=np.uint64)
    b = mix64(shingles * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return tuple(np.array([a, b], dtype=np.uint64).view(np.int64).tolist())


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets([t.translate(LOWER) for t in as_bytes(batch.column("text"))], SHINGLE)


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, the set's key and its registers (null when
    empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = _sets(batch)
            keys = [_set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in keys], pa.int64()),
                    pa.array([b for _, b in keys], pa.int64()),
                    pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "key_a", "key_b", "registers"],
            )

    schema = f"doc_id {_kind(docs)}, text_key long, n_shingles long, key_a long, key_b long, registers binary"
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, schema)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands of all registers that miss a pair at the
    threshold with a chance of at most MISSED; single registers miss the least."""
    for rows in range(REGISTERS, 1, -1):
        if REGISTERS % rows == 0 and (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISSED:
            return REGISTERS // rows, rows
    return REGISTERS, 1


def bands(classes: DataFrame, percent: int) -> DataFrame:
    """(bucket, rep, n): one row for each band of each class."""
    n_bands, n_rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = mix64(np.arange(3, 3 + n_rows, dtype=np.uint64)) | np.uint64(1)
        number = mix64(np.arange(101, 101 + n_bands, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.uint16)
            parts = found.reshape(-1, n_bands, n_rows).astype(np.uint64)
            keys = mix64((parts * weight).sum(axis=2, dtype=np.uint64) ^ number).view(np.int64)
            ends = pa.array(np.arange(0, keys.size + 1, n_bands), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), lists], ["rep", "n", "keys"])

    rows = classes.select("rep", "n", "registers").mapInArrow(run, "rep long, n long, keys array<long>")
    return rows.select(F.explode("keys").alias("bucket"), "rep", "n")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, n, registers, shingles) of the wanted classes (rep, doc_id, key_a,
    key_b), each from its document; the shingles are sorted uint64 as bytes."""

    bits = hash_filter(wanted.select(F.xxhash64("doc_id").alias("hash")), "hash")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, "text"):
            batch = whole.filter(pa.array(may_be_in(shared.value, whole.column("__hash").to_numpy())))
            if not batch.num_rows:
                continue
            sets = _sets(batch)
            keys = [_set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([a for a, _ in keys], pa.int64()),
                    pa.array([b for _, b in keys], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "key_a", "key_b", "n", "registers", "shingles"],
            )

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("__hash"))
    schema = f"doc_id {_kind(docs)}, key_a long, key_b long, n long, registers binary, shingles binary"
    sets = hashed.mapInArrow(run, schema).join(wanted, ["doc_id", "key_a", "key_b"])
    return sets.select("rep", "n", "registers", "shingles")


def _possible(na: F.Column, nb: F.Column, percent: int) -> F.Column:
    """Sizes that allow the threshold."""
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose estimated similarity may reach the threshold."""
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                for c in ("ra", "rb")
            )
            small = np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()) < ESTIMATED
            ok = small | (estimate((a == b).sum(axis=1)) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    own = sets.select("rep", "n", "registers").where("registers is not null")
    rows = (
        pairs.select("a", "b")
        .distinct()
        .join(own.toDF("a", "na", "ra"), "a")
        .join(own.toDF("b", "nb", "rb"), "b")
        .where(_possible(F.col("na"), F.col("nb"), percent))
    )
    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are links on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sa"):
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = sets.select("rep", "shingles")
    rows = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def components(edges: DataFrame) -> DataFrame:
    """(rep, label) for every end of an edge; the label is the smallest id that
    can be reached. Labels pass to neighbours and then jump to their own label,
    so that the number of rounds grows with the logarithm of the longest path."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("rep"), F.least("a", "least").alias("label")
    ))
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), "label"), "b")
        near = near.groupBy(F.col("a").alias("rep")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "rep").select(
            "rep", F.col("label").alias("old"), F.least("label", "near").alias("mid")
        )
        jump = labels.select(F.col("rep").alias("mid"), F.col("label").alias("next"))
        after = stored(
            closer.join(jump, "mid", "left").select("rep", "old", F.least("mid", "next").alias("label"))
        )
        labels = after.select("rep", "label")
        if after.where("label != old").isEmpty():
            return labels


def _unique_counts(sets: DataFrame) -> DataFrame:
    """(rep, alone): shingles of each set that no other of the sets has."""
    kind = sets.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, one in enumerate(batch.column("shingles").to_pylist()):
                found = pa.array(np.frombuffer(one, dtype=np.int64))
                rep = batch.column("rep").take(pa.array(np.full(len(found), k)))
                yield pa.RecordBatch.from_arrays([rep, found], ["rep", "shingle"])

    rows = sets.select("rep", "shingles").mapInArrow(run, f"rep {kind}, shingle long")
    lone = rows.groupBy("shingle").agg(F.count("*").alias("times"), F.min("rep").alias("rep")).where("times = 1")
    return lone.groupBy("rep").agg(F.count("*").alias("alone"))


def _shared_counts(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, shared): for the members of large buckets, how many shingles of
    each occur in some other member of a large bucket."""
    reps = large.select("rep", "n").distinct()
    alone = _unique_counts(sets.join(reps, "rep", "left_semi"))
    return reps.join(alone, "rep", "left").select("rep", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _within_reach(percent: int) -> F.Column:
    """What two members of large buckets share is at most the lesser ``shared``
    count; true unless that rules the threshold out."""
    most = F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), F.least("ca", "cb"))
    return F.coalesce((100 + percent) * most >= percent * (F.col("na") + F.col("nb")), F.lit(True))


def _bucket_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of (bucket, rep, n, shared) rows that meet in a bucket and are
    not ruled out."""
    x = members.select("bucket", "rep", "n", "shared").toDF("bucket", "a", "na", "ca")
    y = members.select("bucket", "rep", "n", "shared").toDF("bucket", "b", "nb", "cb")
    ordered = (F.col("a") < F.col("b")) & _possible(F.col("na"), F.col("nb"), percent)
    return x.join(y, "bucket").where(ordered & _within_reach(percent)).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect all near-duplicate classes."""
    own = bands(classes, percent)
    shared = own.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(own.join(shared, "bucket"))
    wanted = classes.select("rep", "doc_id", "key_a", "key_b").join(members.select("rep"), "rep", "left_semi")
    sets = stored(full_sets(docs, wanted))
    large = members.where(F.col("size") > SMALL)
    few = members.where(F.col("size") <= SMALL)
    if large.isEmpty():
        pairs = _bucket_pairs(few.withColumn("shared", F.lit(None).cast("long")), percent)
        return stored(confirmed(likely(pairs, sets, percent), sets, percent))

    counts = stored(_shared_counts(large, sets))
    pairs = _bucket_pairs(few.join(counts, "rep", "left"), percent)
    large = stored(large.join(counts, "rep").where(100 * F.col("shared") >= percent * F.col("n")))
    order = F.struct(F.col("n") - F.col("shared"), "rep")
    centre = large.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "shared"), order).alias("c"))
    star = large.join(centre, "bucket").select(
        F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b"),
        F.col("n").alias("na"), F.col("c.n").alias("nb"), F.col("shared").alias("ca"), F.col("c.shared").alias("cb"),
    )
    possible = _possible(F.col("na"), F.col("nb"), percent) & _within_reach(percent)
    star = star.where((F.col("a") != F.col("b")) & possible).select("a", "b")
    first = stored(confirmed(likely(pairs.unionByName(star), sets, percent), sets, percent))

    labels = components(first)
    named = large.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    split = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows"))
    rest = named.select("bucket", "rep", "label").join(split.where("lo != hi").select("bucket", "rows"), "bucket")
    return first.unionByName(stored(links_in_groups(rest, sets, percent)))


def links_in_groups(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different labels among the members of each bucket.

    A group is a bucket, or a pair of parts of a bucket of more than GROUP rows.
    All its intersections are counted in one task by matrix products over the
    shingles that occur twice; what leaves the task is a spanning forest, so its
    size is that of the group and not of its square.
    """
    parts = F.ceil(F.col("rows") / GROUP)
    rows = rest.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select(
        "rep", "label", F.concat_ws("/", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("group_no")
    )
    kind = sets.schema["rep"].dataType.simpleString()

    def spanning(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found = [np.frombuffer(x, dtype=np.uint64) for x in group.column("shingles").to_pylist()]
        labels = np.unique(group.column("label").to_numpy(), return_inverse=True)[1]
        both = _intersections(found)
        size = np.array([len(x) for x in found])
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        linked &= labels[:, None] < labels[None, :]
        root = np.arange(labels.max() + 1)
        kept: tuple[list[int], list[int]] = ([], [])
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
            a, b = root[labels[i]], root[labels[j]]
            if a != b:
                root[root == max(a, b)] = min(a, b)
                kept[0].append(i)
                kept[1].append(j)
        ids = group.column("rep")
        return pa.table({"a": ids.take(pa.array(kept[0], pa.int64())), "b": ids.take(pa.array(kept[1], pa.int64()))})

    joined = rows.join(sets.select("rep", "shingles"), "rep")
    return joined.groupBy("group_no").applyInArrow(spanning, f"a {kind}, b {kind}")


def _intersections(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections; memory is a few matrices of one row
    per set and ``width`` columns."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = count > 1
    column = np.cumsum(twice) - 1
    keep = twice[at]
    owner, at = owner[keep], column[at[keep]]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, (low, low + width))
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[a:b], at[a:b] - low] = 1
        total += block @ block.T
    return total.astype(np.int64)


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, label and component_id of every document
    row; the label tells groups apart and is null where a row is alone by rule."""
    found = stored(sketches(docs))
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    keyed = found.where(own)
    classes = keyed.groupBy("key_a", "key_b").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n"),
        F.first("registers").alias("registers"),
    )
    # An id can name several classes; their numbers are fixed once written.
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    labels = components(links(docs, classes, percent))
    named = classes.join(labels, "rep", "left").select("key_a", "key_b", "doc_id", F.coalesce("label", "rep").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.drop("doc_id").join(least, "label")
    columns = ["doc_id", "text_key", "n_shingles", "label", "component_id"]
    alone = found.where(~own).withColumns({"label": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return keyed.join(named, ["key_a", "key_b"]).select(columns).unionByName(alone.select(columns))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document row."""
    rows = grouped(docs, percent).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def surplus(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_key, stays) of the rows that go, for ``without_rows``."""
    rows = stored(grouped(docs, percent))
    others = rows.where("doc_id != component_id").select("doc_id", "text_key").distinct()
    heads = rows.where("doc_id = component_id").groupBy("doc_id", "label", "text_key").agg(F.count("*").alias("times"))
    least = F.min("text_key").over(Window.partitionBy("doc_id", "label"))
    heads = heads.withColumn("stays", F.col("label").isNull() | (F.col("text_key") == least))
    heads = heads.where(~F.col("stays") | (F.col("times") > 1)).select("doc_id", "text_key", "stays")
    return heads.unionByName(others.withColumn("stays", F.lit(False)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = PERCENT) -> DataFrame:
    """One row of each group; a document without words or without id stays."""
    return without_rows(docs, surplus(docs, percent))
