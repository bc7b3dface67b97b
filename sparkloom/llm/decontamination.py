"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments, each the postings of some megabytes of whole
texts: for every term its ascending word positions. It holds all terms, does not
depend on the query set, and is written to the shared folder once. A search walks
the segments: windows with a term that the segment lacks drop out; for the others
it starts from the postings of the rarest term and intersects the lists of the
others, shifted by their offsets. Windows are taken a bounded number of
candidates at a time. With ``slop`` 0 that finds exact phrases, otherwise every
term may stand up to ``slop`` words away from its place.

The windows of the query set are made in Spark and dealt by their words into
blocks of bounded size, however long an item is; each block is broadcast and
searched for in the same index.

Defined results: null has no words; a document without words has n_words 0 and
no hits; an item without words has no window; an item without item_id counts
under an empty id; repeated documents are judged alike and keep their rows,
repeated items count once; without items nothing is contaminated, and the digest
of no items is that of the empty string. The pipeline stage removes the
contaminated rows alone, told apart by doc_id and text; clean rows of the same
doc_id, or without one, stay. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, release_memory, slices, stored, table, text_key, without_rows
from .kernels import word_hashes

WINDOW = 10
#: (window, item) rows that one block of the query set holds on average.
BLOCK_WINDOWS = 200_000
SEGMENT_BYTES = 1 << 19
#: Candidate positions that a search holds at a time; one window's rarest list
#: is taken in parts if it is longer.
CANDIDATES = 1 << 19

#: A-Z become a-z; all other ASCII but 0-9 and a-z ends a word.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, first = word_hashes([t.translate(_WORDS) for t in texts])
    return words.view(np.int64), first


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (terms, item_id) rows: the word hashes of ``window`` words of an
    item; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT_BYTES):
            hashes, first = _hashed(as_bytes(batch.column("text")))
            n_words = np.diff(first)
            short = np.flatnonzero((n_words > 0) & (n_words < window))
            n = np.maximum(n_words - window + 1, 0)
            owner = np.repeat(np.arange(len(n)), n)
            start = first[:-1][owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            full = hashes[start[:, None] + np.arange(window)] if len(start) else hashes[:0]
            ends = np.concatenate(([0], np.cumsum(np.concatenate([np.full(len(start), window), n_words[short]]))))
            rest = [hashes[first[k] : first[k] + n_words[k]] for k in short.tolist()]
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([full.ravel(), *rest])))
            ids = batch.column("item_id").take(pa.array(np.concatenate([owner, short])))
            yield pa.RecordBatch.from_arrays([terms, ids], ["terms", "item_id"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.mapInArrow(run, "terms array<long>, item_id string").distinct()


@dataclass
class Queries:
    """One block of windows. ``terms`` has a row of places in the vocabulary per
    window, -1 where shorter; ``items`` lists the items of each window between
    ``item_at`` bounds, as places in ``names``."""

    vocabulary: np.ndarray
    terms: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str]


def query_block(rows: pa.Table, window: int = WINDOW) -> Queries:
    """From (terms, item_id) rows in which equal terms stand together."""
    rows = rows.combine_chunks()
    lists, ids = rows.column("terms").combine_chunks(), rows.column("item_id").combine_chunks().dictionary_encode()
    flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    vocabulary, places = np.unique(flat, return_inverse=True)
    size = np.diff(at)
    terms = np.full((len(size), window), -1, dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    terms[row, np.arange(len(flat)) - at[row]] = places
    new = np.ones(len(terms), dtype=bool)
    new[1:] = (terms[1:] != terms[:-1]).any(axis=1)
    item_at = np.append(np.flatnonzero(new), len(terms))
    return Queries(vocabulary, terms[new], item_at, ids.indices.to_numpy(), ids.dictionary.to_pylist())


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of positional postings of all terms.

    A row holds: the segment's texts (row number, doc_id, text_key, n_words), its
    terms as ascending 64-bit hashes with their counts, and all positions in the
    order of the terms, counted in words from the start of the segment.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT_BYTES):
            hashes, first = _hashed(as_bytes(batch.column("text")))
            by_term = np.argsort(hashes, kind="stable")
            terms, counts = np.unique(hashes, return_counts=True)
            bounds = pa.array([0, batch.num_rows], pa.int32())
            texts = [pa.ListArray.from_arrays(bounds, batch.column(c)) for c in ("row", "doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays(
                [
                    *texts,
                    pa.ListArray.from_arrays(bounds, pa.array(np.diff(first), pa.int64())),
                    pa.array([terms.astype("<i8").tobytes()], pa.binary()),
                    pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                    pa.array([by_term.astype("<u4").tobytes()], pa.binary()),
                ],
                ["rows", "doc_ids", "text_keys", "n_words", "terms", "counts", "positions"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"rows array<long>, doc_ids array<{kind}>, text_keys array<long>, n_words array<long>,"
        " terms binary, counts binary, positions binary"
    )
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", text_key().alias("text_key"))
    return numbered.mapInArrow(segments, schema)


class Segment:
    """The postings of one segment for the terms of one block of windows."""

    def __init__(self, row: dict, queries: Queries, slop: int) -> None:
        self.queries, self.slop = queries, slop
        self.n_words = row["n_words"].values.to_numpy()
        terms = np.frombuffer(row["terms"].as_py(), dtype="<i8")
        counts = np.frombuffer(row["counts"].as_py(), dtype="<u4").astype(np.int64)
        positions = np.frombuffer(row["positions"].as_py(), dtype="<u4")
        vocabulary = queries.vocabulary
        at = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
        here = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), dtype=bool)
        self.count = np.where(here, counts[at] if len(terms) else 0, 0)
        ends = np.cumsum(counts)
        self.ends = np.concatenate(([0], np.cumsum(self.count)))
        take = np.arange(self.ends[-1]) + np.repeat(((ends - counts)[at] if len(terms) else at) - self.ends[:-1], self.count)
        # texts are set apart by more than a window can reach
        self.gap = queries.terms.shape[1] + 2 * slop + 1
        own = positions[take].astype(np.int64)
        first = np.concatenate(([0], np.cumsum(self.n_words)))
        self.positions = own + self.gap * (np.searchsorted(first, own, side="right") - 1)
        self.first = first + self.gap * np.arange(len(first))
        self.span = self.first[-1] + 2 * self.gap
        self.key = np.repeat(np.arange(len(vocabulary)), self.count) * self.span + self.positions + self.gap

    def matches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start position) of every match, a bounded number at a time."""
        terms = self.queries.terms
        count = np.where(terms >= 0, self.count[terms], np.iinfo(np.int64).max)
        windows = np.flatnonzero((count > 0).all(axis=1))
        if not len(windows):
            return
        order = np.argsort(count[windows], axis=1, kind="stable")
        rare = terms[windows, order[:, 0]]
        start, n = self.ends[rare], self.count[rare]
        ends = np.cumsum(n)
        for low in range(0, int(ends[-1]), CANDIDATES):
            number = np.arange(low, min(low + CANDIDATES, int(ends[-1])))
            of = np.searchsorted(ends, number, side="right")
            yield self._intersect(windows[of], order[of], self.positions[start[of] + number - (ends - n)[of]])

    def _intersect(self, window: np.ndarray, order: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates (window, place of its rarest term) those where each other
        term, rarest first, has a posting within ``slop`` of its place."""
        begin, slop = at - order[:, 0], self.slop
        for step in range(1, order.shape[1]):
            if not len(window):
                break
            offset = order[:, step]
            term = self.queries.terms[window, offset]
            want = term * self.span + begin + offset + self.gap
            near = np.searchsorted(self.key, want - slop)
            ok = near < len(self.key)
            ok[ok] = self.key[near[ok]] <= want[ok] + slop
            ok |= term < 0
            window, begin, order = window[ok], begin[ok], order[ok]
        return window, begin

    def per_text(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Matched word spans and items of each text of the segment."""
        own, slop = self.queries, self.slop
        lengths = (own.terms >= 0).sum(axis=1)
        spans: list[list[tuple[int, int]]] = [[] for _ in self.n_words]
        seen: set[tuple[int, int]] = set()
        for window, begin in self.matches():
            text = np.searchsorted(self.first, begin + slop, side="right") - 1
            local = begin - self.first[text]
            end = np.minimum(local + lengths[window] + slop, self.n_words[text])
            for t, a, b in zip(text.tolist(), np.maximum(local - slop, 0).tolist(), end.tolist()):
                spans[t].append((a, b))
            seen.update(zip(text.tolist(), window.tolist()))
        items: list[set[str]] = [set() for _ in self.n_words]
        for t, w in seen:
            items[t].update(own.names[i] for i in own.items[own.item_at[w] : own.item_at[w + 1]].tolist())
        return [_joined(x) for x in spans], items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(index: DataFrame, queries: Queries, slop: int = 0) -> DataFrame:
    """For every indexed text: row, doc_id, text_key, n_words, the matched word
    spans and the items they belong to (empty lists where nothing matches)."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                spans, items = Segment(row, shared.value, slop).per_text()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(row[c].values for c in ("rows", "doc_ids", "text_keys", "n_words")),
                        pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], _SPANS),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    ["row", "doc_id", "text_key", "n_words", "spans", "items"],
                )
            release_memory()

    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = (
        f"row long, doc_id {kind}, text_key long, n_words long,"
        " spans array<struct<begin:long,end:long>>, items array<string>"
    )
    return index.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def query_blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Queries]:
    """The windows of a query set in blocks of bounded size (one, if it is empty)."""
    rows = stored(windows_of(benchmark, window))
    blocks = max(1, -(-rows.count() // BLOCK_WINDOWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks)))
    for block in range(blocks):
        own = dealt.where(F.col("block") == block).drop("block")
        yield query_block(own.orderBy("terms", "item_id").toArrow(), window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """:func:`search` over all blocks of the query set, one row per document row."""
    index = stored(build_index(docs))
    found = [search(index, own, slop) for own in query_blocks(benchmark, window)]
    if len(found) == 1:
        return found[0].drop("row")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.where(F.size("spans") > 0).groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    zipped = F.explode(F.arrays_zip("rows", "doc_ids", "text_keys", "n_words")).alias("x")
    every = index.select(zipped).select("x.*").toDF("row", "doc_id", "text_key", "n_words")
    return every.join(hits, "row", "left").select(
        "doc_id", "text_key", "n_words", *(F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "items"))
    )


def covered(spans: F.Column) -> F.Column:
    """Number of positions that a list of (begin, end) spans covers."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    done = F.aggregate(
        F.array_sort(spans),
        start,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["end"]).alias("end"),
            (s["total"] + F.greatest(x["end"] - F.greatest(s["end"], x["begin"]), F.lit(0))).alias("total"),
        ),
    )
    return done["total"]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = covered(F.col("spans"))
    return matches(docs, benchmark).select(
        "doc_id",
        "text_key",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document rows without a benchmark window."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    listed = found.where("contaminated").select("doc_id", "text_key").distinct()
    return without_rows(docs, listed.withColumn("stays", F.lit(False)))
