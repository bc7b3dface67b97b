"""Removal of repeated byte strings by common-prefix intervals of suffix arrays.

Goal: remove each byte covered by a string of LENGTH bytes that also starts
earlier in the corpus, documents being ordered by id. Suffixes are dealt by
content, so that equal strings meet wherever they stand:

1. An anchor is a position whose GRAM-byte hash is the least of the SPAN hashes
   around it. Any LENGTH bytes contain an anchor, and equal strings contain the
   same one at the same place. Its context is all that the strings of LENGTH
   bytes around it can hold.
2. Each task keeps, of equal contexts, the first; the others are repeated and
   their bytes are covered at once. So a frequent passage sends one row per task,
   not one per occurrence. The rest meet by anchor hash in sorted order, and there
   equal contexts are settled in the same way over the corpus, in one pass that
   holds no group. Contexts count as equal if two 64-bit hashes are, that of the
   anchor and that of the context.
3. Anchors whose surviving contexts differ lie near the ends of repeats. Their
   contexts are cut in parts by the place where strings start; parts whose core
   is found nowhere else go. For the others an enhanced suffix array is built over
   all suffixes of the parts of equal core: sorted order, longest common prefixes,
   and a stack scan of the prefix intervals. An interval whose suffixes all
   follow the same byte is not left-maximal and is left to the interval one byte
   to the left; the others are maximal repeats, with all their occurrences. All
   occurrences but the first are covered.

A group of more than LARGE parts is not held by one task: its strings of LENGTH
bytes are grouped one by one, which covers the same bytes.

Defined results: null is empty text; a text under LENGTH bytes keeps all; rows
that share a doc_id are one document: repeated rows do not count as earlier than
each other, and what is covered in one is removed from all; a row without doc_id
comes before all others and keeps all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, hash_filter, may_be_in, slices, split_by_ids, stored, table
from .kernels import RangeHasher, lay_out, mix64

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Bytes of a context before and after the start of its anchor.
BEFORE, AFTER = SPAN - 1, LENGTH
#: Bytes of text hashed at a time; about 120 bytes of memory for each of them.
SLICE = 1 << 18
#: Anchors that a task gathers before it settles equal contexts among them.
HELD = 1 << 19
#: Parts of one core that a task holds; more go the way of large groups.
LARGE = 20_000
#: Parts that a task sorts at a time, if no core has more.
BATCH = 4_000


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, bounds: np.ndarray, hasher: RangeHasher) -> np.ndarray:
    """Positions of the anchors of all texts laid out in ``data``."""
    n = len(data) - GRAM + 1
    if n < SPAN:
        return np.zeros(0, dtype=np.int64)
    grams = hasher.every(GRAM)
    # grams that reach over the end of their text never are the least
    over = np.maximum(bounds[1:, None] - 1 - np.arange(GRAM), bounds[:-1, None]).ravel()
    grams[over[over < n]] = np.iinfo(np.uint64).max
    least = _sliding(grams, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, dtype=np.uint64)
    greatest = _sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum)
    return np.flatnonzero((grams == greatest) & (grams != np.iinfo(np.uint64).max))


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching intervals, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def _places(ids: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the order of (doc_id, start), and the place of each row in
    that order (equal for equal pairs). A null id comes first."""
    plain = ids.null_count == 0 and pa.types.is_integer(ids.type)
    rank = ids.to_numpy() if plain else _ranks(ids)
    order = np.arange(len(rank))
    if ((rank[1:] < rank[:-1]) | ((rank[1:] == rank[:-1]) & (starts[1:] < starts[:-1]))).any():
        order = np.lexsort((starts, rank))
    rank, starts = rank[order], starts[order]
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = (rank[1:] != rank[:-1]) | (starts[1:] != starts[:-1])
    return order, np.cumsum(new)


def _first_of(a: np.ndarray, b: np.ndarray, ids: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each key (a, b) in the order of (doc_id, start), and the
    later rows, in that order. Rows at the very place of the first are neither."""
    order, place = _places(ids, starts)
    by_key = np.lexsort((b[order], a[order]))
    a, b = a[order][by_key], b[order][by_key]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = by_key[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    later = np.sort(by_key[place[by_key] > place[head]])
    return order[by_key[new]], order[later]


#: kind 0: an anchor (start is its position, end the length of its text);
#: kind 1: bytes start..end of the document are covered.
_ROWS = "kind int, anchor long, context long, doc_id {kind}, start long, end long"
_NAMES = ["kind", "anchor", "context", "doc_id", "start", "end"]


def _batch(kind: int, anchor: np.ndarray, context: np.ndarray, docs: pa.Array, start: np.ndarray, end: np.ndarray):
    columns = [pa.array(np.full(len(start), kind, dtype=np.int32)), pa.array(anchor), pa.array(context), docs]
    return pa.RecordBatch.from_arrays([*columns, pa.array(start), pa.array(end)], _NAMES)


def _slice_anchors(batch: pa.RecordBatch) -> list:
    """Of one slice: ids, start, text length, anchor hash and context hash."""
    data, bounds = lay_out(as_bytes(batch.column("text")))
    hasher = RangeHasher(data)
    at = anchors(data, bounds, hasher)
    text = np.searchsorted(bounds, at, side="right") - 1
    begin, close = bounds[text], bounds[text + 1] - 1
    left, right = np.maximum(at - BEFORE, begin), np.minimum(at + AFTER, close)
    long = right - left >= LENGTH
    at, text, begin, close, left, right = (x[long] for x in (at, text, begin, close, left, right))
    # where a context is cut short by its text, that is part of it
    cut = ((at - left) * 256 + (right - at)).astype(np.uint64)
    context = hasher(left, right) ^ (cut * np.uint64(0x9E3779B97F4A7C15))
    anchor = hasher(at, at + GRAM).view(np.int64)
    return [batch.column("doc_id").take(pa.array(text)), at - begin, close - begin, anchor, context.view(np.int64)]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Step 1 and the task's part of step 2 (see _ROWS)."""

    def settled(parts: list[list]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([p[0] for p in parts])
        start, size, anchor, context = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
        keep, again = _first_of(anchor, context, ids, start)
        yield _batch(0, anchor[keep], context[keep], ids.take(pa.array(keep)), start[keep], size[keep])
        if len(again):
            # runs of overlapping contexts of one document become one row
            left, right = np.maximum(start[again] - BEFORE, 0), np.minimum(start[again] + AFTER, size[again])
            rank = _ranks(ids.take(pa.array(again)))
            new = np.ones(len(again), dtype=bool)
            new[1:] = (rank[1:] != rank[:-1]) | (left[1:] > right[:-1]) | (left[1:] < left[:-1])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(again) - 1)
            # these rows only pass through, so they are dealt evenly
            spread = mix64(anchor[again[new]].view(np.uint64) + np.arange(new.sum(), dtype=np.uint64)).view(np.int64)
            yield _batch(1, spread, spread, ids.take(pa.array(again[new])), left[new], right[last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = []
        held = 0
        for batch in slices(batches, "text", SLICE):
            parts.append(_slice_anchors(batch))
            held += len(parts[-1][1])
            if held >= HELD:
                yield from settled(parts)
                parts, held = [], 0
        if held:
            yield from settled(parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, _ROWS.format(kind=kind))


def _ranks(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, equal for equal ids; null sorts first."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    return pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Tables of whole groups of ``key``, of about ``least`` rows (more only for
    a larger group), from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for whole in batches:
        for start in range(0, whole.num_rows, least):
            batch = whole.slice(start, least)
            if rows >= least:
                last = held[-1].column(key)[held[-1].num_rows - 1].as_py()
                n = int((batch.column(key).to_numpy() == last).cumprod().sum())
                held.append(batch.slice(0, n))
                if n == batch.num_rows:
                    continue
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, batch = [], 0, batch.slice(n)
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Settling:
    """Goes through anchors sorted by (anchor, context, doc_id, start) and tells
    first contexts from repeated ones. Between batches it holds one row, the first
    of the current context, and whether its anchor has had another context."""

    def __init__(self) -> None:
        self.head: pa.RecordBatch | None = None
        self.several = False

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        carried = self.head is not None
        if carried:
            batch = pa.concat_batches([self.head, batch])
        anchor, context, start, end = (batch.column(c).to_numpy() for c in ("anchor", "context", "start", "end"))
        rank = _ranks(batch.column("doc_id"))
        new_anchor, new = np.ones(len(anchor), dtype=bool), np.ones(len(anchor), dtype=bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new[1:] = new_anchor[1:] | (context[1:] != context[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        again = np.flatnonzero(~new & ((rank != rank[head]) | (start != start[head])))
        left, right = np.maximum(start[again] - BEFORE, 0), np.minimum(start[again] + AFTER, end[again])
        yield _batch(1, anchor[again], context[again], batch.column("doc_id").take(pa.array(again)), left, right)
        number = (np.cumsum(new_anchor) - 1)[new]
        several = np.bincount(number) > 1
        several[0] |= carried and self.several
        found = several[number]
        found[0] &= not (carried and self.several)  # it went out before
        yield batch.take(pa.array(np.flatnonzero(new)[found]))
        self.head, self.several = batch.slice(int(head[-1]), 1), bool(several[-1])


def settle_contexts(rows: DataFrame) -> DataFrame:
    """Step 2 over the corpus: covered bytes, and the anchors (kind 0) that have
    more than one context left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settling = _Settling()
        for batch in batches:
            done = pa.array(batch.column("kind").to_numpy() == 1)
            yield batch.filter(done)
            own = batch.filter(pc.invert(done))
            if own.num_rows:
                yield from settling(own)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "context", "doc_id", "start")
    return dealt.mapInArrow(run, rows.schema)


#: Starts of strings in a context are taken in three parts. All strings of a part
#: share a core, so a part can only repeat where its core does.
PART = SPAN // 3


def _part_keys(anchor: np.ndarray, lead: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, part, key) of the parts whose core lies inside their context."""
    data, bounds = lay_out(texts)
    hasher, size, shift = RangeHasher(data), np.diff(bounds) - 1, BEFORE - lead
    found = []
    for part, low in enumerate(range(0, SPAN, PART)):
        begin, end = low + PART - 1 - shift, low + LENGTH - shift
        own = np.flatnonzero((begin >= 0) & (end <= size))
        key = hasher(bounds[own] + begin[own], bounds[own] + end[own]) ^ anchor[own].view(np.uint64)
        found.append((own, np.full(len(own), part), mix64(key + np.uint64(part)).view(np.int64)))
    context, part, key = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(context, kind="stable")
    return context[order], part[order], key[order]


def context_rows(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """Step 3: of each surviving context its bytes, where they start, how many
    stand before the anchor (``lead``), and parts with their keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = ends.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = batch.column("ends")
            n = np.diff(lists.offsets.to_numpy())
            inside = slice(int(lists.offsets[0].as_py()), int(lists.offsets[-1].as_py()))
            anchor, at = (lists.values.field(c).to_numpy()[inside] for c in ("anchor", "start"))
            if not len(at):
                continue
            of = np.repeat(np.arange(batch.num_rows), n)
            left = np.maximum(at - BEFORE, 0)
            texts = as_bytes(batch.column("text"))
            cut = [texts[k][a:b] for k, a, b in zip(of.tolist(), left.tolist(), (at + AFTER).tolist())]
            context, part, key = _part_keys(anchor, at - left, cut)
            bounds = pa.array(np.searchsorted(context, np.arange(len(at) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(of)),
                    pa.array(left),
                    pa.array((at - left).astype(np.int32)),
                    pa.array(cut, pa.binary()),
                    pa.ListArray.from_arrays(bounds, pa.array(part.astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(key)),
                ],
                ["doc_id", "left", "lead", "bytes", "parts", "keys"],
            )

    schema = f"doc_id {kind}, left long, lead int, bytes binary, parts array<int>, keys array<long>"
    some, _ = split_by_ids(docs.select("doc_id", "text"), ends)
    return some.join(wanted, "doc_id").mapInArrow(run, schema)


def part_rows(contexts: DataFrame, alive: DataFrame) -> DataFrame:
    """(key, doc_id, left, lead, bytes) of the parts whose key another has too:
    the bytes that the strings of the part can cover, and where the first of them
    stands in the part. A hash filter picks them; what it lets through in error
    is alone under its key."""
    kind = contexts.schema["doc_id"].dataType.simpleString()
    shared = contexts.sparkSession.sparkContext.broadcast(hash_filter(alive, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            keys, parts = batch.column("keys"), batch.column("parts")
            inside = slice(int(keys.offsets[0].as_py()), int(keys.offsets[-1].as_py()))
            key = keys.values.to_numpy()[inside]
            own = np.flatnonzero(may_be_in(shared.value, key))
            context = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))[own]
            low = parts.values.to_numpy()[parts.offsets[0].as_py() :][own].astype(np.int64) * PART
            shift = BEFORE - batch.column("lead").to_numpy().astype(np.int64)[context]
            begin = np.maximum(low - shift, 0)
            close = low + PART - 1 + LENGTH - shift
            texts = batch.column("bytes").to_pylist()
            cut = [texts[c][a:b] for c, a, b in zip(context.tolist(), begin.tolist(), close.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[own]),
                    batch.column("doc_id").take(pa.array(context)),
                    pa.array(batch.column("left").to_numpy()[context] + begin),
                    pa.array((begin + shift - low).astype(np.int32)),
                    pa.array(cut, pa.binary()),
                ],
                ["key", "doc_id", "left", "lead", "bytes"],
            )

    return contexts.mapInArrow(run, f"key long, doc_id {kind}, left long, lead int, bytes binary")


def prefix_intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of every common-prefix interval of a suffix array
    with a prefix of at least ``least``; lcp[i] is between entries i and i + 1."""
    out, stack = [], []
    for i, length in enumerate([*lcp, 0]):
        begin = i
        while stack and stack[-1][1] > length:
            begin, most = stack.pop()
            out.append((begin, i, most))
        if length >= least and (not stack or stack[-1][1] < length):
            stack.append((begin, length))
    return out


def maximal_repeats(
    keys: np.ndarray, lead: np.ndarray, texts: list[bytes]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, first byte in each) of the maximal repeats of at least
    LENGTH bytes among rows of equal keys.

    Rows are aligned (``lead``), as equal strings must be. Suffixes are taken from
    right to left, one start at a time: their order follows from the byte at the
    start and the order of the suffixes one byte shorter. A repeat that goes on
    past a row's bytes is reported as far as they reach.
    """
    n, width = len(texts), PART - 1 + LENGTH
    grid = np.zeros((n, width), dtype=np.int16)  # 0 where a row has no byte
    for row, text, s in zip(grid, texts, lead.tolist()):
        row[s : s + len(text)] = np.frombuffer(text, dtype=np.uint8)
        row[s : s + len(text)] += 1
    _, group = np.unique(keys, return_inverse=True)
    end = np.array([len(t) for t in texts]) + lead
    tail = np.ascontiguousarray(grid[:, PART - 1 :].astype(">i2"))
    rank = np.unique(tail.view(f"S{2 * tail.shape[1]}").ravel(), return_inverse=True)[1]
    for start in range(PART - 1, -1, -1):
        if start < PART - 1:
            rank = np.unique(grid[:, start].astype(np.int64) * (n + 1) + rank, return_inverse=True)[1]
        order = np.argsort(group * (n + 1) + rank, kind="stable")
        order = order[(end[order] - start >= LENGTH) & (grid[order, start] > 0)]
        if len(order) < 2:
            continue
        window = grid[order, start:]
        differ = window[1:] != window[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), window.shape[1])
        common = np.minimum(common, np.minimum(end[order][1:], end[order][:-1]) - start)
        common[group[order][1:] != group[order][:-1]] = 0
        long = common >= LENGTH
        if not long.any():
            continue
        # strings at the first start of a part have their left neighbours elsewhere
        left = grid[order, start - 1] if start else np.zeros(len(order), dtype=np.int16)
        diverse = long & ((left[1:] != left[:-1]) | (left[1:] == 0))
        run = np.cumsum(np.concatenate(([True], ~long)))  # entries joined by long prefixes
        first_of_run = np.flatnonzero(np.concatenate(([True], ~long)))
        for number in np.unique(run[1:][diverse]).tolist():
            a = int(first_of_run[number - 1])
            b = int(first_of_run[number]) if number < len(first_of_run) else len(order)
            for first, last, most in prefix_intervals(common[a : b - 1].tolist(), LENGTH):
                inside = left[a + first : a + last + 1]
                if (inside == 0).any() or (inside != inside[0]).any():
                    rows = order[a + first : a + last + 1]
                    yield most, rows, start - lead[rows]


def covered_by_repeats(parts: DataFrame) -> DataFrame:
    """(doc_id, start, end) of the occurrences of maximal repeats that have an
    earlier occurrence."""
    kind = parts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, "key", BATCH):
            ids = part.column("doc_id").combine_chunks()
            lead = part.column("lead").to_numpy().astype(np.int64)
            left = part.column("left").to_numpy()
            order, place = _places(ids, left - lead)
            rank = np.empty(len(place), dtype=np.int64)
            rank[order] = place
            # strings of one part overlap, so what they cover in a row is one span
            low, high = np.full(len(left), PART + LENGTH), np.zeros(len(left), dtype=np.int64)
            repeats = maximal_repeats(part.column("key").to_numpy(), lead, part.column("bytes").to_pylist())
            for most, rows, first_byte in repeats:
                later = rank[rows] > rank[rows].min()
                rows, first_byte = rows[later], first_byte[later]
                low[rows] = np.minimum(low[rows], first_byte)
                high[rows] = np.maximum(high[rows], first_byte + most)
            rows = np.flatnonzero(high)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(left[rows] + low[rows]), pa.array(left[rows] + high[rows])],
                ["doc_id", "start", "end"],
            )

    dealt = parts.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"doc_id {kind}, start long, end long")


def covered_by_string(parts: DataFrame) -> DataFrame:
    """The same for the rows of very large groups, string by string: one row for
    each string of LENGTH bytes, settled by its least place."""
    kind = parts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 16):
            texts = batch.column("bytes").to_pylist()
            n = np.maximum(np.array([len(t) for t in texts]) - LENGTH + 1, 0)
            text = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            strings = [texts[k][a : a + LENGTH] for k, a in zip(text.tolist(), at.tolist())]
            start = at + batch.column("left").to_numpy()[text]
            ids = batch.column("doc_id").take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), ids, pa.array(start)], ["string", "doc_id", "start"])

    strings = parts.mapInArrow(run, f"string binary, doc_id {kind}, start long").distinct()
    first = strings.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
    later = strings.join(first.where("n > 1"), "string").where(F.struct("doc_id", "start") > F.col("first"))
    return later.select("doc_id", "start", (F.col("start") + LENGTH).alias("end"))


def covered_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): for each document with repeated bytes its intervals."""
    settled = stored(settle_contexts(anchor_rows(docs)))
    contexts = stored(context_rows(docs, settled.where("kind = 0")))
    keys = contexts.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    alive = stored(keys.where("n > 1"))
    rows = part_rows(contexts, alive)
    large = alive.where(F.col("n") > LARGE).select("key")
    parts = [settled.where("kind = 1").select("doc_id", "start", "end")]
    if not large.isEmpty():
        parts.append(covered_by_string(rows.join(large, "key", "left_semi")))
        rows = rows.join(large, "key", "left_anti")
    parts.append(covered_by_repeats(rows))
    spans = parts[0]
    for more in parts[1:]:
        spans = spans.unionByName(more)
    spans = merged_spans(spans.where("doc_id is not null"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document made one (within a batch), so that few
    rows are left to gather for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            document = np.concatenate(([0], np.cumsum(np.diff(_ranks(ids)) != 0))) << 40
            start, end = (batch.column(c).to_numpy() + document for c in ("start", "end"))
            start, end = _merged(start, end)
            first = np.searchsorted(document, start >> 40 << 40)
            low = (1 << 40) - 1
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first)), pa.array(start & low), pa.array(end & low)], ["doc_id", "start", "end"]
            )

    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(run, spans.schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            removed, n_spans, rest = [], [], []
            texts = as_bytes(batch.column("text"))
            lists = batch.column("spans")
            at = lists.offsets.to_numpy()
            begin, close = (lists.values.field(c).to_numpy() for c in ("start", "end"))
            for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist()):
                if a == b:
                    removed.append(0)
                    n_spans.append(0)
                    rest.append(text)
                    continue
                starts, ends = _merged(*(np.minimum(x[a:b], len(text)) for x in (begin, close)))
                starts, ends = starts[ends > starts], ends[ends > starts]
                removed.append(int((ends - starts).sum()))
                n_spans.append(len(starts))
                edges = zip([0, *ends.tolist()], [*starts.tolist(), len(text)])
                rest.append(b"".join([text[x:y] for x, y in edges]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(rest, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    covered = stored(covered_bytes(docs))
    some, rest = split_by_ids(docs.select("doc_id", "text"), covered)
    rest = rest.withColumn("spans", F.lit(None).cast(covered.schema["spans"].dataType))
    return some.join(covered, "doc_id", "left").unionByName(rest).mapInArrow(run, schema)


def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
