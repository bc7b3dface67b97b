"""Packing documents into sequences of bounded length by swap local search.

A task tokenises whole texts and emits one small row per piece; the rows are
written once. They are dealt by row number, whatever their ids, into groups of
bounded size, each packed in one task: a best-fit
start, then a local search between underfull bins. The emptiest bin gives: it
moves a piece to another bin, exchanges one of its pieces for a smaller one, or
two of its pieces for one, whenever that raises the sum of squared fills, until
it is empty or stuck. The bins that groups leave underfull are dealt anew into
fewer groups and searched again, so that group edges cost next to nothing.

Defined results: a null or empty text is one piece that holds only the end id;
an overlong document is cut (see :func:`sparkloom.llm.tokens.cut`); repeated
rows are pieces of their own; ties go to the smaller doc_id, then piece. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, release_memory, slices, stored, table
from .tokens import SLICE, cut, shared_encoder

CAPACITY = 1024
#: Pieces that one group holds on average.
GROUP_PIECES = 8192

PIECES = "piece int, start long, length long, ids_crc32 long"


def piece_table(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared_encoder()
        for batch in slices(batches, "text", SLICE):
            rows, of = [], []
            for k, ids in enumerate(encode(as_bytes(batch.column("text")))):
                for piece, (start, n) in enumerate(cut(len(ids), capacity)):
                    of.append(k)
                    rows.append((piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), *columns],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, {PIECES}")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item goes where it leaves the least room.

    ``open_at`` has one bit for each amount of room that some bin has.
    """
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = open_at >> size
        if found:
            room = size + (found & -found).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                open_at &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if room > size:
            with_room[room - size].append(at)
            open_at |= 1 << (room - size)
    return bins


class SwapSearch:
    """Local search over bins that still have room; full bins stay as they are."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int) -> None:
        self.capacity = capacity
        self.full = [b for b in bins if sizes[b].sum() >= capacity]
        self.bins = [list(b) for b in bins if sizes[b].sum() < capacity]
        self.items = np.array([i for b in self.bins for i in b], dtype=np.int64)
        self.size = sizes[self.items].astype(np.int64)
        self.at = np.repeat(np.arange(len(self.bins)), [len(b) for b in self.bins])
        self.fill = np.bincount(self.at, self.size, len(self.bins)).astype(np.int64)

    def _shift(self, item: int, to: int) -> None:
        self.fill[self.at[item]] -= self.size[item]
        self.fill[to] += self.size[item]
        self.at[item] = to

    def _gain(self, d: np.ndarray, fill: np.ndarray, donor: int) -> np.ndarray:
        """Half the rise of the squared fills when d moves out of the donor."""
        return d * (fill - self.fill[donor] + d)

    def _move(self, donor: int, own: np.ndarray) -> bool:
        room = self.capacity - self.fill
        room[donor] = -1
        room[self.fill == 0] = -1
        for item in own[np.argsort(-self.size[own], kind="stable")].tolist():
            left = room - self.size[item]
            left[left < 0] = self.capacity + 1
            to = int(left.argmin())
            if left[to] <= self.capacity and self._gain(self.size[item], self.fill[to], donor) > 0:
                self._shift(item, to)
                return True
        return False

    def _exchange(self, donor: int, give: list[tuple[int, ...]], sums: np.ndarray) -> bool:
        """Give one entry of ``give`` for the best smaller piece elsewhere."""
        fill = self.fill[self.at]
        room = self.capacity - fill
        sums, first = np.unique(sums, return_index=True)
        for total, k in zip(sums[::-1].tolist(), first[::-1].tolist()):
            d = total - self.size
            gain = np.where((d > 0) & (d <= room) & (self.at != donor), self._gain(d, fill, donor), 0)
            item = int(gain.argmax())
            if gain[item] > 0:
                to = int(self.at[item])
                self._shift(item, donor)
                for x in give[k]:
                    self._shift(x, to)
                return True
        return False

    def run(self) -> list[list[int]]:
        stuck = np.zeros(len(self.bins), dtype=bool)
        while True:
            waiting = np.where(stuck | (self.fill == 0) | (self.fill == self.capacity), self.capacity + 1, self.fill)
            if not len(waiting) or waiting.min() > self.capacity:
                break
            donor = int(waiting.argmin())
            while self.fill[donor]:
                own = np.flatnonzero(self.at == donor)
                if self._move(donor, own):
                    continue
                if self._exchange(donor, [(x,) for x in own.tolist()], self.size[own]):
                    continue
                a, b = np.triu_indices(len(own), 1)
                pairs = list(zip(own[a].tolist(), own[b].tolist()))
                if not pairs or not self._exchange(donor, pairs, self.size[own[a]] + self.size[own[b]]):
                    stuck[donor] = True
                    break
        out: dict[int, list[int]] = {}
        for item, at in zip(self.items.tolist(), self.at.tolist()):
            out.setdefault(at, []).append(item)
        return self.full + list(out.values())


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers with total sizes of at most ``capacity``."""
    return SwapSearch(sizes, best_fit(sizes, capacity), capacity).run()


def _packed(rows: pa.Table, capacity: int) -> pa.Table:
    """A group's rows with local sequence numbers, offsets and fills. Ids stay in
    Arrow: with a null beside them pandas would turn them into floats."""
    rows = rows.combine_chunks().sort_by(
        [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")]
    )
    sizes = rows.column("length").to_numpy()
    number, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
    for k, items in enumerate(pack(sizes, capacity)):
        items = sorted(items)
        number[items] = k
        ends = np.cumsum(sizes[items])
        offset[items] = ends - sizes[items]
        fill[items] = ends[-1]
    for name, column in (("number", number), ("offset", offset), ("fill", fill)):
        rows = rows.append_column(name, pa.array(column))
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; groups of about GROUP_PIECES.

    The second round takes only the pieces of underfull sequences (at most a
    fixed share of each group's bins) in groups of the same size. Rows are read
    from where they were written, so that their numbers hold if a task runs
    again.
    """
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    out = f"{own}, group_no long, number long, offset long, fill long"

    def grouped(rows: DataFrame, groups: int, salt: int) -> DataFrame:
        key = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(salt)), F.lit(groups))
        return rows.withColumn("group_no", key).groupBy("group_no").applyInArrow(lambda t: _packed(t, capacity), out)

    pieces = stored(pieces)
    first = max(1, -(-pieces.count() // GROUP_PIECES))
    done = grouped(pieces, first, 1)
    if first == 1:
        return _numbered(done, 0)
    done = stored(done)
    again = stored(done.where(F.col("fill") < capacity).select(pieces.columns))
    second = max(1, -(-again.count() // GROUP_PIECES))
    full = done.where(F.col("fill") == capacity)
    return _numbered(full, 0).unionByName(_numbered(grouped(again, second, 2), 1))


def _numbered(packed: DataFrame, part: int) -> DataFrame:
    """Sequence ids that no other group and no other round can have."""
    sequence = (F.col("group_no") * 2 + part) * (1 << 24) + F.col("number")
    return packed.withColumn("sequence_id", sequence).drop("group_no", "number", "fill")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack_pieces(piece_table(docs, capacity), capacity)


def op4_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
