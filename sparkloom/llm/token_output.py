"""Binary training sequences: packed id matrices with their segment bounds.

Whole texts are tokenised once; overlong documents are cut without loss. The
pieces, ids included, are dealt by row number, whatever their doc_id, into groups
of bounded bytes, and each group is packed by best-fit decreasing: a segment tree over the amounts of room
finds the open sequence with the least room that still fits. One row is one row
of the id matrix, with the cumulative segment lengths and the positions that
restart at every segment.

Defined results: a null or empty text is one segment of the end id alone;
repeated rows are segments of their own; ties go to the smaller doc_id, then
piece; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, release_memory, slices, table
from .tokens import SLICE, cut, shared_encoder

CAPACITY = 1024
#: Bytes of text that one group of pieces comes from, on average.
GROUP_BYTES = 8 << 20
#: Shuffle partitions that groups are dealt over at most.
PARTITIONS = 50_000
#: Ids are written as little-endian unsigned 16-bit numbers (vocabulary < 65536).
ID_TYPE = "<u2"
PAD = 0


class RoomTree:
    """Segment tree over amounts of room 0..capacity, counting open sequences."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least ``least``."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences of item numbers for sizes in descending order."""
    tree = RoomTree(capacity)
    sequences: list[list[int]] = []
    for item, size in enumerate(sizes):
        found = tree.take(size)
        if found is None:
            found = capacity, len(sequences)
            sequences.append([])
        room, at = found
        sequences[at].append(item)
        tree.put(room - size, at)
    return sequences


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and the ids of every piece, as bytes."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared_encoder()
        for batch in slices(batches, "text", SLICE):
            of, piece, start, length, ids = [], [], [], [], []
            for k, whole in enumerate(encode(as_bytes(batch.column("text")))):
                found = whole.astype(ID_TYPE)
                for p, (s, n) in enumerate(cut(len(found), capacity)):
                    of.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    ids.append(found[s : s + n].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(of)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length int, ids binary"
    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def _rows(group: pa.Table, capacity: int) -> pa.Table:
    """The packed rows of one group."""
    group = group.combine_chunks().sort_by(
        [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")]
    )
    lengths = group.column("length").to_pylist()
    ids = group.column("ids").to_pylist()
    sequences = best_fit_decreasing(lengths, capacity)
    members = np.array([i for s in sequences for i in s], dtype=np.int64)
    ends = np.cumsum([len(s) for s in sequences]).astype(np.int32)
    bounds = pa.array(np.concatenate(([0], ends)), pa.int32())

    def listed(name: str) -> pa.ListArray:
        taken = group.column(name).take(pa.array(members)).combine_chunks()
        return pa.ListArray.from_arrays(bounds, taken)

    matrix, positions, cumulative = [], [], []
    pad = np.array([PAD], dtype=ID_TYPE).tobytes()
    width = len(pad)
    steps = np.arange(capacity, dtype=ID_TYPE).tobytes()
    for s in sequences:
        row = b"".join([ids[i] for i in s])
        empty = capacity - len(row) // width
        matrix.append(row + pad * empty)
        positions.append(b"".join([steps[: width * lengths[i]] for i in s]) + b"\0" * (width * empty))
        cumulative.append(np.concatenate(([0], np.cumsum([lengths[i] for i in s]))).tolist())
    number = group.column("group_no")[0].as_py()
    return pa.table(
        {
            "sequence_id": pa.array([(number << 24) + k for k in range(len(sequences))], pa.int64()),
            "n_tokens": pa.array([c[-1] for c in cumulative], pa.int32()),
            "input_ids": pa.array(matrix, pa.binary()),
            "position_ids": pa.array(positions, pa.binary()),
            "cu_seqlens": pa.array(cumulative, pa.list_(pa.int32())),
            "doc_ids": listed("doc_id"),
            "pieces": listed("piece"),
            "starts": listed("start"),
        }
    )


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each training sequence of exactly ``capacity`` ids.

    ``input_ids`` and ``position_ids`` are rows of matrices (see ID_TYPE),
    padded at the end; ``cu_seqlens`` starts at 0 and ends at n_tokens; doc_ids,
    pieces and starts tell what each segment is, so texts can be put together
    again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>,"
        f" doc_ids array<{kind}>, pieces array<int>, starts array<long>"
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(3)), F.lit(groups))
    dealt = token_pieces(docs, capacity).withColumn("group_no", group)
    dealt = dealt.repartition(min(groups, PARTITIONS), "group_no")
    return dealt.groupBy("group_no").applyInArrow(lambda t: _rows(t, capacity), schema)


def id_matrix(rows: list[bytes], capacity: int = CAPACITY) -> np.ndarray:
    """The matrix of some ``input_ids`` (or ``position_ids``) rows."""
    return np.frombuffer(b"".join(rows), dtype=ID_TYPE).reshape(-1, capacity)


def write_token_files(sequences: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet; the ids stay raw little-endian bytes."""
    sequences.write.mode("errorifexists").parquet(path)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents"))
