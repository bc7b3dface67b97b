"""Web archives as seekable Zstandard bundles.

A bundle ``*.warc.zst`` is a row of independent Zstandard frames. Each holds some
whole WARC records (about FRAME bytes; a larger record has a frame of its own).
Then follow an index in a skippable frame, which maps record ids to (frame, offset
in the frame, length), and the seek table of the published seekable format:
compressed and plain size and checksum of every frame, and a footer. So a reader
finds the table from the file's end, and one record costs one frame.

Writing, without a shuffle of payloads:

1. Digests of payloads are counted; of those that occur more than once, the first
   row is kept: the smallest page_id, then the first in file order. One small row
   for each such digest is written.
2. A Bloom filter of them tells which rows may be copies. The others are written as
   responses where they are read. Rows that may be copies leave their payload
   behind, unless they may be the first, and are joined to the kept digests: the
   digests of more than 1 row in HOT (at most HOT of them) by broadcast, the others
   by shuffle. Copies become revisits that name their response.
3. Each task turns its rows into bundles, and :mod:`sparkloom.sources.named_files`
   writes them, so that an archive appears whole and once, whatever executors fail.

Defined results: a null payload is empty. Payloads under LEAST bytes are always
responses. Of equal payloads with equal smallest page_id one row is the response
and the others are revisits of that page_id. A null page_id comes after all others.
Control characters, spaces and non-ASCII letters of a url are percent-encoded; a
null url gives no header. An empty table gives no archive and no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.folders import open_folder
from sparkloom.sources.named_files import write_named

from .common import hash_filter, may_be_in, release_memory, scratch_dir, stored, table

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Plain bytes of a frame, compressed bytes and records of a bundle.
FRAME, BUNDLE, RECORDS = 1 << 20, 64 << 20, 1 << 16
#: A digest that more than one row in HOT has is joined by broadcast.
HOT = 1000
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the Zstandard formats: skippable frames (the second one of the
#: seek table) and the end of the footer; a set bit 7 says that checksums follow.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER = 9
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = np.dtype([("id", "S16"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])


def _located(pages: DataFrame) -> DataFrame:
    """Pages with the place (file, row) of each row, which does not change when a
    task runs again. What does not come from files is written first."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    payload = F.coalesce(F.col("html"), F.lit(""))
    columns = ["page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes")]
    try:
        return pages.select(*columns, *place)
    except AnalysisException:
        return stored(pages.select("page_id", "url", "html")).select(*columns, *place)


def typed_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (null for a revisit), digest, n_bytes, record_type and
    refers_to of each row of (page_id, url, html)."""
    rows = _located(pages)
    first = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "row")
    groups = stored(
        rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("first")).where("n > 1")
        .select("digest", "n", F.col("first.page_id").alias("first_id"), F.col("first.file").alias("first_file"), F.col("first.row").alias("first_row"))
    )
    plain = rows.select("page_id", "url", "payload", "digest", "n_bytes", F.lit("response").alias("record_type"), F.col("page_id").alias("refers_to"))
    alone = plain.withColumn("refers_to", F.when(F.lit(False), F.col("refers_to")))
    if groups.isEmpty():
        return alone
    spark = pages.sparkSession
    of_digest = spark.sparkContext.broadcast(hash_filter(groups.select(F.xxhash64("digest").alias("hash")), "hash"))
    of_first = spark.sparkContext.broadcast(hash_filter(groups.select(F.xxhash64("first_file", "first_row").alias("hash")), "hash"))
    names = rows.columns

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("payload")
        for batch in batches:
            doubt = may_be_in(of_digest.value, batch.column("digest_hash").to_numpy())
            away = doubt & ~may_be_in(of_first.value, batch.column("place_hash").to_numpy())
            columns = [batch.column(c) for c in names]
            columns[at] = pa.compute.if_else(pa.array(away), pa.scalar(None, columns[at].type), columns[at])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(doubt)], [*names, "doubt"])

    hashed = rows.withColumns({"digest_hash": F.xxhash64("digest"), "place_hash": F.xxhash64("file", "row")})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    tagged = hashed.mapInArrow(tag, f"{kinds}, doubt boolean")
    clear = tagged.where("not doubt").select(alone.columns[:5] + [F.lit("response").alias("record_type"), F.when(F.lit(False), F.col("page_id")).alias("refers_to")])
    hot = groups.where(F.col("n") * HOT > rows.count()).select("digest", *[c for c in groups.columns if c.startswith("first")])
    rest = groups.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select(hot.columns)
    found = tagged.where("doubt").join(F.broadcast(hot), "digest", "left")
    joined = found.where("first_file is not null").unionByName(found.where("first_file is null").drop(*hot.columns[1:]).join(rest, "digest", "left"))
    own = F.col("first_file").isNull() | ((F.col("first_file") == F.col("file")) & (F.col("first_row") == F.col("row")))
    return clear.unionByName(
        joined.select(
            "page_id", "url", F.when(own, F.col("payload")).alias("payload"), "digest", "n_bytes",
            F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("first_id")).alias("refers_to"),
        )
    )


def _record_id(seed: str) -> bytes:
    return hashlib.sha256(seed.encode()).digest()[:16]


def _urn(record_id: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=record_id)}>"


def _record(kind: str, record_id: bytes, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", _urn(record_id)), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return f"WARC/1.1\r\n{''.join(f'{k}: {v}\r\n' for k, v in lines if v is not None)}\r\n".encode() + block + b"\r\n\r\n"


def _skippable(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


class Bundle:
    """Chunks of one bundle as its records come in."""

    def __init__(self, name: str) -> None:
        self.name, self.size, self.count = name, 0, 0
        self._compress = zstandard.ZstdCompressor(level=3).compress
        self._frame, self._length, self._entries, self._sizes = [], 0, [], []
        self.add(_record_id(name), _record("warcinfo", _record_id(name), [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record_id: bytes, record: bytes) -> Iterator[bytes]:
        """Takes a record; the chunks that are ready."""
        ready = [self._flush()] if self._length and self._length + len(record) > FRAME else []
        self._entries.append((record_id, len(self._sizes), self._length, len(record)))
        self._frame.append(record)
        self._length += len(record)
        self.count += 1
        return ready

    def _flush(self) -> bytes:
        plain = b"".join(self._frame)
        chunk = self._compress(plain)
        self._sizes.append((len(chunk), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self._frame, self._length = [], 0
        self.size += len(chunk)
        return chunk

    def close(self) -> list[bytes]:
        """The last frame, the index and the seek table."""
        last = self._flush()
        index = _skippable(INDEX_MAGIC, np.sort(np.array(self._entries, dtype=ENTRY), order="id").tobytes())
        self._sizes.append((len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        sizes = np.array(self._sizes, dtype="<u4").tobytes()
        footer = len(self._sizes).to_bytes(4, "little") + bytes([CHECKSUMS]) + FOOTER_MAGIC.to_bytes(4, "little")
        return [last, index, _skippable(TABLE_MAGIC, sizes + footer)]


def _bundled(batches: Iterator[pa.RecordBatch], prefix: str) -> Iterator[pa.RecordBatch]:
    """(name, content) chunks of the bundles of one task."""
    task, number, bundle = TaskContext.get().partitionId(), 0, None

    def rows(chunks: list[bytes]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            yield pa.RecordBatch.from_arrays([pa.array([bundle.name]), pa.array([chunk], pa.binary())], ["name", "content"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "n_bytes", "record_type", "refers_to")]
        for page_id, url, digest, n, kind, refers_to, payload in zip(*columns, batch.column("payload")):
            if bundle is None:
                bundle = Bundle(f"{prefix}-{task:06d}-{number:04d}.warc.zst")
            response = kind == "response"
            # one response has a long payload: its id can be told from the digest
            record_id = _record_id(f"{prefix}:{digest}" if response and n >= LEAST else f"{bundle.name}:{bundle.count}")
            fields = [
                ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]-._~")),
                ("WARC-Payload-Digest", f"sha256:{digest}"),
                ("WARC-Profile", None if response else PROFILE),
                ("WARC-Refers-To", None if response else _urn(_record_id(f"{prefix}:{digest}"))),
                ("Page-ID", None if page_id is None else str(page_id)),
                ("Refers-To-Page-ID", None if refers_to is None else str(refers_to)),
                ("Content-Type", "application/http; msgtype=response"),
            ]
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
            if response:
                block += payload.as_buffer().to_pybytes()
            yield from rows(bundle.add(record_id, _record(kind, record_id, fields, block)))
            if bundle.size >= BUNDLE or bundle.count >= RECORDS:
                yield from rows(bundle.close())
                bundle, number = None, number + 1
        release_memory()
    if bundle is not None:
        yield from rows(bundle.close())


def write_warc(records: DataFrame, folder: str, prefix: str = "pages") -> None:
    """Bundles of typed records under ``folder``; ``prefix`` tells apart the record
    ids of different tables."""
    chosen = records.select("page_id", "url", "payload", "digest", "n_bytes", "record_type", "refers_to")
    write_named(chosen.mapInArrow(lambda batches: _bundled(batches, prefix), "name string, content binary"), folder)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path of every bundle; Spark lists, contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return found.repartition(max(spark.sparkContext.defaultParallelism, min(found.count(), 1 << 14))).select("path")


class Reader:
    """One bundle, read by seeking."""

    def __init__(self, path: str) -> None:
        system, inner = open_folder(path)
        self.path, self._file = path, system.open_input_file(inner)
        size = self._file.size()
        footer = self._at(size - FOOTER, FOOTER) if size >= FOOTER else b""
        if footer[5:] != FOOTER_MAGIC.to_bytes(4, "little"):
            raise ValueError(f"{path} has no seek table")
        count, wide = int.from_bytes(footer[:4], "little"), 3 if footer[4] & CHECKSUMS else 2
        held = self._at(size - FOOTER - 4 * wide * count, 4 * wide * count)
        self.sizes = np.frombuffer(held, dtype="<u4").reshape(count, wide).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        if self.starts[-1] + 8 + len(held) + FOOTER != size:
            raise ValueError(f"{path}: the seek table does not cover the file")

    def _at(self, start: int, length: int) -> bytes:
        self._file.seek(int(start))
        return self._file.read(int(length))

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, k: int) -> bytes:
        """Plain bytes; empty for the index."""
        packed, plain = self.sizes[k, :2]
        if not plain:
            return b""
        out = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], packed), max_output_size=int(plain))
        if self.sizes.shape[1] > 2 and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.sizes[k, 2]:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        return out

    def index(self) -> np.ndarray:
        """Entries (id, frame, offset, length) by id."""
        for k in np.flatnonzero(self.sizes[:, 1] == 0).tolist():
            held = self._at(self.starts[k], self.sizes[k, 0])
            if held[:4] == INDEX_MAGIC.to_bytes(4, "little"):
                return np.frombuffer(held[8:], dtype=ENTRY)
        return np.zeros(0, dtype=ENTRY)


_ID = re.compile(r"<urn:uuid:(.*)>")


def _parsed(frame: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields and block of the record at a place of a frame, and where it ends."""
    head = frame.index(b"\r\n\r\n", at)
    first, *lines = frame[at:head].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not the start of a record")
    fields = dict(line.split(": ", 1) for line in lines)
    end = head + 4 + int(fields["Content-Length"])
    return fields, frame[head + 4 : end], end + 4


def _row(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    name = _ID.fullmatch(fields["WARC-Record-ID"])[1]
    other = _ID.fullmatch(fields["WARC-Refers-To"])[1] if not response else None
    return name, fields["WARC-Type"], fields.get("Page-ID"), fields.get("Refers-To-Page-ID"), fields.get("WARC-Target-URI"), other, n, digest, payload if response else None


RECORD = "record_id string, record_type string, page_id string, refers_to string, url string, refers_to_record string, payload_bytes long, payload_digest string, payload binary"
_FIELDS = [c.split()[0] for c in RECORD.split(", ")]
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _rows(made: list[tuple], payload: bool = True) -> pa.RecordBatch:
    kinds = [_KINDS[c.split()[1]] for c in RECORD.split(", ")]
    columns = [pa.array(v, k) for v, k in zip(zip(*made), kinds)][: None if payload else -1]
    return pa.RecordBatch.from_arrays(columns, _FIELDS[: len(columns)])


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records (RECORD) of the bundles under ``folder``, frame by frame; every
    payload is held against its digest, whether it is returned or not."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                bundle = Reader(path)
                for k in range(len(bundle)):
                    frame, at, made = bundle.frame(k), 0, []
                    while at < len(frame):
                        fields, block, at = _parsed(frame, at)
                        if fields["WARC-Type"] != "warcinfo":
                            made.append(_row(fields, block))
                    if made:
                        yield _rows(made, payload)
                release_memory()

    schema = RECORD if payload else RECORD.rpartition(", ")[0]
    return archives(spark, folder).mapInArrow(read, schema)


def record_index(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, archive, frame, offset and length of every record, from the
    indexes alone: no frame is decompressed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = Reader(path).index()
                ids = pa.array([str(uuid.UUID(bytes=x.ljust(16, b"\0"))) for x in found["id"].tolist()], pa.string())
                columns = [ids, pa.array([path] * len(found), pa.string()), *(pa.array(found[c].astype(np.int64)) for c in ("frame", "offset", "length"))]
                yield pa.RecordBatch.from_arrays(columns, ["record_id", "archive", "frame", "offset", "length"])

    return archives(spark, folder).mapInArrow(read, "record_id string, archive string, frame long, offset long, length long")


def fetch_records(places: DataFrame) -> DataFrame:
    """The records (RECORD) at rows of :func:`record_index`; each costs one frame,
    and neighbouring rows of one frame share it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, frame = None, b""
            bundle = None
            for path, k, offset in zip(*(batch.column(c).to_pylist() for c in ("archive", "frame", "offset"))):
                if held is None or held[0] != path:
                    bundle = Reader(path)
                if held != (path, k):
                    held, frame = (path, k), bundle.frame(k)
                fields, block, _ = _parsed(frame, offset)
                if fields["WARC-Type"] != "warcinfo":
                    yield _rows([_row(fields, block)])

    return places.select("archive", "frame", "offset").repartition("archive", "frame").sortWithinPartitions("archive", "frame", "offset").mapInArrow(read, RECORD)


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind, folder = pages.schema["page_id"].dataType, f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    write_warc(typed_records(pages), folder)
    system, inner = open_folder(folder)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return pages.limit(0).selectExpr("page_id", "0L payload_bytes", "'' payload_digest", "'' record_type", "page_id refers_to")
    read = read_warc(spark, folder, payload=False)
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: The same result from the table, without archives.
ORACLE = f"""
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {LEAST} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND place > 1 THEN first_id END AS refers_to
FROM (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id
  FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages)
  WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST))
"""
