"""Image files as a data source, and pixel tables as image files.

``spark.read.format("image_files").load(folder)`` gives a row per BMP or PNG file:
path, modified, length, width, height, channels, the bytes of the pixels row by row
(``rgb``; grey and transparency as the file has them), and ``problem``. A file that
cannot be decoded is a row of width -1 that names its problem, or no row with
``option("dropInvalid", True)``. Options: ``recursive`` (default true), ``suffixes``
(default ``.bmp,.png``, any case), ``partitionBytes``.

The folder is listed once, folder by folder, and dealt into partitions of about
``partitionBytes``; the driver holds names and sizes, tasks read and decode.
Rows leave a task in Arrow batches of bounded size (a larger image is one row).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sparkloom.sources.folders import files_below, open_folder
from sparkloom.sources.named_files import write_named

#: Bytes of files in a partition, and of pixels in an Arrow batch.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
#: A file counts as so many bytes at least.
OPEN_COST = 1 << 16

SCHEMA = "path string, modified timestamp, length long, width int, height int, channels int, rgb binary, problem string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

#: Fixed values of the published formats.
BMP_MAGIC, BMP_HEADER = b"BM", struct.Struct("<2sIHHIIiiHHIIiiII")
PNG_MAGIC, PNG_CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}


def encode_bmp(width: int, height: int, rgb: bytes) -> bytes:
    """24-bit BMP: rows from the bottom up, blue first, padded to four bytes."""
    pixels = np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3)[::-1, :, ::-1]
    rows = np.zeros((height, -(-3 * width // 4) * 4), dtype=np.uint8)
    rows[:, : 3 * width] = pixels.reshape(height, 3 * width)
    size = BMP_HEADER.size
    return BMP_HEADER.pack(BMP_MAGIC, size + rows.size, 0, 0, size, 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> tuple[int, int, int, bytes]:
    if len(data) < BMP_HEADER.size:
        raise ValueError("truncated header")
    *_, offset, _, width, height, _, bits, packing, _, _, _, _, _ = BMP_HEADER.unpack_from(data)
    if bits not in (24, 32) or packing:
        raise ValueError(f"BMP of {bits} bits and packing {packing}")
    if width <= 0 or not height:
        raise ValueError("no pixels")
    stride, channels = -(-width * bits // 32) * 4, bits // 8
    if len(data) < offset + stride * abs(height):
        raise ValueError("truncated pixels")
    rows = np.frombuffer(data, dtype=np.uint8, count=stride * abs(height), offset=offset).reshape(abs(height), stride)
    pixels = rows[:, : width * channels].reshape(abs(height), width, channels)[:, :, 2::-1]
    return width, abs(height), 3, (pixels[::-1] if height > 0 else pixels).tobytes()


def _png_chunk(kind: bytes, content: bytes) -> bytes:
    return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))


def encode_png(width: int, height: int, rgb: bytes) -> bytes:
    rows = np.zeros((height, 1 + 3 * width), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(rgb, dtype=np.uint8).reshape(height, 3 * width)
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return PNG_MAGIC + _png_chunk(b"IHDR", header) + _png_chunk(b"IDAT", zlib.compress(rows.tobytes())) + _png_chunk(b"IEND", b"")


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    """One row of a PNG without its filter."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, channels), axis=0, dtype=np.uint8).ravel()
    out = bytearray(channels) + bytearray(len(row))  # pixels left of the first are 0
    up = bytes(channels) + above.tobytes()
    for i, value in enumerate(row.tolist(), channels):
        left, top, corner = out[i - channels], up[i], up[i - channels]
        if kind == 3:
            guess = (left + top) >> 1
        else:
            p = left + top - corner
            guess = min((left, top, corner), key=lambda x: abs(p - x))
        out[i] = (value + guess) & 255
    return np.frombuffer(bytes(out[channels:]), dtype=np.uint8)


def decode_png(data: bytes) -> tuple[int, int, int, bytes]:
    at, header, packed = len(PNG_MAGIC), None, []
    while True:
        length, kind = struct.unpack_from(">I4s", data, at) if at + 12 <= len(data) else (len(data), b"")
        content = data[at + 8 : at + 8 + length]
        if at + 12 + length > len(data):
            raise ValueError("truncated")
        if struct.unpack_from(">I", data, at + 8 + length)[0] != zlib.crc32(kind + content):
            raise ValueError(f"damaged {kind.decode('latin-1')}")
        at += 12 + length
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            packed.append(content)
        elif kind == b"IEND":
            break
    if header is None:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlaced = header
    if bits != 8 or colour not in PNG_CHANNELS or interlaced:
        raise ValueError(f"PNG of {bits} bits, colour type {colour}, interlacing {interlaced}")
    if not width or not height:
        raise ValueError("no pixels")
    channels = PNG_CHANNELS[colour]
    plain = zlib.decompress(b"".join(packed))
    if len(plain) != height * (1 + width * channels):
        raise ValueError("truncated pixels")
    rows = np.frombuffer(plain, dtype=np.uint8).reshape(height, 1 + width * channels)
    above, out = np.zeros(width * channels, dtype=np.uint8), []
    for row in rows:
        if row[0] > 4:
            raise ValueError(f"unknown filter {row[0]}")
        above = _unfiltered(int(row[0]), row[1:], above, channels)
        out.append(above.tobytes())
    return width, height, channels, b"".join(out)


def decoded(data: bytes) -> tuple:
    """width, height, channels, rgb and problem of a file's bytes."""
    try:
        if data[:2] == BMP_MAGIC:
            return *decode_bmp(data), None
        if data[:8] == PNG_MAGIC:
            return *decode_png(data), None
        raise ValueError("neither BMP nor PNG")
    except (ValueError, struct.error, zlib.error) as error:
        return -1, -1, -1, None, str(error)


@dataclass
class FileRange(InputPartition):
    """Files of one partition: (path, length, modified in microseconds)."""

    files: list[tuple[str, int, int]]


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("image_files needs the path of a folder")
        self.path = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.drop = options.get("dropinvalid", options.get("dropInvalid", "false")).lower() == "true"
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", ".bmp,.png").split(","))
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[FileRange]:
        system, root = open_folder(self.path)
        out, held, size = [], [], 0
        for info in files_below(system, root, self.recursive):
            if not info.path.lower().endswith(self.suffixes):
                continue
            if held and size + info.size > self.bytes:
                out.append(FileRange(held))
                held, size = [], 0
            held.append((info.path, info.size, info.mtime_ns // 1000 if info.mtime_ns else 0))
            size += max(info.size, OPEN_COST)
        return [*out, FileRange(held)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        rows, size = [], 0
        for path, length, modified in partition.files:
            with system.open_input_stream(path, compression=None) as file:
                found = decoded(file.read())
            if found[-1] is not None and self.drop:
                continue
            rows.append((path, modified, length, *found))
            size += len(found[3] or b"")
            if size > BATCH_BYTES or len(rows) >= 4096:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), _ARROW)], _NAMES)


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(dict(self.options))


def read_image_files(spark: SparkSession, path: str, drop_invalid: bool = False, **options: str) -> DataFrame:
    spark.dataSource.register(ImageFiles)
    return spark.read.format("image_files").options(dropInvalid=drop_invalid, **options).load(path)


def image_bytes(px: DataFrame) -> DataFrame:
    """(image_id, width, height, rgb) of pixel tables (image_id, x, y, r, g, b). A
    pixel that is missing, given twice, or not within 0..255 is an error: a file has
    no holes."""
    level = lambda c: F.lpad(F.hex(c), 2, "0")
    cell = F.struct("y", "x", F.concat(level("r"), level("g"), level("b")).alias("hex"))
    whole = px.groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count_distinct("x", "y").alias("places"), F.count("*").alias("n"),
        F.min(F.least("x", "y")).alias("least"), F.min(F.least("r", "g", "b")).alias("low"), F.max(F.greatest("r", "g", "b")).alias("high"),
        F.array_sort(F.collect_list(cell)).alias("cells"),
    )
    full = (F.col("n") == F.col("places")) & (F.col("n") == F.col("width") * F.col("height")) & (F.col("least") == 0) & (F.col("low") >= 0) & (F.col("high") <= 255)
    checked = F.when(full, F.col("cells")).otherwise(F.raise_error(F.lit("an image needs every pixel once, within 0..255")))
    return whole.select("image_id", "width", "height", F.unhex(F.array_join(F.transform(checked, lambda c: c["hex"]), "")).alias("rgb"))


def image_file_rows(images: DataFrame, kind: str = "png", name: str = "name") -> DataFrame:
    """(name, content) of (width, height, rgb); ``kind`` is png or bmp, or the
    suffix of each name with ``kind="suffix"``."""
    if kind not in ("png", "bmp", "suffix"):
        raise ValueError(f"unknown kind {kind!r}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, width, height, rgb in zip(*(c.to_pylist() for c in batch.columns)):
                bmp = kind == "bmp" or (kind == "suffix" and own.lower().endswith(".bmp"))
                content = (encode_bmp if bmp else encode_png)(width, height, rgb)
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([content], pa.binary())], ["name", "content"])

    return images.select(F.col(name).alias("name"), "width", "height", "rgb").mapInArrow(encode, "name string, content binary")


def write_images(images: DataFrame, path: str, kind: str = "png", mode: str = "append") -> None:
    """A file for each (name, width, height, rgb), whole or not at all (see
    :mod:`named_files`)."""
    write_named(image_file_rows(images, kind), path, mode)
