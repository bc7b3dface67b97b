"""The image source and sink: formats, damage, partitions, and Spark's own decoder."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import image_files as M
from sparkloom.sources.tables import read_images


def picture(rng, width, height, channels=3):
    return bytes(rng.randrange(256) for _ in range(width * height * channels))


@pytest.mark.parametrize("width, height", [(1, 1), (3, 2), (5, 7), (16, 1)])
def test_round_trip(width, height):
    rgb = picture(random.Random(width), width, height)
    assert M.decoded(M.encode_bmp(width, height, rgb)) == (width, height, 3, rgb, None)
    assert M.decoded(M.encode_png(width, height, rgb)) == (width, height, 3, rgb, None)


def png(width, height, colour, rows):
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    packed = zlib.compress(b"".join(rows))
    return M.PNG_MAGIC + M._png_chunk(b"IHDR", header) + M._png_chunk(b"IDAT", packed[:5]) + M._png_chunk(b"IDAT", packed[5:]) + M._png_chunk(b"IEND", b"")


@pytest.mark.parametrize("colour, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_filter(colour, channels):
    """Rows filtered by the rules of the format, value by value."""
    rng, width, height = random.Random(colour), 9, 15
    raw = np.frombuffer(picture(rng, width, height, channels), dtype=np.uint8).reshape(height, width * channels)
    rows = []
    for y in range(height):
        kind, row = y % 5, [y % 5]
        for x in range(width * channels):
            left = int(raw[y, x - channels]) if x >= channels else 0
            up = int(raw[y - 1, x]) if y else 0
            corner = int(raw[y - 1, x - channels]) if y and x >= channels else 0
            p = left + up - corner
            paeth = min([left, up, corner], key=lambda v: abs(p - v))
            row.append((int(raw[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        rows.append(bytes(row))
    assert M.decoded(png(width, height, colour, rows)) == (width, height, channels, raw.tobytes(), None)


@pytest.mark.parametrize("kind", [M.encode_bmp, M.encode_png])
def test_damage_is_named(kind):
    data = kind(6, 5, picture(random.Random(3), 6, 5))
    for cut in range(0, len(data), 7):
        assert M.decoded(data[:cut])[:4] == (-1, -1, -1, None) and M.decoded(data[:cut])[4]
    assert M.decoded(b"GIF89a" + data)[4] == "neither BMP nor PNG"


def test_a_changed_png_is_damaged():
    data = bytearray(M.encode_png(6, 5, picture(random.Random(3), 6, 5)))
    data[len(data) // 2] ^= 1
    assert "damaged" in M.decoded(bytes(data))[4]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("images"), random.Random(9)
    rows = [(f"{'ab'[i % 2]}/{i}.{('bmp', 'png')[i % 3 > 0]}", 2 + i % 5, 3 + i % 4, picture(rng, 2 + i % 5, 3 + i % 4)) for i in range(24)]
    M.write_images(spark.createDataFrame(rows, "name string, width int, height int, rgb binary").repartition(3), f"{folder}/out", "suffix")
    (folder / "out/a/broken.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (folder / "out/a/notes.txt").write_text("no image")
    (folder / "out/_hidden").mkdir()
    (folder / "out/_hidden/x.png").write_bytes(b"")
    return f"{folder}/out", {r[0]: r[1:] for r in rows}


def test_source(spark, folder):
    path, want = folder
    rows = {"/".join(r["path"].split("/")[-2:]): r for r in M.read_image_files(spark, path, partitionBytes="200000").collect()}
    broken = rows.pop("a/broken.png")
    assert broken["width"] == -1 and broken["rgb"] is None and broken["problem"] == "truncated"
    assert {k: (r["width"], r["height"], bytes(r["rgb"])) for k, r in rows.items()} == want
    assert all(r["modified"] is not None and r["length"] > 0 for r in rows.values())
    assert M.read_image_files(spark, path, drop_invalid=True).count() == 24
    assert M.read_image_files(spark, path, partitionBytes="200000").rdd.getNumPartitions() > 4
    assert M.read_image_files(spark, path, recursive="false").count() == 0
    assert M.read_image_files(spark, path, suffixes=".bmp").count() == sum(k.endswith(".bmp") for k in want)


def test_as_spark_decodes_them(spark, folder):
    path, want = folder
    rows = read_images(spark, f"{path}/*", drop_invalid=True).collect()
    assert {"/".join(r["path"].split("/")[-2:]): (r["width"], r["height"], bytes(r["rgb"])) for r in rows} == want


def test_pixel_tables(spark):
    px = [(7, x, y, 10 * x, 20 * y, 255) for x in range(3) for y in range(2)]
    columns = "image_id long, x int, y int, r int, g int, b int"
    row = M.image_bytes(spark.createDataFrame(px, columns).repartition(4)).collect()[0]
    assert (row["width"], row["height"]) == (3, 2)
    assert bytes(row["rgb"]) == b"".join(bytes([10 * x, 20 * y, 255]) for y in range(2) for x in range(3))
    for bad in (px[1:], px + px[:1], [(7, 0, 0, 256, 0, 0)], [(7, 0, 0, -1, 0, 0)]):
        with pytest.raises(Exception, match="every pixel once"):
            M.image_bytes(spark.createDataFrame(bad, columns)).select(F.hex("rgb")).collect()
