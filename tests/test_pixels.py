"""Images: worked coordinates and round trips."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import pixels as P
from sparkloom.sources.tables import blank_pixels, read_images


@pytest.fixture(scope="module")
def image(spark):
    rows = [(7, x, y, x * 10, y * 10, (x + y) * 10) for x in range(5) for y in range(4)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int").cache()


def rows(df):
    return sorted(tuple(r) for r in df.select("image_id", "x", "y", "r", "g", "b").collect())


def test_crop_sizes(spark):
    px = blank_pixels(spark, 222, 222)
    small = P.crop(px, 30, P.image_dims(px))
    assert small.count() == 162 * 162
    assert small.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first() == (0, 161, 0, 161)


def test_crop_undoes_border(image):
    dims = P.image_dims(image)
    framed = P.border(image, dims, 3)
    assert framed.count() == 11 * 10
    assert rows(P.crop(framed, 3, P.image_dims(framed))) == rows(image)


def test_stripe(spark):
    px = blank_pixels(spark, 400, 200, (255, 255, 0))
    stripe = px.where("x >= 390").select("image_id", "x", "y", F.lit(0), F.lit(255), F.lit(0))
    out = P.set_pixels(px, stripe)
    assert out.where("r = 0 and g = 255 and b = 0").count() == 10 * 200
    assert out.where("r = 255 and g = 255 and b = 0").count() == 390 * 200


def test_no_pixels_is_an_error(spark):
    with pytest.raises(ValueError):
        blank_pixels(spark, 0, 5)


def test_reflection(image):
    twice = P.reflect(image, P.image_dims(image))
    twice = P.reflect(twice, P.image_dims(twice))
    assert twice.count() == 4 * 20
    at = {(r[1], r[2]): r[3:] for r in rows(twice)}
    assert all(at[x, y] == at[x, 7 - y] for x in range(5) for y in range(4))


def test_clamp(spark):
    df = spark.createDataFrame([(-3.9,), (12.99,), (255.5,), (382.5,), (None,)], "v double")
    assert [r[0] for r in df.select(P.clamp8(F.col("v"))).collect()] == [0, 12, 255, 255, None]


def test_strict_bounds(image):
    dims = P.image_dims(image).withColumn("width", F.lit(3))
    assert P.require_in_bounds(image, dims).count() == 12
    with pytest.raises(Exception, match="outside"):
        P.require_in_bounds(image, dims, strict=True).collect()


def test_missing_back_pixel(image):
    back = image.where("x < 2").withColumn("b", F.lit(1))
    assert P.blue_screen(image, back).count() == 20
    with pytest.raises(Exception, match="no pixel behind"):
        P.blue_screen(image, back.limit(0), strict=True).collect()


def test_thumbnails_broadcast_no_target_pixels(spark):
    rows = spark.range(200).selectExpr("id AS image_id", "explode(sequence(0, 63)) AS p")
    px = rows.selectExpr("image_id", "p % 8 AS x", "p div 8 AS y", "p AS r")
    small = P.thumbnails(px, P.image_dims(px), 5, "r")
    assert len(small.collect()) == 200 * 25
    plan = small._jdf.queryExecution().executedPlan().toString()  # as it ran: adaptive, final
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_both_thumbnail_paths_agree(spark, image):
    px = image.withColumn("v", F.col("r") + F.col("g") * 2)
    table = sorted(tuple(r) for r in P.thumbnails(px, P.image_dims(px), 3).collect())
    blob = spark.createDataFrame([(7, 5, 4, [float(x * 10 + y * 20) for y in range(4) for x in range(5)])], "image_id long, width int, height int, pixels array<double>")
    flat = P.thumbnail_blobs(blob, 3).first()["thumbnail"]
    assert table == [(7, x, y, flat[y * 3 + x]) for x in range(3) for y in range(3)]


def png(width, height, rgb):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, (1, 2, 3)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    good = read_images(spark, str(tmp_path), drop_invalid=True).collect()
    assert [(r["width"], r["height"], bytes(r["rgb"])) for r in good] == [(3, 2, bytes((1, 2, 3)) * 6)]
    assert read_images(spark, str(tmp_path)).count() == 2
