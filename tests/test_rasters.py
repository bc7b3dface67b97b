"""Images in blocks give what their pixel tables give."""

import random

import pytest

from sparkloom.operators import pixels as P
from sparkloom.operators import rasters as R


@pytest.fixture(scope="module")
def px(spark):
    rng, rows = random.Random(6), []
    for image_id, (width, height) in {1: (1, 1), 2: (7, 5), 3: (13, 1), None: (2, 3), 5: (16, 16), 6: (11, 17)}.items():
        if image_id is not None:
            rows += [(image_id, x, y, *(rng.randrange(256) for _ in range(3)), "x") for x in range(width) for y in range(height)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, w string").repartition(3).cache()


def rows(df):
    return sorted(map(tuple, df.select("image_id", "x", "y", *[c for c in df.columns if c not in P.XY]).collect()))


@pytest.mark.parametrize("size", [1, 4, 256])
def test_blocks_and_crops(px, size):
    blocks, plain = R.to_blocks(px, P.RGB, size), px.select(*P.XY, *P.RGB)
    assert rows(R.from_blocks(blocks, P.RGB)) == rows(plain)
    for n in (0, 2, 4):
        cropped = R.crop_blocks(blocks, P.RGB, n)
        assert rows(R.from_blocks(cropped, P.RGB)) == rows(P.crop(plain, n, P.image_dims(px)))
    again = R.thumbnails_of_blocks(R.crop_blocks(blocks, P.RGB, 2), 3, "g")
    smaller = P.crop(plain, 2, P.image_dims(px))
    assert rows(again) == rows(P.thumbnails(smaller, P.image_dims(smaller), 3, "g"))


@pytest.mark.parametrize("size", [1, 4, 256])
def test_thumbnails_and_sizes(px, size):
    blocks, dims = R.to_blocks(px, P.RGB, size), P.image_dims(px)
    for n in (1, 4, 23):
        assert rows(R.thumbnails_of_blocks(blocks, n, "r")) == rows(P.thumbnails(px, dims, n, "r"))
    target = dims.selectExpr("image_id", "9 AS width", "25 AS height")
    assert rows(R.resize_blocks(blocks, P.RGB, 9, 25)) == rows(P.resize_like(px, dims, target))


def test_crops_and_sizes_shuffle_nothing(px):
    blocks = R.to_blocks(px, P.RGB, 4)
    made = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    before = made(blocks)
    assert made(R.crop_blocks(blocks, P.RGB, 1)) == made(R.resize_blocks(blocks, P.RGB, 3, 3)) == before
    assert made(R.thumbnails_of_blocks(blocks, 4, "r")) == before + 1


def test_a_hole_is_an_error(px):
    for bad in (px.where("NOT (image_id = 2 AND x = 1 AND y = 1)"), px.unionByName(px.where("image_id = 2 AND x = 1 AND y = 1"))):
        with pytest.raises(Exception, match="every pixel once"):
            R.to_blocks(bad, P.RGB, 4).collect()
    assert R.thumbnails_of_blocks(R.to_blocks(px.limit(0), ["r"]), 3, "r").count() == 0
