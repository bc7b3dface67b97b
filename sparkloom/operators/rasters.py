"""Images in blocks: arrays of pixels instead of a row for each.

A block row has image_id, its place and size (x0, y0, w, h), the size of its image
(width, height) and an array of values for each band, row by row. Pixel tables are
shuffled once, to make blocks; crops, resizing and thumbnails then work inside
blocks. None needs its neighbours' pixels: a crop cuts arrays, a resized pixel has one
source pixel, and a thumbnail pixel is a sum over up to four source pixels, to which
each block adds its own share. So only target pixels are shuffled, and those of
thumbnails alone.

Results are those of the pixel forms in :mod:`pixels`. A block with missing or
repeated pixels is an error when it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 256
_PLACE = ("image_id", "x0", "y0", "w", "h", "width", "height")


def to_blocks(px: DataFrame, bands: Sequence[str], size: int = SIZE) -> DataFrame:
    """Blocks of ``size`` x ``size`` pixels; those at the right and lower edge hold
    what is left."""
    bx, by = F.expr(f"x div {size}"), F.expr(f"y div {size}")
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *bands)))
    blocks = px.groupBy("image_id", bx.alias("bx"), by.alias("by")).agg(
        F.max("x").alias("x1"), F.max("y").alias("y1"), cells.alias("cells")
    )
    dims = blocks.groupBy("image_id").agg((F.max("x1") + 1).alias("width"), (F.max("y1") + 1).alias("height"))
    x0, y0 = F.col("bx") * size, F.col("by") * size
    placed = blocks.join(dims, "image_id").select(
        "image_id", x0.cast("int").alias("x0"), y0.cast("int").alias("y0"),
        F.least(F.lit(size), F.col("width") - x0).cast("int").alias("w"), F.least(F.lit(size), F.col("height") - y0).cast("int").alias("h"),
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "cells",
    )
    places = F.array_distinct(F.transform("cells", lambda c: c["y"].cast("long") * (1 << 32) + c["x"]))
    whole = (F.size("cells") == F.col("w") * F.col("h")) & (F.size(places) == F.col("w") * F.col("h"))
    checked = F.when(whole, F.col("cells")).otherwise(F.raise_error(F.lit("a block needs every pixel once")))
    return placed.select(*_PLACE, *(_band(checked, b).alias(b) for b in bands))


def _band(cells: Column, band: str) -> Column:
    return F.transform(cells, lambda c: c[band])


def from_blocks(blocks: DataFrame, bands: Sequence[str]) -> DataFrame:
    """The pixel table again."""
    rows = blocks.select("image_id", "x0", "y0", "w", F.posexplode(F.arrays_zip(*bands)).alias("pos", "cell"))
    x, y = F.col("x0") + F.col("pos") % F.col("w"), F.col("y0") + F.expr("int(pos div w)")
    return rows.select("image_id", x.alias("x"), y.alias("y"), *(F.col(f"cell.{b}").alias(b) for b in bands))


def crop_blocks(blocks: DataFrame, bands: Sequence[str], n: int) -> DataFrame:
    """Without the n outer pixels on each side; coordinates start at 0 again. Blocks
    outside go, blocks on the edge are cut."""
    left, top = F.greatest("x0", F.lit(n)), F.greatest("y0", F.lit(n))
    right = F.least(F.col("x0") + F.col("w"), F.col("width") - n)
    low = F.least(F.col("y0") + F.col("h"), F.col("height") - n)
    rows = blocks.withColumns({"_l": left, "_t": top, "_w": right - left, "_h": low - top}).where("_w > 0 AND _h > 0")
    lines = F.sequence(F.col("_t") - F.col("y0"), F.col("_t") - F.col("y0") + F.col("_h") - 1)

    def cut(band: str) -> Column:
        start = lambda y: y * F.col("w") + F.col("_l") - F.col("x0") + 1
        return F.flatten(F.transform(lines, lambda y: F.slice(band, start(y), F.col("_w"))))

    # apart from the new names, which a lambda would take for the old ones
    rows = rows.withColumns({f"_cut_{b}": cut(b) for b in bands})
    return rows.select(
        "image_id", (F.col("_l") - n).alias("x0"), (F.col("_t") - n).alias("y0"), F.col("_w").alias("w"), F.col("_h").alias("h"),
        (F.col("width") - 2 * n).alias("width"), (F.col("height") - 2 * n).alias("height"), *(F.col(f"_cut_{b}").alias(b) for b in bands),
    )


def _at(band: str, x: Column, y: Column) -> Column:
    return F.get(band, ((y - F.col("y0")) * F.col("w") + x - F.col("x0")).cast("int"))


def _made(xs: Column, ys: Column, cell) -> Column:
    """``cell(x, y)`` for all target places, computed beside the arrays, so that
    these are not copied to a row for each."""
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: cell(x, y))))


def _steps(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def resize_blocks(blocks: DataFrame, bands: Sequence[str], width: int, height: int) -> DataFrame:
    """Pixels of each image at another size, each from the nearest pixel below in
    integer arithmetic. A block makes the pixels that it is the source of."""

    def own(at: str, n: str, of: str, goal: int) -> Column:
        up = lambda v: F.ceil(v.cast("long") * goal / F.col(of)).cast("int")  # noqa: E731  first target at or after v
        return _steps(up(F.col(at)), up(F.col(at) + F.col(n)) - 1)

    def cell(tx: Column, ty: Column) -> Column:
        x, y = F.floor(tx.cast("long") * F.col("width") / width).cast("int"), F.floor(ty.cast("long") * F.col("height") / height).cast("int")
        return F.struct(tx.alias("x"), ty.alias("y"), *(_at(b, x, y).alias(b) for b in bands))

    return blocks.select("image_id", F.inline(_made(own("x0", "w", "width", width), own("y0", "h", "height", height), cell)))


def thumbnails_of_blocks(blocks: DataFrame, size: int, value: str = "v") -> DataFrame:
    """Corner-aligned bilinear thumbnails (image_id, x, y, v), truncated."""
    step = {n: F.when(F.lit(size > 1), (F.col(n) - 1) / F.lit(max(size - 1, 1))).otherwise(0.0) for n in ("width", "height")}

    def own(at: str, n: str, of: str) -> Column:
        """Target places that may have a neighbour in the block; one more on each side."""
        first = F.greatest(F.floor((F.col(at) - 1) / step[of]) - 1, F.lit(0))
        last = F.least(F.ceil((F.col(at) + F.col(n)) / step[of]) + 1, F.lit(size - 1))
        return F.when(step[of] > 0, _steps(first.cast("int"), last.cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(size - 1)))

    def cell(tx: Column, ty: Column) -> Column:
        sx, sy = tx * step["width"], ty * step["height"]
        x, y = F.floor(sx), F.floor(sy)
        fx, fy = sx - x, sy - y
        total, n = F.lit(0.0), F.lit(0)
        for a in (0, 1):
            for b in (0, 1):
                weight = (fx if a else 1 - fx) * (fy if b else 1 - fy)
                inside = (x + a >= F.col("x0")) & (x + a < F.col("x0") + F.col("w")) & (y + b >= F.col("y0")) & (y + b < F.col("y0") + F.col("h")) & (weight > 0)
                total = total + F.when(inside, weight * _at(value, x + a, y + b)).otherwise(0.0)
                n = n + inside.cast("int")
        return F.struct(tx.alias("x"), ty.alias("y"), total.alias("part"), n.alias("n"))

    parts = blocks.select("image_id", F.inline(F.filter(_made(own("x0", "w", "width"), own("y0", "h", "height"), cell), lambda c: c["n"] > 0)))
    return parts.groupBy("image_id", "x", "y").agg(F.floor(F.round(F.sum("part"), 6)).cast("int").alias(value))
