"""Images as pixel tables (image_id, x, y, r, g, b) and voxel tables.

Every operator is a projection, an equi-join or an aggregate, so images spread
over tasks by pixel; parameter tables have a handful of rows and become literals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.quantiles import exact_quantiles
from sparkloom.operators.scans import Previous, segmented

RGB = ("r", "g", "b")
XY = ("image_id", "x", "y")


def clamp8(value: Column) -> Column:
    """Truncated to an integer and limited to 0..255; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(255)))


def mean3() -> Column:
    """Integer mean of the channels."""
    return F.floor((F.col("r") + F.col("g") + F.col("b")) / 3).cast("int")


def _coloured(px: DataFrame, rgb: Sequence[Column]) -> DataFrame:
    return px.withColumns(dict(zip(RGB, rgb)))


def scale_channels(px: DataFrame, kr: float, kg: float, kb: float) -> DataFrame:
    return _coloured(px, [clamp8(F.col(c) * k) for c, k in zip(RGB, (kr, kg, kb))])


def grey_above(px: DataFrame, share: float = 0.6) -> DataFrame:
    """Pixels brighter than a share of 255 become grey."""
    return _coloured(px, [F.when(mean3() > 255 * share, mean3()).otherwise(F.col(c)) for c in RGB])


def highlight_red(px: DataFrame, factor: float = 1.0) -> DataFrame:
    """Pixels whose red reaches the mean (times a factor) become red, others grey."""
    fire = F.col("r") >= mean3() * factor
    return _coloured(px, [F.when(fire, F.lit(v)).otherwise(mean3()) for v in (255, 0, 0)])


def is_blue(share: float = 1.6) -> Column:
    return F.col("b") >= mean3() * share


def crop(px: DataFrame, n: int, dims: DataFrame) -> DataFrame:
    """Without the n outer pixels on each side; coordinates start at 0 again."""
    inside = F.col("x").between(n, F.col("width") - n - 1) & F.col("y").between(n, F.col("height") - n - 1)
    rows = px.join(dims, "image_id").where(inside)
    return rows.select("image_id", (F.col("x") - n).alias("x"), (F.col("y") - n).alias("y"), *RGB)


def image_dims(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def squeeze_z(vox: DataFrame) -> DataFrame:
    """Volumes of depth 1 as 2-D images; deeper ones are left out."""
    flat = vox.groupBy("image_id").agg(F.max("z").alias("depth")).where("depth = 0")
    return vox.join(flat, "image_id", "left_semi").drop("z")


def luminance(px: DataFrame) -> DataFrame:
    """``light``: weighted channels through the two-branch curve. As in the
    published form followed here, 0.55 is taken off both branches."""
    linear = (F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722) / 255
    curve = F.when(linear <= 0.0031308, linear * 12.92).otherwise(F.pow(linear, F.lit(1 / 2.4)) * 1.055)
    return px.withColumn("light", curve - 0.55)


def pick_tile(points: DataFrame, tw: int, th: int, tx: int, ty: int) -> DataFrame:
    """``tile_no`` under each point (event_x, event_y, slice); points are rounded
    half to even first."""
    x, y = F.bround("event_x").cast("int"), F.bround("event_y").cast("int")
    number = F.col("slice") * (tx * ty) + F.expr(f"int(bround(event_y)) div {th}") * tx + F.expr(f"int(bround(event_x)) div {tw}")
    return points.withColumns({"px": x, "py": y, "tile_no": number.cast("bigint")})


def require_in_bounds(px: DataFrame, dims: DataFrame, strict: bool = False) -> DataFrame:
    """Pixels inside their image; with ``strict`` one outside raises on reading."""
    rows = px.join(dims, "image_id")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
    if strict:
        inside = F.assert_true(inside, F.lit("pixel outside the image")).isNull()
    return rows.where(inside).drop("width", "height")


def blue_screen(front: DataFrame, back: DataFrame, share: float = 1.6, strict: bool = False) -> DataFrame:
    """Blue pixels of the front replaced by the back's at the same place. Where
    the back has none the front stays, or with ``strict`` reading raises."""
    behind = back.toDF(*XY, "r2", "g2", "b2")
    rows = front.join(behind, list(XY), "left")
    if strict:
        there = ~is_blue(share) | F.col("r2").isNotNull()
        rows = rows.where(F.assert_true(there, F.lit("no pixel behind")).isNull())
    return _coloured(rows, [F.when(is_blue(share), F.coalesce(c + "2", c)).otherwise(F.col(c)) for c in RGB]).drop("r2", "g2", "b2")


#: Red, green and blue factors, column and row of each patch.
PATCHES = (
    (1.5, 0.0, 1.5, 0, 0),
    (1.2, 0.3, 0.5, 1, 0),
    (0.0, 2.0, 0.1, 2, 0),
    (1.1, 0.0, 3.0, 0, 1),
    (1.5, 2.0, 0.0, 1, 1),
    (1.0, 0.1, 0.0, 2, 1),
)


def patch_montage(px: DataFrame, dims: DataFrame, patches: Sequence[tuple] = PATCHES) -> DataFrame:
    """Each image repeated in recoloured patches on a grid."""
    names = ("kr", "kg", "kb", "col", "row")
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p))) for p in patches]
    out = px.join(dims, "image_id").select("*", F.inline(F.array(*rows)))
    scaled = [clamp8(F.col(c) * F.col("k" + c)).alias(c) for c in RGB]
    x, y = F.col("x") + F.col("col") * F.col("width"), F.col("y") + F.col("row") * F.col("height")
    return out.select("image_id", x.alias("x"), y.alias("y"), *scaled)


def paste(canvas: DataFrame, px: DataFrame, dx: int, dy: int) -> DataFrame:
    """The image on the canvas, shifted; where both have a pixel the image's wins."""
    top = px.select("image_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *(F.col(c).alias(c + "2") for c in RGB))
    rows = canvas.join(top, list(XY), "full")
    return rows.select(*XY, *(F.coalesce(c + "2", c).alias(c) for c in RGB))


def tile_index(images: DataFrame, tx: int, ty: int, tw: int, th: int) -> DataFrame:
    """``slice``, ``x0`` and ``y0`` of numbered images (``row_no`` from 0, see
    :func:`sparkloom.operators.ordered.global_number`)."""
    n = F.col("row_no")
    inside = n % (tx * ty)
    return images.withColumns(
        {
            "slice": F.floor(n / (tx * ty)),
            "x0": (inside % tx) * tw,
            "y0": F.floor(inside / tx) * th,
        }
    )


def tile_lookup(picks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Picks with the tile of their number; numbers past the end drop out."""
    return picks.join(tiles, "tile_no")


def distinct_picks(picks: DataFrame) -> DataFrame:
    return picks.select("tile_no").distinct()


def get_pixels(px: DataFrame, points: DataFrame) -> DataFrame:
    return points.select(*XY).join(px, list(XY))


def set_pixels(px: DataFrame, updates: DataFrame) -> DataFrame:
    """The image with updated pixels, clamped; updates outside it are ignored."""
    new = updates.toDF(*XY, "r2", "g2", "b2")
    rows = px.join(new, list(XY), "left")
    return rows.select(*XY, *(F.coalesce(clamp8(F.col(c + "2")), F.col(c)).alias(c) for c in RGB))


def window_level(vox: DataFrame, value: str = "v", w: float = 1.5) -> DataFrame:
    """``level``: values mapped to 0..255 between robust bounds of each image,
    max(Q1 - w IQR, least) and min(Q3 + w IQR, greatest), truncated."""
    bounds = exact_quantiles(vox, ["image_id"], value, (0.0, 0.25, 0.75, 1.0)).select(
        "image_id",
        F.greatest(F.col("q")[1] - w * (F.col("q")[2] - F.col("q")[1]), F.col("q")[0]).alias("low"),
        F.least(F.col("q")[2] + w * (F.col("q")[2] - F.col("q")[1]), F.col("q")[3]).alias("high"),
    )
    return _levelled(vox.join(bounds, "image_id"), value)


def rescale8(vox: DataFrame, value: str = "v") -> DataFrame:
    """``level``: values mapped to 0..255 between least and greatest, truncated."""
    bounds = vox.groupBy("image_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return _levelled(vox.join(bounds, "image_id"), value)


def _levelled(rows: DataFrame, value: str) -> DataFrame:
    inside = F.least(F.greatest(F.col(value), F.col("low")), F.col("high"))
    share = (inside - F.col("low")) * 255 / (F.col("high") - F.col("low"))
    level = F.when(F.col("high") > F.col("low"), clamp8(share)).otherwise(0)
    return rows.withColumn("level", level).drop("low", "high")


def max_projection(vox: DataFrame, axis: str, value: str = "v") -> DataFrame:
    """The greatest value along one of the axes x, y, z."""
    rest = [a for a in ("x", "y", "z") if a != axis]
    return vox.groupBy("image_id", *rest).agg(F.max(value).alias(value))


def _grid(dims: DataFrame, width: int, height: int) -> DataFrame:
    """Target pixels of each image (tx, ty) with its size."""
    xs = F.sequence(F.lit(0), F.lit(width * height - 1))
    rows = dims.select("image_id", "width", "height", F.explode(xs).alias("i"))
    return rows.select("image_id", "width", "height", (F.col("i") % width).alias("tx"), F.floor(F.col("i") / width).cast("int").alias("ty"))


def thumbnails(px: DataFrame, dims: DataFrame, size: int, value: str = "v") -> DataFrame:
    """Corner-aligned bilinear thumbnails (image_id, x, y, v), truncated.

    Each target pixel meets its up to four neighbours by equi-join and sums
    them by weight. Both sides are shuffled: Spark's estimate of the target pixels
    does not count the rows that are made of each image, so it would broadcast them.
    """
    step_x, step_y = (F.when(F.lit(size > 1), (F.col(n) - 1) / F.lit(max(size - 1, 1))).otherwise(0.0) for n in ("width", "height"))
    grid = _grid(dims, size, size).withColumns({"sx": F.col("tx") * step_x, "sy": F.col("ty") * step_y})
    corner = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    near = grid.select("*", F.inline(corner)).withColumns(
        {
            "x": (F.floor("sx") + F.col("a")).cast("int"),
            "y": (F.floor("sy") + F.col("b")).cast("int"),
            "fx": F.col("sx") - F.floor("sx"),
            "fy": F.col("sy") - F.floor("sy"),
        }
    )
    weight = F.when(F.col("a") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("b") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    near = near.withColumn("weight", weight).where("weight > 0").select("image_id", "tx", "ty", "x", "y", "weight")
    summed = near.hint("merge").join(px.select(*XY, value), list(XY)).groupBy("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"))
    return summed.agg(F.floor(F.round(F.sum(F.col("weight") * F.col(value)), 6)).cast("int").alias(value))


def thumbnail_blobs(images: DataFrame, size: int) -> DataFrame:
    """The same for whole images (image_id, width, height, pixels array<double>),
    one array per image and a few images per batch, without a pixel table."""

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for width, height, pixels in zip(batch["width"], batch["height"], batch["pixels"]):
                grid = np.asarray(pixels, dtype=float).reshape(height, width)
                at = [np.arange(size) * (n - 1) / max(size - 1, 1) for n in (height, width)]
                low = [np.floor(a).astype(int) for a in at]
                high = [np.minimum(a + 1, n - 1) for a, n in zip(low, (height, width))]
                fy, fx = (a - b for a, b in zip(at, low))
                rows = grid[low[0]] * (1 - fy)[:, None] + grid[high[0]] * fy[:, None]
                both = rows[:, low[1]] * (1 - fx) + rows[:, high[1]] * fx
                out.append(np.floor(np.round(both, 6)).astype(int).ravel())
            yield pd.DataFrame({"image_id": batch["image_id"], "thumbnail": out})

    return images.mapInPandas(shrink, "image_id bigint, thumbnail array<int>")


def resize_like(px: DataFrame, dims: DataFrame, target: DataFrame) -> DataFrame:
    """Each image at the size (width, height) that ``target`` has for it, by the
    nearest pixel below in integer arithmetic."""
    goal = target.select("image_id", F.col("width").alias("w2"), F.col("height").alias("h2"))
    spots = F.sequence(F.lit(0), F.col("w2") * F.col("h2") - 1)
    rows = dims.join(goal, "image_id").select("*", F.explode(spots).alias("i"))
    rows = rows.select(
        "image_id",
        (F.col("i") % F.col("w2")).cast("int").alias("tx"),
        F.floor(F.col("i") / F.col("w2")).cast("int").alias("ty"),
        F.expr("int((i % w2) * width div w2)").alias("x"),
        F.expr("int((i div w2) * height div h2)").alias("y"),
    )
    return rows.join(px, list(XY)).select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *RGB)


def reflect(px: DataFrame, dims: DataFrame) -> DataFrame:
    """The image with its mirror image below it."""
    below = px.join(dims, "image_id").select("image_id", "x", (2 * F.col("height") - F.col("y") - 1).alias("y"), *RGB)
    return px.select(*XY, *RGB).unionByName(below)


def blank_like(dims: DataFrame, rgb: tuple[int, int, int] = (255, 255, 255), grow: int = 0) -> DataFrame:
    """A canvas of one colour for each image, ``grow`` pixels larger each way."""
    wide, high = F.col("width") + grow, F.col("height") + grow
    rows = dims.select("image_id", wide.alias("w"), F.explode(F.sequence(F.lit(0), wide * high - 1)).alias("i"))
    y = F.floor(F.col("i") / F.col("w")).cast("int")
    return rows.select("image_id", (F.col("i") % F.col("w")).cast("int").alias("x"), y.alias("y"), *(F.lit(v).alias(c) for v, c in zip(rgb, RGB)))


def border(px: DataFrame, dims: DataFrame, n: int, rgb: tuple[int, int, int] = (240, 150, 150)) -> DataFrame:
    """The image in a filled frame that is n pixels wide."""
    return paste(blank_like(dims, rgb, 2 * n), px, n, n)


def pad_last_slice(tiles: DataFrame, per_slice: int, value: str = "v") -> DataFrame:
    """Every slot of every slice (tile_no), empty ones with the background 0. Slots
    are made where some are missing only: between a tile and the one before (known
    by bucket, see :mod:`scans`), and after the last one to the end of its slice."""
    tiles = tiles.where("tile_no >= 0")
    known = segmented(tiles, [], ["tile_no"], F.floor(F.col("tile_no") / 4096), {"_before": Previous(F.col("tile_no"))})
    first, last = F.coalesce(F.col("_before"), F.lit(-1)) + 1, F.col("tile_no") - 1
    between = known.where(first <= last).select(F.explode(F.sequence(first, last)).alias("tile_no"))
    end = tiles.agg(F.max("tile_no").alias("last")).select("last", ((F.floor(F.col("last") / per_slice) + 1) * per_slice - 1).alias("end"))
    behind = end.where("last < end").select(F.explode(F.sequence(F.col("last") + 1, F.col("end"))).alias("tile_no"))
    background = F.lit(0).cast(tiles.schema[value].dataType).alias(value)
    empty = between.unionByName(behind).select(F.col("tile_no").cast(tiles.schema["tile_no"].dataType).alias("tile_no"), background)
    return tiles.select("tile_no", F.coalesce(value, F.lit(0)).alias(value)).unionByName(empty)


def image_stats(images: DataFrame, low: float, high: float) -> DataFrame:
    """A function mapped over whole images with bound options: least, greatest
    and the number of values within the bounds."""

    def measure(batches: Iterator[pd.DataFrame], low: float = low, high: float = high) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [np.asarray(p, dtype=float) for p in batch["pixels"]]
            yield pd.DataFrame(
                {
                    "image_id": batch["image_id"],
                    "least": [v.min() for v in values],
                    "greatest": [v.max() for v in values],
                    "n_inside": [int(((v >= low) & (v <= high)).sum()) for v in values],
                }
            )

    return images.mapInPandas(measure, "image_id bigint, least double, greatest double, n_inside bigint")
