"""Reading tables, series, line files, directories and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.scans import RunningMax, segmented
from sparkloom.sources.folders import open_folder
from sparkloom.sources.listing import list_tree


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_series(df: DataFrame, value_col: int | str = 1, order: str | None = None, t_start: int = 0) -> DataFrame:
    """A table's column (by default the second) as a series (t, y).

    ``order`` names the column that orders rows; values of that column are
    numbered from ``t_start`` when it is given as a position in the table's
    first column.
    """
    name = value_col if isinstance(value_col, str) else df.columns[value_col]
    order = order or df.columns[0]
    return df.select((F.col(order) + t_start).alias("t"), F.col(name).cast("double").alias("y"))


def read_line_counts(spark: SparkSession, path: str) -> DataFrame:
    """region, day_index and cases from files with one integer per line.

    The line number is the day; the file name (without ending) is the region,
    unless folders named ``region=...`` tell it.
    One file is one row while it is split: for many small files.
    """
    files = spark.read.text(path, wholetext=True)
    if "region" not in files.columns:
        files = files.withColumn("region", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    lines = files.select("region", F.posexplode(F.split("value", "\n")).alias("day_index", "line"))
    return lines.where(F.trim("line") != "").select("region", "day_index", strip_int(F.col("line")).alias("cases"))


def strip_int(text: Column) -> Column:
    """Surrounding space dropped and cast; null if that is no integer."""
    return F.trim(text).try_cast("bigint")


def contiguous_prefix(df: DataFrame, key: list[str], order: list[str], value: str, bucket: Column | str | None = None) -> DataFrame:
    """Rows of each key from its first up to, and without, its first null value. With
    ``bucket`` (rising with the order) no task holds a key."""
    is_blank = F.col(value).isNull().cast("int")
    if bucket is not None:
        out = segmented(df, key, order, bucket, {"_blank": RunningMax(is_blank)})
    else:
        out = df.withColumn("_blank", F.max(is_blank).over(Window.partitionBy(*key).orderBy(*order)))
    return out.where("_blank = 0").drop("_blank")


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, modified and length of files; contents are not read. A store that only
    Spark's readers know is listed by the driver, and empty files are left out there."""
    try:
        open_folder(path)
    except ValueError:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")
    return list_tree(spark, path, recursive)


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """path, width, height, channels and RGB bytes of image files.

    The source stores blue first; the bytes of three-channel images are turned.
    An unreadable file is a row of width -1 unless ``drop_invalid``.
    """
    rows = spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")
    pixels = F.regexp_replace(F.hex("data"), "(..)(..)(..)", "$3$2$1")
    rgb = F.when(F.col("nChannels") == 3, F.unhex(pixels)).otherwise(F.col("data"))
    return rows.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), rgb.alias("rgb"))


#: Named background colours.
COLOURS = {
    "white": (255, 255, 255),
    "black": (0, 0, 0),
    "red": (255, 0, 0),
    "green": (0, 255, 0),
    "blue": (0, 0, 255),
}


def blank_pixels(spark: SparkSession, width: int, height: int, colour: str | tuple = "white", image_id: int = 0) -> DataFrame:
    """A pixel table of one colour; an image without pixels is an error."""
    if width <= 0 or height <= 0:
        raise ValueError(f"an image needs pixels: {width} x {height}")
    rgb = COLOURS[colour] if isinstance(colour, str) else colour
    xy = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    return xy.select(F.lit(image_id).cast("bigint").alias("image_id"), "x", "y", *(F.lit(v).alias(c) for v, c in zip(rgb, "rgb")))


def random_ints(spark: SparkSession, n: int, low: int, high: int, seed: int) -> DataFrame:
    """n uniform integers, both ends included."""
    return spark.range(n).select("id", (F.floor(F.rand(seed) * (high - low + 1)) + low).alias("value"))


def random_choice(df: DataFrame, values: list, seed: int, name: str = "choice", key: list[str] | None = None) -> DataFrame:
    """Each row with one of ``values``, chosen uniformly by a hash of the seed and
    the ``key`` columns (by default all): a choice that survives any shuffle."""
    listed = F.array(*(F.lit(v) for v in values))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key or df.columns)))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return df.withColumn(name, F.element_at(listed, (number % len(values) + 1).cast("int")))
