"""The supplied tables in the shapes that the operators take, and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import SPECIALS
from sparkloom.operators import ordered
from sparkloom.operators.trials import chosen
from sparkloom.sources.tables import load

LIMIT = 50.0
#: Months (t) up to this one train, later ones test.
CUT = 70


def metocean(spark: SparkSession, d: str) -> DataFrame:
    """Events as sensor records: the user is the station, the value the height."""
    rows = load(spark, d, "events").select(F.col("user_id").alias("station"), "ts", "event_id", F.col("value").alias("height"))
    return ordered.weather_state(rows, "height", LIMIT)


MET = (
    "met AS (SELECT user_id AS station, ts, event_id, value AS height,"
    " CASE WHEN value < 50 THEN 'W' WHEN value >= 50 THEN 'D' END AS state FROM events)"
)
RUNS = (
    MET + ", isl AS (SELECT *, sum(CASE WHEN state = 'W' THEN 0 ELSE 1 END) OVER"
    " (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM met),"
    " runs AS (SELECT *, CASE WHEN state = 'W' THEN sum(CASE WHEN state = 'W' THEN 1 ELSE 0 END) OVER"
    " (PARTITION BY station, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS pos FROM isl)"
)


def sql_window(k: int) -> str:
    return f"CAST(CASE WHEN state = 'W' THEN (pos - 1) % {k} + 1 ELSE 0 END AS BIGINT)"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Order totals by priority and calendar month: (series_id, t, y)."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    rows = load(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), month.cast("long").alias("t"), "o_totalprice")
    return rows.groupBy("series_id", "t").agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


SERIES = (
    "series AS (SELECT o_orderpriority AS series_id, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t,"
    " round(sum(o_totalprice), 2) AS y FROM orders GROUP BY ALL)"
)
TRAIN = SERIES + f", train AS (SELECT * FROM series WHERE t <= {CUT}), test AS (SELECT * FROM series WHERE t > {CUT})"


def cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Orders so far on each day of a priority: (region, day_index, day, cases)."""
    rows = load(spark, d, "orders").select(F.col("o_orderpriority").alias("region"), F.to_date("o_orderdate").alias("day"))
    daily = rows.groupBy("region", "day").agg(F.count("*").alias("n"))
    w = ordered.Window.partitionBy("region").orderBy("day")
    return daily.select("region", F.datediff("day", F.lit("1995-01-01")).alias("day_index"), "day", F.sum("n").over(w).alias("cases"))


CASES = (
    "daily AS (SELECT o_orderpriority AS region, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL),"
    " cases AS (SELECT region, date_diff('day', DATE '1995-01-01', day) AS day_index, day,"
    " CAST(sum(n) OVER (PARTITION BY region ORDER BY day) AS BIGINT) AS cases FROM daily)"
)


def level(v: Column) -> Column:
    return F.greatest(F.least(F.floor((v.cast("double") + 1) * 127.5), F.lit(255)), F.lit(0)).cast("int")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 images."""
    p = F.col("p")
    rows = load(spark, d, "embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("p", "v"))
    return rows.select(
        F.col("vec_id").alias("image_id"),
        (p % 8).alias("x"),
        F.floor(p / 8).cast("int").alias("y"),
        level(F.col("v")).alias("r"),
        level(F.get("embedding", (p + 21) % 64)).alias("g"),
        level(F.get("embedding", (p + 42) % 64)).alias("b"),
    )


def _sql_level(i: str) -> str:
    return f"CAST(greatest(0, least(255, floor((CAST(embedding[{i} + 1] AS DOUBLE) + 1) * 127.5))) AS INTEGER)"


PX = (
    f"px AS (SELECT vec_id AS image_id, CAST(p % 8 AS INTEGER) AS x, CAST(p // 8 AS INTEGER) AS y, {_sql_level('p')} AS r,"
    f" {_sql_level('(p + 21) % 64')} AS g, {_sql_level('(p + 42) % 64')} AS b"
    " FROM embeddings, (SELECT unnest(range(64)) AS p)), pm AS (SELECT *, (r + g + b) // 3 AS m FROM px)"
)


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 4 x 4 x 4 volumes; those of even id keep their first slice."""
    p = F.col("p")
    rows = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    rows = rows.select(
        F.col("vec_id").alias("image_id"), (p % 4).alias("x"), F.expr("p div 4 % 4").cast("int").alias("y"),
        F.expr("p div 16").cast("int").alias("z"), F.col("v").cast("double").alias("v"),
    )
    return rows.where((F.col("image_id") % 2 == 1) | (F.col("z") == 0))


VOX = (
    "vox AS (SELECT vec_id AS image_id, p % 4 AS x, (p // 4) % 4 AS y, p // 16 AS z, CAST(embedding[p + 1] AS DOUBLE) AS v"
    " FROM embeddings, (SELECT unnest(range(64)) AS p) WHERE vec_id % 2 = 1 OR p < 16)"
)


def lines(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.operators.documents import nonblank_lines

    return nonblank_lines(load(spark, d, "documents"))


LINES = (
    "parts AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: l <> '') AS ls FROM documents),"
    " lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM parts)"
)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as tables of two by two cells."""
    rows = load(spark, d, "conversations")
    return rows.select(
        F.col("conv_id").alias("doc_id"), F.expr("turn div 4").alias("table_no"), F.expr("turn % 4 div 2").alias("row"),
        (F.col("turn") % 2).alias("col"), "text",
    )


CELLS = (
    "cells AS (SELECT conv_id AS doc_id, turn // 4 AS table_no, (turn % 4) // 2 AS \"row\", turn % 2 AS col, text"
    " FROM conversations)"
)
NAME_CODES = ("NEWT", "DRM", "HIR", "FTO", "XYZ", "DRM-NEWT")


def named_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files whose names hold study codes."""
    code = chosen(F.col("page_id"), NAME_CODES)
    name = F.concat(code, F.lit("_"), F.col("page_id").cast("string"), F.lit(".png"))
    return load(spark, d, "pages").select("page_id", "url", name.alias("name"), F.concat("url", F.lit("/"), name).alias("path"))


_CODES = ", ".join(f"'{c}'" for c in NAME_CODES)
FILES = (
    f"named AS (SELECT page_id, url, list_value({_CODES})[page_id % 6 + 1] || '_' || page_id || '.png' AS name FROM pages),"
    " files AS (SELECT *, url || '/' || name AS path,"
    " CASE WHEN contains(name, 'NEWT') THEN 'NEWT' WHEN contains(name, 'DRM') THEN 'DRM'"
    " WHEN contains(name, 'HIR') THEN 'HIR' WHEN contains(name, 'FTO') THEN 'FTO' END AS code FROM named)"
)


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers to stimuli; one stimulus of five is not in the key."""
    return load(spark, d, "events").select(
        "event_id", "user_id", (F.col("event_id") % 2 + 1).cast("int").alias("phase"),
        chosen(F.expr("event_id div 2"), ("puppy", "panda", "spider", "bat", "cat")).alias("stimulus"),
        F.when(F.col("value") < LIMIT, "cute").otherwise("scary").alias("answer"),
    )


TRIALS = (
    "log AS (SELECT event_id, user_id, event_id % 2 + 1 AS phase,"
    " list_value('puppy', 'panda', 'spider', 'bat', 'cat')[(event_id // 2) % 5 + 1] AS stimulus,"
    " CASE WHEN value < 50 THEN 'cute' ELSE 'scary' END AS answer FROM events),"
    " key AS (SELECT * FROM (VALUES (1, 'puppy', 'cute'), (1, 'panda', 'cute'), (1, 'spider', 'scary'), (1, 'bat', 'scary'),"
    " (2, 'puppy', 'scary'), (2, 'panda', 'scary'), (2, 'spider', 'cute'), (2, 'bat', 'cute')) AS k(phase, stimulus, expected)),"
    " scored AS (SELECT l.*, k.expected, l.answer = k.expected AS correct FROM log l JOIN key k USING (phase, stimulus))"
)


def sql_escape(x: str) -> str:
    cases = " ".join(f"WHEN contains({x}, '{c}') THEN replace({x}, '{c}', '{s} ')" for c, s in SPECIALS)
    return f"CASE {cases} ELSE {x} END"


GAPS = (
    "gaps AS (SELECT user_id, event_id, ts, date_diff('microsecond', lag(ts) OVER w, ts) AS gap_us FROM events"
    " WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    " classed AS (SELECT *, CASE WHEN gap_us >= 36000000000 THEN 'day_break' WHEN gap_us > 300000000 THEN 'outlier'"
    " ELSE 'normal' END AS gap_class FROM gaps)"
)


def gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select("user_id", "event_id", "ts")
    return ordered.classify_gaps(ordered.time_gaps(rows, ["user_id"], "ts", "event_id"))
