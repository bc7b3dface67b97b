"""Every registered query on the supplied tables, with its SQL twin.

A name starts with the identifier of its operator in the survey.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.table_functions import register
from sparkloom.operators import documents as D
from sparkloom.operators import forecast as M
from sparkloom.operators import ordered as O
from sparkloom.operators import pixels as P
from sparkloom.operators import rasters as R
from sparkloom.operators import trials as Q
from sparkloom.operators.quantiles import exact_quantiles
from sparkloom.operators.scans import range_buckets
from sparkloom.plans import inputs as I
from sparkloom.plans.scratch import scratch_path
from sparkloom.sources import sinks as K
from sparkloom.sources.image_files import image_bytes, image_file_rows, read_image_files
from sparkloom.sources.listing import read_named_texts
from sparkloom.sources.named_files import write_named
from sparkloom.sources.tables import blank_pixels, contiguous_prefix, list_files, load, random_choice, read_line_counts, read_series, strip_int

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# ---------------------------------------------------------------- weather windows

KS = (1, 2, 3, 4, 5, 6)
_STATION, _TIME = ["station"], ["ts", "event_id"]


@query(
    "g1_weather_summary",
    f"WITH {I.RUNS} SELECT station, count(*) AS n_rows, count(*) FILTER (state = 'W') AS n_workable,"
    f" count(*) FILTER ({I.sql_window(4)} = 4) AS full_windows, CAST(max(pos) AS BIGINT) AS longest_run FROM runs GROUP BY station",
)
def g1(spark, d):
    """By day, so that a station of any length is spread over tasks."""
    runs = O.run_positions(I.metocean(spark, d), _STATION, _TIME, F.date_trunc("DAY", F.col("ts")))
    runs = runs.withColumn("win4", O.counter(F.col("run_pos"), 4))
    return runs.groupBy("station").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("state") == "W").alias("n_workable"),
        F.count_if(F.col("win4") == 4).alias("full_windows"),
        F.max("run_pos").cast("long").alias("longest_run"),
    )


def _window_query(name: str, k: int) -> None:
    @query(name, f"WITH {I.RUNS} SELECT event_id, {I.sql_window(k)} AS win{k} FROM runs")
    def run(spark, d):
        rows = O.weather_windows(I.metocean(spark, d), [k], _STATION, _TIME)
        return rows.select("event_id", F.col(f"win{k}").cast("long").alias(f"win{k}"))


for _name, _k in zip(("w01", "w03", "w04", "w05", "w06", "w07"), KS):
    _window_query(f"{_name}_window_of_{_k}", _k)

_STREAKS = (
    "WITH l AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER"
    " (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS misses FROM events),"
    " s AS (SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, misses ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM l)"
    " SELECT event_id, streak, max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS mastered FROM s"
)
_ALL = ", ".join(f"{I.sql_window(k)} AS win{k}" for k in KS)


@query("w_windows_in_buckets", f"WITH {I.RUNS} SELECT event_id, {_ALL} FROM runs")
def windows_in_buckets(spark, d):
    day = F.date_trunc("DAY", F.col("ts"))
    rows = O.weather_windows_in_buckets(I.metocean(spark, d), KS, _STATION, _TIME, day)
    return rows.select("event_id", *(F.col(f"win{k}").cast("long").alias(f"win{k}") for k in KS))


@query("p01_weather_state", f"WITH {I.MET} SELECT event_id, state FROM met")
def p01(spark, d):
    return I.metocean(spark, d).select("event_id", "state")


@query(
    "p02_split_timestamp",
    "SELECT event_id, strftime(ts, '%-m/%-d/%Y') AS date_part, strftime(ts, '%-I:%M:%S %p') AS time_part FROM events",
)
def p02(spark, d):
    return O.split_timestamp(load(spark, d, "events"), "ts").select("event_id", "date_part", "time_part")


@query(
    "s04_contiguous_prefix",
    "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS height FROM events),"
    " b AS (SELECT *, max(CASE WHEN height IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id"
    " ROWS UNBOUNDED PRECEDING) AS blank FROM e) SELECT user_id, event_id, height FROM b WHERE blank = 0",
)
def s04(spark, d):
    height = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    rows = load(spark, d, "events").select("user_id", "ts", "event_id", height.alias("height"))
    return contiguous_prefix(rows, ["user_id"], ["ts", "event_id"], "height").select("user_id", "event_id", "height")


@query(
    "a06_scale_stops",
    f"WITH {I.RUNS}, w AS (SELECT {_ALL} FROM runs), u AS (UNPIVOT w ON win1, win2, win3, win4, win5, win6 INTO NAME counter VALUE v)"
    " SELECT counter, CAST(min(v) AS DOUBLE) AS lowest, CAST(quantile_cont(v, 0.5) AS DOUBLE) AS middle,"
    " CAST(max(v) AS DOUBLE) AS highest FROM u GROUP BY counter",
)
def a06(spark, d):
    rows = O.weather_windows(I.metocean(spark, d), KS, _STATION, _TIME)
    return O.scale_stops(rows, [f"win{k}" for k in KS])


# ---------------------------------------------------------------- the same over very long keys

def _day() -> Column:
    return F.date_trunc("DAY", F.col("ts"))


@query("s04_contiguous_prefix_in_buckets", ORACLES["s04_contiguous_prefix"])
def s04_buckets(spark, d):
    height = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    rows = load(spark, d, "events").select("user_id", "ts", "event_id", height.alias("height"))
    return contiguous_prefix(rows, ["user_id"], ["ts", "event_id"], "height", _day()).select("user_id", "event_id", "height")


def _gaps_in_buckets(spark, d) -> DataFrame:
    rows = load(spark, d, "events").select("user_id", "event_id", "ts")
    return O.classify_gaps(O.time_gaps(rows, ["user_id"], "ts", "event_id", _day()))


@query("p07_gap_class_in_buckets", f"WITH {I.GAPS} SELECT event_id, gap_us, gap_class FROM classed")
def p07_buckets(spark, d):
    return _gaps_in_buckets(spark, d).select("event_id", "gap_us", "gap_class")


@query("w08_daily_new_in_buckets", f"WITH {I.CASES} SELECT region, day_index, coalesce(greatest(cases - lag(cases) OVER (PARTITION BY region ORDER BY day_index), 0), 0) AS new_cases FROM cases")
def w08_buckets(spark, d):
    rows = O.daily_new(I.cumulative(spark, d), bucket=F.floor(F.col("day_index") / 64))
    return rows.select("region", F.col("day_index").cast("long").alias("day_index"), "new_cases")


@query(
    "w10_sessions_in_buckets",
    "WITH g AS (SELECT event_id, ts, date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) AS gap_us FROM events)"
    " SELECT event_id, CAST(sum(CASE WHEN gap_us >= 60000000 THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g",
)
def w10_buckets(spark, d):
    """Sessions of the whole log as one key, in ranges of equal numbers of rows."""
    rows = range_buckets(load(spark, d, "events").select("event_id", "ts"), [], ["ts", "event_id"], 2000)
    return O.sessions(O.time_gaps(rows, [], "ts", "event_id", "bucket"), [], ["ts", "event_id"], O.MINUTE_US, "bucket").select("event_id", "session")


@query("w14_streaks_in_buckets", _STREAKS)
def w14_buckets(spark, d):
    log = load(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("correct"))
    return O.streaks(log, ["user_id"], ["ts", "event_id"], bucket=_day()).select("event_id", "streak", "mastered")


# ---------------------------------------------------------------- series and gaps


@query("s01_read_series", "SELECT o_orderkey AS t, CAST(o_totalprice AS DOUBLE) AS y FROM orders")
def s01(spark, d):
    return read_series(load(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query(
    "s02_line_counts",
    f"WITH {I.CASES} SELECT region, row_number() OVER (PARTITION BY region ORDER BY day) - 1 AS day_index, cases FROM cases",
)
def s02(spark, d):
    """Counts are written as one text file per region and read back by line."""
    rows = I.cumulative(spark, d).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("day", "cases"))).alias("c"))
    value = F.array_join(F.transform("c", lambda x: F.concat(F.lit(" "), x["cases"].cast("string"))), "\n")
    path = scratch_path(spark)
    rows.select("region", value.alias("value")).write.partitionBy("region").text(path)
    return read_line_counts(spark, path).select("region", F.col("day_index").cast("long").alias("day_index"), "cases")


@query("s05_list_files")
def s05(spark, d):
    return list_files(spark, d, recursive=True).select(K.base_name(F.col("path")).alias("name"), "length")


_IMAGE_NAMES = "CASE WHEN vec_id % 2 = 0 THEN 'even/' || vec_id || '.bmp' ELSE 'odd/' || vec_id || '.PNG' END"
_IMAGE_FILES = (
    f"{I.PX}, img AS (SELECT image_id AS vec_id, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x) AS rgb FROM px GROUP BY image_id)"
)


def _image_files(spark, d) -> tuple[str, str]:
    """Images of the embeddings as BMP and PNG files, those of every 50th id cut
    off; the folder, and the time before they were written."""
    path, began = scratch_path(spark), spark.sql("SELECT date_sub(current_date(), 1)").first()[0]
    name = F.expr(_IMAGE_NAMES.replace("vec_id", "image_id"))
    rows = image_file_rows(image_bytes(I.pixels(spark, d)).withColumn("name", name), "suffix")
    number = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    cut = F.expr("substring(content, 1, length(content) div 2)")
    write_named(rows.withColumn("content", F.when(number % 50 == 7, cut).when(number % 50 == 8, cut).otherwise(F.col("content"))), path)
    return path, str(began)


def _short_name(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+/[^/]+)$", 1).alias("name")


@query(
    "s08_image_files",
    f"WITH {_IMAGE_FILES} SELECT {_IMAGE_NAMES} AS name, NOT broken AS valid, CASE WHEN broken THEN -1 ELSE 8 END AS width,"
    " CASE WHEN broken THEN -1 ELSE 8 END AS height, CASE WHEN NOT broken THEN rgb END AS rgb"
    " FROM (SELECT *, vec_id % 50 IN (7, 8) AS broken FROM img)",
)
def s08(spark, d):
    """All files, the unreadable ones marked."""
    path, _ = _image_files(spark, d)
    rows = read_image_files(spark, path)
    return rows.select(_short_name(), F.col("problem").isNull().alias("valid"), "width", "height", F.hex("rgb").alias("rgb"))


@query(
    "s09_valid_image_files",
    f"WITH {_IMAGE_FILES} SELECT {_IMAGE_NAMES} AS name, rgb FROM img WHERE vec_id % 50 NOT IN (7, 8)",
)
def s09(spark, d):
    """Unreadable files dropped where they are read."""
    path, _ = _image_files(spark, d)
    return read_image_files(spark, path, drop_invalid=True).select(_short_name(), F.hex("rgb").alias("rgb"))


@query(
    "s07_file_times",
    "SELECT 'even/' || vec_id || '.bmp' AS name, CASE WHEN vec_id % 50 = 8 THEN 123 ELSE 246 END AS length, true AS stamped FROM embeddings WHERE vec_id % 2 = 0",
)
def s07(spark, d):
    """Lengths of the BMP files (54 bytes before 8 rows of 24), and whether their
    time stamps are those of this run."""
    path, began = _image_files(spark, d)
    rows = list_files(spark, path, recursive=True).where("path LIKE '%.bmp'")
    stamped = (F.col("modified") >= F.lit(began).cast("timestamp")) & (F.col("modified") <= F.current_timestamp() + F.expr("INTERVAL 1 DAY"))
    return rows.select(_short_name(), F.col("length").cast("int").alias("length"), stamped.alias("stamped"))


@query("s06_recursive_listing", "SELECT 'g' || page_id % 7 || '/h' || page_id % 3 || '/' || page_id || '.html' AS name, strlen(html) AS length FROM pages")
def s06(spark, d):
    """Pages written as files in a tree of folders, and the tree listed."""
    path = scratch_path(spark)
    name = F.expr("concat('g', page_id % 7, '/h', page_id % 3, '/', page_id, '.html')")
    write_named(load(spark, d, "pages").select(name.alias("name"), F.col("html").alias("content")), path)
    rows = list_files(spark, path, recursive=True)
    return rows.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("name"), "length")


@query("s05_directory", "SELECT page_id || '.html' AS name, strlen(html) AS length FROM pages WHERE page_id % 3 > 0")
def s05_directory(spark, d):
    """One folder listed, without the folders in it."""
    path = scratch_path(spark)
    name = F.expr("concat(if(page_id % 3 > 0, '', 'below/'), page_id, '.html')")
    write_named(load(spark, d, "pages").select(name.alias("name"), F.col("html").alias("content")), path)
    return list_files(spark, path).select(K.base_name(F.col("path")).alias("name"), "length")


@query(
    "p05_strip_int",
    "SELECT event_id, TRY_CAST(trim(CASE WHEN event_id % 7 = 0 THEN event_type ELSE '  ' || event_id || ' ' END) AS BIGINT) AS number FROM events",
)
def p05(spark, d):
    words = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit(" ")))
    return load(spark, d, "events").select("event_id", strip_int(words).alias("number"))


@query(
    "p03_index_series",
    f"WITH {I.SERIES} SELECT series_id, t AS month, 1800 + row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS t, y FROM series",
)
def p03(spark, d):
    rows = I.monthly(spark, d).withColumnRenamed("t", "month")
    return O.index_series(rows, ["series_id"], ["month"], 1800).select("series_id", "month", F.col("t").cast("long").alias("t"), "y")


@query("p04_split_at", f"WITH {I.TRAIN} SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' FROM test")
def p04(spark, d):
    train, test = O.split_at(I.monthly(spark, d), I.CUT)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("p06_day_to_date", f"WITH {I.CASES} SELECT region, day_index, CAST(DATE '2020-01-22' + CAST(day_index AS INTEGER) AS VARCHAR) AS day FROM cases")
def p06(spark, d):
    rows = O.day_to_date(I.cumulative(spark, d), "2020-01-22")
    return rows.select("region", F.col("day_index").cast("long").alias("day_index"), F.col("day").cast("string").alias("day"))


@query(
    "w08_daily_new",
    f"WITH {I.CASES} SELECT region, day_index, coalesce(greatest(cases - lag(cases) OVER (PARTITION BY region ORDER BY day_index), 0), 0) AS new_cases FROM cases",
)
def w08(spark, d):
    return O.daily_new(I.cumulative(spark, d)).select("region", F.col("day_index").cast("long").alias("day_index"), "new_cases")


@query("w09_time_gaps", f"WITH {I.GAPS} SELECT event_id, gap_us FROM gaps")
def w09(spark, d):
    return I.gaps(spark, d).select("event_id", "gap_us")


@query("p07_gap_class", f"WITH {I.GAPS} SELECT event_id, gap_class FROM classed")
def p07(spark, d):
    return I.gaps(spark, d).select("event_id", "gap_class")


@query(
    "w10_sessions",
    f"WITH {I.GAPS} SELECT event_id, CAST(sum(CASE WHEN gap_us >= 36000000000 THEN 1 ELSE 0 END) OVER"
    " (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps",
)
def w10(spark, d):
    return O.sessions(I.gaps(spark, d), ["user_id"], ["ts", "event_id"]).select("event_id", "session")


@query("k01_outlier_log", f"WITH {I.GAPS} SELECT gap_us || ', ' || event_id AS value FROM classed WHERE gap_class = 'outlier'")
def k01(spark, d):
    return K.outlier_lines(I.gaps(spark, d), "gap_us", "event_id")


@query(
    "k01_outlier_log_files",
    f"WITH {I.GAPS} SELECT user_id || '.log' AS name, string_agg(gap_us || ', ' || event_id || chr(10), '' ORDER BY ts, event_id) AS content"
    " FROM classed WHERE gap_class = 'outlier' GROUP BY user_id",
)
def k01_files(spark, d):
    """A log for each user, written line by line and read back by name."""
    path = scratch_path(spark)
    K.write_outlier_logs(I.gaps(spark, d), path, "user_id", ["ts", "event_id"], name="event_id")
    return read_named_texts(spark, path)


@query(
    "w02_seasonal_lag",
    f"WITH {I.SERIES} SELECT series_id, t, lag(y, 12) OVER w AS lagged, round(y - lag(y, 12) OVER w, 2) AS change FROM series"
    " WINDOW w AS (PARTITION BY series_id ORDER BY t)",
)
def w02(spark, d):
    return O.seasonal_lag(I.monthly(spark, d), 12).select("series_id", "t", "lagged", F.round("change", 2).alias("change"))


# ---------------------------------------------------------------- forecasts

HORIZON = 8
_NEWEST = (
    "newest AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS rn,"
    " max(t) OVER (PARTITION BY series_id) AS last_t FROM train), steps AS (SELECT unnest(range(1, 9)) AS h)"
)


def _sql_naive(m: int) -> str:
    return f"SELECT series_id, h, last_t + h AS t, y AS forecast FROM newest, steps WHERE rn = {m} - (h - 1) % {m}"


@query("m01_naive", f"WITH {I.TRAIN}, {_NEWEST} {_sql_naive(1)}")
def m01(spark, d):
    train, _ = O.split_at(I.monthly(spark, d), I.CUT)
    return M.forecast_naive(train, HORIZON).select("series_id", F.col("h").cast("long").alias("h"), "t", "forecast")


@query("m01_seasonal_naive", f"WITH {I.TRAIN}, {_NEWEST} {_sql_naive(12)}")
def m01_seasonal(spark, d):
    train, _ = O.split_at(I.monthly(spark, d), I.CUT)
    return M.forecast_naive(train, HORIZON, 12).select("series_id", F.col("h").cast("long").alias("h"), "t", "forecast")


_GRID_SQL = ", ".join(f"('{f}', {a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE, {M.ETS_PARAMETERS[f] + 1})" for f, a, b, p in M.ETS_GRID)
_ETS = (
    f"grid AS (SELECT * FROM (VALUES {_GRID_SQL}) AS g(form, alpha, beta, phi, k)),"
    " num AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, count(*) OVER (PARTITION BY series_id) AS n,"
    " max(t) OVER (PARTITION BY series_id) AS last_t FROM train),"
    " rec AS (SELECT a.series_id, a.n, a.last_t, g.*, 1 AS i, a.y AS lv, CASE WHEN g.form = 'level' THEN 0.0::DOUBLE ELSE b.y - a.y END AS sl, 0.0::DOUBLE AS sse"
    " FROM num a JOIN num b ON b.series_id = a.series_id AND b.i = 2, grid g WHERE a.i = 1 AND a.n >= 8"
    " UNION ALL SELECT r.series_id, r.n, r.last_t, r.form, r.alpha, r.beta, r.phi, r.k, r.i + 1,"
    " r.lv + r.sl * r.phi + r.alpha * (x.y - r.lv - r.sl * r.phi), r.sl * r.phi + r.alpha * r.beta * (x.y - r.lv - r.sl * r.phi),"
    " r.sse + (x.y - r.lv - r.sl * r.phi) * (x.y - r.lv - r.sl * r.phi) FROM rec r JOIN num x ON x.series_id = r.series_id AND x.i = r.i + 1),"
    " fits AS (SELECT *, (n - 1) * ln(greatest(sse / (n - 1), 1e-12)) + 2 * k + 2 * k * (k + 1) / (n - 1 - k - 1) AS aicc FROM rec WHERE i = n AND n - 1 - k - 1 > 0),"
    " best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(aicc, 6), form, alpha, beta) AS place FROM fits) WHERE place = 1),"
    " ets AS (SELECT series_id, form, alpha, beta, h, last_t + h AS t, lv + sl * list_sum(list_transform(range(1, h + 1), lambda i: pow(phi, i))) AS forecast FROM best, steps)"
)
_WITH_ETS = f"WITH RECURSIVE {I.TRAIN}, {_NEWEST}, {_ETS}"


@query("m02_smoothing", f"{_WITH_ETS} SELECT series_id, form, alpha, beta, h, t, round(forecast, 2) AS forecast FROM ets")
def m02(spark, d):
    train, _ = O.split_at(I.monthly(spark, d), I.CUT)
    rows = M.forecast_ets(train, HORIZON)
    return rows.select("series_id", "form", "alpha", "beta", F.col("h").cast("long").alias("h"), "t", F.round("forecast", 2).alias("forecast"))


def _sql_kpss(name: str, source: str) -> str:
    return (
        f"{name}e AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS e FROM {source}),"
        f" {name}s AS (SELECT *, sum(e) OVER w AS s, e * lag(e, 1) OVER w AS g1, e * lag(e, 2) OVER w AS g2, e * lag(e, 3) OVER w AS g3"
        f" FROM {name}e WINDOW w AS (PARTITION BY series_id ORDER BY t)),"
        f" {name} AS (SELECT series_id, sum(s * s) / (count(*) * count(*)) / ((sum(e * e) + 1.5 * coalesce(sum(g1), 0)"
        f" + 1.0 * coalesce(sum(g2), 0) + 0.5 * coalesce(sum(g3), 0)) / count(*)) AS eta FROM {name}s GROUP BY series_id)"
    )


@query(
    "m03_differencing",
    f"WITH {I.TRAIN}, once AS (SELECT series_id, t, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS y FROM train),"
    f" diffs AS (SELECT * FROM once WHERE y IS NOT NULL), {_sql_kpss('k0', 'train')}, {_sql_kpss('k1', 'diffs')}"
    " SELECT series_id, round(k0.eta, 6) AS eta0, round(k1.eta, 6) AS eta1,"
    " CAST(CASE WHEN k0.eta < 0.463 THEN 0 WHEN k1.eta < 0.463 THEN 1 ELSE 2 END AS BIGINT) AS d FROM k0 JOIN k1 USING (series_id)",
)
def m03_order(spark, d):
    train, _ = O.split_at(I.monthly(spark, d), I.CUT)
    rows = M.differencing_order(train)
    return rows.select("series_id", F.round("eta0", 6).alias("eta0"), F.round("eta1", 6).alias("eta1"), F.col("d").cast("long").alias("d"))


@query("m03_arima")
def m03(spark, d):
    train, _ = O.split_at(I.monthly(spark, d), I.CUT)
    return M.forecast_arima(train, HORIZON)


@query("m04_neural")
def m04(spark, d):
    train, _ = O.split_at(I.monthly(spark, d), I.CUT)
    return M.forecast_nnar(train, HORIZON)


@query(
    "m05_intervals",
    f"WITH {I.TRAIN}, {_NEWEST}, c AS (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS ch FROM train),"
    " sd AS (SELECT series_id, sqrt(avg(ch * ch)) AS sd FROM c GROUP BY series_id)"
    " SELECT series_id, h, last_t + h AS t, y AS forecast, round(y - 1.96 * sd * sqrt(h), 2) AS lo, round(y + 1.96 * sd * sqrt(h), 2) AS hi"
    " FROM newest JOIN sd USING (series_id), steps WHERE rn = 1",
)
def m05(spark, d):
    train, _ = O.split_at(I.monthly(spark, d), I.CUT)
    rows = M.forecast_intervals(train, HORIZON)
    return rows.select("series_id", F.col("h").cast("long").alias("h"), "t", "forecast", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"))


@query(
    "m06_decompose",
    f"WITH {I.SERIES}, c AS (SELECT *, count(*) OVER w AS n, avg(y) OVER w AS a FROM series WINDOW w AS"
    " (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"
    " SELECT series_id, t, round(CASE WHEN n = 5 THEN a END, 2) AS trend, round(y - CASE WHEN n = 5 THEN a END, 2) AS remainder FROM c",
)
def m06(spark, d):
    rows = M.decompose(I.monthly(spark, d))
    return rows.select("series_id", "t", F.round("trend", 2).alias("trend"), F.round("remainder", 2).alias("remainder"))


def _sql_trend() -> str:
    """Three local lines, the error of each value left out, the best span."""
    names, fits = [], []
    for i, k in enumerate(M.SPANS):
        w = f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
        names.append(
            f"regr_count(y, x) {w} AS n{i}, regr_sxx(y, x) {w} AS s{i}, x - regr_avgx(y, x) {w} AS d{i},"
            f" regr_avgy(y, x) {w} AS a{i}, regr_slope(y, x) {w} AS b{i}"
        )
        fits.append(
            f"CASE WHEN n{i} >= 3 AND s{i} > 0 THEN a{i} + b{i} * d{i} END AS f{i},"
            f" CASE WHEN n{i} >= 3 AND s{i} > 0 AND 1.0::DOUBLE / n{i} + d{i} * d{i} / s{i} < 0.999 THEN abs(y - (a{i} + b{i} * d{i})) / (1 - (1.0::DOUBLE / n{i} + d{i} * d{i} / s{i})) END AS e{i}"
        )
    k = M.SPANS[1]
    w = f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    means = ", ".join(f"round(avg(e{i}) {w}, 6) AS m{i}" for i in range(3))
    return (
        f"xy AS (SELECT series_id, t, CAST(t AS DOUBLE) AS x, y FROM series), moments AS (SELECT *, {', '.join(names)} FROM xy),"
        f" fits AS (SELECT *, {', '.join(fits)} FROM moments), chosen AS (SELECT *, {means} FROM fits),"
        " trend AS (SELECT series_id, t, y, CASE WHEN m0 <= coalesce(m1, m0) AND m0 <= coalesce(m2, m0) THEN f0 WHEN m1 <= coalesce(m2, m1) THEN f1 ELSE f2 END AS trend FROM chosen)"
    )


@query("m06_smooth_trend", f"WITH {I.SERIES}, {_sql_trend()} SELECT series_id, t, round(trend / 1000, 3) AS trend, round((y - trend) / 1000, 3) AS remainder FROM trend")
def m06_trend(spark, d):
    rows = M.smooth_trend(I.monthly(spark, d))
    return rows.select("series_id", "t", F.round(F.col("trend") / 1000, 3).alias("trend"), F.round(F.col("remainder") / 1000, 3).alias("remainder"))


_STACK = f"stacked AS (SELECT 'naive' AS model, series_id, t, forecast FROM ({_sql_naive(1)}) UNION ALL SELECT 'seasonal', series_id, t, forecast FROM ({_sql_naive(12)}))"
_ACC = (
    _STACK + ", ch AS (SELECT series_id, abs(y - lag(y) OVER (PARTITION BY series_id ORDER BY t)) AS c FROM train),"
    " scale AS (SELECT series_id, avg(c) AS scale FROM ch GROUP BY series_id),"
    " err AS (SELECT s.series_id, s.model, x.y AS actual, x.y - s.forecast AS e, scale FROM stacked s JOIN test x USING (series_id, t) JOIN scale USING (series_id)),"
    " acc AS (SELECT series_id, model, avg(e) AS me, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(100 * e / actual) AS mpe,"
    " avg(abs(100 * e / actual)) AS mape, avg(abs(e)) / max(scale) AS mase FROM err GROUP BY series_id, model)"
)
_WITH_ACC = f"WITH {I.TRAIN}, {_NEWEST}, {_ACC}"
_MEASURES = ("me", "rmse", "mae", "mpe", "mape", "mase")


def _stacked(train: DataFrame) -> DataFrame:
    return M.stack_models({"naive": M.forecast_naive(train, HORIZON), "seasonal": M.forecast_naive(train, HORIZON, 12)})


def _accuracy(spark: SparkSession, d: str) -> DataFrame:
    train, test = O.split_at(I.monthly(spark, d), I.CUT)
    return M.accuracy(_stacked(train), test, train)


@query("u01_stack_models", f"WITH {I.TRAIN}, {_NEWEST}, {_STACK} SELECT * FROM stacked")
def u01(spark, d):
    return _stacked(O.split_at(I.monthly(spark, d), I.CUT)[0])


@query("j04_align", f"WITH {I.TRAIN}, {_NEWEST}, {_STACK} SELECT s.*, x.y AS actual FROM stacked s JOIN test x USING (series_id, t)")
def j04(spark, d):
    train, test = O.split_at(I.monthly(spark, d), I.CUT)
    return M.align(_stacked(train), test)


@query("a01_accuracy", f"{_WITH_ACC} SELECT series_id, model, {', '.join(f'round({m}, 5) AS {m}' for m in _MEASURES)} FROM acc")
def a01(spark, d):
    return M.round_report(_accuracy(spark, d), 5)


@query("f03_accuracy_by_model", f"{_WITH_ACC} SELECT model, round(avg(e), 6) AS me, round(avg(abs(e)), 6) AS mae, count(*) AS n FROM err GROUP BY model")
def f03(spark, d):
    train, test = O.split_at(I.monthly(spark, d), I.CUT)
    e = F.col("actual") - F.col("forecast")
    rows = M.align(_stacked(train), test)
    return rows.groupBy("model").agg(F.round(F.avg(e), 6).alias("me"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.count("*").alias("n"))


@query("p34_round_report", f"{_WITH_ACC} SELECT series_id, model, {', '.join(f'round({m}, 2) AS {m}' for m in _MEASURES[3:])} FROM acc")
def p34(spark, d):
    return M.round_report(_accuracy(spark, d).select("series_id", "model", *_MEASURES[3:]), 2)


@query("o01_rank_by_mase", f"{_WITH_ACC} SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY mase, model) AS rank FROM acc")
def o01(spark, d):
    return M.rank_models(_accuracy(spark, d), "mase").select("series_id", "model", F.col("rank").cast("long").alias("rank"))


_CV = (
    "naive AS (SELECT series_id, 'naive' AS model, lag(t) OVER w AS origin, y - lag(y) OVER w AS error FROM series"
    " WINDOW w AS (PARTITION BY series_id ORDER BY t)), mean AS (SELECT series_id, 'mean' AS model, lag(t) OVER w AS origin,"
    " y - avg(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)),"
    " num AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i FROM series),"
    " sm AS (SELECT series_id, t, i, y AS lv, CAST(NULL AS DOUBLE) AS error, CAST(NULL AS BIGINT) AS origin FROM num WHERE i = 1"
    " UNION ALL SELECT n.series_id, n.t, n.i, s.lv + 0.3 * (n.y - s.lv), n.y - s.lv, s.t FROM sm s JOIN num n ON n.series_id = s.series_id AND n.i = s.i + 1),"
    " errors AS (SELECT * FROM naive WHERE origin IS NOT NULL UNION ALL SELECT * FROM mean WHERE origin IS NOT NULL"
    " UNION ALL SELECT series_id, 'level_0.3', origin, error FROM sm WHERE origin IS NOT NULL),"
    " mse AS (SELECT series_id, model, avg(error * error) AS mse FROM errors GROUP BY series_id, model)"
)
_WITH_CV = f"WITH RECURSIVE {I.SERIES}, {_CV}"


def _cv_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = I.monthly(spark, d)
    return M.rolling_naive(rows).unionByName(M.rolling_mean(rows)).unionByName(M.rolling_smoothing(rows, 0.3))


@query("w15_rolling_cv", f"{_WITH_CV} SELECT series_id, model, origin, round(error / 1000, 2) AS error FROM errors")
def w15(spark, d):
    return _cv_errors(spark, d).withColumn("error", F.round(F.col("error") / 1000, 2))


@query("f01_forecaster_callback", f"{_WITH_CV} SELECT series_id, model, origin, round(error / 1000, 2) AS error FROM mean WHERE origin IS NOT NULL")
def f01(spark, d):
    return M.rolling_cv(I.monthly(spark, d), "mean").withColumn("error", F.round(F.col("error") / 1000, 2))


def _viewed(df: DataFrame) -> str:
    """A view of a name that no other query has."""
    name = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


@query("f01_sql_table_function", f"{_WITH_CV} SELECT series_id, model, origin, round(error / 1000, 2) AS error FROM errors")
def f01_sql(spark, d):
    """The rolled forecasters as a table function of SQL."""
    register(spark)
    series = _viewed(I.monthly(spark, d))
    calls = [f"SELECT * FROM rolling_errors(TABLE({series}) PARTITION BY (series_id) ORDER BY (t), '{m}')" for m in ("naive", "mean", "level_0.3")]
    return spark.sql(" UNION ALL ".join(calls)).withColumn("error", F.round(F.col("error") / 1000, 2))


@query(
    "f02_sql_table_function",
    "SELECT vec_id AS image_id, CAST(list_min(embedding) AS DOUBLE) AS least, CAST(list_max(embedding) AS DOUBLE) AS greatest,"
    " CAST(len(list_filter(embedding, lambda v: CAST(v AS DOUBLE) >= -0.1::DOUBLE AND CAST(v AS DOUBLE) <= 0.1::DOUBLE)) AS BIGINT) AS within FROM embeddings",
)
def f02_sql(spark, d):
    """A function of whole images as a table function of SQL."""
    register(spark)
    images = _viewed(load(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("pixels")))
    return spark.sql(f"SELECT * FROM image_stats(TABLE({images}), -0.1D, 0.1D)")


@query("a02_cv_mse", f"{_WITH_CV} SELECT series_id, model, round(mse / 1000000, 3) AS mse FROM mse")
def a02(spark, d):
    return M.cv_mse(_cv_errors(spark, d)).withColumn("mse", F.round(F.col("mse") / 1000000, 3))


@query("o02_rank_by_mse", f"{_WITH_CV} SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY mse, model) AS rank FROM mse")
def o02(spark, d):
    return M.rank_models(M.cv_mse(_cv_errors(spark, d)), "mse").select("series_id", "model", F.col("rank").cast("long").alias("rank"))


@query("o03_best_model", f"{_WITH_CV} SELECT series_id, arg_min(model, mse) AS model FROM mse GROUP BY series_id")
def o03(spark, d):
    return M.best_model(M.cv_mse(_cv_errors(spark, d)))


# All models of the comparison: no SQL, as they are fitted (see tests/test_models.py).
_MODELS = ("naive", "ets", "arima", "nnar")


def _all_forecasts(train: DataFrame) -> DataFrame:
    found = {name: M.forecast_model(train, name, HORIZON) for name in _MODELS}
    return M.stack_models(found | {"seasonal": M.forecast_naive(train, HORIZON, 12)})


def _all_errors(spark: SparkSession, d: str) -> DataFrame:
    """One-step errors of all models from each origin that leaves 24 values."""
    rows = I.monthly(spark, d)
    parts = [M.rolling_cv(rows, name, least=24) for name in _MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("m02_smoothing_fitted")
def m02_fitted(spark, d):
    return M.forecast_model(O.split_at(I.monthly(spark, d), I.CUT)[0], "ets", HORIZON)


@query("m05_intervals_of_all_models")
def m05_all(spark, d):
    train, _ = O.split_at(I.monthly(spark, d), I.CUT)
    parts = [M.forecast_model(train, name, HORIZON).withColumn("model", F.lit(name)) for name in _MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("a01_accuracy_of_all_models")
def a01_all(spark, d):
    train, test = O.split_at(I.monthly(spark, d), I.CUT)
    return M.accuracy(_all_forecasts(train), test, train)


@query("o01_rank_of_all_models")
def o01_all(spark, d):
    return M.rank_models(a01_all(spark, d), "mase").select("series_id", "model", "mase", "rank")


@query("w15_rolling_cv_of_all_models")
def w15_all(spark, d):
    return _all_errors(spark, d)


@query("o02_rank_of_all_models_by_mse")
def o02_all(spark, d):
    return M.rank_models(M.cv_mse(_all_errors(spark, d)), "mse")


@query("o03_best_of_all_models")
def o03_all(spark, d):
    return M.best_model(M.cv_mse(_all_errors(spark, d)))


# ---------------------------------------------------------------- pixels

_RGB = "image_id, x, y, r, g, b"


def _sql_clamp(x: str) -> str:
    return f"CAST(greatest(0, least(255, trunc({x}))) AS INTEGER)"


@query(
    "s10_blank_image",
    "SELECT CAST(0 AS BIGINT) AS image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, 255 AS r, 255 AS g, 255 AS b"
    " FROM (SELECT unnest(range(8 * (SELECT count(*) FROM embeddings))) AS i)",
)
def s10_image(spark, d):
    """A blank image with a row of eight pixels for each embedding."""
    return blank_pixels(spark, 8, load(spark, d, "embeddings").count())


@query("s10_blank_pixels", f"WITH {I.PX} SELECT image_id, x, y, 0 AS r, 255 AS g, 0 AS b FROM px")
def s10(spark, d):
    return P.blank_like(P.image_dims(I.pixels(spark, d)), (0, 255, 0))


@query("p08_clamp8", f"SELECT event_id, {_sql_clamp('value * 3 - 50')} AS level FROM events")
def p08(spark, d):
    return load(spark, d, "events").select("event_id", P.clamp8(F.col("value") * 3 - 50).alias("level"))


@query("p09_mean3", f"WITH {I.PX} SELECT image_id, x, y, CAST(m AS INTEGER) AS m FROM pm")
def p09(spark, d):
    return I.pixels(spark, d).select("image_id", "x", "y", P.mean3().alias("m"))


@query("p10_scale_channels", f"WITH {I.PX} SELECT image_id, x, y, {_sql_clamp('r * 1.5')} AS r, {_sql_clamp('g * 0.3')} AS g, {_sql_clamp('b * 2.0')} AS b FROM px")
def p10(spark, d):
    return P.scale_channels(I.pixels(spark, d), 1.5, 0.3, 2.0)


@query("p11_grey_above", f"WITH {I.PX} SELECT image_id, x, y, {', '.join(f'CAST(CASE WHEN m > 153 THEN m ELSE {c} END AS INTEGER) AS {c}' for c in 'rgb')} FROM pm")
def p11(spark, d):
    return P.grey_above(I.pixels(spark, d), 0.6)


@query(
    "p12_highlight_red",
    f"WITH {I.PX} SELECT image_id, x, y, {', '.join(f'CAST(CASE WHEN r >= m THEN {v} ELSE m END AS INTEGER) AS {c}' for c, v in zip('rgb', (255, 0, 0)))} FROM pm",
)
def p12(spark, d):
    return P.highlight_red(I.pixels(spark, d))


@query("p13_is_blue", f"WITH {I.PX} SELECT image_id, x, y, b >= m * 1.6 AS blue FROM pm")
def p13(spark, d):
    return I.pixels(spark, d).select("image_id", "x", "y", P.is_blue().alias("blue"))


@query("p14_crop", f"WITH {I.PX} SELECT image_id, x - 2 AS x, y - 2 AS y, r, g, b FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
def p14(spark, d):
    px = I.pixels(spark, d)
    return P.crop(px, 2, P.image_dims(px))


@query("p14_crop_of_blocks", ORACLES["p14_crop"])
def p14_blocks(spark, d):
    return R.from_blocks(R.crop_blocks(R.to_blocks(I.pixels(spark, d), P.RGB, 3), P.RGB, 2), P.RGB)


@query("p15_squeeze_z", f"WITH {I.VOX} SELECT image_id, x, y, v FROM vox WHERE image_id % 2 = 0")
def p15(spark, d):
    return P.squeeze_z(I.voxels(spark, d))


@query(
    "p16_luminance",
    f"WITH {I.PX}, l AS (SELECT image_id, x, y, (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255 AS i FROM px)"
    " SELECT image_id, x, y, round(CASE WHEN i <= 0.0031308::DOUBLE THEN i * 12.92 ELSE pow(i, 1 / 2.4::DOUBLE) * 1.055 END - 0.55, 6) AS light FROM l",
)
def p16(spark, d):
    return P.luminance(I.pixels(spark, d)).select("image_id", "x", "y", F.round("light", 6).alias("light"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        "event_id", F.col("value").alias("event_x"), (F.col("value") * 0.5 + 10).alias("event_y"), (F.col("user_id") % 3).alias("slice")
    )


_PICKS = (
    "pts AS (SELECT event_id, value AS event_x, value * 0.5::DOUBLE + 10 AS event_y, user_id % 3 AS slice FROM events),"
    " picks AS (SELECT event_id, slice * 20 + CAST(round_even(event_y, 0) AS BIGINT) // 24 * 5 + CAST(round_even(event_x, 0) AS BIGINT) // 32 AS tile_no FROM pts)"
)


@query("p17_pick_tile", f"WITH {_PICKS} SELECT event_id, tile_no FROM picks")
def p17(spark, d):
    return P.pick_tile(_points(spark, d), 32, 24, 5, 4).select("event_id", "tile_no")


@query("p18_in_bounds", f"WITH {I.PX} SELECT {_RGB} FROM px WHERE x < 6 AND y < 6")
def p18(spark, d):
    px = I.pixels(spark, d)
    dims = P.image_dims(px).select("image_id", (F.col("width") - 2).alias("width"), (F.col("height") - 2).alias("height"))
    return P.require_in_bounds(px, dims).select(*P.XY, *P.RGB)


_BACK = "back AS (SELECT image_id - 1 AS image_id, x, y, r AS r2, g AS g2, b AS b2 FROM px WHERE image_id % 2 = 1)"


@query(
    "j01_blue_screen",
    f"WITH {I.PX.replace('px AS (', 'px AS MATERIALIZED (', 1).replace('pm AS (', 'pm AS MATERIALIZED (', 1)}, {_BACK} SELECT image_id, x, y, {', '.join(f'CASE WHEN b >= m * 1.6 THEN coalesce({c}2, {c}) ELSE {c} END AS {c}' for c in 'rgb')}"
    " FROM pm LEFT JOIN back USING (image_id, x, y) WHERE image_id % 2 = 0",
)
def j01(spark, d):
    px = I.pixels(spark, d)
    back = px.where("image_id % 2 = 1").withColumn("image_id", F.col("image_id") - 1)
    return P.blue_screen(px.where("image_id % 2 = 0"), back)


_PATCH_SQL = ", ".join(f"({r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE, {c}, {w})" for r, g, b, c, w in P.PATCHES)


@query(
    "j02_patch_montage",
    f"WITH {I.PX}, k AS (SELECT * FROM (VALUES {_PATCH_SQL}) AS k(kr, kg, kb, c, w)) SELECT image_id, x + c * 8 AS x, y + w * 8 AS y,"
    f" {_sql_clamp('r * kr')} AS r, {_sql_clamp('g * kg')} AS g, {_sql_clamp('b * kb')} AS b FROM px, k",
)
def j02(spark, d):
    px = I.pixels(spark, d)
    return P.patch_montage(px, P.image_dims(px))


_SPOTS = "spots AS (SELECT image_id, x, y FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range({w})) AS x), (SELECT unnest(range({h})) AS y))"


@query(
    "j03_paste",
    f"WITH {I.PX}, {_SPOTS.format(w=11, h=11)} SELECT s.image_id, s.x, s.y, coalesce(r, 1) AS r, coalesce(g, 2) AS g, coalesce(b, 3) AS b"
    " FROM spots s LEFT JOIN px p ON p.image_id = s.image_id AND p.x + 2 = s.x AND p.y + 1 = s.y",
)
def j03(spark, d):
    px = I.pixels(spark, d)
    return P.paste(P.blank_like(P.image_dims(px), (1, 2, 3), 3), px, 2, 1)


_AT = "x = image_id % 8 AND y = (image_id // 8) % 8"


def _spots(px: DataFrame) -> DataFrame:
    return px.where("x = image_id % 8 AND y = image_id div 8 % 8").select("image_id", "x", "y", F.lit(300).alias("r"), F.lit(-5).alias("g"), F.col("b") + 1)


@query("j11_get_pixels", f"WITH {I.PX} SELECT {_RGB} FROM px WHERE {_AT}")
def j11_get(spark, d):
    px = I.pixels(spark, d)
    return P.get_pixels(px, _spots(px))


@query(
    "j11_set_pixels",
    f"WITH {I.PX} SELECT image_id, x, y, CASE WHEN {_AT} THEN 255 ELSE r END AS r, CASE WHEN {_AT} THEN 0 ELSE g END AS g,"
    f" CASE WHEN {_AT} THEN least(b + 1, 255) ELSE b END AS b FROM px",
)
def j11_set(spark, d):
    px = I.pixels(spark, d)
    return P.set_pixels(px, _spots(px))


_TILES = "numbered AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS row_no FROM pages)"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return O.global_number(load(spark, d, "pages").select("page_id"), ["page_id"], F.floor(F.col("page_id") / 64))


@query(
    "w11_tile_index",
    f"WITH {_TILES} SELECT page_id, row_no, row_no // 20 AS slice, row_no % 20 % 5 * 32 AS x0, row_no % 20 // 5 * 24 AS y0 FROM numbered",
)
def w11(spark, d):
    return P.tile_index(_tiles(spark, d), 5, 4, 32, 24)


@query("j10_tile_lookup", f"WITH {_TILES}, {_PICKS} SELECT event_id, tile_no, page_id FROM picks JOIN numbered ON row_no = tile_no")
def j10(spark, d):
    picks = P.pick_tile(_points(spark, d), 32, 24, 5, 4).select("event_id", "tile_no")
    return P.tile_lookup(picks, _tiles(spark, d).withColumnRenamed("row_no", "tile_no"))


@query("a13_distinct_picks", f"WITH {_PICKS} SELECT DISTINCT tile_no FROM picks")
def a13(spark, d):
    return P.distinct_picks(P.pick_tile(_points(spark, d), 32, 24, 5, 4))


_Q = "q AS (SELECT image_id, quantile_cont(v, [0.0, 0.25, 0.75, 1.0]) AS q FROM vox GROUP BY image_id)"
_LEVEL = (
    "SELECT image_id, x, y, z, CASE WHEN high > low THEN " + _sql_clamp("(least(greatest(v, low), high) - low) * 255 / (high - low)")
    + " ELSE 0 END AS level FROM vox JOIN bounds USING (image_id)"
)


@query(
    "a03_window_level",
    f"WITH {I.VOX}, {_Q}, bounds AS (SELECT image_id, greatest(q[2] - 1.5::DOUBLE * (q[3] - q[2]), q[1]) AS low,"
    f" least(q[3] + 1.5::DOUBLE * (q[3] - q[2]), q[4]) AS high FROM q) {_LEVEL}",
)
def a03(spark, d):
    return P.window_level(I.voxels(spark, d)).drop("v")


@query(
    "a03_levels_of_one_large_image",
    f"WITH {I.VOX}, q AS (SELECT quantile_cont(v, [0.0, 0.25, 0.75, 1.0]) AS q FROM vox), bounds AS (SELECT greatest(q[2] - 1.5::DOUBLE * (q[3] - q[2]), q[1]) AS low,"
    " least(q[3] + 1.5::DOUBLE * (q[3] - q[2]), q[4]) AS high FROM q) SELECT image_id * 64 + z * 16 + y * 4 + x AS place,"
    " CAST(least(255, greatest(0, trunc((least(greatest(v, low), high) - low) * 255 / (high - low)))) AS INTEGER) AS level FROM vox, bounds",
)
def a03_large(spark, d):
    """All volumes as one image, whose quartiles no task can hold."""
    place = F.expr("image_id * 64 + z * 16 + y * 4 + x")
    rows = I.voxels(spark, d).select(F.lit(0).alias("image_id"), place.alias("place"), "v")
    return P.window_level(rows).select("place", "level")


@query(
    "a06_quartiles_of_prices",
    "SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.0) AS lowest, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,"
    " round(quantile_cont(l_extendedprice, 0.5), 4) AS middle, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,"
    " quantile_cont(l_extendedprice, 1.0) AS highest FROM (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem) GROUP BY l_returnflag",
)
def a06_quartiles(spark, d):
    """Stops of a scale with quartiles, over a few groups of a great many values."""
    q = exact_quantiles(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.0, 0.25, 0.5, 0.75, 1.0))
    names = ("lowest", "q1", "middle", "q3", "highest")
    return q.select(F.col("l_returnflag").alias("flag"), *(F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(names)))


@query("a04_rescale8", f"WITH {I.VOX}, bounds AS (SELECT image_id, min(v) AS low, max(v) AS high FROM vox GROUP BY image_id) {_LEVEL}")
def a04(spark, d):
    return P.rescale8(I.voxels(spark, d)).drop("v")


@query("a05_max_projection", f"WITH {I.VOX} SELECT image_id, x, y, max(v) AS v FROM vox GROUP BY image_id, x, y")
def a05(spark, d):
    return P.max_projection(I.voxels(spark, d), "z")


_THUMB = (
    f"WITH {I.PX}, {_SPOTS.format(w=5, h=5)}, near AS (SELECT image_id, s.x AS tx, s.y AS ty, s.x * 1.75::DOUBLE AS sx, s.y * 1.75::DOUBLE AS sy, da, db"
    " FROM spots s, (SELECT unnest([0, 1]) AS da), (SELECT unnest([0, 1]) AS db)),"
    " weighted AS (SELECT *, CASE WHEN da = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END * CASE WHEN db = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END AS k FROM near)"
    " SELECT w.image_id, tx AS x, ty AS y, CAST(floor(round(sum(k * r), 6)) AS INTEGER) AS r FROM weighted w JOIN px p"
    " ON p.image_id = w.image_id AND p.x = floor(sx) + da AND p.y = floor(sy) + db WHERE k > 0 GROUP BY ALL"
)


@query("a09_thumbnails", _THUMB)
def a09(spark, d):
    px = I.pixels(spark, d)
    return P.thumbnails(px, P.image_dims(px), 5, "r")


@query("a09_thumbnails_of_blocks", _THUMB)
def a09_blocks(spark, d):
    """The same from blocks of three pixels a side; only sums are shuffled."""
    return R.thumbnails_of_blocks(R.to_blocks(I.pixels(spark, d), ["r"], 3), 5, "r")


@query("j09_four_neighbours", _THUMB.replace("* 1.75::DOUBLE", "* (7 / 3::DOUBLE)").replace("range(5)", "range(4)"))
def j09(spark, d):
    px = I.pixels(spark, d)
    return P.thumbnails(px, P.image_dims(px), 4, "r")


def _whole_images(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.transform("embedding", lambda v: I.level(v).cast("double"))
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), pixels.alias("pixels"))


@query("a09_thumbnail_blobs", _THUMB)
def a09_blobs(spark, d):
    rows = P.thumbnail_blobs(_whole_images(spark, d), 5).select("image_id", F.posexplode("thumbnail").alias("i", "r"))
    return rows.select("image_id", (F.col("i") % 5).alias("x"), F.floor(F.col("i") / 5).cast("int").alias("y"), "r")


@query(
    "f02_mapped_images",
    f"WITH {I.PX} SELECT image_id, CAST(min(r) AS DOUBLE) AS least, CAST(max(r) AS DOUBLE) AS greatest,"
    " count(*) FILTER (r BETWEEN 100 AND 150) AS n_inside FROM px GROUP BY image_id",
)
def f02(spark, d):
    return P.image_stats(_whole_images(spark, d), 100, 150)


@query(
    "a14_resize_like",
    f"WITH {I.PX}, {_SPOTS.format(w=12, h=5)} SELECT s.image_id, s.x, s.y, r, g, b FROM spots s JOIN px p"
    " ON p.image_id = s.image_id AND p.x = s.x * 8 // 12 AND p.y = s.y * 8 // 5",
)
def a14(spark, d):
    px = I.pixels(spark, d)
    dims = P.image_dims(px)
    return P.resize_like(px, dims, dims.select("image_id", F.lit(12).alias("width"), F.lit(5).alias("height")))


@query("a14_resize_of_blocks", ORACLES["a14_resize_like"])
def a14_blocks(spark, d):
    return R.resize_blocks(R.to_blocks(I.pixels(spark, d), P.RGB, 3), P.RGB, 12, 5)


@query("u02_reflect", f"WITH {I.PX} SELECT {_RGB} FROM px UNION ALL SELECT image_id, x, 15 - y, r, g, b FROM px")
def u02(spark, d):
    px = I.pixels(spark, d)
    return P.reflect(px, P.image_dims(px))


@query(
    "u03_border",
    f"WITH {I.PX}, {_SPOTS.format(w=12, h=12)} SELECT s.image_id, s.x, s.y, coalesce(r, 240) AS r, coalesce(g, 150) AS g, coalesce(b, 150) AS b"
    " FROM spots s LEFT JOIN px p ON p.image_id = s.image_id AND p.x + 2 = s.x AND p.y + 2 = s.y",
)
def u03(spark, d):
    px = I.pixels(spark, d)
    return P.border(px, P.image_dims(px), 2)


@query(
    "u04_pad_last_slice",
    "WITH slots AS (SELECT unnest(range((SELECT (max(vec_id) // 12 + 1) * 12 FROM embeddings))) AS tile_no)"
    " SELECT tile_no, coalesce(label, 0) AS v FROM slots LEFT JOIN embeddings ON vec_id = tile_no",
)
def u04(spark, d):
    return P.pad_last_slice(load(spark, d, "embeddings").select(F.col("vec_id").alias("tile_no"), F.col("label").alias("v")), 12)


@query(
    "u04_sparse_slots",
    "WITH tiles AS (SELECT DISTINCT l_orderkey AS tile_no, l_orderkey % 5 + 1 AS v FROM lineitem WHERE l_orderkey % 7 < 3),"
    " slots AS (SELECT unnest(range((SELECT (max(tile_no) // 100 + 1) * 100 FROM tiles))) AS tile_no)"
    " SELECT tile_no, coalesce(v, 0) AS v FROM slots LEFT JOIN tiles USING (tile_no)",
)
def u04_sparse(spark, d):
    """Slots completed in a numbering with many gaps."""
    tiles = load(spark, d, "lineitem").where("l_orderkey % 7 < 3").select(F.col("l_orderkey").alias("tile_no")).distinct()
    return P.pad_last_slice(tiles.withColumn("v", F.col("tile_no") % 5 + 1), 100)


# ---------------------------------------------------------------- documents


@query("p19_nonblank_lines", f"WITH {I.LINES} SELECT doc_id, pos, line FROM lines")
def p19(spark, d):
    return I.lines(spark, d)


@query(
    "p20_clean_items",
    "WITH i AS (SELECT doc_id, list_filter(string_split(text, '!!'), lambda x: x NOT IN ('', ' ')) AS items FROM documents)"
    " SELECT doc_id, len(items) AS n_items, array_to_string(items, '|') AS items FROM i",
)
def p20(spark, d):
    items = T.clean_items(F.split("text", "!!"))
    return load(spark, d, "documents").select("doc_id", F.size(items).cast("long").alias("n_items"), F.array_join(items, "|").alias("items"))


@query(
    "p21_flatten_cells",
    f'WITH {I.CELLS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY table_no, "row", col) - 1 AS pos, text FROM cells',
)
def p21(spark, d):
    return D.flatten_cells(I.cells(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


@query(
    "p22_label_paragraphs",
    f"WITH {I.CELLS}, l AS (SELECT *, max(table_no) OVER (PARTITION BY doc_id) AS last FROM cells)"
    ' SELECT doc_id, table_no, "row", col, text FROM l WHERE table_no = last AND (contains(text, \':\') OR NOT contains(text, \'=\'))',
)
def p22(spark, d):
    return D.label_paragraphs(I.cells(spark, d))


@query(
    "p23_first_marked",
    "SELECT doc_id, substring(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'the'))[1], 12) AS value FROM documents",
)
def p23(spark, d):
    return load(spark, d, "documents").select("doc_id", T.first_marked(F.col("text"), "the", 11).alias("value"))


@query("o04_first_match", "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: contains(l, 'icense'))[1] AS value FROM documents")
def o04(spark, d):
    return load(spark, d, "documents").select("doc_id", T.first_marked(F.col("text"), "icense", 0).alias("value"))


_FIRST = "CASE WHEN contains({x}, '{o}') THEN substr({x}, 1, strpos({x}, '{o}') - 1) || '{n}' || substr({x}, strpos({x}, '{o}') + {k}) ELSE {x} END"


@query(
    "p24_replace_first",
    f"WITH {I.FILES}, r AS (SELECT path AS src, url || '/' || {_FIRST.format(x='name', o='_1', n='_2', k=2)} AS dst FROM files)"
    " SELECT src, dst, count(*) OVER (PARTITION BY dst) > 1 AS collides FROM r",
)
def p24(spark, d):
    renamed = F.concat("url", F.lit("/"), T.replace_first(F.col("name"), "_1", "_2"))
    return K.rename_manifest(I.named_files(spark, d), renamed)


@query("p25_latex_escape", f"WITH {I.LINES} SELECT doc_id, pos, {I.sql_escape('line')} AS tex FROM lines")
def p25(spark, d):
    return I.lines(spark, d).select("doc_id", "pos", T.latex_escape(F.col("line")).alias("tex"))


@query(
    "p26_latex_escape_v3",
    "SELECT page_id, CASE WHEN contains(u, '_') THEN replace(u, '_', '\\_') ELSE replace(u, '°', '\\°') END AS tex"
    " FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '/', '°') ELSE replace(url, '/', '_') END AS u FROM pages)",
)
def p26(spark, d):
    marked = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("/"), F.lit("°"))).otherwise(F.replace("url", F.lit("/"), F.lit("_")))
    return load(spark, d, "pages").select("page_id", T.latex_escape(marked, "v3").alias("tex"))


@query(
    "p27_tex_line",
    "SELECT conv_id, turn, '\\section{' || role || '}' AS section, '\\subsubsection{' || role || '}' || chr(10) || text AS sub,"
    " chr(9) || '\\item ' || role AS item, '\\item[' || role || ']' || text AS described FROM conversations",
)
def p27(spark, d):
    role, body = F.col("role"), F.col("text")
    return load(spark, d, "conversations").select(
        "conv_id", "turn", T.tex_line("section", role).alias("section"), T.tex_line("subsubsection", role, body).alias("sub"),
        T.tex_line("item", role).alias("item"), T.tex_line("description", role, body).alias("described"),
    )


_PARENT = "array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '\\')"


@query("p28_parent_dir", f"WITH {I.FILES} SELECT page_id, {_PARENT} AS folder FROM files")
def p28(spark, d):
    return I.named_files(spark, d).select("page_id", T.parent_dir(F.col("path")).alias("folder"))


@query("p29_type_glob", f"WITH {I.FILES} SELECT page_id, '*' || right(name, 4) AS glob FROM files")
def p29(spark, d):
    return I.named_files(spark, d).select("page_id", T.type_glob(F.col("name")).alias("glob"))


@query("p30_study_code", f"WITH {I.FILES} SELECT page_id, code FROM files")
def p30(spark, d):
    return I.named_files(spark, d).select("page_id", T.study_code(F.col("name")).alias("code"))


_MODE_NAMES = tuple(m for m, _ in T.MODES)
_MODE_SQL = (
    "list_value(" + ", ".join(f"'{m}'" for m in (*_MODE_NAMES, "other")) + ")[page_id % 5 + 1]"
)
_INDEX_SQL = "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '1,2' END"


@query("p31_mode_index", f"SELECT page_id, {_MODE_SQL} AS mode, {_INDEX_SQL} AS index_list FROM pages")
def p31(spark, d):
    mode = Q.chosen(F.col("page_id"), (*_MODE_NAMES, "other"))
    return load(spark, d, "pages").select("page_id", mode.alias("mode"), F.array_join(T.mode_index(mode).cast("array<string>"), ",").alias("index_list"))


def _specs(spark: SparkSession, d: str) -> DataFrame:
    mode = Q.chosen(F.col("page_id"), (*_MODE_NAMES, "other"))
    return D.build_spec(I.named_files(spark, d), T.parent_dir(F.col("path")), T.type_glob(F.col("name")), T.mode_index(mode))


@query(
    "p32_build_spec",
    f"WITH {I.FILES} SELECT page_id, {_PARENT} AS InputDirectory, {_PARENT} AS OutputDirectory, '*' || right(name, 4) AS InputFileNames,"
    f" {_INDEX_SQL} AS InputFileCorrespondencesIndex FROM files",
)
def p32(spark, d):
    rows = _specs(spark, d)
    lists = ("InputFileNames", "InputFileCorrespondencesIndex")
    return rows.select("page_id", "InputDirectory", "OutputDirectory", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in lists))


def _sql_json_field(name: str, value: str) -> str:
    return f"'  \"{name}\" : ' || {value}"


def _sql_json_text(value: str) -> str:
    return f"'\"' || replace({value}, '\\', '\\\\') || '\"'"


_JSON_FIELDS = (
    _sql_json_field("InputDirectory", _sql_json_text(_PARENT)),
    _sql_json_field("OutputDirectory", _sql_json_text(_PARENT)),
    _sql_json_field("InputFileNames", f"'[ ' || {_sql_json_text("'*' || right(name, 4)")} || ' ]'"),
)
_JSON_INDEX = f"CASE WHEN ({_INDEX_SQL}) = '' THEN '[ ]' ELSE '[ ' || replace(({_INDEX_SQL}), ',', ', ') || ' ]' END"


@query(
    "k04_spec_json",
    f"WITH {I.FILES} SELECT '{{' || chr(10) || {" || ',' || chr(10) || ".join(_JSON_FIELDS)}"
    f" || coalesce(',' || chr(10) || {_sql_json_field('InputFileCorrespondencesIndex', _JSON_INDEX)}, '') || chr(10) || '}}' AS value FROM files",
)
def k04(spark, d):
    return K.spec_json(_specs(spark, d).select("InputDirectory", "OutputDirectory", "InputFileNames", "InputFileCorrespondencesIndex"))


@query(
    "k04_spec_files",
    f"WITH {I.FILES} SELECT 'jobs/' || name || '.json' AS name, '{{' || chr(10) || {" || ',' || chr(10) || ".join(_JSON_FIELDS)}"
    f" || coalesce(',' || chr(10) || {_sql_json_field('InputFileCorrespondencesIndex', _JSON_INDEX)}, '') || chr(10) || '}}' AS value FROM files",
)
def k04_files(spark, d):
    """Each spec in a file of its own name, read back by name."""
    path = scratch_path(spark)
    specs = _specs(spark, d).select("name", "InputDirectory", "OutputDirectory", "InputFileNames", "InputFileCorrespondencesIndex")
    K.write_specs(specs.withColumn("name", F.concat(F.lit("jobs/"), "name")), path)
    return read_named_texts(spark, path).withColumnRenamed("content", "value")


@query("k02_copy_manifest", f"WITH {I.FILES} SELECT path AS src, 'out/' || name AS dst FROM files")
def k02(spark, d):
    return K.copy_manifest(I.named_files(spark, d), "out")


@query("k03_keyed_manifest", f"WITH {I.FILES} SELECT path AS src, 'out/' || code || '__' || name AS dst FROM files WHERE code IS NOT NULL")
def k03(spark, d):
    rows = I.named_files(spark, d).withColumn("code", T.study_code(F.col("name")))
    return K.keyed_copy_manifest(rows, "code", "out")


@query(
    "a08_group_images",
    "SELECT CAST(page_id % 7 AS BIGINT) AS subject, CAST(page_id // 7 % 3 AS BIGINT) AS day,"
    " array_to_string(list_sort(list(CAST(page_id AS VARCHAR))), ',') AS names FROM pages GROUP BY ALL",
)
def a08(spark, d):
    rows = load(spark, d, "pages").select(
        (F.col("page_id") % 7).alias("subject"), F.expr("page_id div 7 % 3").alias("day"), (F.col("page_id") % 2).alias("side"), F.col("page_id").cast("string").alias("name")
    )
    return D.group_images(rows, 1)


@query("a10_count_parts", f"WITH {I.LINES} SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id")
def a10(spark, d):
    return D.count_parts(I.lines(spark, d))


_PAIRS = (
    "pairs AS (SELECT doc_id, pos // 2 AS pair, max(line) FILTER (pos % 2 = 0) AS heading, max(line) FILTER (pos % 2 = 1) AS description"
    " FROM lines GROUP BY ALL)"
)


@query("w12_pair_lines", f"WITH {I.LINES}, {_PAIRS} SELECT * FROM pairs")
def w12(spark, d):
    return D.pair_lines(I.lines(spark, d))


@query(
    "w13_head_tail",
    f"WITH {I.LINES}, l AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM lines) SELECT doc_id, pos, line, 'head' AS part FROM l WHERE pos < 3"
    " UNION ALL SELECT doc_id, pos, line, 'tail' FROM l WHERE pos > last - 6",
)
def w13(spark, d):
    return D.head_tail(I.lines(spark, d), 3)


@query(
    "a11_itemize",
    f"WITH {I.LINES}, k AS (SELECT *, contains(line, ':') AS is_key FROM lines), b AS (SELECT *, CAST(sum(CASE WHEN is_key THEN 1 ELSE 0 END) OVER"
    " (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM k)"
    f" SELECT doc_id, block, max(line) FILTER (is_key) AS heading, coalesce(string_agg(chr(9) || '\\item ' || {I.sql_escape('line')}, chr(10) ORDER BY pos)"
    " FILTER (NOT is_key AND contains(line, '=')), '') AS items FROM b GROUP BY doc_id, block",
)
def a11(spark, d):
    return D.itemize(I.lines(spark, d))


_TEX_LINE = f"'\\subsubsection{{' || ({I.sql_escape('heading')}) || '}}' || chr(10) || ({I.sql_escape('d')})"
_TEX = (
    f"WITH {I.LINES}, {_PAIRS} SELECT doc_id, '\\begin{{document}}' || chr(10) || string_agg({_TEX_LINE}, chr(10) ORDER BY pair)"
    " || chr(10) || '\\end{document}' AS tex FROM (SELECT *, coalesce(description, '') AS d FROM pairs) GROUP BY doc_id"
)


@query("a12_render_tex", _TEX)
def a12(spark, d):
    return D.render_tex(D.pair_lines(I.lines(spark, d)))


@query("k05_tex_documents", _TEX)
def k05(spark, d):
    """Documents written as text, one file each, and read back by name."""
    path = scratch_path(spark)
    K.write_tex(D.render_tex(D.pair_lines(I.lines(spark, d))), path)
    return read_named_texts(spark, path).select(F.split("name", "[.]")[0].cast("long").alias("doc_id"), F.col("content").alias("tex"))


@query(
    "j07_before_first_member",
    f"WITH {I.LINES}, m AS (SELECT DISTINCT line FROM lines WHERE contains(line, 'icense')), s AS (SELECT doc_id, min(pos) AS stop FROM lines SEMI JOIN m USING (line) GROUP BY doc_id)"
    " SELECT doc_id, pos, line FROM lines LEFT JOIN s USING (doc_id) WHERE stop IS NULL OR pos < stop",
)
def j07(spark, d):
    lines = I.lines(spark, d)
    return D.before_first_member(lines, lines.where(F.contains("line", F.lit("icense")))).select("doc_id", "pos", "line")


@query(
    "j08_zip_by_position",
    f"WITH {I.LINES} SELECT doc_id, pos, line, text FROM lines JOIN conversations ON conv_id = doc_id AND turn = pos",
)
def j08(spark, d):
    turns = load(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), "text")
    return D.zip_by_position(I.lines(spark, d), turns)


# ---------------------------------------------------------------- answer logs


@query("p33_answer_key", f"WITH {I.TRIALS} SELECT event_id, phase, stimulus, expected FROM scored")
def p33(spark, d):
    return Q.score_trials(I.trials(spark, d), Q.answer_key(spark)).select("event_id", "phase", "stimulus", "expected")


@query("j05_score_trials", f"WITH {I.TRIALS} SELECT event_id, correct FROM scored")
def j05(spark, d):
    return Q.score_trials(I.trials(spark, d), Q.answer_key(spark)).select("event_id", "correct")


@query(
    "a07_phase_score",
    f"WITH {I.TRIALS} SELECT user_id, phase, count(*) FILTER (correct) AS n_correct, count(*) AS n_tries FROM scored GROUP BY user_id, phase",
)
def a07(spark, d):
    return Q.phase_score(Q.score_trials(I.trials(spark, d), Q.answer_key(spark)))


@query("w14_streaks", _STREAKS)
def w14(spark, d):
    log = load(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("correct"))
    return O.streaks(log, ["user_id"], ["ts", "event_id"]).select("event_id", "streak", "mastered")


@query(
    "s11_random_choice",
    "SELECT event_id, ['red', 'green', 'blue'][CAST('0x' || substr(md5('7|' || event_id), 1, 8) AS BIGINT) % 3 + 1] AS choice FROM events",
)
def s11(spark, d):
    return random_choice(load(spark, d, "events").select("event_id"), ["red", "green", "blue"], 7)
