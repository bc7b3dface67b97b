"""A stream over files, one per trigger, gives the classes of the batch."""

import datetime as dt
import random

from sparkloom.operators import ordered as O
from sparkloom.streaming.gaps import stream_gaps


def test_stream_equals_batch(spark, tmp_path):
    rng, now, rows = random.Random(1), dt.datetime(2024, 1, 1), []
    for i in range(120):
        now += dt.timedelta(seconds=rng.choice([10, 300, 301, 4000, 36000]))
        rows.append((i % 3, i, now))
    schema = "station long, event_id long, ts timestamp"
    for k in range(3):
        part = spark.createDataFrame(rows[40 * k : 40 * k + 40], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = O.classify_gaps(O.time_gaps(spark.createDataFrame(rows, schema), ["station"], "ts", "event_id"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = (
        stream_gaps(stream, "station", "ts", "event_id")
        .writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("gaps").select("event_id", "gap_us", "gap_class").collect())
    assert got == sorted(tuple(r) for r in batch.select("event_id", "gap_us", "gap_class").collect())
