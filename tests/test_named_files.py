"""The sink of one named file per row: names, both phases, errors."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.named_files import NamedFileWriter, Written, write_named


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.startswith("."))


@pytest.fixture
def rows(spark):
    return spark.range(0, 20, 1, 4).select(F.format_string("sub/f%02d.txt", "id").alias("name"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("content"))


def test_one_file_per_name(spark, tmp_path, rows):
    write_named(rows, f"file:{tmp_path}/out")
    assert files(tmp_path / "out") == [f"sub/f{i:02d}.txt" for i in range(20)]
    assert (tmp_path / "out/sub/f07.txt").read_text() == "é" * 7 and os.listdir(tmp_path / "out") == ["sub"]


def test_neighbouring_rows_are_chunks(spark, tmp_path):
    chunks = [("a.zst", b"\0\1"), ("a.zst", None), ("a.zst", b"\2"), ("b", b"")]
    write_named(spark.createDataFrame(chunks, "name string, content binary").coalesce(1), f"{tmp_path}/out")
    assert (tmp_path / "out/a.zst").read_bytes() == b"\0\1\2" and (tmp_path / "out/b").read_bytes() == b""


@pytest.mark.parametrize("name", ["'same'", "case when id = 7 then null else concat('z', id) end", "'../up'", "'/abs'", "'a//b'", "'_staging-x'"])
def test_bad_and_equal_names_leave_nothing(spark, tmp_path, name):
    rows = spark.range(0, 20, 1, 4).selectExpr(f"{name} AS name", "'x' AS content")
    with pytest.raises(Exception, match="name"):
        write_named(rows, f"{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out") or files(tmp_path / "out") == []


def test_append_refuses_and_overwrite_replaces(spark, tmp_path, rows):
    out = f"{tmp_path}/out"
    write_named(rows.limit(3), out)
    before = files(out)
    with pytest.raises(Exception, match="exist already"):
        write_named(rows, out)
    assert files(out) == before
    write_named(rows.limit(2).withColumn("content", F.lit("new")), out, "overwrite")
    assert files(out) == before[:2] and open(f"{out}/{before[0]}").read() == "new"


def test_a_task_that_ends_between_write_and_commit(tmp_path):
    """Its attempt leaves staged files only; the attempt that is reported counts."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([b"1"])], ["name", "content"])
    writer = NamedFileWriter(str(tmp_path), overwrite=False)
    writer.write(iter([batch]))  # lost: no one hears of it
    assert files(tmp_path) and not os.path.exists(tmp_path / "f")
    again = writer.write(iter([batch]))
    writer.commit([again, None])
    assert files(tmp_path) == ["f"]
    second = NamedFileWriter(str(tmp_path), overwrite=False)
    made = second.write(iter([pa.RecordBatch.from_arrays([pa.array(["g"]), pa.array([b"2"])], ["name", "content"])]))
    second.abort([made])
    assert files(tmp_path) == ["f"]
    with pytest.raises(ValueError, match="two files"):
        second.commit([Written("x", ["g"]), Written("y", ["g"])])


def test_a_retried_task_writes_each_file_once(spark, tmp_path):
    """The first attempt of each task fails after it has written."""
    import subprocess
    import sys

    code = f"""
import os, sys
from pyspark.sql import SparkSession
from pyspark import TaskContext
sys.path.insert(0, {os.getcwd()!r})
from sparkloom.sources.named_files import write_named
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.local.dir", {str(tmp_path)!r}).getOrCreate()
def fail(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
df = spark.range(0, 6, 1, 3).selectExpr("concat('f', id) AS name", "repeat('x', 5) AS content")
write_named(df.mapInArrow(fail, df.schema), {str(tmp_path / "out")!r})
"""
    env = os.environ | {"PYTHONPATH": os.getcwd()}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, capture_output=True, timeout=300)
    assert files(tmp_path / "out") == [f"f{i}" for i in range(6)]
