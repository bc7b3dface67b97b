"""Listing folder trees, and whole text files, in tasks.

A tree is listed level by level: the folders of a level are a table, tasks list
them, and the folders they find are the next level. Each level is written, so that
the driver holds no names and a lost executor costs one level's task. A task holds
the entries of one folder at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.scratch import scratch_path
from sparkloom.sources.folders import open_folder, visible

#: Folders that one task lists on average in a wide level.
FOLDERS = 64
#: Bytes of contents in an Arrow batch.
BATCH_BYTES = 1 << 20


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _prefix(path: str, inner: str) -> str:
    """What stands before the path within the file system; Spark's ``file:``."""
    head = path.rstrip("/")
    return re.sub(r"^file:/*$", "file:", head[: len(head) - len(inner)]) if head.endswith(inner) and head != inner else "file:"


def list_tree(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, modified and length of the visible files of a folder, empty ones too."""
    system, root = open_folder(path)
    if system.get_file_info(root).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = _prefix(path, root)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = open_folder(path)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = own.get_file_info(fs.FileSelector(folder[len(prefix) :]))
                found = [x for x in found if visible(x.path, root) and x.type in (fs.FileType.File, fs.FileType.Directory)]
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([prefix + x.path for x in part], pa.string()),
                            pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_()),
                            pa.array([x.mtime_ns // 1000 if x.mtime_ns else None for x in part], pa.timestamp("us", "UTC")),
                            pa.array([x.size or 0 for x in part], pa.int64()),
                        ], ["path", "folder", "modified", "length"],
                    )

    level, found = spark.createDataFrame([(prefix + root,)], "path string"), []
    while True:
        listed = _written(level.mapInArrow(entries, "path string, folder boolean, modified timestamp, length long"))
        found.append(listed.where("not folder").select("path", "modified", "length"))
        folders = listed.where("folder").select("path")
        n = folders.count() if recursive else 0
        if not n:
            break
        level = folders.repartition(max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // FOLDERS)))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def read_named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the text files below a folder, each whole; the name is
    relative to the folder."""
    _, root = open_folder(path)
    cut = len(_prefix(path, root) + root) + 1

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(path)
        names, texts = [], []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "content"])

        for batch in batches:
            for name in batch.column("name").to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as file:
                    texts.append(file.read().decode())
                names.append(name)
                if sum(map(len, texts[-64:])) > BATCH_BYTES or len(texts) >= 64:
                    yield batch_of()
                    names, texts = [], []
        if names:
            yield batch_of()

    files = list_tree(spark, path).select(F.substring("path", cut + 1, 1 << 30).alias("name"))
    return files.repartition(max(spark.sparkContext.defaultParallelism, 1)).mapInArrow(contents, "name string, content string")
