"""A sink that writes each row's content to a file of the row's own name.

``df.write.format("named_files").mode("append").save(folder)`` takes the columns
``name`` and ``content`` (string or binary). Neighbouring rows of one name are
chunks of one file, so a large file never is one row.

Two phases: a task writes into a staging folder of its own attempt and reports the
names; the driver moves the files of the attempts that Spark counts as done, and
drops the staging folder with whatever failed or speculative attempts have left.
Nothing appears in the target before all tasks are done. Equal names, and in
``append`` names that the folder already has, are an error that leaves the folder
as it was. ``overwrite`` replaces the visible files of the folder. The driver holds
the names, not the contents, and moves one file after the other on a few threads,
as Spark's own committer does.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

from sparkloom.sources.folders import files_below, open_folder

MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt has written."""

    folder: str
    names: list[str]


def checked_name(name: str | None) -> str:
    parts = (name or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_staging-"):
        raise ValueError(f"not the name of a file: {name!r}")
    return name


class NamedFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_folder(self.path)
        task = TaskContext.get()
        folder = f"{self._staging(root)}/{task.partitionId() if task else 0}-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        names: dict[str, None] = {}
        last, out = None, None
        try:
            for batch in iterator:
                contents = pc.cast(batch.column("content"), pa.large_binary())
                for name, content in zip(batch.column("name").to_pylist(), contents):
                    if name != last or out is None:
                        if out is not None:
                            out.close()
                        if checked_name(name) in names:
                            raise ValueError(f"two files of one name: {name!r}")
                        names[name], last = None, name
                        if "/" in name:
                            system.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out is not None:
                out.close()
        return Written(folder, list(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        moves = [(m.folder, name) for m in messages if m is not None for name in m.names]
        twice = [name for name, n in Counter(name for _, name in moves).items() if n > 1]
        if twice:
            raise ValueError(f"two files of one name: {sorted(twice)[:5]}")
        new = {f"{root}/{name}" for _, name in moves}
        there = [info.path for info in files_below(system, root)]
        if not self.overwrite and (clash := sorted(new.intersection(there))):
            raise ValueError(f"files exist already: {clash[:5]}")
        for folder in sorted({path.rpartition("/")[0] for path in new} - {root}):
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: system.move(f"{m[0]}/{m[1]}", f"{root}/{m[1]}"), moves))
            list(pool.map(system.delete_file, set(there) - new if self.overwrite else ()))
        self._drop(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*open_folder(self.path))

    def _drop(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(root))


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFileWriter:
        kinds = {f.name: type(f.dataType) for f in schema.fields}
        if kinds.get("name") is not StringType or kinds.get("content") not in (StringType, BinaryType):
            raise ValueError(f"named_files takes name string and content string or binary, not {schema.simpleString()}")
        if "path" not in self.options:
            raise ValueError("named_files needs the path of a folder")
        return NamedFileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def write_named(df: DataFrame, path: str, mode: str = "append") -> None:
    """One file per ``name`` of (name, content) under the folder ``path``."""
    register(df.sparkSession)
    df.select("name", "content").write.format("named_files").mode(mode).save(path)
