"""A fresh path in the folder that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own_folder() -> tempfile.TemporaryDirectory:
    """A folder of this process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="spark-", ignore_cleanup_errors=True)


def scratch_path(spark: SparkSession) -> str:
    """Under ``spark.checkpoint.dir``, which driver and executors share. It may be
    unset only where both are one process; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = f"file://{_own_folder().name}"
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder}/{uuid.uuid4().hex}"
