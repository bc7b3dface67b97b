"""Writing logs, manifests, job specs and documents; each also as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.named_files import write_named


def outlier_lines(gaps: DataFrame, delta: str = "gap_us", path: str = "path") -> DataFrame:
    """Lines ``delta, path`` of the gaps classed as outliers."""
    return gaps.where("gap_class = 'outlier'").select(F.concat_ws(", ", F.col(delta).cast("string"), F.col(path).cast("string")).alias("value"))


def write_outlier_log(gaps: DataFrame, path: str) -> None:
    outlier_lines(gaps).write.text(path)


def base_name(path: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(path, sep), -1)


def copy_manifest(files: DataFrame, target: str, path: str = "path") -> DataFrame:
    """src and dst of each file to copy into the target folder."""
    return files.select(F.col(path).alias("src"), F.concat(F.lit(target + "/"), base_name(F.col(path))).alias("dst"))


def keyed_copy_manifest(files: DataFrame, key: str, target: str, path: str = "path") -> DataFrame:
    """The same with ``<key>__`` before the name; files without key are left out
    here (see :func:`unmatched`)."""
    name = F.concat(F.lit(target + "/"), F.col(key), F.lit("__"), base_name(F.col(path)))
    return files.where(F.col(key).isNotNull()).select(F.col(path).alias("src"), name.alias("dst"))


def unmatched(files: DataFrame, key: str) -> DataFrame:
    return files.where(F.col(key).isNull())


def rename_manifest(files: DataFrame, renamed: Column, path: str = "path") -> DataFrame:
    """src, dst and whether another row has the same destination."""
    rows = files.select(F.col(path).alias("src"), renamed.alias("dst"))
    targets = rows.groupBy("dst").agg((F.count("*") > 1).alias("collides"))
    return rows.join(targets, "dst").select("src", "dst", "collides")


def spec_json(specs: DataFrame) -> DataFrame:
    """Each row as one indented JSON text."""
    return specs.select(F.to_json(F.struct(*specs.columns), {"pretty": "true"}).alias("value"))


def write_specs(specs: DataFrame, path: str, name: Column | str = "name") -> None:
    """One indented JSON file per row, called by the row's ``name`` (not a field)."""
    own = F.col(name) if isinstance(name, str) else name
    fields = [c for c in specs.columns if not isinstance(name, str) or c != name]
    text = F.to_json(F.struct(*fields), {"pretty": "true"})
    write_named(specs.select(F.concat(own, F.lit(".json")).alias("name"), text.alias("content")), path)


def write_tex(documents: DataFrame, path: str) -> None:
    """One file ``<doc_id>.tex`` per document (doc_id, tex)."""
    write_named(documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".tex")).alias("name"), F.col("tex").alias("content")), path)


def write_outlier_logs(gaps: DataFrame, path: str, key: str, order: list[str], delta: str = "gap_us", name: str = "path") -> None:
    """One log ``<key>.log`` per key with its outlier lines in order; lines are
    chunks of the file, so a log need not fit into a row."""
    lines = gaps.where("gap_class = 'outlier'").withColumn("_file", F.concat(F.col(key).cast("string"), F.lit(".log")))
    lines = lines.repartition("_file").sortWithinPartitions("_file", *order)
    text = F.concat(F.col(delta).cast("string"), F.lit(", "), F.col(name).cast("string"), F.lit("\n"))
    write_named(lines.select(F.col("_file").alias("name"), text.alias("content")), path)
