"""Document lines and table cells: numbering, pairing, itemising, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import latex_escape, tex_line


def nonblank_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, line): non-empty lines, numbered from 0 within the document.

    Numbering happens inside the row, so no shuffle is needed.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x != "")
    return docs.select(doc, F.posexplode(lines).alias("pos", "line"))


def flatten_cells(cells: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Table cells (table_no, row, col, text) as one numbered list per document."""
    order = Window.partitionBy(doc).orderBy("table_no", "row", "col")
    return cells.withColumn("pos", F.row_number().over(order) - 1).select(doc, "pos", "text")


def label_paragraphs(cells: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Cells of each document's last table that have ``:`` or lack ``=``."""
    last = F.max("table_no").over(Window.partitionBy(doc))
    rows = cells.withColumn("_last", last).where(F.col("table_no") == F.col("_last")).drop("_last")
    return rows.where(F.contains("text", F.lit(":")) | ~F.contains("text", F.lit("=")))


def pair_lines(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, pair, heading, description) from lines taken two by two; an odd
    last line has a null description."""
    rows = lines.withColumn("pair", F.floor(F.col("pos") / 2))
    side = F.col("pos") % 2
    return rows.groupBy(doc, "pair").agg(
        F.max(F.when(side == 0, F.col("line"))).alias("heading"),
        F.max(F.when(side == 1, F.col("line"))).alias("description"),
    )


def head_tail(lines: DataFrame, n: int, doc: str = "doc_id") -> DataFrame:
    """The first n lines (part ``head``) and the last 2n (``tail``) per document;
    a line may be both."""
    last = F.max("pos").over(Window.partitionBy(doc))
    rows = lines.withColumn("_last", last)
    head = rows.where(F.col("pos") < n).withColumn("part", F.lit("head"))
    tail = rows.where(F.col("pos") > F.col("_last") - 2 * n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail).drop("_last")


def before_first_member(lines: DataFrame, members: DataFrame, doc: str = "doc_id", value: str = "line") -> DataFrame:
    """Lines before a document's first line that equals a member's ``value``."""
    stops = lines.join(members.select(value).distinct(), value, "left_semi").groupBy(doc).agg(F.min("pos").alias("_stop"))
    rows = lines.join(stops, doc, "left").where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    return rows.drop("_stop")


def zip_by_position(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of two numbered lists at equal positions; the shorter ends the zip."""
    return left.join(right, [key, "pos"])


def itemize(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """For each ``:`` line the ``=`` lines up to the next one, as item lines.

    (doc, block, heading, items): a ``:`` line without ``=`` line has no items;
    ``=`` lines before the first ``:`` line belong to block 0.
    """
    order = Window.partitionBy(doc).orderBy("pos")
    is_key = F.contains("line", F.lit(":"))
    rows = lines.withColumn("block", F.sum(is_key.cast("int")).over(order))
    item = F.when(~is_key & F.contains("line", F.lit("=")), F.struct("pos", "line"))
    out = rows.groupBy(doc, "block").agg(
        F.max(F.when(is_key, F.col("line"))).alias("heading"), F.array_sort(F.collect_list(item)).alias("items")
    )
    lines_of = F.transform("items", lambda x: tex_line("item", latex_escape(x["line"])))
    return out.withColumn("items", F.array_join(lines_of, "\n"))


def count_parts(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    return lines.groupBy(doc).agg(F.count("*").alias("n_lines"))


def render_tex(pairs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, tex): headings and descriptions as subsubsections, in order."""
    line = tex_line("subsubsection", latex_escape(F.col("heading")), latex_escape(F.coalesce("description", F.lit(""))))
    rows = pairs.select(doc, "pair", line.alias("line"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("pair", "line"))), lambda x: x["line"])
    return rows.groupBy(doc).agg(
        F.concat(F.lit("\\begin{document}\n"), F.array_join(body, "\n"), F.lit("\n\\end{document}")).alias("tex")
    )


def build_spec(files: DataFrame, folder: Column, glob: Column, index: Column) -> DataFrame:
    """Files with the fields that a job spec fills in."""
    return files.select(
        "*",
        folder.alias("InputDirectory"),
        folder.alias("OutputDirectory"),
        F.array(glob).alias("InputFileNames"),
        index.alias("InputFileCorrespondencesIndex"),
    )


#: Keys that remain in each grouping mode, in the order of the mode list.
GROUP_KEYS = (("subject", "day", "side"), ("subject", "day"), ("subject", "side"), ("subject",))


def group_images(images: DataFrame, mode: int) -> DataFrame:
    """Names of the images that are shown together, sorted and comma-joined."""
    names = F.array_join(F.array_sort(F.collect_list("name")), ",")
    return images.groupBy(*GROUP_KEYS[mode]).agg(names.alias("names"))
