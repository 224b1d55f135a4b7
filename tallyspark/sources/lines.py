"""Lines of text files with their exact numbers, read in splits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """(path, size, block, rid, line) for every physical line, read with the ``text`` source,
    which splits large files into many tasks and leaves out a file's first BOM: ``size`` is the
    file's, ``block`` the split's first byte, ``rid`` rises by one within a split.
    ``path`` is a folder or a list of file names."""
    reader = spark.read.format("text")
    if isinstance(path, str):
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    elif not path:
        return spark.createDataFrame([], "path string, size long, block long, rid long, line string")
    else:
        path = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in path]     # names, not patterns
    # the metadata holds the path as a URI; elsewhere (binaryFile) it is plain
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return reader.load(path).select(
        plain.alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("rid"), F.col("value").alias("line"))


def split_offsets(raw: DataFrame) -> DataFrame:
    """(path, block, first_rid, offset) of ``text_lines``: a row a split, ``offset`` the count of lines
    in the file's earlier splits."""
    splits = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"),
                                              F.min("rid").alias("first_rid"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    return splits.select("path", "block", "first_rid",
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def numbered(raw: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """(path, idx, line) of ``text_lines`` (``splits``: its ``split_offsets``, if they are kept).

    Exact 0-based line numbers without a row-level window: within a split the
    generated row ids are consecutive, so a line's number is the count of lines
    in the file's earlier splits plus its distance from the split's first id.
    The per-split table (a few rows per file) gets its offsets from a running
    sum over the file's splits."""
    splits = split_offsets(raw) if splits is None else splits
    idx = F.col("offset") + F.col("rid") - F.col("first_rid")
    lines = raw.join(splits, ["path", "block"])
    return lines.select("path", idx.alias("idx"), "line")


def numbered_lines(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """(path, idx, line) for every physical line of a folder or a list of files."""
    return numbered(text_lines(spark, path, glob))


def in_order(lines: DataFrame) -> DataFrame:
    """``numbered_lines`` with ``row_id``: the number of a line in all files, taken in the order of
    their names. Only the files' line counts (a row a file) are summed in one place."""
    sizes = lines.groupBy("path").agg((F.max("idx") + 1).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return lines.join(first, "path").withColumn("row_id", F.col("first") + F.col("idx")).drop("first")
