"""Text logs as ``log_lines(file_path, line_no, line)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files with their 1-based number within the file.

    Files are split freely. Rows of one split carry consecutive ids, so a line's
    number is its place in its split plus the lines of the splits before it. The
    per-split counts are one small aggregate; nothing is sorted globally, and Spark
    chooses the join from its size. Bytes
    that are no UTF-8 become replacement characters when the text is used.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = raw.groupBy("file_path", "_block").agg(F.min("_id").alias("_base"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "file_path", "_block", "_base", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before")
    )
    number = F.col("_id") - F.col("_base") + F.col("_before") + 1
    return raw.join(starts, ["file_path", "_block"]).select("file_path", number.alias("line_no"), "line")


def text_lines(documents: DataFrame, key: str, text: str, prefix: str = "") -> DataFrame:
    """Lines of a text column; ``file_path`` is the prefixed key."""
    rows = documents.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("file_path"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.select("file_path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
