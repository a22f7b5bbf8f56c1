"""Streaming forms of the deny and frequency aggregates.

The per-row parsers are stateless and serve streams as they are. The windowed
aggregates carry a watermark, so late rows are dropped and state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracesift.functions import text as tx
from tracesift.operators.firewall import deny_windows
from tracesift.operators.logs import resolve_pattern


def deny_stream(
    entries: DataFrame, time_column: str = "event_time", window_minutes: int = 60, lateness: str = "10 minutes"
) -> DataFrame:
    """Denied entries per window and pair of a stream (or, unchanged, a batch)."""
    return deny_windows(entries.withWatermark(time_column, lateness), window_minutes, time_column)


def frequency_stream(
    lines: DataFrame, pattern: str, time_column: str = "event_time", window_minutes: int = 60, lateness: str = "10 minutes"
) -> DataFrame:
    """Counts per window and extracted value of a stream of lines."""
    hits = lines.withColumn("value", tx.first_match("line", resolve_pattern(pattern))).where(F.col("value").isNotNull())
    counted = (
        hits.withWatermark(time_column, lateness)
        .groupBy(F.window(time_column, f"{window_minutes} minutes").alias("_window"), "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counted.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "value", "cnt")


def line_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Lines of text files as they arrive in a folder, stamped with arrival time."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return raw.select(F.col("value").alias("line"), F.current_timestamp().alias("event_time"))


def entry_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Parsed rows as they arrive in a folder of Parquet files, oldest files first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def start(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False) -> StreamingQuery:
    """Append finished windows to files; with ``once`` all present input, then stop."""
    writer = df.writeStream.outputMode("append").format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
