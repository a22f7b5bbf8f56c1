"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "parquet", "csv")


def write_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write a result; any Hadoop file system URI works as the path."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {', '.join(FORMATS)}")
    df.write.mode(mode).format(fmt).save(path)


def export_results(results: dict[str, DataFrame], path: str, tag: str, fmt: str = "json") -> None:
    """Write results below ``<path>/source_tool=<name>/tag=<tag>``, one folder a
    result, so that a reader can prune by either."""
    for name, df in results.items():
        write_result(df.withColumn("exported_at", F.current_timestamp()), f"{path}/source_tool={name}/tag={tag}", fmt)
