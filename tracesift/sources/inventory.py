"""File listings, file metadata and lookup with precedence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.operators.ranking import first_per_key, positive, top_n


def file_inventory(spark: SparkSession, base: str) -> DataFrame:
    """Files below a folder: path, size, modification time. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = relative_path(F.col("path"), base)
    return files.select("path", relative.alias("relative_path"), "length", "modificationTime")


def relative_path(path: Column, base: str) -> Column:
    """The part of a file's path below the folder ``base``, by the longest way the folder begins the path.

    Paths are URIs and may be percent-encoded; the folder may lack its scheme.
    """
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    root = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", base).rstrip("/") + "/"
    return F.when(plain.startswith(root), F.substring(plain, F.lit(len(root) + 1), F.length(plain))).otherwise(plain)


def directory_entries(files: DataFrame, prefix: str = "", max_results: int | None = None) -> DataFrame:
    """Entries of a folder, folders first, then by name without regard to case."""
    first = F.split("relative_path", "/", 2)
    is_dir = F.size(first) > 1
    entries = files.groupBy(F.get(first, 0).alias("name"), is_dir.alias("is_dir")).agg(F.max("length").alias("length"))
    kept = entries.where(F.startswith(F.lower("name"), F.lit(prefix.lower())))
    ordered = top_n(kept, max_results if max_results is None else positive("max_results", max_results), F.desc("is_dir"), F.asc(F.lower("name")), F.asc("name"))
    return ordered.select(
        F.when(F.col("is_dir"), F.concat("name", F.lit("/"))).otherwise(F.col("name")).alias("name"),
        F.when(F.col("is_dir"), "directory").otherwise("file").alias("type"),
        F.when(~F.col("is_dir"), F.col("length")).alias("size"),
    )


def file_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Size, modification time and number of lines of text files."""
    raw = spark.read.text(paths)
    meta = "_metadata"
    return raw.groupBy(
        F.col(f"{meta}.file_path").alias("file_path"), F.col(f"{meta}.file_name").alias("name"),
        F.col(f"{meta}.file_size").alias("size_bytes"),
        F.date_format(f"{meta}.file_modification_time", "yyyy-MM-dd HH:mm:ss").alias("modified"),
    ).agg(F.count(F.lit(1)).alias("line_count"))


def resolve_files(inventory: DataFrame) -> DataFrame:
    """One place for every file name: lowest ``priority`` first, a workspace
    folder before the root of the same place, then by path."""
    ranked = inventory.withColumn("_root_level", (F.coalesce("workspace", F.lit("")) == "").cast("int"))
    return first_per_key(ranked, ["filename"], "priority", "_root_level", "object_path").drop("_root_level")


def workspace_files(inventory: DataFrame, workspace: str | None = None, include_common: bool = True) -> DataFrame:
    """Distinct file names of a workspace; the first place shadows later ones.

    Without a workspace every file counts, as a listing by empty prefix does.
    """
    mine = inventory if workspace is None else inventory.where(F.col("workspace") == workspace)
    if not include_common:
        mine = mine.where(F.col("priority") == 0)
    return first_per_key(mine, ["filename"], "priority", "object_path")
