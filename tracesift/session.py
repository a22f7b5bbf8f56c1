"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "tracesift") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for ``DataFrame.checkpoint``, shared by every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that
    setting nor a programmatic folder exists (tests on one machine) is a
    temporary folder made.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster[...] has executors apart
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Files read inside are listed by a few tasks a core, not by one task a folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_once(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    Like ``checkpoint`` it cuts the lineage and survives lost executors, but the
    rows are computed once, and later joins know the table's size. The table
    goes when the session ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table of ``written_once`` that no other plan will read again."""
    _delete(table.sparkSession, table._written_path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """The file system deletes the folder when the driver's JVM ends in good order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
