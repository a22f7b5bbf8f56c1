"""Shared steps of the operators: tables, samples, written intermediates and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracesift.session import discard, written_once

#: Rows and bytes that one Arrow batch brings into a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Bits of a filter of ``marked``, 64 to a row.
FILTER_BITS = 1 << 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; also bounds what one Arrow batch holds, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def sampled(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, the same ones each time: those with the smallest hash of ``doc_id``.

    A top-k, pruned in each partition before the shuffle.
    """
    return labelled.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(most).drop("_order")


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, parts: int, held: int) -> DataFrame:
    """Texts (and further columns) of at most ``most`` labelled documents outside the held-out fold, with ``label`` 0 or 1.

    The sample of ids and labels is bounded by ``most`` and therefore broadcast.
    Ids with contradicting labels count by their smallest label; null labels and ids don't count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(
        "_label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("_label").alias("_label"))
    chosen = sampled(known.where(fold(F.col("doc_id"), parts) != held), most)
    return docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).drop("_id")


def marked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: true where ``key`` is one of the ``ids`` (of one column), false for nearly all other rows and nulls.

    Every id sets one bit by its hash. However many there are, at most
    ``FILTER_BITS`` / 64 rows are broadcast; more ids mark more rows. A join of
    the marked rows decides; the others need not be shuffled for it.
    """
    (name, kind), = ids.dtypes

    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    own = ids.select(bit(F.col(name)).alias("_bit"))
    bits = own.groupBy(F.floor(F.col("_bit") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    at = bit(F.col(key).cast(kind))
    found = df.withColumn("_word", F.when(F.col(key).isNotNull(), F.floor(at / 64))).join(F.broadcast(bits), "_word", "left")
    return found.withColumn("_maybe", F.coalesce(F.getbit("_bits", (at % 64).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (null becomes empty)."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``most`` bytes; a longer text is a range of its own."""
    offsets = byte_offsets(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, len(texts))
        start = end


def byte_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows ``start`` to ``end`` and each row's offsets into them."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = byte_offsets(texts)[start : end + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _printed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and print, observed by the write itself.

    Rows that a lost executor makes Spark count twice change the print, which costs one more round.
    """
    seen = Observation()
    table = written_once(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                                       F.sum(F.xxhash64("b", "a") % 1000003).alias("s")))
    return table, (seen.get["n"], seen.get["x"], seen.get["s"])


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) of every node of the links ``a``, ``b``.

    Alternating large-star and small-star rounds: each node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows, until the
    edges no longer change and every component is a star. No step gathers a
    node's neighbours; a hub's rows are only joined and aggregated. Each round
    is written to the shared checkpoint folder, so that the lineage stays
    short and lost executors cost one round; older rounds are deleted.
    Self-links and repeated links change nothing. No links: no rows.
    """
    edges, seen = _printed(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.least("a", "_m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b")).distinct()
        after, now = _printed(small)
        discard(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
