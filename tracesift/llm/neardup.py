"""Near-duplicate documents by b-bit MinHash: bands propose, packed low bits estimate, full sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm import similar_sets
from tracesift.llm.common import slices, strings, text_bytes
from tracesift.llm.textkernel import mix, shingles, words
from tracesift.session import discard, written_once

_SIGNED = "rid long, n_shingles long, f1 long, f2 long, bands array<long>, sig array<long>"


def _signer(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = strings(batch, "text"), batch.column(0)
            for lo, hi in slices(texts):
                data, offsets = text_bytes(texts, lo, hi)
                found = words(data, offsets)
                hashes, first = shingles(found.hashes, found.first, size)
                n = hi - lo
                counts, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
                values = np.zeros((n, similar_sets.MINIMA), np.uint64)
                for i in np.flatnonzero(np.diff(first)):
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    counts[i] = len(own)
                    prints[i] = mix(own, 1).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own, 2))
                    values[i] = similar_sets.minima(own)
                keys, sig = similar_sets.band_keys(values, bands, rows), similar_sets.packed(values)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (keys, sig)]
                signed = prints.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(counts), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy()), *lists],
                    names=["rid", "n_shingles", "f1", "f2", "bands", "sig"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row of ``docs`` (``doc_id``, ``text``).

    Two documents are linked if 100 * intersection >= ``percent`` * union of
    their sets of ``size``-word shingles; ``component_id`` is the smallest
    reachable id, ``kept`` tells whether that is the row's own. Equal sets are
    one class from the start (128-bit prints and the size of the set), so copies
    cost one row each; classes then go through ``similar_sets``. A pair at the
    threshold shares no band with probability (1 - t**rows)**bands: 4e-7 at 0.85.

    Null or empty texts have no shingles and no links. Rows that share an id
    are judged each by its own text. Rows without id get a null component and
    are kept. An empty table gives no
    rows; further columns are ignored.
    """
    signed = written_once(docs.select(F.col("doc_id").cast("long").alias("rid"), F.col("text").cast("string").alias("text"))
                          .mapInArrow(_signer(size, bands, rows), _SIGNED))
    classes = written_once(signed.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("rid").alias("class_id")).where("class_id is not null"))
    items = signed.join(classes, ["f1", "f2", "n_shingles"]).where("rid = class_id").select("rid", "bands", "sig").dropDuplicates(["rid", "bands"])
    items = written_once(items)
    texts = docs.select(F.col("doc_id").cast("long").alias("rid"), F.col("text").cast("string").alias("text")).join(items.select("rid", "sig"), "rid")
    found = similar_sets.similar_components(items, texts, size, percent)
    discard(items)
    rows_ = signed.select("rid", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("f1")).alias("f1"), "f2")
    return (
        rows_.join(classes.select("f1", "f2", F.col("n_shingles").alias("size_"), "class_id"), ["f1", "f2"], "left")
        .where("size_ is null or size_ = n_shingles")
        .join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
        .select(F.col("rid").alias("doc_id"), "n_shingles", F.coalesce("component", "class_id", "rid").alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, with all their columns.

    Of rows that share an id one stays. Rows without id stay.
    """
    decided = near_duplicates(docs, **how).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    with_id = docs.join(decided, docs["doc_id"] == F.col("_kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return with_id.unionByName(docs.where("doc_id is null"))
