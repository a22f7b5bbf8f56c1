"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracesift.llm.common import fold, strings
from tracesift.session import discard, written_once

#: N-grams in a profile, n-gram sizes, and texts per language that a profile is learnt from.
RANKS, SIZES, SAMPLE = 400, (1, 2, 3), 2_000


@cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams of a text's words, most frequent first, ties by code; empty without letters.

    A word is a run of letters with a blank on either side; no n-gram crosses a
    blank. An n-gram's code holds its characters in 21 bits each.
    """
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate((np.zeros(1, np.uint64), points.astype(np.uint64), np.zeros(1, np.uint64)))
    points = points[(points > 0) | np.concatenate(([True], points[:-1] > 0))]
    if not points.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = []
    for n in SIZES:
        codes = np.zeros(max(len(points) - n + 1, 0), np.uint64)
        inner = np.zeros(len(codes), bool)
        for k in range(n):
            part = points[k : k + len(codes)]
            codes = (codes << np.uint64(21)) | np.maximum(part, np.uint64(32))
            inner |= (part == 0) & (0 < k < n - 1)
        found.append(codes[~inner] if n > 1 else codes[points > 0])
    codes, counts = np.unique(np.concatenate(found), return_counts=True)
    order = np.lexsort((codes, -counts))
    return codes[order], counts[order]


class Profiles:
    """Each language's n-grams with their ranks, all in one sorted table."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.names = sorted(ranked)
        self.codes = np.unique(np.concatenate(list(ranked.values()))) if ranked else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.names), len(self.codes)), -1, np.int64)
        for row, name in enumerate(self.names):
            self.ranks[row, np.searchsorted(self.codes, ranked[name])] = np.arange(len(ranked[name]))

    def predict(self, text: str) -> tuple[str, float]:
        """The language with the smallest distance (ties by name) and one minus its share of the largest possible distance."""
        codes = ngrams(text)[0][:RANKS]
        if not len(codes):
            return "und", 0.0
        if not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.ranks[:, at]
        missing = (self.codes[at] != codes) | (known < 0)
        distance = np.where(missing, RANKS, np.abs(known - np.arange(len(codes)))).sum(axis=1)
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (RANKS * len(codes)))


def _first(rows: DataFrame, key: str, most: int, *order) -> DataFrame:
    ranks = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", ranks).where(F.col("_rank") <= most).drop("_rank")


def learn(docs: DataFrame, parts: int = 4, held: int = 2, most: int = SAMPLE) -> Profiles:
    """Profiles from at most ``most`` texts of each language outside the held-out fold, of every language there.

    The sample, those with the smallest hash of the id, and the ``RANKS`` most
    frequent n-grams are ranks within a language, which Spark prunes before it
    shuffles. N-grams are counted per batch on the executors and summed by Spark;
    the driver gets ``RANKS`` rows a language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), parts) != held)
    ids = _first(usable.select("doc_id", F.col("lang").alias("_lang")), "_lang", most, F.xxhash64("doc_id"), F.col("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = strings(batch, "text"), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                parts_ = [ngrams(t) for t, x in zip(texts.to_pylist(), langs, strict=True) if x == lang]
                codes, inverse = np.unique(np.concatenate([c for c, _ in parts_]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([n for _, n in parts_]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)],
                                                 names=["lang", "code", "n"])

    # The ids are bounded by ``most`` for each language, so they are broadcast.
    texts = usable.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), "lang").join(
        F.broadcast(ids.withColumnRenamed("doc_id", "_id").distinct()), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    counts = written_once(texts.select("text", "lang").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    ranked: dict[str, list[int]] = {}
    top = _first(counts, "lang", RANKS, F.desc("n"), F.asc("code")).collect()
    for lang, code, _ in sorted(top, key=lambda r: (r[0], -r[2], r[1])):
        ranked.setdefault(lang, []).append(code)
    discard(counts)
    return Profiles({k: np.array(v, np.int64).view(np.uint64) for k, v in ranked.items()})


def identified(docs: DataFrame, profiles: Profiles, parts: int = 4, held: int = 2) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row, from the whole text alone.

    ``und`` with score 0 for null texts and texts without letters. Ties go to
    the smaller language name. Repeated rows get equal results; a null id stays
    null and is not held out. An empty table gives no rows; further columns are
    ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in strings(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
