"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of words with smallest period q that is at least
``max(6, 4 * q)`` words long and as long as it can be. Each of its words comes up
four times in it, so a word that is rarer within a segment belongs to no run
there and cuts the segment. That is repeated until nothing is cut any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import slices, strings
from tracesift.llm.textkernel import mix, powers

#: A run holds each of its words at least so often and has at least so many words.
REPEATS, SHORTEST = 4, 6


def surviving_segments(ids: np.ndarray, segment: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches that stay when words too rare in their segment split it, again and again until stable.

    ``ids`` are word numbers, ``segment`` (ascending) starts with the texts' numbers.
    All segments of a round are counted together; a segment that a round leaves whole is done.
    """
    at = np.arange(len(ids))
    while len(at):
        _, word, counts = np.unique(segment * (ids.max() + 1) + ids[at], return_inverse=True, return_counts=True)
        stays = counts[word] >= REPEATS
        edges = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        whole = np.logical_and.reduceat(stays, edges)
        sizes = np.diff(np.append(edges, len(at)))
        for k in np.flatnonzero(whole & (sizes >= SHORTEST)).tolist():
            yield int(at[edges[k]]), int(at[edges[k]] + sizes[k])
        stays &= ~np.repeat(whole, sizes)
        at, segment = at[stays], segment[stays]
        if not len(at):
            return
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])))
        number = np.cumsum(new) - 1
        long_enough = (np.bincount(number) >= SHORTEST)[number]
        at, segment = at[long_enough], number[long_enough]


def _agree(words: np.ndarray, start: int, step: int, lag: int) -> int:
    """How many successive places from ``start`` on, going by ``step`` (1 or -1), hold the same word as ``lag`` places later."""
    count, size, last = 0, 64, len(words) - lag
    while True:
        lo = start + count if step > 0 else max(0, start - count - size + 1)
        hi = min(last, lo + size) if step > 0 else start - count + 1
        if lo >= hi:
            return count
        differ = np.flatnonzero(words[lo:hi] != words[lo + lag : hi + lag])
        if len(differ):
            return count + int(differ[0] if step > 0 else hi - lo - 1 - differ[-1])
        count, size = count + hi - lo, size * 2


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one segment.

    For each lag q the segment is cut into cells of q words. A run of that period
    spans two equal neighbouring cells whole, so hashes of the cells (off one
    running sum) point to every run, in q-th parts of the words; words decide, and
    the stretch is followed both ways. Two cells inside a run that was found at a
    smaller lag belong to that run, whose period is the smallest.
    """
    n = len(words)
    power, _ = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words.astype(np.uint64), 5) * power[:n], out=sums[1:])
    reach = np.zeros(n, np.int64)  # the furthest end of a found run over each word
    found = []
    for lag in range(1, n // REPEATS + 1):
        cells = np.diff(sums[::lag])
        equal = np.flatnonzero(cells[:-1] * power[lag] == cells[1:]) * lag
        if not len(equal):
            continue
        done = 0
        for x in equal[reach[equal] < equal + 2 * lag].tolist():
            if x + 2 * lag <= done or not np.array_equal(words[x : x + lag], words[x + lag : x + 2 * lag]):
                continue
            start = x - _agree(words, x - 1, -1, lag)
            done = x + 2 * lag + _agree(words, x + lag, 1, lag)
            if done - start >= max(SHORTEST, REPEATS * lag):
                found.append((start, done - start, lag))
                reach[start:done] = np.maximum(reach[start:done], done)
    return found


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """For every tenth document by ``crc32`` of its decimal id: the order in which a stretch of its words repeats to the end."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(reorder: Callable[[int | None, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = strings(batch, "text"), batch.column(0)
            for lo, hi in slices(texts):
                words, first, numbers, ids = [], [0], {}, []
                for doc_id, text in zip(keys.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    own = text.encode().split()
                    order = reorder(doc_id, len(own)) if reorder else None
                    own = own if order is None else [own[k] for k in order.tolist()]
                    for word in own:
                        ids.append(numbers.setdefault(word, len(numbers)))
                    words.append(own)
                    first.append(len(ids))
                values, offsets = np.array(ids, np.int64), np.array(first)
                runs: list[list] = [[] for _ in words]
                owner = np.repeat(np.arange(len(words)), np.diff(offsets))
                for a, b in surviving_segments(values, owner):
                    text_no = int(owner[a])
                    runs[text_no] += [(a - first[text_no] + s, n, q) for s, n, q in runs_of(values[a:b])]
                collapsed = []
                for own, mine in zip(words, runs, strict=True):
                    mine.sort(key=lambda r: (r[0], r[2]))
                    if mine:
                        kept = np.ones(len(own), bool)
                        for s, n, q in mine:
                            kept[s + q : s + n] = False
                        own = [own[k] for k in np.flatnonzero(kept).tolist()]
                    collapsed.append(b" ".join(own))
                named = [[{"start": s, "length": n, "period": q} for s, n, q in mine] for mine in runs]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array(named, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, reorder: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id``, ``runs`` (by start, then period) and ``collapsed``: the words without those that repeat a run's first period.

    Words are runs of bytes other than space and \\x09-\\x0D, told apart byte by
    byte. ``reorder`` may give the order of a document's words first. Null and empty texts have no runs and
    collapse to nothing. Every row stands for itself: repeated rows and null ids stay, further columns are ignored, an
    empty table gives no rows. Memory goes with a slice of texts of 1 MB or with one longer text.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _finder(reorder), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest length over period; the first of equals; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def run_digests(docs: DataFrame) -> DataFrame:
    """Numbers and digests of the runs of every document, with the stretches of ``planted_order`` in it."""
    found = periodic_runs(docs, planted_order).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
