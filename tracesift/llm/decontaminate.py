"""Benchmark passages in documents: SimHash of item-sized windows, multi-index lookup, exact check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import slices, strings, text_bytes
from tracesift.llm.textkernel import mix, shingles, words

#: Fingerprints of 64 bits in 8 blocks. Two that differ in at most ``RADIUS`` bits differ in at most 2 within some block.
BLOCKS, NEAR, RADIUS = 8, 2, 23
#: Items and characters of items that one pass over the documents holds in memory.
PASS_ITEMS, PASS_CHARS = 20_000, 16 << 20

_MATCH = "doc_id long, item_id long, start_word long, n_words int, start long, n_chars long, hamming int, similarity double"


def _signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of 64 signed weights per shingle."""
    bits = np.unpackbits(mix(hashes, 7).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits * np.float32(2) - 1) * weights[:, None]


def _print(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


@dataclass
class Index:
    """The items of one pass: shingles with their weights, lengths, prints and block tables by item length."""

    item_ids: list
    lengths: np.ndarray
    shingle: np.ndarray
    weight: np.ndarray
    rare: float
    lengths_of: list[np.ndarray]
    bags: list[dict[int, int]]
    prints: np.ndarray
    tables: dict[int, list[list[np.ndarray]]]

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.shingle, hashes), len(self.shingle) - 1)
        return np.where(self.shingle[place] == hashes, self.weight[place], np.float32(self.rare))


_NEAR_MASKS = [m for m in range(256) if m.bit_count() <= NEAR]


def build_index(items: list[tuple[int, str]], size: int) -> Index | None:
    """The index of ``(item_id, text)``; a shingle's weight falls with the number of items that hold it."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    data, offsets = text_bytes(texts, 0, len(texts))
    found = words(data, offsets)
    hashes, first = shingles(found.hashes, found.first, size)
    used = [i for i in range(len(items)) if first[i + 1] > first[i]]
    if not used:
        return None
    own = [hashes[first[i] : first[i + 1]] for i in used]
    lengths = np.diff(found.first)[used]
    shingle, holders = np.unique(np.concatenate([np.unique(x) for x in own]), return_counts=True)
    weight = np.log1p(len(used) / holders).astype(np.float32)
    index = Index([items[i][0] for i in used], lengths, shingle, weight, float(np.log1p(len(used))), [], [], np.empty(0, np.uint64), {})
    holds: list[set] = [set() for _ in shingle]
    for n, x in zip(lengths, own, strict=True):
        for k in np.searchsorted(shingle, x):
            holds[k].add(int(n))
    index.lengths_of = [np.array(sorted(x)) for x in holds]
    for x in own:
        values, counts = np.unique(x, return_counts=True)
        index.bags.append(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    index.prints = np.concatenate([_print(_signs(x, index.weights(x)).sum(axis=0, keepdims=True)) for x in own])
    for n in np.unique(lengths):
        members = np.flatnonzero(lengths == n)
        tables = []
        for b in range(BLOCKS):
            values = (index.prints[members] >> np.uint64(8 * b)).astype(np.int64) & 255
            slots: list[list[int]] = [[] for _ in range(256)]
            for m, v in zip(members, values, strict=True):
                for mask in _NEAR_MASKS:
                    slots[v ^ mask].append(int(m))
            tables.append([np.array(x, np.int64) for x in slots])
        index.tables[int(n)] = tables
    return index


def _near_items(index: Index, n: int, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(window, item, Hamming distance) of all items of ``n`` words within the radius of the window's print."""
    for w, value in enumerate(prints.tolist()):
        found = np.unique(np.concatenate([table[(value >> (8 * b)) & 255] for b, table in enumerate(index.tables[n])]))
        if len(found):
            distance = np.bitwise_count(index.prints[found] ^ np.uint64(value))
            for k in np.flatnonzero(distance <= RADIUS):
                yield w, int(found[k]), int(distance[k])


def _similarity(index: Index, bag: dict[int, int], window: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles: the sum of smaller by the sum of larger counts, each times the weight."""
    values, at, counts = np.unique(window, return_index=True, return_counts=True)
    shared = total = 0.0
    known = 0
    for v, c, w in zip(values.tolist(), counts.tolist(), weights[at].tolist(), strict=True):
        other = bag.get(v, 0)
        known += other > 0
        shared += w * min(c, other)
        total += w * max(c, other)
    if known < len(bag):
        missing = np.array([v for v in bag if v not in set(values.tolist())], np.uint64)
        total += float(sum(w * bag[v] for v, w in zip(missing.tolist(), index.weights(missing).tolist(), strict=True)))
    return shared / total


def _in_document(index: Index, hashes: np.ndarray, size: int, full: bool, least: float, hits: np.ndarray) -> dict[int, tuple]:
    """Best window of every item found among a document's word hashes: (similarity, start, length, distance).

    ``hits``: words at which a shingle of some item begins. A window without
    such a word has similarity 0, so only windows around them get prints. Only
    items of which ``size`` is the shingle size are looked for; a document of
    fewer words than an item is one window.
    """
    best: dict[int, tuple] = {}
    all_shingles = shingles(hashes, np.array([0, len(hashes)]), size)[0]
    by_length: dict[int, list[int]] = {}
    for h in hits.tolist():
        k = np.searchsorted(index.shingle, all_shingles[h])
        for n in index.lengths_of[k].tolist():
            if n == size or (full and n > size):
                by_length.setdefault(n, []).append(h)
    for length, places in by_length.items():
        n = min(length, len(hashes))
        runs = max(n - size, 0) + 1
        first = np.zeros(len(hashes) - n + 2, np.int64)
        np.add.at(first, np.maximum(np.array(places) - runs + 1, 0), 1)
        np.add.at(first, np.minimum(np.array(places) + 1, len(hashes) - n + 1), -1)
        starts = np.flatnonzero(np.cumsum(first)[:-1] > 0)
        cuts = np.flatnonzero(np.diff(starts) > 1) + 1
        for part in np.split(starts, cuts):
            if not len(part):
                continue
            span = all_shingles[part[0] : part[-1] + runs]
            weights = index.weights(span)
            sums = np.concatenate((np.zeros((1, 64)), np.cumsum(_signs(span, weights), axis=0, dtype=np.float64)))
            prints = _print(sums[runs:] - sums[:-runs])
            for w, item, distance in _near_items(index, length, prints):
                value = _similarity(index, index.bags[item], span[w : w + runs], weights[w : w + runs])
                if value >= least - 1e-9:
                    row = (-value, int(part[0]) + w, n, distance)
                    best[item] = min(best.get(item, row), row)
    return best


def _matches(index: Index, size: int, least: float, texts: pa.Array) -> Iterator[tuple[int, dict[int, tuple], Callable]]:
    """(row, best windows, character range of a word range) of every text with a match."""
    low = np.zeros(1 << 20, bool)
    low[(index.shingle & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    for lo, hi in slices(texts):
        data, offsets = text_bytes(texts, lo, hi)
        found = words(data, offsets)
        bests: dict[int, dict[int, tuple]] = {}
        for k in sorted({min(size, n) for n in index.tables}):  # shorter items are one shingle of their own length
            hashes, first = shingles(found.hashes, found.first, k)
            maybe = np.flatnonzero(low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(index.shingle, hashes[maybe]), len(index.shingle) - 1)
            maybe = maybe[index.shingle[place] == hashes[maybe]]
            owners = np.searchsorted(first, maybe, "right") - 1
            bounds = np.flatnonzero(np.diff(owners, prepend=-1, append=-1))
            for lo_hit, hi_hit in zip(bounds[:-1], bounds[1:], strict=True):
                i = int(owners[lo_hit])
                own = found.hashes[found.first[i] : found.first[i + 1]]
                bests.setdefault(i, {}).update(_in_document(index, own, k, k == size, least, maybe[lo_hit:hi_hit] - first[i]))
        for i, best in sorted(bests.items()):
            begin = found.first[i]
            if best:
                def chars(w: int, n: int, begin=begin, i=i) -> tuple[int, int]:
                    a, b = found.starts[begin + w], found.ends[begin + w + n - 1]
                    text = data[offsets[i] : b]
                    return len(text[: a - offsets[i]].tobytes().decode()), len(text[a - offsets[i] :].tobytes().decode())

                yield lo + i, best, chars


def _passes(items: DataFrame, size: int) -> Iterator[Index]:
    """Indexes over all items, each of a bounded number of items and characters."""
    usable = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    n, length = usable.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).head()
    parts = max(1, -(-n // PASS_ITEMS), -(-length // PASS_CHARS))
    for part in range(parts):
        index = build_index([tuple(r) for r in usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().orderBy("item_id", "text").collect()], size)
        if index:
            yield index


def contaminations(docs: DataFrame, items: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document row and benchmark item that it holds, with the best window.

    ``doc_id``, ``item_id``, ``start_word``, ``n_words`` (the window's), ``start``
    and ``n_chars`` in the text, ``hamming`` and ``similarity`` (weighted Jaccard
    of ``size``-word shingles, at least ``least``; of equal windows the first).

    For each item the windows of as many words are compared, or the whole text
    where it has fewer. Windows that share
    no shingle with any item can't be similar and get no print; all others get a
    64-bit SimHash of their weighted shingles and look their 8 blocks up in
    tables that hold each item under every block value within 2 bits, which
    finds all items within 23 bits. The exact similarity decides. At similarity
    0.8 prints differ in about 10 bits, in more than 23 with probability 1e-6.

    Items are read in passes of at most ``PASS_ITEMS``, so the memory of a task
    is bounded at any size of the benchmark. Items of fewer words than ``size``
    are one shingle, found wherever a text holds those words; null and empty items and texts match nothing. Equal items
    count once per id; repeated rows of documents each give their rows; null ids
    stay null. Empty tables give no rows; further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = texts.sparkSession.createDataFrame([], _MATCH)
    for index in _passes(items, size):
        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (batch.column(0)[i].as_py(), index.item_ids[item], start, n, *chars(start, n), distance, -value)
                    for i, best, chars in _matches(index, size, least, strings(batch, "text"))
                    for item, (value, start, n, distance) in sorted(best.items())
                ]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=[x.split()[0] for x in _MATCH.split(", ")])

        out = out.union(texts.mapInArrow(run, _MATCH))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; each row is decided where it is read, without a shuffle."""
    for index in _passes(items, size):
        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, _ in _matches(index, size, least, strings(batch, "text")):
                    clean[i] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
