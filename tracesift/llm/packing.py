"""Packing documents into token sequences by bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import slices, strings, text_bytes
from tracesift.llm.textkernel import words

#: Runs without white space whose ids a worker keeps, and their ids; when full it starts anew.
CACHED_RUNS, CACHED_IDS = 1_200_000, 1 << 23

_PLAIN, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[[c for c in range(128) if chr(c).isalnum()]] = True
#: No apostrophes, which begin contractions, and nothing that a special token holds.
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True


class BestFit:
    """Online best fit with at most ``most`` open bins of ``capacity``.

    A bit of ``free`` says whether some open bin has just that much space left,
    so the tightest bin for an item is the lowest bit at or above its size.
    When one bin too many is open, the fullest closes.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free, self.open, self.used = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        own = self.bins[space]
        bin_ = own.pop()
        if not own:
            self.free &= ~(1 << space)
        self.open -= 1
        return bin_

    def put(self, size: int) -> tuple[int, int]:
        """The bin that takes an item of ``size`` (1 to ``capacity``), and the item's offset there."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.capacity, self.used
            self.used += 1
        left = space - size
        if left:
            if self.open >= self.most:
                fullest = (self.free & -self.free).bit_length() - 1
                if fullest >= left:
                    return bin_, self.capacity - space  # the bin just used is itself the fullest
                self._take(fullest)
            self.bins[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.capacity - space


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Vocabulary:
    """Ids of runs without white space, encoded once each and kept in flat arrays.

    The tokenizer lower-cases, drops white space and joins nothing across it, nor
    across the border of an ASCII letter or digit and a punctuation mark, so a
    text's ids are those of its runs in order. Runs are known by their 64-bit
    hash (with A-Z taken as a-z); two of ``CACHED_RUNS`` runs share one with
    probability 4e-8.
    """

    def __init__(self, path: str):
        self.path = path
        self._clear()

    def _clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.begin, self.size, self.ids, self.used = np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(1 << 14, "<u4"), 0

    def _add(self, hashes: np.ndarray, runs: list[str]) -> None:
        """Takes up ``hashes``, ascending and not known yet, of the ``runs``."""
        encode = _tokenizer(self.path).encode_batch_fast
        sizes, begin = np.empty(len(runs), np.int32), self.used
        for k in range(0, len(runs), 8192):
            found = [e.ids for e in encode(runs[k : k + 8192], add_special_tokens=False)]
            sizes[k : k + 8192] = [len(x) for x in found]
            ids = np.fromiter(chain.from_iterable(found), "<u4", int(sizes[k : k + 8192].sum()))
            self.ids = _roomy(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.begin = np.insert(self.begin, at, (begin + np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32))
        self.size, self.known = np.insert(self.size, at, sizes), np.insert(self.known, at, hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts that ``offsets`` cut ``data`` into, each followed by ``end_id``, and where each text's begin."""
        plain, mark = _PLAIN[data], _MARK[data]
        cuts = np.zeros(len(data), bool)
        cuts[1:] = (plain[:-1] & mark[1:]) | (mark[:-1] & plain[1:])
        found = words(data, offsets, cuts)
        unique, at, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHED_RUNS or self.used > CACHED_IDS:
            self._clear()
        left, right = np.searchsorted(self.known, unique), np.searchsorted(self.known, unique, "right")
        missing = np.flatnonzero(left == right)
        if len(missing):
            raw = data.tobytes()
            spans = zip(found.starts[at[missing]].tolist(), found.ends[at[missing]].tolist(), strict=True)
            self._add(unique[missing], [raw[a:b].decode() for a, b in spans])
        place = np.searchsorted(self.known, unique)[inverse]
        sizes, starts = self.size[place].astype(np.int64), self.begin[place]
        total = np.concatenate(([0], np.cumsum(sizes)))
        shift = np.repeat(starts - total[:-1], sizes)
        body = self.ids[shift + np.arange(total[-1])]
        bounds = total[found.first] + np.arange(len(offsets))
        out = np.full(bounds[-1], end_id, "<u4")
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = body
        return out, bounds


def _roomy(array: np.ndarray, need: int) -> np.ndarray:
    return array if need <= len(array) else np.concatenate((array, np.zeros(max(need - len(array), len(array)), array.dtype)))


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _cutter(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = strings(batch, "text"), batch.column(0)
            for lo, hi in slices(texts):
                ids, bounds = _vocabulary(path).encode(*text_bytes(texts, lo, hi), end_id)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                begin = bounds[doc] + start
                crc = [zlib.crc32(ids[b : b + n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc + lo)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _packer(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.put(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            bins, offsets = zip(*placed, strict=True) if placed else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``: every document's ids, cut where longer than ``capacity``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cutter(tokenizer_path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, open_bins: int = 65_536) -> DataFrame:
    """One row per piece with the sequence that holds it and its offset there.

    Only the pieces' sizes are shuffled, not the texts: rebalanced into
    partitions of Spark's advisory size and dealt out longest first, each
    partition runs one online best fit with at most ``open_bins`` open bins
    (when one more is needed the fullest closes). A retried task sees the same
    rows in the same order. Sequence ids are the partition number times 2**40
    plus a running number.

    A null or empty text has the single token ``end_id``. Repeated rows are
    packed each for itself; a null id stays null. An empty table gives no rows;
    further columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity).hint("rebalance")
    ordered = pieces.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(_packer(capacity, open_bins), ordered.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long")
