"""Word hashes and shingles of many texts at once, on their UTF-8 bytes.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z
taken as a-z. A word's hash is a polynomial over its bytes modulo 2**64, read
off one running sum, so that no word becomes a Python object.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For Python's ``bytes.translate``, followed by ``split()``, which cuts at the same bytes.
LOWER_BYTES = _LOWER.tobytes()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    x = (x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(_LOWER.astype(np.uint64), 11)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, kept for later calls."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors)
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Hash, unit number and byte range of every word; ``first[u]`` to ``first[u + 1]`` are unit ``u``'s words."""

    hashes: np.ndarray
    unit: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """The words of the units that ``offsets`` cut ``data`` into; no word crosses a cut, nor a byte before which ``cuts`` is true."""
    n, units = len(data), len(offsets) - 1
    solid = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    if cuts is not None:
        cut[:n] = cuts
    cut[offsets] = True
    cut[n] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    first = np.searchsorted(starts, offsets)
    unit = np.repeat(np.arange(units), np.diff(first))
    return Words(hashes, unit, starts, ends, first)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a unit, and where each unit's begin.

    A unit of fewer words, but at least one, is one shingle; one without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate(([0], np.cumsum(runs)))
    total = int(begin[-1])
    place = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(total)
    out = np.zeros(total, np.uint64)
    length = np.repeat(np.minimum(counts, size), runs)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    for k in range(size):
        part = padded[place + k] * np.uint64(_WEIGHTS[k])
        out += np.where(length > k, part, np.uint64(0)) if (counts < size).any() else part
    return mix(out + length.astype(np.uint64)), begin


_WEIGHTS = [pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(16)]


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` successive words, whatever their units, off one running sum."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)))
    return mix((sums[size:] - sums[:-size]) * inverse[:n], 3)


def newline_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts at line feeds too: the offsets of all lines, and each line's text number.

    An empty text has one empty line. A line keeps its line feed, which is no part of a word.
    """
    after = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(offsets, after - 1, "right") - 1
    inner = after[after < offsets[owner + 1]] if len(after) else after
    owner = owner[after < offsets[owner + 1]] if len(after) else owner
    lines = np.concatenate((offsets[:-1], inner))
    texts = np.concatenate((np.arange(len(offsets) - 1), owner))
    order = np.lexsort((lines, texts))
    return np.concatenate((lines[order], offsets[-1:])), texts[order]
