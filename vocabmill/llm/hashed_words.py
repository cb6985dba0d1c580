"""Words of many texts as 64-bit hashes, without a Python object for each word.

A word is what stands between the ASCII characters 0x20 and 0x09 to 0x0D. Its
hash is a polynomial over its bytes, taken from running sums, and mixed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from vocabmill.llm.shared import BLOCK_CHARS

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of a known 64-bit generator: each input bit changes each output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    result = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        result.append(np.cumprod(steps))
    return result[0], result[1]


def _hash_part(data: np.ndarray, breaks: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the words of ``data``; a word also ends before each of ``breaks``."""
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[breaks] = True
    edge[0] = edge[-1] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    size = 1 << max(len(data) - 1, 1).bit_length()
    power, inverse = _powers(size)
    folded = _FOLDED[data] if fold else data
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[folded] * power[: len(data)])))
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of rows ``data[offsets[i]:offsets[i + 1]]``, words per row, bytes of each word.

    ``fold`` makes A-Z lower case. Long data is hashed in parts that end at a blank.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64)
    hashes, starts, sizes = [], [], []
    at = 0
    while at < len(data):
        end = min(at + BLOCK_CHARS, len(data))
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                later = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        h, s, e = _hash_part(data[at:end], inner, fold)
        hashes.append(h)
        starts.append(s + at)
        sizes.append(e - s)
        at = end
    where = np.searchsorted(np.concatenate(starts), offsets)
    return np.concatenate(hashes), np.diff(where), np.concatenate(sizes)


def windows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a row, and runs per row."""
    runs = np.maximum(counts - width + 1, 0)
    total = len(words)
    if total < width or not runs.any():
        return np.zeros(0, np.uint64), runs
    x = words[: total - width + 1].copy()
    for k in range(1, width):
        x = mixed(x) + words[k : total - width + 1 + k]
    firsts = np.cumsum(counts) - counts
    index = np.repeat(firsts - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
    return mixed(x[index]), runs


def row_slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(counts)
    return zip((ends - counts).tolist(), ends.tolist(), strict=True)
