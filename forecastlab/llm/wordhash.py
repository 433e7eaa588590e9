"""Words and word shingles of whole Arrow text columns as 64-bit hashes, in numpy.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; only A-Z are lower-cased. Equal word
sequences give equal hashes whatever white space lies between the words. Work is done over slices of a
batch, so memory follows the slice (or the longest single text) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For ``words_of``: ASCII signs part words as well; letters, digits and all bytes of other scripts make them.
SIGNS = np.ones(256, dtype=bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept for later calls up to the slice size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, rows)`` of consecutive slices of about ``limit`` bytes; a null text counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield start, texts.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a large-string slice, and the bounds of each text: text ``i`` has words ``[b[i], b[i+1])``."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0])
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=n, offset=int(offsets[0]))
    offsets = offsets - offsets[0]
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = offsets[(offsets > 0) & (offsets <= n)] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    sums = _BYTE[_LOWER[data]]  # in place: the arrays are eight times the slice
    sums *= _power(_BASE, n)
    np.cumsum(sums, out=sums)
    value = sums[ends] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    value = mix(value * _power(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return value, np.searchsorted(starts, offsets)


def gram_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words (across texts; the caller cuts at their bounds)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size * 0x632BE59BD9B4E019 & (2**64 - 1)))
    for k in range(size):
        total += words[k : k + n] * np.uint64(_BASE * (2 * k + 3) + 2 * (k * 0xD1342543DE82EF95) & (2**64 - 1) | 1)
    return mix(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than ``size`` words make one shingle, none make none."""
    for _, rows in slices(texts):
        words, bounds = words_of(rows)
        grams = gram_hash(words, size)
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if stop - start >= size:
                yield np.unique(grams[start : stop - size + 1])
            elif stop > start:
                yield gram_hash(words[start:stop], stop - start)
            else:
                yield np.zeros(0, np.uint64)
