"""Vectorised word and shingle hashing over Arrow string columns (numpy; used inside Spark tasks).

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return;
A-Z fold to a-z, every other byte is kept. Hashes are 64 bit: a random value per byte times a power of an odd base,
summed over the word, then mixed, so equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE_WORDS + 1, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = _BYTE_VALUE[_FOLD]
_VALUE[_SPACE] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets between them (a null text is empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text in order, and the n + 1 offsets of the texts in that list."""
    raw, at = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = ~space[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    sums = np.add.reduceat(_VALUE[raw] * _powers(_BASE, len(raw)), starts)
    words = mix(sums * _powers(_BASE_INV, len(raw))[starts])
    return words, np.searchsorted(starts, at)


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    """Consecutive slices of about ``limit`` bytes of text (one longer text stands alone)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    s = 0
    while s < len(texts):
        e = max(s + 1, int(np.searchsorted(at, at[s] + limit, "right")) - 1)
        yield texts.slice(s, e - s)
        s = e


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole word sequence as the only shingle; one without words has none.
    """
    for part in slices(texts):
        words, at = word_hashes(part)
        n = len(words)
        grams = np.zeros(n, np.uint64)
        for k in range(width):
            grams[:max(0, n - k)] += words[k:] * _PLACE[k]
        grams = mix(grams)
        for s, e in zip(at[:-1], at[1:]):
            if e - s >= width:
                yield np.unique(grams[s:e - width + 1])
            elif e > s:
                tail = np.array([(int(_PLACE[width]) * int(e - s)) & _MASK], np.uint64)
                yield mix(tail + (words[s:e] * _PLACE[:e - s]).sum(keepdims=True))
            else:
                yield np.zeros(0, np.uint64)
