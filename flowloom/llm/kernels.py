"""Vectorised word and token hashing over Arrow text columns, inside tasks.

Texts are handled in slices of whole texts of about ``SLICE`` bytes, so that the arrays of one
slice stay small whatever an Arrow batch holds; one longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive whole texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8) if what else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def portions(batch: pa.RecordBatch, texts: int, most: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``most`` bytes of texts (column ``texts``) each."""
    for first, _, offsets in slices(batch.column(texts), most):
        yield batch.slice(first, len(offsets) - 1)


def release() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, releasing memory when its task ends: Python workers live on, and
    what their allocators keep would add to each executor's memory."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each of the ordered, disjoint, non-empty spans of ``data``."""
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    powers = np.ones(int(length.max()), np.uint64)
    powers[1:] = _MULTIPLIER
    powers = np.multiply.accumulate(powers)
    inside = np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
    at = inside - np.repeat(start, length)
    terms = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[at]
    return mix(np.add.reduceat(terms, np.r_[0, np.cumsum(length)[:-1]]))


def blank_separated(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of the words between ASCII blanks, in order."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(word & (cut[:-1] | np.r_[True, ~word[:-1]]))
    end = np.flatnonzero(word & (cut[1:] | np.r_[~word[1:], True])) + 1
    return np.searchsorted(offsets, start, "right") - 1, _hash_spans(data, start, end)


#: Classes of bytes: blank, lower-case or non-ASCII letter, upper-case letter, digit, other sign.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:33] = 0
_CLASS[48:58] = 3
_CLASS[65:91] = 2
_CLASS[97:123] = 1
_CLASS[128:] = 1
_GROUP = np.array([0, 1, 1, 2, 3], np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SHOUTED, _NUMBER = np.uint64(1), np.uint64(2)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of lower-cased words and runs of signs; every number is one token, and so
    is every word in capitals only."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    kind = _CLASS[data]
    group = _GROUP[kind]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(cut[:-1] | np.r_[True, group[1:] != group[:-1]])
    end = np.r_[start[1:], len(data)]
    full = group[start] > 0
    start, end = start[full], end[full]
    hashes = _hash_spans(LOWER[data], start, end)
    if len(start):
        small = np.r_[0, np.cumsum(kind == 1)]
        shouted = (group[start] == 1) & (end - start > 1) & (small[end] == small[start])
        hashes[shouted] = _SHOUTED
        hashes[group[start] == 2] = _NUMBER
    return np.searchsorted(offsets, start, "right") - 1, hashes


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + hashes[i : i + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        if len(out) <= step:
            return out[:0]
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
