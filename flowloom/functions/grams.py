"""Word sequences as keys of 96 bits, over Arrow lists of word hashes, inside tasks.

A word is its ``xxhash64`` and its ``hash``; sequences of words mix those of their words. Different sequences
share a key with a probability of 2 ** -96 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are worked on at a time; bits of a :func:`bitmap` at most (32 MB).
PORTION, MOST_BITS = 1 << 19, 28


def word_hashes(words: Column) -> tuple[Column, Column]:
    """The hashes of 64 and of 32 bits of an array of words."""
    return F.transform(words, lambda w: F.xxhash64(w)), F.transform(words, lambda w: F.hash(w))


def portions(lists: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of consecutive rows with about ``most`` values, one row at least."""
    offsets, first = lists.offsets.to_numpy(), 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def values(lists: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows and how many each row has; null rows have none."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), np.diff(offsets)


def longer(a: np.ndarray, b: np.ndarray, n: int, words: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sequences of ``n`` words from those of ``n - 1`` at the same places, as far as words go."""
    wa, wb = (w[n - 1 :] for w in words)
    a = (a[: len(wa)] ^ (a[: len(wa)] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + wa
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    b = (b[: len(wb)] ^ (b[: len(wb)] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + wb
    return a ^ (a >> np.uint64(32)), (b ^ (b >> np.uint32(13))) * np.uint32(0xC2B2AE35)


def keys(words: tuple[np.ndarray, np.ndarray], sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``n, a, b`` for each of the ``sizes``: the keys of the sequences that begin at each word, wherever sentences end."""
    a, b = words
    for n in range(1, max(sizes) + 1):
        if n > 1:
            a, b = longer(a, b, n, words)
        if n in sizes:
            yield n, a, b


def room(lengths: np.ndarray) -> np.ndarray:
    """How many words there are from each word to its sentence's end, itself included."""
    return np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())


def bitmap(a: np.ndarray) -> np.ndarray:
    """A bit for the low bits of each key, eight times as many bits as keys or more, up to ``2 ** MOST_BITS``."""
    bits = np.zeros(1 << min(MOST_BITS, max(10, int(len(a) * 8).bit_length())), bool)
    bits[a & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little")


def may_hold(bits: np.ndarray, a: np.ndarray) -> np.ndarray:
    """False for no key of the :func:`bitmap`; true for some others."""
    at = a & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def packed(keys: DataFrame, rows: int, part_rows: int = 1 << 20) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """``a, b`` in order for each ``kind`` and ``n`` of a table with about ``rows`` keys; tasks sort and pack them, so that
    the driver gets twelve bytes a key."""

    def run(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("kind", pa.int32()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int32())]))
        kind, n, a, b = (c.to_numpy() for c in table.columns)
        order = np.lexsort((b.view(np.uint32), a, n, kind))
        kind, n, a, b = (c[order] for c in (kind, n, a, b))
        for at in np.split(np.arange(len(a)), np.flatnonzero((np.diff(n) != 0) | (np.diff(kind) != 0)) + 1) if len(a) else []:
            i, j = at[0], at[-1] + 1
            values = [kind[i : i + 1], n[i : i + 1], [a[i:j].tobytes()], [b[i:j].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["kind", "n", "a", "b"])

    cut = keys.select(F.col("kind").cast("int"), F.col("n").cast("int"), "a", "b").repartitionByRange(max(1, -(-rows // part_rows)), "a")
    found: dict = {}
    for kind, n, a, b in zip(*(c.to_pylist() for c in cut.mapInArrow(run, "kind int, n int, a binary, b binary").toArrow().columns)):
        found.setdefault((kind, n), []).append((np.frombuffer(a, np.int64), np.frombuffer(b, np.uint32)))
    return {k: tuple(np.concatenate(x) for x in zip(*sorted(parts, key=lambda p: p[0][0]))) for k, parts in found.items()}


class KeySet:
    """Keys in the order of :func:`packed`, behind a bitmap."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.bits = a, b, bitmap(a.view(np.uint64))

    def places(self, a: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Of the places ``there`` those whose key is held."""
        there = there[may_hold(self.bits, a[there])]
        asked = a[there].view(np.int64)
        left, right = np.searchsorted(self.a, asked), np.searchsorted(self.a, asked, "right")
        found, more = np.zeros(len(there), bool), left < right
        while more.any():  # a second round where keys share their first 64 bits alone
            found[more] |= self.b[left[more]] == b[there[more]]
            left = left + 1
            more &= ~found & (left < right)
        return there[found]
