"""CRC-32C of many byte strings at once, in numpy, and the mask of length-delimited records.

A checksum without its start and end values is linear in the bits, so zeros in front change nothing.
Strings are padded in front to whole lanes; all lanes advance together, four bytes a step; the lanes of
a string are then joined in pairs, the left one advanced by as many zero bytes as the right one has.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# The Castagnoli polynomial, bit-reversed, and the constant of the mask.
_POLYNOMIAL = np.uint32(0x82F63B78)
_MASK = np.uint32(0xA282EAD8)
_ONES = np.uint32(0xFFFFFFFF)
_LOW, _HALF, _ONE = np.uint32(0xFFFF), np.uint32(16), np.uint32(1)
#: Bytes of a lane, as a power of two, for long strings and for lengths; strings of a group share a megabyte.
_LANE, _SHORT, _GROUP = 8, 3, 1 << 20


@cache
def _tables(level: int) -> tuple[np.ndarray, np.ndarray]:
    """By low and by high half of a checksum: the same followed by ``2 ** level`` zero bytes."""
    if level > 1:
        return tuple(_advanced(half, level - 1) for half in _tables(level - 1))
    word = np.arange(1 << 16, dtype=np.uint32)
    low = word.copy()
    for _ in range(16):
        low = (low >> _ONE) ^ np.where(low & _ONE, _POLYNOMIAL, np.uint32(0))
    return low, word  # over two bytes the upper half only moves down


def _advanced(crc: np.ndarray, level: int) -> np.ndarray:
    low, high = _tables(level)
    return low.take(crc & _LOW) ^ high.take(crc >> _HALF)


@cache
def _start(length: int) -> np.uint32:
    """What the start value becomes over ``length`` bytes."""
    crc = _ONES
    for _ in range(8 * (length & 1)):
        crc = (crc >> _ONE) ^ (_POLYNOMIAL if crc & _ONE else np.uint32(0))
    for level in range(1, length.bit_length()):
        if length >> level & 1:
            crc = _advanced(np.array([crc], np.uint32), level)[0]
    return crc


def _linear(strings: list[bytes], lengths: np.ndarray, lane: int) -> np.ndarray:
    size = 1 << lane
    lanes = np.maximum(1, -(-lengths // size))
    ends = np.cumsum(lanes)
    flat = np.zeros(int(ends[-1]) * size, np.uint8)
    for s, end, n in zip(strings, (ends * size).tolist(), lengths.tolist()):
        flat[end - n : end] = np.frombuffer(s, np.uint8)
    crc = np.zeros(int(ends[-1]), np.uint32)
    for word in np.ascontiguousarray(flat.view("<u4").reshape(-1, size // 4).T):
        crc = _advanced(crc ^ word, 2)
    out = np.empty(len(strings), np.uint32)
    levels = np.ceil(np.log2(lanes)).astype(int)
    for level in np.unique(levels).tolist():
        members = np.flatnonzero(levels == level)
        place = np.arange(1 << level) - (1 << level) + lanes[members][:, None]  # below 0: padding in front
        joined = np.where(place >= 0, crc[np.maximum((ends - lanes)[members][:, None] + place, 0)], np.uint32(0))
        for step in range(level):
            joined = _advanced(joined[:, ::2], lane + step) ^ joined[:, 1::2]
        out[members] = joined[:, 0]
    return out


def crc32c(strings: list[bytes]) -> np.ndarray:
    """The CRC-32C of each string as unsigned 32-bit integers."""
    lengths = np.array([len(s) for s in strings], np.int64)
    out = np.array([_start(n) for n in lengths.tolist()], np.uint32) ^ _ONES
    lane = _SHORT if lengths.max(initial=0) <= 1 << _SHORT else _LANE
    first, before = 0, np.cumsum(lengths) - lengths
    while first < len(strings):
        last = max(first + 1, int(np.searchsorted(before, before[first] + _GROUP)))
        out[first:last] ^= _linear(strings[first:last], lengths[first:last], lane)
        first = last
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums turned by 15 bits plus a constant, since what is framed may hold checksums itself."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + _MASK
