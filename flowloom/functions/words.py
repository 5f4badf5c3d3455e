"""Texts as arrays of words inside tasks: sentences, words and tags as :mod:`text` makes them, hashes as Spark has them.

A worker takes some texts at a time and looks at their bytes and at their distinct words, not at each word by itself.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import lexicon

#: What ends sentences and what parts words: of bytes, 2 and 1.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[ord(c) for c in ".!?\n"]] = 2
_KINDS[[ord(c) for c in " \t\r"]] = 1


class Words(NamedTuple):
    """The words of some texts: ``codes`` into ``known`` (distinct, lower-case, UTF-8); words of each sentence, sentences of each
    text; ``written``: bytes of the texts, where each word begins and ends in them."""

    codes: np.ndarray
    known: pa.Array
    lengths: np.ndarray
    sentences: np.ndarray
    written: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def words_of(texts: pa.Array) -> Words:
    """The lower-case words of texts; null texts have no sentences."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kinds = _KINDS[data]
    inside = kinds == 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (first[1:] | ~np.r_[inside[1:], False])) + 1
    of_text = np.diff(np.searchsorted(start, offsets))
    text = np.repeat(np.arange(len(texts)), of_text)
    ends = np.cumsum(kinds == 2, dtype=np.int32)[start]
    new = np.flatnonzero(np.r_[True, (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])]) if len(start) else start
    letters = data[inside]
    letters = letters + ((letters >= ord("A")) & (letters <= ord("Z"))) * np.uint8(32)
    places = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=places[1:])
    low = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
    known, codes = low.dictionary, low.indices.to_numpy()
    beyond = np.add.reduceat(_bytes(known)[0] >= 128, _bytes(known)[1][:-1], dtype=np.int32) if len(known) else np.empty(0)
    if beyond.any():  # other letters as Unicode has them; words that become equal are one
        whole = known.to_pylist()
        for i in np.flatnonzero(beyond).tolist():
            whole[i] = whole[i].decode().lower().encode()
        low = pa.array(whole, pa.large_binary()).dictionary_encode()
        known, codes = low.dictionary, low.indices.to_numpy()[codes]
    return Words(codes, known, np.diff(np.r_[new, len(start)]), np.bincount(text[new], minlength=len(texts)), (data, start, end))


def _bytes(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binaries without nulls, and where each begins."""
    _, where, what = found.buffers()
    offsets = np.frombuffer(where, np.int64)[found.offset : found.offset + len(found) + 1]
    return (np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what else np.empty(0, np.uint8)), offsets - offsets[0]


def ends_in(words: Words, ending: str, least: int = 0) -> np.ndarray:
    """Whether each word, as it is written, ends in ``ending`` (ASCII) and has ``least`` letters."""
    data, start, end = words.written
    n = len(ending)
    long = end - start >= n
    if least:
        inner = np.r_[0, np.cumsum((data & 0xC0) == 0x80)]  # bytes that go on with a letter
        long &= end - start - (inner[end] - inner[start]) >= least
    at = np.flatnonzero(long)
    for k, c in enumerate(ending.encode()):
        at = at[data[end[at] - n + k] == c]
    return np.bincount(at, minlength=len(start)) > 0


def phrase_classes(words: Words, lexicons: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number (from 1) of the first of ``lexicons`` that has a phrase over it, else 0, and whether that phrase
    begins there; by the rules of :func:`text.phrase_spans`, each lexicon for itself."""
    codes, n = words.codes, len(words.codes)
    room = np.repeat(np.cumsum(words.lengths), words.lengths) - np.arange(n)
    wanted = pa.array(sorted({w.encode() for phrases in lexicons for p in phrases for w in p.lower().split(" ")}), pa.large_binary())
    code = {w.decode(): i for w, i in zip(wanted.to_pylist(), pc.index_in(wanted, words.known).to_pylist()) if i is not None}
    classes, begins = np.zeros(n, np.uint8), np.zeros(n, bool)
    for number, phrases in enumerate(lexicons, 1):
        taken, head = np.zeros(n, bool), np.zeros(n, bool)
        for size, of_size in lexicon(phrases).items():
            for phrase in of_size:
                wanted = [code.get(w, -1) for w in phrase.split(" ")]
                if min(wanted) < 0 or n < size:
                    continue
                hit = room[: n - size + 1] >= size
                for k, w in enumerate(wanted):
                    hit &= (codes[k : n - size + 1 + k] == w) & ~taken[k : n - size + 1 + k]
                at = np.flatnonzero(hit)
                if size > 1 and (np.diff(at) < size).any():  # a phrase that overlaps itself: the first place goes first
                    free, kept = -1, []
                    for i in at.tolist():
                        if i >= free:
                            kept.append(i)
                            free = i + size
                    at = np.array(kept)
                head[at] = True
                for k in range(size):
                    taken[at + k] = True
        new = taken & (classes == 0)
        classes[new], begins[new] = number, head[new]
    return classes, begins


def spaced(words: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words ``codes`` one after the other, a space after each: bytes, and where each begins (and all end)."""
    data, offsets = _bytes(words.known)
    whole = np.empty(len(data) + len(words.known), np.uint8)
    whole[offsets[1:] + np.arange(len(words.known))] = ord(" ")
    whole[np.arange(len(data)) + np.repeat(np.arange(len(words.known)), np.diff(offsets))] = data
    places = offsets + np.arange(len(offsets))
    known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.known), [None, pa.py_buffer(places), pa.py_buffer(whole)])
    return _bytes(known.take(pa.array(codes))) if len(codes) else (np.empty(0, np.uint8), np.zeros(1, np.int64))


def neighbours(codes: np.ndarray, lengths: np.ndarray, width: int, none: int) -> list[np.ndarray]:
    """The codes of the words ``width`` places before to ``width`` after each word in its sentence; ``none`` where there is none."""
    at = np.arange(len(codes)) + width * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    padded = np.full(len(codes) + width * (len(lengths) + 1), none, np.int32)
    padded[at] = codes
    return [padded[at + k] for k in range(-width, width + 1)]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _last(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _lane(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _turn(h ^ (_turn(k * _P2, 31) * _P1), 27) * _P1 + _P4


def xxhash64_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of longs, going on from ``seed`` (the hash of the columns before, or 42)."""
    return _last(_lane(seed + _P5 + np.uint64(8), x.astype(np.int64).view(np.uint64)))


def xxhash64_int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + _P5 + np.uint64(4)) ^ (x.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)) * _P1
    return _last(_turn(h, 23) * _P2 + _P3)


def _by_length(data: np.ndarray, start: np.ndarray, lengths: np.ndarray, before: bytes):
    """(which, their bytes after those ``before`` as rows of a matrix) for the stretches of ``data`` of each length."""
    order = np.argsort(lengths, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(start) else []:
        m = np.empty((len(at), len(before) + lengths[at[0]]), np.uint8)
        m[:, : len(before)] = np.frombuffer(before, np.uint8)
        m[:, len(before) :] = data[start[at][:, None] + np.arange(lengths[at[0]])]
        yield at, m


def _numbers(m: np.ndarray, at: int, size: int) -> np.ndarray:
    return np.ascontiguousarray(m[:, at : at + size]).view(f"<u{size}")[:, 0]


def xxhash64_texts(texts: pa.Array, before: bytes = b"", seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of each of the texts (large binaries), with what comes ``before`` it."""
    out, seed = np.empty(len(texts), np.uint64), np.uint64(seed)
    data, offsets = _bytes(texts)
    with np.errstate(over="ignore"):
        for which, m in _by_length(data, offsets[:-1], np.diff(offsets), before):
            n, at = m.shape[1], 0
            h = np.full(len(m), seed + _P5, np.uint64)
            if n >= 32:
                v = [np.full(len(m), s, np.uint64) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                while at + 32 <= n:
                    v = [_turn(x + _numbers(m, at + 8 * i, 8) * _P2, 31) * _P1 for i, x in enumerate(v)]
                    at += 32
                h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
                for x in v:
                    h = (h ^ (_turn(x * _P2, 31) * _P1)) * _P1 + _P4
            h = h + np.uint64(n)
            while at + 8 <= n:
                h, at = _lane(h, _numbers(m, at, 8)), at + 8
            if at + 4 <= n:
                h, at = _turn(h ^ (_numbers(m, at, 4).astype(np.uint64) * _P1), 23) * _P2 + _P3, at + 4
            for i in range(at, n):
                h = _turn(h ^ (m[:, i].astype(np.uint64) * _P5), 11) * _P1
            out[which] = _last(h)
    return out


def murmur3_texts(texts: pa.Array, before: bytes = b"", seed: int = 42) -> np.ndarray:
    """The hash that Spark ML's ``HashingTF`` takes of each of the texts, with what comes ``before`` it; signed."""
    data, offsets = _bytes(texts)
    return murmur3_stretches(data, offsets[:-1], np.diff(offsets), before, seed)


def murmur3_stretches(data: np.ndarray, start: np.ndarray, lengths: np.ndarray, before: bytes = b"", seed: int = 42) -> np.ndarray:
    """The same of stretches of ``data``, which may overlap."""
    out = np.empty(len(start), np.int32)

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)

    with np.errstate(over="ignore"):
        for which, m in _by_length(data, start, lengths, before):
            n = m.shape[1]
            h = np.full(len(m), seed, np.uint32)
            for at in range(0, n - n % 4, 4):
                h = h ^ mixed(_numbers(m, at, 4))
                h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
            if n % 4:
                k = sum((m[:, n - n % 4 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(n % 4)), np.zeros(len(m), np.uint32))
                h = h ^ mixed(k)
            h = h ^ np.uint32(n)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out[which] = (h ^ (h >> np.uint32(16))).view(np.int32)
    return out
