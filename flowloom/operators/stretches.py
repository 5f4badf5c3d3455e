"""Training rows that are stretches of a document's words with two words before them, in blocks.

A row's features are its words and its pairs of neighbours, hashed as Spark ML's ``HashingTF`` does. Stretches overlap, and a
block holds each word's place and that of the pair it begins once: sums over a stretch are differences of running sums, so a
pass costs the words of the documents and not those of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import words as texts_
from ..functions.words import Words
from . import blocks

SCHEMA = "docs array<long>, rows_of binary, words binary, pairs binary, first binary, last binary, begun binary, labels binary, sentence binary, token binary"
#: The keys of a row: those of its first word.
KEYS = "doc_id long, sentence_idx int, token_idx int"
#: Features whose squares are counted at a time.
FEATURES_AT_ONCE = 1 << 20


class Rows(NamedTuple):
    """Rows in the order of their texts: two words (as places among all words), the stretch from ``first`` to before ``last``, a label."""

    one: np.ndarray
    two: np.ndarray
    first: np.ndarray
    last: np.ndarray
    labels: np.ndarray


def stretch_blocks(docs: DataFrame, rows_of: Callable[[Words], Rows], size: int) -> DataFrame:
    """Blocks of the rows that ``rows_of`` finds in the texts of ``docs`` (``doc_id, text``), over ``size`` places, at most 65,536."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
            cut = np.flatnonzero(np.diff(sizes // blocks.BLOCK_BYTES, prepend=0)) if len(sizes) else []
            for part in np.split(np.arange(len(text)), cut):
                if len(part):
                    yield _block(batch.take(pa.array(part)), rows_of, size)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _pairs(words: Words, codes: np.ndarray, size: int) -> np.ndarray:
    """The place of each pair of neighbours of ``codes``."""
    data, at = texts_.spaced(words, codes)
    return texts_.murmur3_stretches(data, at[:-2], at[2:] - 1 - at[:-2]) % size if len(codes) > 1 else np.empty(0, np.int32)


def _block(batch: pa.RecordBatch, rows_of: Callable, size: int) -> pa.RecordBatch:
    words = texts_.words_of(batch.column("text"))
    rows = rows_of(words)
    place = (texts_.murmur3_texts(words.known) % size).astype(np.uint16)
    codes = words.codes
    one, two, then = (codes[at] for at in (rows.one, rows.two, rows.first))
    begun = _pairs(words, np.stack([one, two, then], axis=1).ravel(), size)
    begun = np.append(begun, 0).reshape(-1, 3)[:, :2] if len(one) else np.empty((0, 2))
    begun = np.stack([place[one], place[two], *begun.T]).astype(np.uint16)
    pairs = np.append(_pairs(words, codes, size), [0] * (len(codes) > 0)).astype(np.uint16)
    doc, sentence, token = blocks.placed(words)
    of_doc = np.bincount(doc[rows.one], minlength=len(batch))
    numbers = [of_doc.astype(np.int32), place[codes], pairs, rows.first.astype(np.int32), rows.last.astype(np.int32), begun, rows.labels.astype(np.uint8), sentence[rows.one].astype(np.int32), token[rows.one].astype(np.int32)]
    names = ["docs", "rows_of", "words", "pairs", "first", "last", "begun", "labels", "sentence", "token"]
    return pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in numbers)], names=names)


class Stretches(NamedTuple):
    """The rows of a block; ``words`` and ``pairs`` are the places of each word and of the pair it begins, ``begun`` those of a
    row's two words, of their pair, and of the second with the stretch's first word."""

    docs: list
    rows_of: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray
    begun: np.ndarray
    labels: np.ndarray
    sentence: np.ndarray
    token: np.ndarray

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Columns x rows: the sums of the rows of ``w`` at a row's places."""
        out = np.empty((w.shape[1], len(self.labels)))
        for o, column in zip(out, np.ascontiguousarray(w.T)):
            running = np.r_[0, np.cumsum(column[self.words] + column[self.pairs])]
            o[:] = running[self.last] - running[self.first] - column[self.pairs[self.last - 1]] + column[self.begun].sum(axis=0)
        return out

    def back(self, sides: np.ndarray, size: int) -> np.ndarray:
        """Columns x places: the sums of ``sides`` (columns x rows), as often as a row has a place."""
        out, n = np.empty((len(sides), size)), len(self.words)
        for o, side in zip(out, sides):
            over = np.cumsum(np.bincount(self.first, side, n + 1) - np.bincount(self.last, side, n + 1))[:n]
            o[:] = np.bincount(self.words, over, size) + np.bincount(self.pairs, over - np.bincount(self.last - 1, side, n)[:n], size)
            for b in self.begun:
                o += np.bincount(b, side, size)
        return out

    def counted(self, labels: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Labels x places: the sums of the rows' features, and of their squares."""
        sums, squares = np.zeros(labels * size), np.zeros(labels * size)
        lengths = (self.last - self.first).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(2 * lengths + 3) // FEATURES_AT_ONCE, prepend=0)) if len(lengths) else []
        for at in np.split(np.arange(len(lengths)), cut):
            if not len(at):
                continue
            n = lengths[at]
            row = np.repeat(np.arange(len(at)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at], n)
            paired = inside < np.repeat(self.last[at], n) - 1
            key = np.concatenate([row * size + self.words[inside], row[paired] * size + self.pairs[inside[paired]], *(np.arange(len(at)) * size + b[at] for b in self.begun)])
            key.sort()
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            times = np.diff(np.r_[new, len(key)]).astype(float)
            of = self.labels[at][key[new] // size] * np.int64(size) + key[new] % size
            sums += np.bincount(of, times, labels * size)
            squares += np.bincount(of, times**2, labels * size)
        return sums.reshape(labels, size), squares.reshape(labels, size)

    def rows(self, more: list, names: list[str]) -> pa.RecordBatch:
        ids = pa.array(self.docs, pa.int64()).take(pa.array(np.repeat(np.arange(len(self.docs)), self.rows_of)))
        columns = [ids, *(pa.array(x) for x in (self.sentence, self.token, *more))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "sentence_idx", "token_idx", *names])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretches]:
    for batch in batches:
        for row in range(len(batch)):
            get = lambda c, kind=np.int32: np.frombuffer(batch.column(c)[row].as_py(), kind)  # noqa: E731, B023
            places = (get(c, np.uint16).astype(np.intp) for c in ("words", "pairs"))
            labels = get("labels", np.uint8)
            begun = get("begun", np.uint16).reshape(4, len(labels)).astype(np.intp)
            yield Stretches(batch.column("docs")[row].as_py(), get("rows_of"), *places, get("first"), get("last"), begun, labels, get("sentence"), get("token"))
