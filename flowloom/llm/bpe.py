"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The vocabulary's byte strings are mapped to Latin-1 (one character a byte) and compiled into a
pyahocorasick automaton. A piece is encoded left to right: at each position the longest token is
tried first, shorter prefixes next, and a token stands only if it is compatible with the token
before it, that is, if merging the two tokens' bytes by rank gives exactly these two tokens.
Compatibility of adjacent tokens is memoised, positions that failed are remembered, and since
merging is decided by adjacent pairs the first full path is the merge result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .kernels import portions, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces up to this length are remembered with their ids, up to this many of them.
CACHED_LENGTH, CACHED_PIECES = 48, 400_000
CACHED_PAIRS = 1 << 18


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if self.merged(token) == [rank]:  # others can't come from merging
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.prefixes = lru_cache(None)(self._prefixes)
        self.compatible = lru_cache(CACHED_PAIRS)(self._compatible)
        self.pieces = _Pieces(self)

    def merged(self, piece: bytes) -> list[int]:
        """Merge by lowest rank, pair by pair: the definition, used on one or two tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = min((rank(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def _prefixes(self, token: int) -> list[int]:
        """The tokens that start ``token``, longest first, itself included."""
        word = self.bytes_of[token].decode("latin-1")
        return [self.automaton.get(word[:n]) for n in range(len(word), 0, -1) if word[:n] in self.automaton]

    def longest(self, piece: bytes) -> list[int]:
        """For each position the longest token that starts there, from one automaton pass."""
        found: list[int] = [-1] * len(piece)
        size = [0] * len(piece)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            n = len(self.bytes_of[rank])
            at = end - n + 1
            if n > size[at]:
                found[at], size[at] = rank, n
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest, end = self.longest(piece), len(piece)
        failed: set[tuple[int, int]] = set()
        path: list[int] = []
        tries = [iter(self.prefixes(longest[0]))]
        at = 0
        while at < end:
            for token in tries[-1]:
                after = at + len(self.bytes_of[token])
                if (after, token) not in failed and (not path or self.compatible(path[-1], token)):
                    path.append(token)
                    at = after
                    if at < end:
                        tries.append(iter(self.prefixes(longest[at])))
                    break
            else:
                tries.pop()
                token = path.pop()
                failed.add((at, token))
                at -= len(self.bytes_of[token])
        return path

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        if len(pieces) > CACHED_PIECES:
            pieces.clear()
        return b"".join(map(pieces.__getitem__, self.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec.encode_piece(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            self[piece] = ids
        return ids


@lru_cache(2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return Codec(path, pattern)


def bpe_encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """Encode the ``text`` of every row with the rank file at ``path`` and decode the ids again.

    Returns the columns ``keep`` of ``docs`` with ``n_tokens``, ``input_ids`` (unless left out),
    ``ids_sha256`` and ``decoded_sha256``. A null text counts as empty and gives no ids; rows map
    one to one, so repeated rows, null ids and empty tables need no rule. ``path`` must be readable
    on every executor.
    """
    fields = [docs.select(*keep).schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", n_tokens long" + ", input_ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string"
    names = [*keep, "n_tokens", *["input_ids"] * with_ids, "ids_sha256", "decoded_sha256"]

    def run(batches):
        c = codec(path, pattern)
        for b in (part for whole in batches for part in portions(whole, len(keep))):
            ids = [c.encode(t.as_py() or "") for t in b.column(len(keep))]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            columns = [b.column(i) for i in range(len(keep))] + [pa.array(sizes)]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat))
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
            columns.append(pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*keep, "text").mapInArrow(tidy(run), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document. Null and empty texts have no tokens; repeated rows
    and null doc_ids map one to one; an empty table gives no rows."""
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)


QUERIES = {"op8_bpe": op8_bpe}
#: SQL can't express BPE; tests compare with the tiktoken library.
ORACLES: dict = {}
