"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A data file is a run of frames: the length of the payload as a little-endian unsigned 64-bit integer,
the masked CRC-32C of those eight bytes, the payload, the masked CRC-32C of the payload. That is the
frame of TFRecord files, so their readers take these too. A payload is one sequence: a byte with the
width of an id (2 or 4), the length of the document's key as an unsigned 32-bit integer (all ones for a
null key), the key in UTF-8, and the ids, little-endian. Beside each data file an index file holds
the offset of every frame and the end of the last one as unsigned 64-bit integers, so the n-th record of a
file can be read without those before it, in any order.

Tasks write their range of the documents with pyarrow's file systems: a file under a temporary name,
then moved to a name that range and number decide. A task that runs again writes the same bytes to the
same name, so lost executors leave no second copy. The folder must be one that pyarrow can open.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checksums import crc32c, masked
from .common import running_total, shared_dir, stored, table
from .kernels import portions, slices, tidy

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Bytes of text in a range of documents, and of frames in a file, about.
RANGE_BYTES, FILE_BYTES = 128 << 20, 64 << 20
#: Chunks of text remembered with their ids, in each of two generations.
CACHED_CHUNKS = 400_000
#: Open files of a task that reads in any order.
OPEN_FILES = 64
#: Bytes of texts that are encoded together.
PORTION = 4 << 20
_NULL_KEY = 0xFFFFFFFF
_HEAD = 12

# The characters that Unicode calls white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_IS_WHITE = np.isin(np.arange(256), [ord(c) for c in _WHITE if c.isascii()])
_WIDE_WHITE = re.compile(b"|".join(re.escape(c.encode()) for c in _WHITE if not c.isascii())).finditer


class Encoder:
    """Batches of texts to ids with a tokenizer file of the ``tokenizers`` library, special tokens
    neither added nor recognised.

    Byte-level BPE splits a text wherever white space follows a word, so such vocabularies encode chunks
    (white space and the word after it), the distinct ones of many texts at once, and remember them. New
    chunks go through the library together, as one text, and are told apart by the bytes of their
    tokens. Other tokenizers take whole texts.
    """

    def __init__(self, path: str, end: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = f.read()
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        described = json.loads(content)
        split = described.get("pre_tokenizer") or {}
        self.chunked = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not described.get("normalizer") and described["model"]["type"] == "BPE"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        highest = max([*vocabulary.values(), end or 0])
        self.dtype = np.dtype("<u2" if highest < 1 << 16 else "<u4")
        self.bytes_of = np.zeros(highest + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # byte-level tokens have a character a byte
        self.end = b"" if end is None else np.array([end], self.dtype).tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks. Those that end in a word are joined, a line end before each that has no
        white space of its own: both are places where the tokenizer splits."""
        words = [c for c in chunks if c[-1] not in _WHITE]
        blank = [c for c in chunks if c[-1] in _WHITE]
        self.young.update(zip(blank, self._whole(blank)))
        if not words:
            return
        led = [c if c[0] in _WHITE else "\n" + c for c in words]
        sizes = np.array(list(map(len, map(str.encode, led))), np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(led)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.cumsum(self.bytes_of[ids])
        last = np.cumsum(sizes)
        first = last - sizes + np.array(list(map(len, led)), np.int64) - np.array(list(map(len, words)), np.int64)
        start, stop = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")
        if (ends[stop - 1] != last).any() or ((first > 0) & (ends[start - 1] != first)).any():
            self.young.update(zip(words, self._whole(words)))  # a token reaches over a chunk's end
            return
        flat, width = ids.tobytes(), self.dtype.itemsize
        self.young.update((c, flat[a:b]) for c, a, b in zip(words, (start * width).tolist(), (stop * width).tolist()))

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_CHUNKS:
            self.old, self.young = self.young, {}
        known = list(map(self.young.get, chunks))
        if None in known:
            new = list(compress(chunks, map(not_, known)))
            again = {c: ids for c in new if (ids := self.old.get(c))}
            self.young.update(again)
            if fresh := [c for c in new if c not in again]:
                self._learn(fresh)
            found = map(self.young.__getitem__, new)
            known = [ids or next(found) for ids in known]
        return known

    def _by_chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data`` and how many come before each text."""
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(len(offsets), np.int64)
        white = _IS_WHITE[data]
        begins = white.copy()
        for m in _WIDE_WHITE(data):  # white space of several bytes ends no word
            white[m.end() - 1] = True
        begins[1:] &= ~white[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(begins)
        bounds = pa.py_buffer(np.append(at, len(data)))
        chunks = pa.LargeStringArray.from_buffers(len(at), bounds, pa.py_buffer(data)).dictionary_encode()
        ids, which = self._ids_of(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), chunks.indices.to_numpy()
        sizes = np.array(list(map(len, ids)), np.int64) // self.dtype.itemsize
        counts = sizes[which]
        ends = np.cumsum(counts)
        place = np.repeat((np.cumsum(sizes) - sizes)[which] - ends + counts, counts) + np.arange(ends[-1])
        return np.frombuffer(b"".join(ids), self.dtype)[place], np.append(0, ends)[np.searchsorted(at, offsets)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, the end id after them, in ``dtype``; null counts as empty."""
        if not self.chunked:
            return [ids + self.end for ids in self._whole([t or "" for t in texts.to_pylist()])]
        out, width = [], self.dtype.itemsize
        for _, data, offsets in slices(texts, PORTION):
            ids, before = self._by_chunks(data, offsets)
            flat, places = ids.tobytes(), (before * width).tolist()
            out += [flat[i:j] + self.end for i, j in zip(places, places[1:])]
        return out


@lru_cache(2)
def encoder(path: str, end: int | None) -> Encoder:
    return Encoder(path, end)


def payload(key: str | None, ids: bytes, width: int) -> bytes:
    name = b"" if key is None else key.encode()
    return bytes([width]) + (_NULL_KEY if key is None else len(name)).to_bytes(4, "little") + name + ids


def parsed(data: bytes) -> tuple[str | None, np.ndarray]:
    """Key and ids of a payload."""
    n = int.from_bytes(data[1:5], "little")
    size = 0 if n == _NULL_KEY else n
    return None if n == _NULL_KEY else data[5 : 5 + n].decode(), np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=5 + size)


def framed(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    heads, bodies = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, h.tobytes(), p, c.tobytes())) for n, h, p, c in zip(lengths, heads, payloads, bodies)]


def checked(frames: list[bytes], where: str) -> list[bytes]:
    """The payloads of frames; a frame whose length or checksums don't fit is an error."""
    payloads = [f[_HEAD:-4] for f in frames]
    heads, bodies = masked(crc32c([f[:8] for f in frames])), masked(crc32c(payloads))
    for f, p, h, b in zip(frames, payloads, heads.tolist(), bodies.tolist()):
        if int.from_bytes(f[:8], "little") != len(p) or int.from_bytes(f[8:12], "little") != h or int.from_bytes(f[-4:], "little") != b:
            raise ValueError(f"damaged record in {where}")
    return payloads


class _Files:
    """The data and index files of one range, one after another, each about ``size`` bytes."""

    def __init__(self, folder: str, part: int, size: int):
        self.folder, self.part, self.size, self.number = folder, part, size, 0
        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.stream = None

    def add(self, frames: list[bytes], counts: list[int]) -> Iterator[tuple]:
        for frame, n in zip(frames, counts):
            if self.stream is None:
                self.temporary = f"{self.base}/_{uuid.uuid4().hex}"
                self.stream, self.offsets, self.ids = self.system.open_output_stream(self.temporary), [0], 0
            self.stream.write(frame)
            self.offsets.append(self.offsets[-1] + len(frame))
            self.ids += n
            if self.offsets[-1] >= self.size:
                yield self.close()

    def close(self) -> tuple:
        self.stream.close()
        name = f"part-{self.part:07d}-{self.number:05d}"
        with self.system.open_output_stream(f"{self.temporary}-index") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())
        self.system.move(f"{self.temporary}-index", f"{self.base}/{name}.index")
        self.system.move(self.temporary, f"{self.base}/{name}.records")
        row = (self.part, self.number, f"{self.folder}/{name}.records", len(self.offsets) - 1, self.ids, self.offsets[-1])
        self.stream, self.number = None, self.number + 1
        return row


_FILES = "part long, number long, file string, records long, ids long, bytes long"


def write_records(docs: DataFrame, folder: str, tokenizer: str, end: int | None = END, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) and write the records below ``folder``, in ascending order
    of doc_id over all files; returns the stored list of files (``part, number, file, records, ids, bytes,
    start``), ``start`` being the ids of all files before.

    Null ids come first; rows that share an id lie in the order of their texts' hashes, then texts, and
    can be split over ranges by those. A null text counts as empty: its record holds the end id
    alone. An empty table writes no file. No range passes through the driver or is held in memory.
    ``tokenizer`` must be readable on every executor.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    rows = texts.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text").select(F.col("doc_id").cast("string"), "text")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)

    def write(batches):
        files, e = _Files(folder, TaskContext.get().partitionId(), file_bytes), encoder(tokenizer, end)
        width = e.dtype.itemsize

        def closed():
            for b in (part for whole in batches for part in portions(whole, 1, PORTION)):
                ids = e.encode(b.column(1))
                yield from files.add(framed([payload(k, i, width) for k, i in zip(b.column(0).to_pylist(), ids)]), [len(i) // width for i in ids])
            if files.stream is not None:
                yield files.close()

        for row in closed():
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "number", "file", "records", "ids", "bytes"])

    return stored(running_total(stored(rows.mapInArrow(tidy(write), _FILES), "record-files"), "part", "number", "ids", "start"), "record-list")


def _spread(files: DataFrame) -> DataFrame:
    """The rows of a short table over the cores, at least one in four a task of its own."""
    n = files.count()
    return files.repartition(max(1, min(n, max(2 * files.sparkSession.sparkContext.defaultParallelism, n // 4))))


_SEQUENCE = "doc_id string, start long, n_tokens long, ids_crc32 long, input_ids array<int>"


def _sequences(payloads: list[bytes], start: int | None, with_ids: bool) -> pa.RecordBatch:
    keys, ids = zip(*map(parsed, payloads))
    ids = [i.astype("<u4") for i in ids]
    sizes = np.array([len(i) for i in ids], np.int64)
    starts = pa.nulls(len(ids), pa.int64()) if start is None else pa.array(start + np.cumsum(sizes) - sizes)
    columns = [pa.array(keys, pa.string()), starts, pa.array(sizes), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids).view("<i4"))))
        names.append("input_ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _schema(with_ids: bool) -> str:
    return _SEQUENCE if with_ids else _SEQUENCE.rsplit(",", 1)[0]


def read_records(files: DataFrame, with_ids: bool = True, most: int = 1 << 20) -> DataFrame:
    """Every sequence of the files that :func:`write_records` listed, each frame checked:
    ``doc_id`` (as text), ``start``, ``n_tokens``, ``ids_crc32`` and, unless left out, ``input_ids``."""

    def read(batches):
        for file, start in ((f, s) for b in batches for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_stream(path, buffer_size=most) as stream:
                frames, held = [], 0
                while head := stream.read(_HEAD):
                    frames.append(head + stream.read(int.from_bytes(head[:8], "little") + 4))
                    held += len(frames[-1])
                    if held >= most:
                        batch = _sequences(checked(frames, file), start, with_ids)
                        start += int(np.sum(batch.column(2).to_numpy()))
                        frames, held = [], 0
                        yield batch
                if frames:
                    yield _sequences(checked(frames, file), start, with_ids)

    return _spread(files.select("file", "start")).mapInArrow(tidy(read), _schema(with_ids))


def record_index(files: DataFrame) -> DataFrame:
    """``file, record, offset, size`` of every frame, from the index files."""

    def read(batches):
        for file in (f for b in batches for f in b.column(0).to_pylist()):
            system, path = fs.FileSystem.from_uri(file.removesuffix(".records") + ".index")
            with system.open_input_file(path) as f:
                at = np.frombuffer(f.read(), "<u8").astype(np.int64)
            n = len(at) - 1
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), *map(pa.array, (np.arange(n), at[:-1], np.diff(at)))], names=["file", "record", "offset", "size"])

    return _spread(files.select("file")).mapInArrow(tidy(read), "file string, record long, offset long, size long")


def read_at(places: DataFrame, with_ids: bool = True, most: int = 1 << 20) -> DataFrame:
    """The sequences at ``places`` (``file, offset, size``) in just that order, each by a seek."""

    def read(batches):
        opened: OrderedDict = OrderedDict()

        def at(file, offset, size):
            if file not in opened:
                if len(opened) == OPEN_FILES:
                    opened.popitem(last=False)[1].close()
                system, path = fs.FileSystem.from_uri(file)
                opened[file] = system.open_input_file(path)
            opened.move_to_end(file)
            return opened[file].read_at(size, offset)

        try:
            for b in batches:
                frames, held = [], 0
                for place in zip(*(c.to_pylist() for c in b.columns)):
                    frames.append(at(*place))
                    held += place[2]
                    if held >= most:
                        yield _sequences(checked(frames, "a record's place"), None, with_ids)
                        frames, held = [], 0
                if frames:
                    yield _sequences(checked(frames, "a record's place"), None, with_ids)
        finally:
            for f in opened.values():
                f.close()

    return places.select("file", "offset", "size").mapInArrow(tidy(read), _schema(with_ids))


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The rows of :func:`record_index` in an order that ``seed`` alone decides."""
    return index.orderBy(F.xxhash64(F.lit(seed), F.regexp_extract("file", "[^/]+$", 0), "record"), "file", "record")


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token stream, read back from the record files.

    Null and empty texts are one id, the end; null doc_ids come first; rows that repeat an id are records
    of their own; text that looks like a special token is ordinary text; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    files = write_records(docs, f"{shared_dir(spark)}/flowloom/records-{uuid.uuid4().hex}", public_tokenizers.path(VOCABULARY))
    kind = docs.schema["doc_id"].dataType
    return read_records(files, with_ids=False).select(F.col("doc_id").cast(kind), "start", "n_tokens", "ids_crc32")


QUERIES = {"op11_token_records": op11_token_records}
#: BPE has no SQL form; tests compare with the tokenizers library and a plain reader of the format.
ORACLES: dict = {}
