import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from flowloom.llm.checksums import crc32c, masked
from flowloom.llm.records import END, Encoder, encoder, op11_token_records, parsed, payload, read_at, read_records, record_index, shuffled, write_records

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def slow_mask(crc):
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [END]


def plain_read(path):
    """(key, ids) of a data file by the description of the format alone."""
    data, at, out = open(path, "rb").read(), 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        (head,) = struct.unpack_from("<I", data, at + 8)
        body = data[at + 12 : at + 12 + n]
        (tail,) = struct.unpack_from("<I", data, at + 12 + n)
        assert head == slow_mask(slow_crc(data[at : at + 8])) and tail == slow_mask(slow_crc(body))
        width, size = struct.unpack_from("<BI", body)
        key = None if size == 0xFFFFFFFF else body[5 : 5 + size].decode()
        rest = body[5 + (0 if key is None else size) :]
        out.append((key, list(struct.unpack(f"<{len(rest) // width}{'H' if width == 2 else 'I'}", rest))))
        at += 16 + n
    return out


@given(st.lists(st.binary(max_size=700), max_size=6))
def test_checksums(strings):
    assert crc32c(strings).tolist() == [slow_crc(s) for s in strings]
    assert masked(crc32c(strings)).tolist() == [slow_mask(slow_crc(s)) for s in strings]


def test_known_checksum():
    assert crc32c([b"123456789", b""]).tolist() == [0xE3069283, 0]
    long = bytes(range(256)) * 9000
    assert crc32c([long, b"x", long[1:]]).tolist()[1] == slow_crc(b"x")
    assert crc32c([long[:3000]])[0] == slow_crc(long[:3000])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85\xa0 　᠎​'!a1é中🙂<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_encoder_equals_the_library(texts):
    e = encoder(PATH, END)
    plain = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(pa.array(texts, pa.string()))] == [p.ids + [END] for p in plain]


def test_encoder_on_many_texts(library):
    words = ["one", "two,", "\u00a0", "three\u2003", "\n", "\t\t", "", "é", "🙂", "don't", "x" * 50, "\x1c", "<|endoftext|>"]
    texts = [None, "", " ", "a ", *(" ".join(words[(i * k) % 13] for k in range(i % 40)) for i in range(3000)), "", "y " * 700_000]
    e = Encoder(PATH, END)
    want = [p.ids + [END] for p in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(pa.array(texts))] == want
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(pa.array(texts).slice(2, 500))] == want[2:502]


def test_encoder_forgets_and_finds_again(library, monkeypatch):
    monkeypatch.setattr("flowloom.llm.records.CACHED_CHUNKS", 3)
    e = Encoder(PATH, END)
    for text in ["one two three four", "five six one", "two <|endoftext|> one", "seven  eight\n\nnine ", "one two"] * 3:
        assert np.frombuffer(e.encode(pa.array([text]))[0], "<u2").tolist() == ids_of(library, text)


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    e, t = Encoder(path, None), Tokenizer.from_file(path)
    assert not e.chunked
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(pa.array(["Hello  World", None]))] == [t.encode(x, add_special_tokens=False).ids for x in ("Hello  World", "")]


def test_payloads():
    for key in (None, "", "12", "ü"):
        name, ids = parsed(payload(key, np.array([1, 70_000], "<u4").tobytes(), 4))
        assert (name, ids.tolist()) == (key, [1, 70_000])


def order(row):
    import xxhash

    i, text = row
    return (i is not None, i or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64)), text or "")


def test_files(spark, docs, odd_rows, library, tmp_path):
    rows = [(i, t) for i, t in odd_rows] + [(100 + i, f"word{i} and more of it") for i in range(200)] + [(50, f"tie {i % 3}") for i in range(30)]
    folder = f"file://{tmp_path}/out"
    files = write_records(docs(rows, 5), folder, PATH, range_bytes=20_000, file_bytes=2_000)
    listed = files.orderBy("part", "number").collect()
    assert len(listed) > len({r.part for r in listed}) > 3
    stream, at = [], 0
    for r in listed:
        found = plain_read(r.file.removeprefix("file://"))
        assert (len(found), sum(len(i) for _, i in found), r.start) == (r.records, r.ids, at)
        stream += found
        at += r.ids
    want = [(None if i is None else str(i), ids_of(library, t)) for i, t in sorted(rows, key=order)]
    assert stream == want

    got = read_records(files).collect()
    starts = np.cumsum([0] + [len(i) for _, i in want])[:-1].tolist()
    assert sorted((r.start, r.doc_id or "", r.n_tokens, r.input_ids) for r in got) == [(s, k or "", len(i), i) for s, (k, i) in zip(starts, want)]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.input_ids, "<u4").tobytes()) for r in got)

    index = record_index(files)
    assert Counter(r.file for r in index.collect()) == Counter({r.file: r.records for r in listed})
    mixed = shuffled(index, 7)
    seen = read_at(mixed.coalesce(1)).collect()
    assert Counter((r.doc_id, tuple(r.input_ids)) for r in seen) == Counter((k, tuple(i)) for k, i in want)
    places = mixed.collect()
    assert places == shuffled(record_index(files), 7).collect() != shuffled(index, 8).collect()
    by_place = {r.file: plain_read(r.file.removeprefix("file://")) for r in listed}
    assert [(r.doc_id, r.input_ids) for r in seen] == [by_place[p.file][p.record] for p in places]


def test_a_task_that_runs_again_leaves_the_same_files(docs, odd_rows, tmp_path):
    folder = f"file://{tmp_path}/again"
    first = write_records(docs(odd_rows), folder, PATH).drop("start").collect()
    system, base = fs.FileSystem.from_uri(folder)
    names = lambda: sorted(x.path for x in system.get_file_info(fs.FileSelector(base)))
    before = {p: open(p, "rb").read() for p in names()}
    assert sorted(write_records(docs(odd_rows), folder, PATH).drop("start").collect()) == sorted(first)
    assert before == {p: open(p, "rb").read() for p in names()}


def test_damage_is_seen(docs, tmp_path):
    files = write_records(docs([(1, "some words"), (2, "others")], 1), f"file://{tmp_path}/bad", PATH)
    path = files.first().file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="damaged record"):
        read_records(files).collect()


def test_empty_tables(docs, tmp_path):
    files = write_records(docs([]), f"file://{tmp_path}/none", PATH)
    assert files.count() == read_records(files).count() == record_index(files).count() == read_at(record_index(files)).count() == 0


def test_query(spark, docs, odd_rows, library, tmp_path):
    docs(odd_rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_token_records(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids_of(library, t)), zlib.crc32(np.array(ids_of(library, t), "<u4").tobytes())) for i, t in odd_rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
