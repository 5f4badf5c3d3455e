import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from flowloom.llm.shards import assign_shards, jump_hash, write_shards


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([xxhash.xxh64_intdigest(str(i).encode()) for i in range(3000)], np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert jump_hash(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    old, new = jump_hash(keys, 16), jump_hash(keys, 17)
    moved = old != new
    assert (new[moved] == 16).all() and abs(moved.mean() - 1 / 17) < 0.02


def test_rows(docs, odd_rows):
    rows = odd_rows + [(1000 + i, "t") for i in range(400)]
    got = assign_shards(docs(rows, 3)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        key = xxhash.xxh64_intdigest(b"" if r.doc_id is None else str(r.doc_id).encode())
        assert (r.law, r.shard, r.grown_shard) == ("key", slow_jump(key, 16), slow_jump(key, 17))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(docs([])).count() == 0


def test_write(spark, docs, odd_rows, tmp_path):
    write_shards(docs(odd_rows), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows)
    want = {r.doc_id: r.shard for r in assign_shards(docs(odd_rows)).collect()}
    assert all(want[r.doc_id] == r.shard for r in back.collect())


def test_write_with_a_shard_column(spark, docs, odd_rows, tmp_path):
    write_shards(docs(odd_rows).selectExpr("*", "'mine' AS Shard"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {r.doc_id: r.shard for r in assign_shards(docs(odd_rows)).collect()}
    assert len(back) == len(odd_rows)
    assert all(r.Shard == "mine" and r.shard_ == want[r.doc_id] for r in back)
