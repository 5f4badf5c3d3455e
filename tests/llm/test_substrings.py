import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from flowloom.llm import kernels, substrings
from flowloom.llm.substrings import op4_substring_dedup, strip_repeats

BIG = 1 << 62


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def slow(rows):
    smallest = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            smallest[g] = min(smallest.get(g, BIG), BIG if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if smallest[tuple(w[k : k + 13])] < (BIG if i is None else i):
                gone.update(range(k, k + 13))
        out.append((i, w, [x for k, x in enumerate(w) if k not in gone]))
    return out


def test_kernels():
    texts = ["", None, "a  bé\tc ", " x", "a bé c", "Abc!! 12, DEF g", "\n"]
    got, toks = [], []
    for first, data, offsets in kernels.slices(pa.array(texts), 8):
        text, h = kernels.blank_separated(data, offsets)
        got += [(first + t, x) for t, x in zip(text.tolist(), h.tolist())]
        text, h = kernels.tokens(data, offsets)
        toks += [first + t for t in text.tolist()]
    assert [t for t, _ in got] == [2, 2, 2, 3, 4, 4, 4, 5, 5, 5, 5]
    h = [x for _, x in got]
    assert h[:3] == h[4:7] and len(set(h)) == 8
    assert toks == [2, 2, 2, 3, 4, 4, 4, 5, 5, 5, 5, 5, 5]
    values = np.array([5, 3, 9, 1, 7, 8, 2, 6, 4], np.uint64)
    for width in range(1, 9):
        assert kernels.sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(kernels.sliding_min(values[:3], 5)) == 0


@pytest.fixture
def rows(odd_rows):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "é", "a,", "X"] + [f"w{i}" for i in range(40)])
    passage = [word() for _ in range(60)]
    short = [word() for _ in range(13)]
    whole = [word() for _ in range(200)]
    out = list(odd_rows)
    for i in range(60):
        own = [word() for _ in range(rng.choice([5, 12, 30, 150]))]
        kind = i % 6
        if kind == 1:
            own[3:3] = passage[: rng.choice([13, 20, 60])]
        elif kind == 2:
            own[2:2] = short
        elif kind == 3:
            own = list(whole)
        elif kind == 4:
            own = list(whole)
            own[rng.randrange(200)] = "changed"
        elif kind == 5:
            own = own + ["la", "lo"] * 40
        out.append((100 + i, "  ".join(own)))
    return out + [(100, "\t".join(whole)), (None, " ".join(passage)), (99, " ".join(passage)), (7, "x " * 500)]


@pytest.mark.parametrize("hot, bits", [(2000, 1 << 28), (3, 1 << 28), (2000, 1)])
def test_against_brute_force(spark, docs, rows, monkeypatch, tmp_path, hot, bits):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "UNIT", 4000)
    monkeypatch.setattr(substrings, "FILTER_BITS", bits)  # 1: anchors are met in a join
    table = docs(rows, 3)
    monkeypatch.setattr(substrings, "table", lambda *_: table)
    want = slow(rows)
    assert sum(len(w) - len(k) for _, w, k in want) > 3000
    sha = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    got = op4_substring_dedup(spark, "").collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(i), len(w), len(w) - len(k), sha(k)) for i, w, k in want)
    if hot == 2000 and bits > 1:
        stripped = strip_repeats(table)
        assert stripped.columns == table.columns
        expect = [(str(i), t if len(k) == len(w) else " ".join(k)) for (i, t), (_, w, k) in zip(rows, want)]
        assert sorted(((str(r.doc_id), r.text) for r in stripped.collect()), key=str) == sorted(expect, key=str)


def test_empty(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "table", lambda *_: docs([]))
    assert op4_substring_dedup(spark, "").count() == 0
