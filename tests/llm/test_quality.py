import random
import zlib

import numpy as np
import pyarrow as pa

from flowloom.llm.quality import FEATURES, Network, context_sums, drop_low_quality, fit, index_vectors, op1_quality, pool, score_quality, word_vectors
from flowloom.llm.quality import DIM, SLOTS, WINDOW, _slots
from flowloom.llm.kernels import slices
from flowloom.llm import quality


def made(n, rng):
    words = [f"{a}{b}" for a in ("the", "re", "ing", "ou", "né") for b in ("", "a", "st", "er")]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 80)))
        bad = rng.random() < 0.3
        if bad:
            text = text.upper() if i % 2 else " ".join(w + "***" for w in text.split())
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_context_sums_by_hand(docs, odd_rows):
    got = {r.slot: (r.n, list(r[2:])) for r in context_sums(docs(odd_rows, 3)).collect()}
    place, sign = index_vectors()
    want_n, want = np.zeros(SLOTS, int), np.zeros((SLOTS, DIM), int)
    for _, t in odd_rows:
        for _, data, offsets in slices(pa.array([t])):
            slot = _slots(data, offsets)[1]
            for i, a in enumerate(slot):
                want_n[a] += 1
                for j in range(max(0, i - WINDOW), min(len(slot), i + WINDOW + 1)):
                    if j != i:
                        np.add.at(want[a], place[slot[j]], sign[slot[j]])
    assert set(got) == set(np.flatnonzero(want_n).tolist())
    for s, (n, v) in got.items():
        assert n == want_n[s] and v == want[s].tolist()


def test_pool_ignores_slicing(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(SLOTS, DIM)).astype(np.float32)
    texts = pa.array(["a b c", None, "", "B c!! 12", "é" * 50, "a b c"])
    whole = pool(texts, vectors)
    assert whole.shape == (6, FEATURES) and not whole[1:3].any() and (whole[0] == whole[5]).all()
    one_by_one = np.vstack([pool(texts.slice(i, 1), vectors) for i in range(6)])
    assert np.allclose(whole, one_by_one, atol=1e-6)


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, FEATURES))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    net = Network().fit(x[:3000], y[:3000], np.arange(3000) % 5 == 0)
    s = net.score(x[3000:])
    for a, b in ((0, 0.25), (0.25, 0.75), (0.75, 1)):
        inside = (s >= a) & (s < b)
        assert abs(s[inside].mean() - y[3000:][inside].mean()) < 0.08


def test_query(spark, docs, monkeypatch, odd_rows):
    rows, labels = made(600, random.Random(6))
    table = {"documents": docs(rows + [(i, t) for i, t in odd_rows if i is None], 3)}
    # labels of held-out rows are wrong on purpose: they must not matter
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    spoilt = [(i, 1 - q if held(i) else q, t) for i, q, t in labels] + [(None, 0, 0), (5, None, 0), (3, labels[3][1], 0)]
    table["labels"] = spark.createDataFrame(spoilt, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "table", lambda s, d, name: table[name])
    got = op1_quality(spark, "").collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: q for i, q, _ in labels}
    test = [r for r in got if r.doc_id is not None and r.held_out]
    assert {r.doc_id for r in test} == {i for i in truth if held(i)}
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95


def test_degenerate(spark, docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    table = docs(odd_rows)
    assert {r.score for r in score_quality(table, fit(table, none)).collect()} == {0.5}
    kept = drop_low_quality(table, none)
    assert kept.columns == table.columns and kept.count() == len(odd_rows)
    empty = docs([])
    assert score_quality(empty, fit(empty, none)).count() == 0
    assert word_vectors(context_sums(empty)).shape == (SLOTS, DIM)
