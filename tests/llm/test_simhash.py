import random

import numpy as np
import pytest
import xxhash

from flowloom.llm import simhash
from flowloom.llm.simhash import classes_of_bucket, components, drop_near_duplicates, fingerprint, near_duplicates, near_links


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 301):
        text = " \t".join(rng.choice(["The", "ÉTÉ", "a", "b c", "zz"]) for _ in range(n))
        assert fingerprint(text) == slow_print(text)
    assert fingerprint(None) == fingerprint(" \n") == 0


@pytest.mark.parametrize("n", [2, 64, 65, 300])
def test_bucket_classes(n):
    rng = random.Random(n)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    values = list({flipped(rng, rng.choice(seeds), rng.randrange(5)) for _ in range(n)})
    root = classes_of_bucket(np.array(values, np.uint64))
    want = slow_classes(values)
    got = {}
    for v, r in zip(values, root):
        got.setdefault(int(r), set()).add(v)
    classes = {}
    for v, r in want.items():
        classes.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


@pytest.mark.parametrize("chunk", [8192, 20])
def test_links_lose_nothing(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = {flipped(rng, s, rng.randrange(4)) for s in seeds for _ in range(rng.choice([1, 3, 150]))} | {rng.getrandbits(64) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(near_links(df)).collect()}
    want = slow_classes(values)
    for v in values:
        for w in (want[v],):
            assert got.get(v, v) == got.get(w, w)
    assert len({got.get(v, v) for v in values}) == len(set(want.values()))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_rows(docs, odd_rows):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = odd_rows + [(50 + i, " ".join(base[: 299 - i % 4])) for i in range(12)]
    table = docs(rows)
    got = near_duplicates(table).collect()
    assert len(got) == len(rows)
    want = slow_classes([slow_print(t) for _, t in rows])
    least = {}
    for i, t in rows:
        r = want[slow_print(t)]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert sorted((r.fingerprint, r.component_id) for r in got) == sorted((f"{slow_print(t):016x}", least.get(want[slow_print(t)])) for _, t in rows)
    kept = drop_near_duplicates(table)
    assert kept.columns == table.columns and kept.count() == len(set(want.values()))


def test_empty(docs):
    assert near_duplicates(docs([])).count() == 0
    assert drop_near_duplicates(docs([])).count() == 0
