import random

import pyarrow as pa
import pytest

from flowloom.llm import overlap
from flowloom.llm.overlap import drop_near_copies, shingle_sets


def slow_kept(rows):
    """Smallest doc_id of each class, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()), key=str)


def test_shingle_sets():
    texts = ["a b c d e f", None, "A b", "a b c d e f x a b c d e", "  ", "b a", "q"]
    sets = {first + t: set(items[of == t].tolist()) for first, n, of, items in shingle_sets(pa.array(texts), 5) for t in range(n)}
    assert [len(sets[k]) for k in range(7)] == [2, 1, 1, 7, 1, 1, 1]
    assert sets[0] < sets[3] and sets[1] == sets[4] and len(sets[1] | sets[2] | sets[5] | sets[6]) == 4


@pytest.mark.parametrize("chunk", [500_000, 400])
def test_against_all_pairs(docs, odd_rows, monkeypatch, chunk):
    monkeypatch.setattr(overlap, "CHUNK_ITEMS", chunk)
    monkeypatch.setattr(overlap, "CHUNK_ROWS", chunk // 50)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(900)}"
    rows = list(odd_rows)
    boiler = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120, 300]))]
        if rng.random() < 0.5:
            base = boiler + base
        for _ in range(rng.choice([1, 2, 6])):
            new = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                new[rng.randrange(len(new))] = word()
            rows.append((len(rows) + 100, " ".join(new)))
    middle = [word() for _ in range(200)]  # one class by way of its middle: copies are far from each other
    for _ in range(90):
        new = list(middle)
        for k in rng.sample(range(200), 4):
            new[k] = word()
        rows.append((len(rows) + 100, " ".join(new)))
    rows.append((5000, " ".join(middle)))
    table = docs(rows, 3)
    kept = drop_near_copies(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == slow_kept(rows)
    assert drop_near_copies(docs([])).count() == 0


def test_pipeline_stage_uses_it(spark, docs):
    import corpus_pipeline

    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:50] + ["new"] + base[51:])), (3, " ".join(base[:30]))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()) == slow_kept(rows) == [1, 3]
