import hashlib
import random
import re

import pytest

from flowloom.llm.decontaminate import decontaminate, item_windows, judged, scan


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for i in range(max(1, len(b) - 12)) if b else ():
            gram = b[i : i + 13]
            for j in range(len(w) - len(gram) + 1):
                if w[j : j + len(gram)] == gram:
                    hit.update(range(j, j + len(gram)))
                    if item is not None:
                        found.add(str(item))
    return w, hit, sorted(found)


@pytest.fixture
def cases(odd_rows):
    rng = random.Random(2)
    vocabulary = ["the", "of", "Ärger", "x1", "token", "été"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([20, 13, 12, 3, 1, 14, 40])]
    items += [(10, "the of"), (10, "the of"), (None, "zz yy"), (11, None), (12, "!!"), (13, "x")]
    docs = odd_rows + [(100 + i, ", ".join(rng.choice(vocabulary).upper() for _ in range(60))) for i in range(10)]
    docs += [(200 + i, "lead-in " + body + " tail") for i, (_, body) in enumerate(items) if body] + [(300, "zz yy " + "q " * 100)]
    return docs, items


@pytest.mark.parametrize("block", [32 << 20, 5000])
def test_against_brute_force(spark, docs, cases, block):
    rows, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = judged(scan(docs(rows, 3), bench, block=block)).collect()
    want = []
    for i, t in rows:
        w, hit, found = slow(t, items)
        want.append((str(i), len(w), len(hit), ",".join(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got) == sorted(want)


def test_removal(spark, docs, cases):
    rows, items = cases
    bench, table = spark.createDataFrame(items, "item_id long, text string"), docs(rows)
    kept = decontaminate(table, bench)
    assert kept.columns == table.columns
    bad = [20 * len(h) >= len(w) and bool(h) for w, h, _ in (slow(t, items) for _, t in rows)]
    assert kept.count() == bad.count(False)
    got = {(r.doc_id, r.text) for r in decontaminate(table, bench, "spans").collect()}
    for i, t in rows:
        w, hit, _ = slow(t, items)
        assert (i, t if not hit else " ".join(x for k, x in enumerate(w) if k not in hit)) in got


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert judged(scan(docs([]), none)).count() == 0
    got = judged(scan(docs([(1, "a b")]), none)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    assert hashlib.sha256(b"").hexdigest()


def test_windows_are_filed_under_their_rarest_pair(spark):
    """A benchmark of one field: every window holds the same long word and the same opening."""
    rng = random.Random(9)
    body = lambda i: "phosphorylation of the " + " ".join(f"w{rng.randrange(40)}" for _ in range(9)) + f" k{i}"
    items = [(i, body(i)) for i in range(300)] + [(1000, "x"), (1001, "of the")]
    windows, members = item_windows(spark.createDataFrame(items, "item_id long, text string"))
    assert windows.count() == members.count() == 302
    crowd = [r["count"] for r in windows.groupBy("anchor").count().collect()]
    assert max(crowd) <= 3
    for r in windows.collect():
        assert 0 <= r.offset <= max(0, len(r.gram) - 2)
