import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import whitening
from flowloom.llm.whitening import op13_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, `key` string, `index` string, v string"


def table(spark, path, rows, files=3):
    spark.createDataFrame([(*r, 1, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def plain(rows, components=4):
    """By the definition, whole numbers in plain Python, the rest in numpy."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    if not usable:
        return [], None
    lengths = Counter(len(v) for _, v in usable)
    d = max(lengths, key=lambda k: (lengths[k], k))
    limit = lambda a: max(-(2**63), min(2**63 - 1, a))
    whole = [(i, tuple(limit(math.floor(256 * float(np.float32(c)))) for c in v)) for i, v in usable if len(v) == d]
    fit = sorted({x for _, x in whole})
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    mean = np.array([a / n for a in s])
    centred = np.array(fit, float) - mean
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for i, x in whole:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        out.append((i, n, dev if dev < 2**63 else None, ((np.array(x, float) - mean) @ u)))
    return out, (e, np.trace(v))


def compare(got, rows, components=4):
    want, spectrum = plain(rows, components)
    assert Counter((r.vec_id, r.component) for r in got) == Counter((w[0], k + 1) for w in want for k in range(len(spectrum[0]) if spectrum else 0))
    if not want:
        return
    e, trace = spectrum
    assert {r.identity_error for r in got} == {got[0].identity_error}
    assert Counter((r.vec_id, r.n, r.deviation) for r in got if r.component == 1) == Counter(w[:3] for w in want)
    for k, value in enumerate(e):
        mine = {}
        for r in got:
            if r.component == k + 1:
                mine.setdefault(r.vec_id, []).append(r.whitened)
                assert r.explained == pytest.approx(value / trace if trace > 0 else 0.0, rel=1e-9, abs=1e-9)
        theirs = {}
        for i, _, _, y in want:
            theirs.setdefault(i, []).append(y[k] / math.sqrt(value) if value > 1e-9 * e[0] else 0.0)
        a, b = (np.concatenate([sorted(p[i]) for i in sorted(p, key=str)]) for p in (mine, theirs))
        flipped = np.concatenate([sorted(-x for x in theirs[i]) for i in sorted(theirs, key=str)])
        assert np.allclose(a, b, atol=1e-7) or np.allclose(a, flipped, atol=1e-7)


def random_rows(n, d, seed=0):
    rng = np.random.default_rng(seed)
    stretch = np.linspace(1, 3, d)
    return [(i, (rng.normal(size=d) * stretch).astype(np.float32).tolist()) for i in range(n)]


def test_against_numpy(spark, tmp_path):
    rows = random_rows(300, 9)
    rows += [(1000 + i, rows[7][1]) for i in range(400)] + [(5, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, *[0.0] * 7]), (2003, [float("nan")] * 9), (2004, [float("-inf"), *[0.0] * 8]), (2005, [1.0, 2.0]), (2006, [-0.0] * 9)]
    got = whiten(table(spark, str(tmp_path / "v"), rows)).collect()
    compare(got, rows)
    assert got[0].n == 301 and got[0].identity_error < 1e-9


def test_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 4)
    rows = random_rows(90, 11, 3)
    compare(whiten(table(spark, str(tmp_path / "v"), rows)).collect(), rows)


def test_narrow_flat_and_single(spark, tmp_path):
    for k, rows in enumerate(([(i, [float(i)]) for i in range(5)], [(i, [float(i), 1.0, float(-i)]) for i in range(6)], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(4)])):
        got = whiten(table(spark, str(tmp_path / f"v{k}"), rows)).collect()
        compare(got, rows)
        assert all(not math.isnan(r.whitened) for r in got)
        assert got[0].identity_error == pytest.approx(0.0 if k == 0 else 1.0, abs=1e-9)


def test_beyond_longs(spark, tmp_path):
    rows = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [1e9, 3.0]), (3, [1.0, 2.0])]
    got = whiten(table(spark, str(tmp_path / "v"), rows)).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(w[0], w[2]) for w in plain(rows)[0]}


def test_no_usable_rows(spark, tmp_path):
    assert whiten(table(spark, str(tmp_path / "none"), [])).count() == 0
    got = whiten(table(spark, str(tmp_path / "nulls"), [(1, None), (2, [None])]))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = op13_whitening(spark, d)
    compare(out.collect(), rows)
    assert out.select(F.max("identity_error")).first()[0] < 1e-9
