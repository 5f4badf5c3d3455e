import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np

from flowloom.llm.merkle import ORACLES, append_log, fold, height, manifest, op12_merkle_manifest, parent, position, proofs, siblings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `digest` string, grp string, forged string, at string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(i, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def levels_of(nodes):
    """All levels of a tree by the definition: pairs, the last run maybe one alone."""
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return out


def by_definition(rows):
    """Rows ``(doc_id, text, lang, source, n_chars)`` to the contract's rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf_of(r[0], r[3], lang, r[4], r[1])), r) for r in rows if r[2] == lang)
        trees[lang] = ([r for _, r in mine], levels_of([k[2] for k, _ in mine]))
    top = levels_of([trees[lang][1][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        members, tree = trees[lang]
        for i, (doc_id, text, _, source, n) in enumerate(members):
            forged = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
            node = leaf_of(doc_id, source, lang, n + 1, text) if forged else tree[0][i]
            found = []
            for levels, at in ((tree, i), (top, g)):
                for level in levels[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    k = at % 2
                    found += run[:k] + run[k + 1 :]
                    run[k] = node
                    node, at = sha("".join(run)), at // 2
            out.append((doc_id, tree[0][i], tree[-1][0], top[-1][0], sha("".join(found)), node, node == top[-1][0]))
    return out


def table(spark, path, rows):
    spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


ODD = [
    (1, None, "en", "s", None), (2, "", "en", None, 0), (None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (3, "é" * 50_000, None, "s", 7), (4, "b", None, None, None),
    (5, "tie", "de", "s", 3), (5, "tie", "de", "s", 3), (5, "other", "de", "s", 5), (-7, "minus", "", "s", 5), (2**62, "last", "\U0001f600", "s", 4), (6, "x:y-", "ﬁ", "-", 1),
]


def test_log_positions_and_paths():
    for n in [*range(1, 70), 127, 128, 129, 1000]:
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        log = append_log(leaves, height(n))
        tree = levels_of([x.hex() for x in leaves])
        assert len(log) == 32 * sum(map(len, tree))
        for level, nodes in enumerate(tree):
            at = position(level, np.arange(len(nodes)), n)
            assert [log[p * 32 : p * 32 + 32].hex() for p in at.tolist()] == nodes
        assert all(fold(leaf, path) == log[-32:] for leaf, path in zip(leaves, siblings(log, n, height(n))))
    assert parent(b"\0" * 32) == hashlib.sha256(b"00" * 32).digest()


def test_blocks_below_a_taller_tree():
    """A short block at the right edge has single nodes up to the block's level."""
    leaves = [bytes([i]) * 32 for i in range(11)]
    tops = [append_log(leaves[k : k + 4], 2)[-32:] for k in range(0, 11, 4)]
    assert append_log(tops, height(3))[-32:].hex() == levels_of([x.hex() for x in leaves])[-1][0]


def test_every_group_size_over_tiers(spark, tmp_path):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 8, "g": 9, "h": 16, "i": 17, "j": 33, "k": 64, "l": 65, "m": 100, None: 130}
    rows = [(1000 * g + i, f"t{i % 5}", lang, "s", i) for g, (lang, n) in enumerate(sizes.items()) for i in range(n)] + ODD
    docs = table(spark, str(tmp_path / "docs"), rows)
    m = manifest(docs, levels=2)
    assert len(m.documents.tiers) >= 4 and len(m.languages.tiers) > 1
    got = [tuple(r) for r in proofs(m, spark).drop("siblings").collect()]
    assert Counter(got) == Counter(by_definition(rows))
    assert Counter(tuple(r) for r in proofs(manifest(docs), spark).drop("siblings").collect()) == Counter(got)
    assert all(x[-1] == (x[0] is None or zlib.crc32(str(x[0]).encode()) % 7 != 0 or x[0] in (1, 4)) for x in got)


def test_proofs_hold_their_siblings(spark, tmp_path):
    rows = [(i, "t", "en" if i % 3 else "de", "s", i) for i in range(40)]
    for r in proofs(manifest(table(spark, str(tmp_path / "docs"), rows), levels=3), spark).collect():
        assert r.proof_sha256 == sha("".join(r.siblings))


def test_query_and_sql(spark, tmp_path):
    rows = [(i, f"text {i}", ["en", "de", None][i % 3], "s", i) for i in range(60)] + ODD
    table(spark, str(tmp_path / "documents.parquet"), rows)
    got = Counter(tuple(r) for r in op12_merkle_manifest(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(con.execute(ORACLES["op12_merkle_manifest"]).fetchall()) == Counter(by_definition(rows))


def test_one_row_and_none(spark, tmp_path):
    one = [(1, "t", "en", "s", 1)]
    assert [tuple(r) for r in proofs(manifest(table(spark, str(tmp_path / "one"), one)), spark).drop("siblings").collect()] == by_definition(one)
    assert by_definition(one)[0][4] == sha("")
    assert proofs(manifest(table(spark, str(tmp_path / "none"), [])), spark).count() == 0
    assert os.path.isdir(tmp_path / "none")
