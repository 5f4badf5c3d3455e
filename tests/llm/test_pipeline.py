import base64
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_exact import norm
from tests.llm.test_overlap import slow_kept
from tests.llm.test_quality import made


def test_stages_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(9)
    rows, labels = made(300, rng)
    items = [(k, " ".join(f"q{rng.randrange(50)}" for _ in range(30))) for k in range(3)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(400))
    rows += [(1100 + i, long + f" tail{i}") for i in range(4)] + [(1200 + k, "a lead " + t) for k, t in items] + [(1300, None), (1301, " ")]
    docs(rows, 3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    table, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        before, table = table, spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or table.columns == before.columns
        seen.append([(r.doc_id, r.text) for r in table.collect()] if k < 4 else table.collect())

    bad = {i for i, q, _ in labels if q == 0}
    truth = {t for i, t in rows if i in bad}
    kept = {i for i, _ in seen[0]}
    assert sum(i in kept for i, t in rows if t in truth) <= 0.1 * len(truth)
    assert all(i in kept for i, t in rows if i >= 1200 and t not in truth) or len(kept) > 200
    first = {}
    for i, t in seen[0]:
        first[norm(t)] = min(first.get(norm(t), i), i)
    assert sorted(i for i, _ in seen[1]) == sorted(first.values())
    assert sorted((i for i, _ in seen[2]), key=str) == slow_kept(seen[1])
    clean = [i for i, t in seen[2] for w, hit, _ in [slow_hits(t, items)] if not hit or 20 * len(hit) < len(w)]
    assert sorted(i for i, _ in seen[3]) == sorted(clean)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = dict(seen[3])
    assert {r.doc_id: r.input_ids for r in seen[4]} == {i: library.encode_ordinary(t or "") for i, t in text.items()}
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.ids_sha256) for r in seen[4])


def test_empty_tables_and_null_ids(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = docs([(None, "a b c d e f"), (None, None), (3, None), (4, "a b  c d e f"), (None, "alone here")])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        rows = stage(spark, rows, str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in rows.collect()) == [("3", None), ("4", "a b  c d e f"), ("None", "alone here")]
