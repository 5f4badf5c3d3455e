"""Golden and property tests of the library's operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions.text import add_spans, span_tags
from flowloom.operators import evaluate, flows, gateways, graph, neighbors, scoring, tagging, trainset
from flowloom.schemas import ACTIVITY, AND, XOR, at
from flowloom.sources import corpus, lexicons

#: The annotated example document: words with tags where they have one.
DOCUMENT = """A/B-Actor customer/I-Actor brings/B-Activity in/I-Activity a/B-Activity_Data defective/I-Activity_Data computer/I-Activity_Data and the/B-Actor CRS/I-Actor checks/B-Activity the/B-Activity_Data defect/I-Activity_Data and hands/B-Activity out/I-Activity a/B-Activity_Data repair/I-Activity_Data cost/I-Activity_Data calculation/I-Activity_Data back .
If/B-XOR_Gateway the/B-Condition_Specification customer/I-Condition_Specification decides/I-Condition_Specification that/I-Condition_Specification the/I-Condition_Specification costs/I-Condition_Specification are/I-Condition_Specification acceptable/I-Condition_Specification , the process continues , otherwise/B-XOR_Gateway she/B-Actor takes/B-Activity her/B-Activity_Data computer/I-Activity_Data home/B-Further_Specification unrepaired/I-Further_Specification .
The ongoing repair consists of two activities , which are executed , in an arbitrary order .
The first activity is to check/B-Activity and repair/B-Activity the/B-Activity_Data hardware/I-Activity_Data , whereas/B-AND_Gateway the second activity checks/B-Activity and configures/B-Activity the/B-Activity_Data software/I-Activity_Data .
After each of these activities , the/B-Activity_Data proper/I-Activity_Data system/I-Activity_Data functionality/I-Activity_Data is tested/B-Activity .
If/B-XOR_Gateway an/B-Condition_Specification error/I-Condition_Specification is/I-Condition_Specification detected/I-Condition_Specification another/B-Activity_Data arbitrary/I-Activity_Data repair/I-Activity_Data activity/I-Activity_Data is executed/B-Activity , otherwise/B-XOR_Gateway the repair is finished ."""

# The literature lexicons' phrases that matter here, and a pair set.
XOR_WORDS = ["either", "else", "if", "if not", "in case", "in case of", "only", "only if", "or", "otherwise", "till", "unless", "until", "when", "whether"]
AND_WORDS = ["at the same time", "concurrently", "in addition to", "in parallel", "in parallel with this", "in the meantime", "meantime", "meanwhile", "simultaneously", "whereas", "while"]
PAIRS = [("either", "or"), ("if", "if"), ("if", "otherwise"), ("otherwise", "if")]


@pytest.fixture(scope="module")
def sentences(spark):
    rows = []
    for i, line in enumerate(DOCUMENT.split("\n")):
        words = [(w, t.replace("_", " ") or "O") for w, _, t in (x.partition("/") for x in line.split(" "))]
        rows.append(("doc", i, i, [w for w, _ in words], [t for _, t in words]))
    return spark.createDataFrame(rows, "doc_id string, sentence_idx int, sample_id long, tokens array<string>, ner_tags array<string>")


@pytest.fixture(scope="module")
def found(sentences):
    spans = tagging.tag_phrases(sentences, XOR_WORDS, AND_WORDS)
    g = spans.select("doc_id", F.col("sentence_idx").alias("s"), F.col("start").alias("t"), "tokens", F.transform("tokens", lambda x: F.lower(x)).alias("low"), F.col("gateway_type").alias("kind"))
    acts = tagging.spans_of_tags(corpus.to_tokens(sentences)).filter(F.col("entity.entity_type") == ACTIVITY)
    return g, acts.select("doc_id", F.col("entity.sentence_idx").alias("s"), F.col("entity.token_idx").alias("t"), F.col("entity.tokens").alias("tokens"))


def test_golden_tags(sentences, found):
    g, a = found
    assert sorted((r.s, r.t, r.low[0]) for r in g.filter(F.col("kind") == XOR).collect()) == [(1, 0, "if"), (1, 14, "otherwise"), (5, 0, "if"), (5, 12, "otherwise")]
    assert [(r.s, r.t) for r in g.filter(F.col("kind") == AND).collect()] == [(3, 11)]
    assert sorted((r.s, r.t) for r in a.collect()) == [(0, 2), (0, 10), (0, 14), (1, 16), (3, 5), (3, 7), (3, 15), (3, 17), (4, 11), (5, 10)]
    counts = corpus.to_tokens(sentences).groupBy("ner_tag").count().collect()
    assert {r.ner_tag: r["count"] for r in counts}["O"] == 54 and sum(r["count"] for r in counts) == 113


def test_golden_neighbours(found):
    g, a = found
    rows = {(r.s, r.t): r for r in neighbors.neighbours(g, a).collect()}
    w = rows[(3, 11)]
    assert [(x.s, x.t) for x in (w.ppa, w.pa, w.fa, w.ffa)] == [(3, 5), (3, 7), (3, 15), (3, 17)]
    last = rows[(5, 12)]
    assert (last.pa.s, last.pa.t, last.ppa.s, last.ppa.t) == (5, 10, 4, 11) and last.fa is None and last.ffa is None
    pairs = neighbors.contradictory(g.filter(F.col("kind") == XOR), PAIRS).collect()
    assert sorted((r.s, r.t, r.n_s, r.n_t) for r in pairs) == [(1, 0, 1, 14), (5, 0, 5, 12)]


def test_golden_flows(found):
    g, a = found
    merged, same = flows.document_flows(g, a, PAIRS)
    edges = sorted(((r.src.s, r.src.t), (r.tgt.s, r.tgt.t)) for r in merged.collect())
    assert len(edges) == 13 and same.count() == 2
    assert ((1, 0), (3, 11)) in edges and ((1, 16), (3, 11)) in edges and ((0, 2), (0, 10)) in edges and ((3, 17), (4, 11)) in edges and ((0, 10), (0, 14)) not in edges
    clean, _ = flows.document_flows(g, a, PAIRS, compat=False)
    assert ((1, 0), (3, 5)) in {((r.src.s, r.src.t), (r.tgt.s, r.tgt.t)) for r in clean.collect()}


def test_longest_phrase_first_and_no_overlap(spark):
    rng = random.Random(1)
    words = ["in", "case", "of", "if", "not", "x", "In"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(0, 12))]) for i in range(200)]
    phrases = ["in case", "in case of", "if", "if not", "of if"]
    got = add_spans(spark.createDataFrame(rows, "id int, tokens array<string>"), {"x": phrases}).collect()
    for r in got:
        taken, want = set(), []
        low = [w.lower() for w in r.tokens]
        for p in sorted((q.split() for q in phrases), key=lambda p: (-len(p), " ".join(p))):
            for k in range(len(low) - len(p) + 1):
                if low[k : k + len(p)] == p and not taken & set(range(k, k + len(p))):
                    taken |= set(range(k, k + len(p)))
                    want.append((k, len(p)))
        assert [tuple(s) for s in r.x] == sorted(want)


def test_closure_on_cycles(spark):
    rng = random.Random(2)
    edges = {(d, rng.randrange(12), rng.randrange(12)) for d in range(4) for _ in range(14)}
    got = {tuple(r) for r in graph.closure(spark.createDataFrame(list(edges), "doc_id int, a int, b int")).collect()}
    want = set(edges)
    while True:
        more = {(d, a, c) for d, a, b in want for e, x, c in want if d == e and b == x} - want
        if not more:
            break
        want |= more
    assert got == want


def test_pairing_closes_newest_split(spark):
    splits = [(1, 0, [1], [2, 3]), (1, 1, [4], [5, 6]), (2, 0, [1], [2, 3])]
    merges = [(1, 2, [5, 6], [7]), (1, 3, [8, 2], [9]), (1, 4, [10, 11], [12]), (2, 1, [0, 9], [4])]
    s = "doc_id int, ord int, pointing array<int>, receiving array<int>"
    got = gateways.pair_points(spark.createDataFrame(splits, s), spark.createDataFrame(merges, s)).collect()
    out = {(r.doc_id, r.split.pointing[0]): r.merge and r.merge.receiving[0] for r in got}
    # in text order: split 1, merge from 2, split 4, merge from 5; document 2's merge comes before any split
    assert out == {(1, 1): 9, (1, 4): 7, (2, 1): None}


def test_votes(spark):
    gates = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3)], "doc_id int, gateway_idx int")
    v = lambda g, kinds: [(1, g, 0, 1, i, 0, 10 + i, 0, k) for i, k in enumerate(kinds)]
    rows = v(0, ["concurrent", "exclusive", "exclusive"]) + v(1, ["concurrent", "exclusive"]) + v(2, ["directly_following"])
    voted = spark.createDataFrame(rows, "doc_id int, gateway_idx int, b1 int, b2 int, a1 int, o1 int, a2 int, o2 int, relation_type string")
    got = {r.gateway_idx: (r.type, r.confidence) for r in gateways.vote(gates, voted).collect()}
    assert got == {0: ("XOR Gateway", 0.6667), 1: ("AND Gateway", 0.5), 2: ("no_gateway_relations", -1.0), 3: ("XOR Gateway optional", 1.0)}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (0, 2), (2, 2), (1, 2)], "y int, p int")
    r = evaluate.class_scores(rows, [2]).first()
    assert (r.tp, r.predicted, r.real) == (1, 3, 1) and r.precision == pytest.approx(1 / 3) and r.recall == 1.0
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    gold = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A")], "doc_id int, label string")
    pred = spark.createDataFrame([(1, "A")], "doc_id int, label string")
    for compat, fp in ((False, [0, 0]), (True, [1, 1])):
        m = evaluate.count_benchmark(gold, pred, docs, ["A"], compat).orderBy("doc_id").collect()
        assert [(x.tp, x.fp, x.fn) for x in m] == [(1, fp[0], 1), (0, fp[1], 1)]


def test_relaxed_matching(spark):
    s = "doc_id int, label string, ord long, source array<string>, target array<string>"
    gold = spark.createDataFrame([(1, "f", 0, ["the", "Order"], ["pay"]), (1, "f", 1, ["a", "b", "c"], ["x"])], s)
    pred = spark.createDataFrame([(1, "f", 0, ["order"], ["pay", "it"]), (1, "f", 1, ["q"], ["x"])], s)
    r = evaluate.relaxed_matches(gold, pred).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1)


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (5, 2)])
def test_folds(spark, n, k):
    got = trainset.folds(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", k).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in got] == [n // k + (i < n % k) for i in range(k)]


def test_sampling_and_masks(sentences, spark):
    assert trainset.up_sample(sentences, 1).count() == 2 * 3
    assert trainset.down_sample(sentences, 1).count() == 2 * 3
    with pytest.raises(ValueError):
        trainset.sample(sentences, "sideways")
    toks = corpus.to_tokens(sentences)
    masked = trainset.mask_activities(toks, "single_mask").filter(F.endswith("ner_tag", F.lit(ACTIVITY)))
    assert {r.token for r in masked.select("token").distinct().collect()} == {"checks"}
    bad = spark.createDataFrame([("B-Nonsense",)], "ner_tag string")
    with pytest.raises(Exception, match="unknown tag"):
        trainset.encode_tokens(bad).collect()
    assert trainset.features(spark.createDataFrame([(1, 1, "a", "b", "c")], "doc_id int, pair_id int, gram1 string, gram2 string, context string"), "n_gram").columns == ["doc_id", "pair_id", "gram1", "gram2"]


def test_sources_and_sinks(spark, sentences, tmp_path):
    (tmp_path / "p.txt").write_text("or\n\nif not \n")
    assert sorted(r.phrase for r in lexicons.read_phrases(spark, str(tmp_path / "p.txt"), "s", XOR).collect()) == ["if not", "or"]
    (tmp_path / "c.csv").write_text("or;lit;keep\nsuch;lit;drop\n")
    assert [r.phrase for r in lexicons.read_kept_phrases(spark, str(tmp_path / "c.csv"), "s", XOR).collect()] == ["or"]
    (tmp_path / "pairs.txt").write_text("if;otherwise\nin case of; in case\n")
    assert [(r.p1, r.p2) for r in lexicons.read_pairs(spark, str(tmp_path / "pairs.txt"), "s").collect()] == [(["in", "case", "of"], ["in", "case"]), (["if"], ["otherwise"])]
    (tmp_path / "syn.json").write_text(json.dumps({"xor": {"or": ["else"]}, "and": {"while": ["whilst", "as"]}, "sources": ["x"]}))
    assert lexicons.read_synonyms(spark, str(tmp_path / "syn.json")).count() == 3
    (tmp_path / "loops.json").write_text(json.dumps({"loop_flows": {"doc-1": {"source": [1, 2, ["a", "b"], "Activity"], "target": [0, 1, ["c"], "XOR Gateway"]}}}))
    loop = lexicons.read_loops(spark, str(tmp_path / "loops.json")).first()
    assert (loop.doc_id, loop.source.token_idx, loop.source.tokens, loop.target.entity_type) == ("doc-1", 2, ["a", "b"], XOR)
    (tmp_path / "names.json").write_text(json.dumps({"test_docs": ["doc-1.1", "doc-2.2"]}))
    assert sorted(r.doc_id for r in lexicons.read_names(spark, str(tmp_path / "names.json")).collect()) == ["doc-1.1", "doc-2.2"]
    corpus.write_corpus(sentences, str(tmp_path / "corpus"))
    assert corpus.read_corpus(spark, str(tmp_path / "corpus"), ["doc"]).count() == 6
    runs = spark.createDataFrame([(0.5,)], "f1 double")
    runs.write.json(str(tmp_path / "runs/model=a/seed=3"))
    assert corpus.read_runs(spark, str(tmp_path / "runs"), "f1 double").first().params == {"model": "a", "seed": "3"}
    corpus.write_metrics(runs, runs, runs, str(tmp_path / "m"), "csv")
    corpus.write_gateways(runs, str(tmp_path / "g"))
    corpus.write_params(spark, {"threshold": 1}, str(tmp_path / "params"))
    corpus.write_predictions(runs, runs, str(tmp_path / "pred"))
    assert spark.read.json(str(tmp_path / "params")).first().name == "threshold"


def test_stream_equals_batch(spark, tmp_path):
    from flowloom.streaming.tags import tag_stream, write_stream

    docs = spark.createDataFrame([(1, "If so. Or not!"), (2, None), (3, "when, or when or")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    write_stream(tag_stream(spark, str(tmp_path / "in"), "doc_id long, text string", XOR_WORDS, AND_WORDS), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = tagging.tag_phrases(tagging.split_sentences(docs), XOR_WORDS, AND_WORDS)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))


def test_stopping_epoch(spark):
    values = [0.1, 0.2, 0.2, 0.5]
    h = spark.createDataFrame([(0, 0, e, "f", v) for e, v in enumerate(values)], "fold int, seed int, epoch int, metric string, value double")
    assert scoring.stopping_epoch(h, "f").first().epoch == 2
    assert scoring.stopping_epoch(h, "f", patience=2).first().epoch == 3


def test_entry_and_oracles():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_position_text(spark):
    row = spark.createDataFrame([(1, 2, ["a"], "Activity")], "sentence_idx int, token_idx int, tokens array<string>, entity_type string").select(at(F.struct("*")).alias("x")).first()
    assert row.x == "1:2"


def test_relation_filter_and_document_selection(spark):
    rel = spark.createDataFrame([("a1", "x"), ("b1", "y"), ("b1", None)], "doc_id string, relation_type string")
    kinds = lambda df: sorted((r.relation_type or "") for r in df.collect())
    assert kinds(tagging.filter_relations(rel, label="x")) == ["x"]
    assert kinds(tagging.filter_relations(rel, exclude="x")) == ["", "y"]
    for given in ({}, {"label": "x", "exclude": "y"}):
        with pytest.raises(ValueError):
            tagging.filter_relations(rel, **given)
    one = spark.createDataFrame([("a1",)], "doc_id string")
    assert kinds(tagging.select_documents(rel, listed=one)) == ["x"]
    assert kinds(tagging.select_documents(rel, excluded=one)) == ["", "y"]
    assert kinds(tagging.select_documents(rel, prefix="b")) == ["", "y"]
    assert tagging.select_documents(rel).count() == 3


def test_synonym_variants(spark):
    copies = spark.createDataFrame([(0, 500, ["x"]), (0, 501, ["y"]), (1, 502, ["z"])], "original_id long, sample_id long, tokens array<string>")
    pairs = spark.createDataFrame([(7, 1, 0, 1, 0, 1), (7, 2, 0, 0, 0, 0), (7, 3, 2, 2, 2, 2)], "doc_id int, pair_id int, s1 int, s2 int, sample1 long, sample2 long")
    variants = trainset.synonym_variants(pairs, copies)
    sents = spark.createDataFrame([(7, 0, ["a"]), (7, 1, ["b"]), (7, 2, ["c"])], "doc_id int, sentence_idx int, tokens array<string>")
    texts: dict = {}
    for r in trainset.variant_contexts(variants, sents, copies, 0).collect():
        texts.setdefault(r.pair_id, []).append(r.context)
    assert {k: sorted(v) for k, v in texts.items()} == {1: ["a b", "a z", "x b", "x z", "y b", "y z"], 2: ["a", "x", "y"], 3: ["c"]}
    assert trainset.synonym_variants(pairs, copies.limit(0)).count() == 3


def test_sentences_without_first_words(spark):
    rows = spark.createDataFrame([(1, ["a", None, "or"]), (2, ["a", "b"]), (3, []), (4, None), (5, [None])], "doc_id int, tokens array<string>")
    found = add_spans(rows, {"s": ["or", "it is"]})
    got = {r.doc_id: ([tuple(x) for x in r.s], r.t) for r in found.select("doc_id", "s", span_tags(F.col("tokens"), F.col("s"), XOR).alias("t")).collect()}
    assert got == {1: ([(2, 1)], ["O", "O", "B-XOR Gateway"]), 2: ([], ["O", "O"]), 3: ([], []), 4: ([], None), 5: ([], ["O"])}
