"""What is found within documents leaves the scan that finds it; only its inputs are shuffled and stored."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from flowloom.operators import flows, graph, scoring, tagging, trainset
from flowloom.schemas import ACTIVITY, AND, ENTITY, XOR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chain(spark, n=12):
    """One document: a gateway after every two activities, each gateway also to the node after next."""
    nodes = [(0, i, [f"n{i}"], XOR if i % 3 == 2 else ACTIVITY) for i in range(n)]
    ends = [(i, j) for i in range(n) for j in (i + 1, i + 2) if j < n and (j == i + 1 or nodes[i][3] == XOR)]
    flows = spark.createDataFrame([(1, o, nodes[i], nodes[j]) for o, (i, j) in enumerate(ends)], f"doc_id long, flow_ord int, source {ENTITY}, target {ENTITY}")
    same = spark.createDataFrame([(1, nodes[2], nodes[5])], f"doc_id long, source {ENTITY}, target {ENTITY}")
    return nodes, flows, same


def test_walks_and_relations_leave_the_scan_unshuffled(spark):
    nodes, flows, same = chain(spark)
    starts = spark.createDataFrame([(1, nodes[3], None), (1, nodes[3], nodes[6])], f"doc_id long, start {ENTITY}, merge {ENTITY}")
    found = graph.until_merge(starts, flows, same)
    got = sorted((r.merge is None, r.entity.token_idx) for r in found.collect())
    # before 6 the gateway 5 is met, which has no partners; without a merge point all that follows is
    assert got == [(False, 3), (False, 4), (False, 5)] + [(True, i) for i in range(3, 12)]
    relations, _, branches = graph.activity_relations(flows, same)
    for df in (found, relations, branches):
        above = plan(df).split("MapInArrow")[0]
        assert "MapInArrow" in plan(df) and "Exchange" not in above and "Join" not in above
    assert plan(relations.filter("relation_type = 'directly_following'")).count("MapInArrow") == 1
    rows = relations.collect()
    assert len(rows) == len({(r.a1.token_idx, r.a2.token_idx, r.relation_type, r.comment) for r in rows})
    assert {frozenset((r.a1.token_idx, r.a2.token_idx)) for r in rows} == {frozenset((i, j)) for i in range(12) for j in range(i) if i % 3 != 2 and j % 3 != 2}


def tagged(spark):
    """Two documents: a phrase of two words at a sentence's end, a short sentence, spans with gaps."""
    sents = [(["a", "it", "is"], ["O", "B-XOR Gateway", "I-XOR Gateway"]), (["b"], ["O"]), (["or", "c", "d", "e"], ["B-XOR Gateway", "O", "B-Activity", "I-Activity"])]
    return spark.createDataFrame([(1, sents), (2, [(["x", "or"], ["O", "B-XOR Gateway"])])], "doc_id long, sents array<struct<tokens:array<string>,ner_tags:array<string>>>")


def test_grams_pairs_and_spans_need_no_shuffle(spark):
    docs = tagged(spark)
    placed = trainset.tagged_places(docs, "B-XOR Gateway")
    grams, pairs = trainset.n_grams(placed, 2), trainset.pair_rows(placed, 1, 1, threshold=2, size=6)
    assert sorted(map(tuple, grams.collect())) == [(1, 1, "a it is b or"), (1, 4, "is b or c d"), (2, 1, "x or")]
    assert [tuple(r) for r in pairs.collect()] == [(1, 1, 1, 4, "a it is b", "b or c", "a it is b or c d e", [1, 1, 1, 1, 1, 1])]
    assert trainset.pair_rows(placed, 1, 1).isEmpty()
    modes = trainset.features_by_mode(pairs, ["n_gram", "context_index"])
    assert sorted((r.mode, r.features) for r in modes.collect()) == [("context_index", "a it is b or c d e|1|4"), ("n_gram", "a it is b|b or c")]
    spans = tagging.document_spans(docs)
    tokens = docs.selectExpr("doc_id", "posexplode(sents) AS (sentence_idx, s)").selectExpr("doc_id", "sentence_idx", "posexplode(arrays_zip(s.tokens, s.ner_tags)) AS (token_idx, z)").selectExpr("doc_id", "sentence_idx", "token_idx", "z.tokens AS token", "z.ner_tags AS ner_tag")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(spans.selectExpr("doc_id", "inline(spans)")) == rows(tagging.spans_of_tags(tokens))
    for df in (grams, pairs, modes, spans):
        assert "Exchange" not in plan(df) and "Join" not in plan(df)


def test_features_of_sentences_need_no_shuffle(spark):
    sents = tagged(spark).selectExpr("doc_id", "posexplode(sents) AS (sentence_idx, s)").selectExpr("doc_id", "sentence_idx", "s.tokens", "s.ner_tags")
    tokens = sents.selectExpr("doc_id", "sentence_idx", "posexplode(arrays_zip(tokens, ner_tags)) AS (token_idx, z)").selectExpr("doc_id", "sentence_idx", "token_idx", "z.tokens AS token", "z.ner_tags AS ner_tag")
    found = scoring.sentence_features(sents)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(found) == rows(scoring.token_features(tokens)) and "Exchange" not in plan(found)


def test_copies_read_their_samples_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def met(i):
        seen.add(1)
        return i

    rows = spark.createDataFrame([(i, ["a", "or"], ["O", "B-XOR Gateway"]) for i in range(20)], "sample_id long, tokens array<string>, ner_tags array<string>")
    syn = spark.createDataFrame([(XOR, "or", "else"), (XOR, "or", "otherwise")], "gateway_type string, keyword string, synonym string")
    made = trainset.synonym_samples(rows.withColumn("sample_id", met.asNondeterministic()("sample_id")), syn)
    assert sorted(r.sample_id for r in made.collect()) == list(range(500, 540))
    assert seen.value == 20


def test_flows_of_documents_need_no_shuffle(spark):
    rng = random.Random(29)
    words = {XOR: ["or", "if", "that"], AND: ["and", "while"], ACTIVITY: ["started", "station", "ended"]}
    rows = []
    for d in range(60):
        # gateways and activities may share a place; some documents have none of either
        kinds = rng.choice([(XOR, AND, ACTIVITY), (XOR, ACTIVITY, ACTIVITY), (XOR, AND), (ACTIVITY,)])
        places = {(rng.randrange(6), rng.choice((0, 0, 1, 2, 3)), rng.choice(kinds)) for _ in range(rng.randrange(25))}
        rows += [(d, s, t, [rng.choice(words[k])], k) for s, t, k in sorted(places)]
    one = spark.createDataFrame(rows, "doc_id long, s int, t int, tokens array<string>, kind string")
    acts, gates = one.filter(F.col("kind") == ACTIVITY).drop("kind"), one.filter(F.col("kind") != ACTIVITY).withColumn("low", F.col("tokens"))
    of = lambda k: gates.filter(F.col("kind") == k).drop("kind")
    got = lambda df: sorted(map(repr, df.collect()))
    by_document = {}
    for d, s, t, w, k in rows:
        by_document.setdefault(d, []).append((s, t, int(k == ACTIVITY), w, k))
    docs = spark.createDataFrame([(d, sorted(p)) for d, p in by_document.items()] + [(98, []), (99, None)], f"doc_id long, places {flows.PLACES}")
    pairs = [("that", "or"), ("or", "or"), ("if", "if"), ("if", "that")]
    for multiple in (False, True):
        xor, x_frames, same = flows.exclusive_flows(of(XOR), acts, pairs, multiple=multiple)
        par, a_frames = flows.concurrent_flows(of(AND), acts)
        ruled = flows.ruled(docs, pairs, multiple=multiple)
        assert got(flows.document_rows(ruled, "same")) == got(same) and same.count() > 3
        assert got(flows.document_rows(ruled, "flows").select("doc_id", "rel", "src", "tgt")) == got(xor.unionAll(par))
        frames = x_frames.unionAll(a_frames)
        assert got(flows.document_rows(ruled, "frames")) == got(frames.drop("g_s", "g_t"))
        defaults = flows.default_flows(acts)
        kept = flows.suppress_defaults(defaults, xor.unionAll(par)).drop("rel")
        assert got(flows.document_rows(flows.with_defaults(ruled), "defaults")) == got(kept.select("doc_id", "src", "tgt"))
        for compat in (True, False):
            found = flows.document_rows(flows.merged(ruled, compat), "flows")
            assert got(found) == got(flows.merge_flows(defaults, xor.unionAll(par), frames, compat))
            assert "Exchange" not in plan(found) and "Join" not in plan(found) and "Sort" not in plan(found)
    placed = flows.placed(gates, acts)
    assert plan(placed).count("Exchange") == 1 and got(placed) == got(docs.filter("size(places) > 0"))


def test_least_holders_of_long_stretches():
    rng = random.Random(31)
    docs = [(sorted(rng.sample(range(5000), n)), [(i, *sorted(rng.sample(range(5000), 2))) for i in rng.sample(range(400), m)]) for n, m in ((0, 3), (700, 0), (1, 5), (1000, 30), (300, 300))]
    stretches = pa.array([[{"i": i, "lo": lo, "hi": hi} for i, lo, hi in x] for _, x in docs], pa.list_(pa.struct([("i", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])))
    points = pa.array([p for p, _ in docs], pa.list_(pa.int64()))
    want = [[min((i for i, lo, hi in x if lo <= k <= hi), default=None) for k in p] for p, x in docs]
    assert flows.least_holders(points, stretches).to_pylist() == want
    assert flows.least_holders(points.slice(2, 2), stretches.slice(2, 2)).to_pylist() == want[2:4]
    assert flows.least_holders(points.slice(0, 0), stretches.slice(0, 0)).to_pylist() == []
