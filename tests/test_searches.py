"""Brute-force tests of the searches that replace joins within a document."""

import random

from pyspark.sql import functions as F

from flowloom.functions import grams, paths
from flowloom.functions.documents import by_document
from flowloom.operators import evaluate, flows, gateways, graph, tagging, trainset
from flowloom.schemas import ACTIVITY, AND, GATEWAYS, XOR
from flowloom.sources import lexicons

ENTITY = "struct<sentence_idx:int,token_idx:int,tokens:array<string>,entity_type:string>"


def reached(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        seen, front = set(), [a]
        while front:
            new = after.get(front.pop(), set()) - seen
            seen |= new
            front += new
        out |= {(a, b) for b in seen}
    return out


def test_components_closure_and_labels():
    rng = random.Random(3)
    for n, m in [(1, 1), (4, 6), (12, 14), (12, 40), (60, 70)] * 8:
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        a, b = map(list, zip(*edges))
        want = reached(edges)
        assert set(paths.closure(a, b)) == want
        limit, paths.BIT_SETS = paths.BIT_SETS, 0
        assert set(paths.closure(a, b)) == want
        paths.BIT_SETS = limit
        reaches = paths.searcher(a, b)
        nodes = sorted({*a, *b})
        assert {(x, y) for x in nodes for y in nodes if reaches(x, y)} == want
        assert not reaches("elsewhere", nodes[0])
        labels = {node: rest for node, *rest in paths.labels(a, b)}
        for x in nodes:
            for y in nodes:
                (c, cyclic, first, last, low, rank), (d, _, at, _, low2, rank2) = labels[x], labels[y]
                if c == d:
                    assert cyclic == ((x, y) in want)
                elif first <= at <= last:
                    assert (x, y) in want
                elif not all(low[i] <= low2[i] and rank2[i] <= rank[i] for i in (0, 1)):
                    assert (x, y) not in want


def test_a_chain_of_100000_nodes_has_linear_labels():
    n = 100_000
    a, b = [*range(n - 1), 5, n], [*range(1, n), 3, 0]
    rows = list(paths.labels(a, b))
    assert len(rows) == n + 1 and sum(r[2] for r in rows) == 3  # one loop, 3 to 5
    reaches = paths.searcher(a, b)
    assert reaches(0, n - 1) and reaches(n, 77_777) and reaches(5, 3) and not reaches(77_777, 4) and not reaches(0, 0)


def slow_merge(elements, flow_list):
    """The definition: every element scans the flows of its scope."""
    out = []
    degree = {}
    for _, _, target, _, _ in flow_list:
        degree[target] = degree.get(target, 0) + 1
    for place, key in elements:
        least = min([place, *(to for at, _, _, to, _ in flow_list if at >= place)])
        open_, met, merge, nested = 1, set(), None, []
        for at, _, target, _, gateway in sorted(f for f in flow_list if f[0] >= least and f[2] != key):
            if gateway and degree[target] == 1:
                open_ += 1
                nested.append(target)
            if target in met:
                open_ -= 1
                if open_ == 0:
                    merge = target
                    break
            met.add(target)
        out.append((key, merge, sorted(set(nested))))
    return sorted(out)


def test_merge_points_equal_the_scan():
    rng = random.Random(5)
    for n, m in [(1, 1), (2, 3), (6, 9), (9, 12), (30, 45)] * 40:
        kinds = [rng.random() < 0.5 for _ in range(n)]
        found = []
        for o in range(rng.randrange(m + 1)):
            s, t = rng.randrange(n), rng.randrange(n)
            if rng.random() < 0.8:
                s, t = min(s, t), max(s, t)
            found.append(((0, s), o, f"n{t}", (0, t), kinds[t]))
        found.sort()
        elements = [((0, i), f"n{i}") for i in range(n) if kinds[i]]
        columns = [[f[i] for f in found] for i in (2, 0, 3, 4)]
        got = sorted((k, x, sorted(y)) for k, x, y in paths.merge_points(elements, *columns))
        assert got == slow_merge(elements, found)


def test_documents_in_any_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(7)
        rows = [(None if d == 0 else d, i, rng.randrange(2)) for d in range(9) for i in range(rng.randrange(1, 9))]
        df = spark.createDataFrame(rows, "doc_id long, x int, later int").repartition(3)
        got = by_document(df, lambda x, later: [(len(x), x)], "n int, x array<int>", ("x",)).collect()
        want = {}
        for d, i, _ in rows:
            want.setdefault(d, []).append(i)
        assert {r.doc_id: r.x for r in got} == want and len(got) == len(want)
        pieces = by_document(df, lambda x, _: lambda y, _2: [(sum(x), v) for v in y], "s int, y int", ("x",), streamed="later").collect()
        first = {d: sum(i for e, i, k in rows if e == d and k == 0) for d, _, _ in rows}
        assert sorted((str(r.doc_id), r.s, r.y) for r in pieces) == sorted((str(d), first[d], i) for d, i, k in rows if k)
        assert by_document(df.limit(0), lambda x, later: [(1,)], "n int", ("x",)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reachability_of_asked_pairs(spark):
    rng = random.Random(11)
    node = lambda i: (0, i, [f"n{i}"], ACTIVITY if i % 3 else GATEWAYS[0])
    edges = [(d, o, node(rng.randrange(9)), node(rng.randrange(9))) for d in range(12) for o in range(11)]
    same = [(d, node(0), node(3)) for d in range(0, 12, 2)]
    f = spark.createDataFrame(edges, f"doc_id long, flow_ord int, source {ENTITY}, target {ENTITY}")
    s = spark.createDataFrame(same, f"doc_id long, source {ENTITY}, target {ENTITY}")
    labels = graph.reach_labels(f, s)
    side = lambda i: labels.select("doc_id", F.col("entity").alias(f"a{i}"), F.col("label").alias(f"label{i}"))
    got = graph.reaches(side(1).join(side(2), "doc_id"), f, s).collect()
    want = {d: reached([(a[1], b[1]) for e, _, a, b in edges if e == d] + [(a[1], b[1]) for e, a, b in same if e == d]) for d in range(12)}
    assert got and all(r.path == ((r.a1.token_idx, r.a2.token_idx) in want[r.doc_id]) for r in got)
    unsure = [r for r in side(1).join(side(2), "doc_id").withColumn("known", graph._by_labels(F.col("label1"), F.col("label2"))).collect() if r.known is None]
    assert len(unsure) < len(got) / 10
    assert {(r.doc_id, r.source.token_idx, r.target.token_idx) for r in graph.reachability(f, s).collect()} == {(d, a, b) for d, p in want.items() for a, b in p}


def holds(frame, place, compat):
    (_, a, b), (s, t) = frame, place
    if compat:
        return (s == a[0] and t >= a[1]) or a[0] < s < b[0] or (s == b[0] and t <= b[1])
    return a <= place <= b


def test_frames_that_hold_places(spark):
    rng = random.Random(13)
    at = lambda top=4: (rng.randrange(top), rng.randrange(6))
    places, frames = [], []
    for d in range(40):
        places += [(d, *at()) for _ in range(rng.randrange(30))]
        ends = [(at(), at()) for _ in range(rng.randrange(9))]
        ordered = [tuple(sorted(e)) if rng.random() < 0.8 else e for e in ends]
        frames += [(d, i, a, b) for i, (a, b) in enumerate(ordered)]
    p = spark.createDataFrame(places, "doc_id int, s int, t int")
    f = spark.createDataFrame(frames, "doc_id int, i int, start struct<s:int,t:int>, end struct<s:int,t:int>")
    for compat in (True, False):
        want = {}
        for d, s, t in set(places):
            held = [i for e, i, a, b in frames if e == d and holds((i, a, b), (s, t), compat)]
            if held:
                want[d, s, t] = min([i for i in held if i > 0] or held) if compat else min(held)
        got = {(r.doc_id, r.s, r.t): r.frame for r in flows.holding_frames(p, f, compat).collect()}
        assert got == want


def test_a_lexicon_of_thousands(spark):
    rng = random.Random(17)
    words = ["a", "B", "c", "d", "e", "of", "ß"]
    sents = [(i % 9, i, [rng.choice(words) for _ in range(rng.randrange(0, 30))]) for i in range(150)] + [(None, 1, ["a", "b", "a", "b"]), (3, 900, None)]
    phrases = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(1500)}
    lexicon = [(XOR if rng.random() < 0.6 else AND, p) for p in sorted(phrases)] + [(AND, "a b"), (XOR, "A B"), (XOR, None), (AND, "")]
    want = []
    for d, i, tokens in sents:
        low = [w.lower() for w in tokens or ()]
        for kind in (XOR, AND):
            taken = set()
            for p in sorted({p.lower() for k, p in lexicon if k == kind and p}, key=lambda p: (-len(p.split(" ")), p.encode())):
                n = len(p.split(" "))
                for at in range(len(low) - n + 1):
                    if low[at : at + n] == p.split(" ") and not taken & set(range(at, at + n)):
                        taken |= set(range(at, at + n))
                        want.append((str(d), i, kind, at, n, p))
    s = spark.createDataFrame(sents, "doc_id int, sentence_idx int, tokens array<string>")
    lex = spark.createDataFrame(lexicon, "gateway_type string, phrase string")
    for most in (10_000, 0):  # broadcast, joined
        got = tagging.tag_lexicon(s, lex, most).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert tagging.tag_lexicon(s, lex.limit(0)).count() == 0
    xor, and_ = ([p for k, p in lexicon if k == kind and p] for kind in (XOR, AND))
    by_values = tagging.tag_phrases(s, xor, and_).collect()
    assert sorted((str(r.doc_id), r.sentence_idx, r.gateway_type, r.start, r.n_words) for r in by_values) == sorted(w[:5] for w in want)


def test_one_long_sentence(spark):
    s = spark.createDataFrame([(1, 0, ["x"] * 20_001)], "doc_id int, sentence_idx int, tokens array<string>")
    lex = spark.createDataFrame([(XOR, "x x"), (XOR, "x"), (XOR, "x y")], "gateway_type string, phrase string")
    got = tagging.tag_lexicon(s, lex)
    assert got.groupBy("n_words").count().orderBy("n_words").collect() == [(1, 1), (2, 10_000)]


def test_mined_n_grams(spark):
    s = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["A", "b"]), (2, ["a", "B"]), (3, ["c"]), (None, ["a", "b"])], "doc_id int, tokens array<string>")
    assert {(r.phrase, r.n, r.n_docs) for r in lexicons.mine_n_grams(s, (2, 3), 2).collect()} == {("a b", 2, 3)}
    assert {(r.phrase, r.n_docs) for r in lexicons.mine_n_grams(s, (1,), 2).collect()} == {("a", 3), ("b", 3), ("c", 2)}


def test_depth_first_order_decides_a_tied_vote(spark):
    """Members of the first branch are 1, 3, 5, then 4; by rounds 4 would come before 5."""
    assert list(paths.depth_first(1, {1: [3, 4], 3: [5], 5: [1, 9]}, {9})) == [1, 3, 5, 4]
    edges = [(0, 1), (0, 2), (1, 3), (1, 4), (3, 5)]
    df = spark.createDataFrame([(7, a, b, i) for i, (a, b) in enumerate(edges)], "doc_id long, a1 int, a2 int, ord long")
    split = spark.createDataFrame([(7, 0, ([0], [1, 2]), None)], "doc_id long, gateway_idx int, split struct<pointing:array<int>,receiving:array<int>>, merge struct<pointing:array<int>,receiving:array<int>>")
    members = gateways.full_branches(split, df)
    assert sorted((r.branch, r.ord, r.a) for r in members.collect()) == [(0, 0, 1), (0, 1, 3), (0, 2, 5), (0, 3, 4), (1, 0, 2)]
    kinds = {(1, 2): "directly_following", (2, 3): "directly_following", (2, 5): "exclusive", (2, 4): "concurrent"}
    rel = spark.createDataFrame([(7, a, b, k, i) for i, ((a, b), k) in enumerate(kinds.items())], "doc_id long, a1 int, a2 int, relation_type string, ord long")
    vote = lambda m: gateways.vote(split, gateways.branch_relations(m, rel)).first()
    assert (vote(members).type, vote(members).confidence) == ("XOR Gateway", 0.25)
    by_rounds = members.withColumn("ord", F.expr("CASE a WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 5 THEN 2 ELSE 1 END"))
    assert vote(by_rounds).type == "AND Gateway"


def test_relaxed_matching_by_the_definition(spark):
    rng = random.Random(19)
    words = ["a", "B", "c"]
    some = lambda: [rng.choice(words) for _ in range(rng.randrange(0, 4))]
    both = [[(d, rng.choice("xy"), i, some(), some()) for d in range(6) for i in range(rng.randrange(9))] for _ in range(2)]

    def fits(p, q):
        cut = lambda w: {tuple(x.lower() for x in w[i : len(w) - j]) for i in (0, 1) for j in (0, 1) if i + j < len(w)} | {tuple(x.lower() for x in w)}
        return bool(cut(p) & cut(q))

    want = {}
    for key in {(r[0], r[1]) for side in both for r in side}:
        gold, free = ([r for r in side if (r[0], r[1]) == key] for side in both)
        n, tp = len(free), 0
        for g in gold:
            hit = next((i for i, p in enumerate(free) if fits(g[3], p[3]) and fits(g[4], p[4])), None)
            if hit is not None:
                free.pop(hit)
                tp += 1
        want[key] = (tp, n - tp, len(gold) - tp)
    frames = [spark.createDataFrame(side, "doc_id int, label string, ord long, source array<string>, target array<string>") for side in both]
    got = {(r.doc_id, r.label): (r.tp, r.fp, r.fn) for r in evaluate.relaxed_matches(*frames).collect()}
    assert got == want


def test_many_relations_under_one_label(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit("x").alias("label"), F.col("id").alias("ord"), F.array(F.lit("same"), (F.col("id") % 7).cast("string")).alias("source"), F.array(F.lit("t")).alias("target"))
    assert [tuple(r) for r in evaluate.relaxed_matches(rows, rows.filter("ord >= 50")).collect()] == [(1, "x", n - 50, 0, 50)]


def test_the_rows_with_the_least_keys(spark):
    rng = random.Random(23)
    rows = spark.createDataFrame([(i, rng.randrange(-50, 50)) for i in range(500)] + [(None, None)], "id long, n long")
    order = sorted(range(500), key=lambda i: __import__("hashlib").md5(f"{i}:42".encode()).hexdigest())
    known = rows.filter("id IS NOT NULL")
    for k in (0, 1, 7, 250, 499, 500, 600):
        low, rest = trainset.split_lowest(known, trainset.seeded("id", 42), k)
        assert sorted(r.id for r in low.collect()) == sorted(order[:k])
        assert low.count() + rest.count() == 500
        assert "Sort" not in low._jdf.queryExecution().executedPlan().toString()
    values = sorted(r.n for r in rows.filter("n IS NOT NULL").collect())
    for k in (3, 200):  # equal keys at the cut
        low, rest = trainset.split_lowest(rows.filter("n IS NOT NULL"), trainset.sortable("n"), k)
        assert sorted(r.n for r in low.collect()) == values[:k] and rest.count() == 500 - k
    head, tail = trainset.split_head_tail(rows, "id", 0.1)
    assert sorted(r.id for r in head.collect()) == list(range(451)) and tail.count() == 50
    assert trainset.split_lowest(rows.limit(0), trainset.sortable("n"), 5)[0].count() == 0


def test_word_sequences_are_shuffled_once_and_not_sorted(spark):
    s = spark.createDataFrame([(d, i, ["a", "b", str(d)]) for i, d in enumerate((1, 1, 2))], "doc_id long, sentence_idx int, tokens array<string>")
    mined = lexicons.mine_n_grams(s, (2,), 2)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert [(r.phrase, r.n_docs) for r in mined.collect()] == [("a b", 2)]
    assert len([x for x in plan(lexicons.mine_n_grams(s, (2,), 2)).splitlines() if "Exchange" in x and "phrase#" in x]) == 1
    found = tagging.tag_lexicon(s, spark.createDataFrame([(XOR, "a b"), (AND, "b")], "gateway_type string, phrase string"), 0)
    assert "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" in plan(found)
    assert found.count() == 6


def test_mined_keys_tag_as_mined_phrases(spark):
    """Sequences by keys in their sentences' rows, at once and in parts, equal those by phrases and joins."""
    rng = random.Random(37)
    words = ["a", "b", "c", "d", "ß", "x"]
    docs = [(d, [[rng.choice(words) for _ in range(rng.choice((0, 1, 2, 5, 12)))] for _ in range(rng.randrange(5))]) for d in range(40)] + [(3, [["a", "b", "c", "d"]] * 2), (50, None)]
    docs = spark.createDataFrame(docs, "doc_id long, sents array<array<string>>").repartition(3)  # document 3 is in two rows
    sents = docs.groupBy("doc_id").agg(F.flatten(F.collect_list("sents")).alias("s")).select("doc_id", F.posexplode("s").alias("sentence_idx", "low"))
    by_phrase = sents.withColumnRenamed("low", "tokens")
    kind = F.when(F.col("n") == 3, AND).otherwise(XOR).alias("gateway_type")
    for least, sizes in ((2, (2, 3, 4)), (5, (1, 3)), (1000, (2, 3))):
        keys, phrases = lexicons.mine_keys(docs, sizes, least), lexicons.mine_n_grams(by_phrase, sizes, least)
        count = lambda df: sorted(tuple(r) for r in df.groupBy("n", "n_docs").count().collect())
        assert count(keys) == count(phrases)
        want = sorted(map(tuple, tagging.tag_lexicon(by_phrase, phrases.select(kind, "phrase")).collect()))
        assert len(want) > 50 or least == 1000
        for most in (1 << 20, 40):
            got = tagging.tag_keys(sents, keys.select(kind, "n", "a", "b"), most)
            assert sorted(map(tuple, got.collect())) == want
    one = tagging.tag_keys(docs.select("doc_id", F.posexplode("sents").alias("sentence_idx", "low")), keys.select(kind, "n", "a", "b"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and "Join" not in plan


def test_keys_that_share_their_first_64_bits():
    import numpy as np

    known = grams.KeySet(np.array([7, 7, 7, 9]), np.array([1, 3, 5, 2], np.uint32))
    asked = np.array([7, 7, 7, 8, 9], np.uint64), np.array([5, 4, 3, 1, 2], np.uint32)
    assert known.places(*asked, np.arange(5)).tolist() == [0, 2, 4]
