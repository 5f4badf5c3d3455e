"""Cross-validation, ensembles and scorers against recomputation."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions.shared import stored
from flowloom.operators import scoring, training


@pytest.fixture(scope="module")
def rows(spark):
    """Words decide the class, but for noise: 0 for most, 1 for 'or' beside 'x', 2 for 'and'."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(1500):
        word = rng.choice(["or", "and", "a", "b", "c", "d"])
        near = [str(rng.choice(["x", "y", "z"])) for _ in range(int(rng.integers(0, 4)))]
        label = {"or": 1 if "x" in near else 0, "and": 2}.get(str(word), 0)
        data.append((i, i // 10, label if rng.random() < 0.95 else int(rng.integers(3)), 1.0, [f"0={word}", *(f"1={w}" for w in near)]))
    data.append((5000, 3, None, 1.0, ["0=or"]))
    df = spark.createDataFrame(data, "id long, doc long, label int, weight double, words array<string>").repartition(3)
    return stored(training.hashed(df).select("id", training.fold_of(F.col("doc"), 3).alias("fold"), "label", "weight", F.col("id").alias("key"), "features"), "rows")


@pytest.fixture(scope="module")
def trained(rows):
    return training.cross_validate(rows, 3, [1, 2], folds=3, seeds=(0, 1), epochs=30, patience=4)


def test_history_and_stops(trained):
    h = trained.history
    stops = {(r.fold, r.seed): r.epoch for r in scoring.stopping_epoch(h, "f1", patience=4).collect()}
    last = {(r.fold, r.seed): r.e for r in h.groupBy("fold", "seed").agg(F.max("epoch").alias("e")).collect()}
    assert stops == last and set(last) == {(f, s) for f in range(3) for s in range(2)}
    assert h.count() == 3 * sum(e + 1 for e in last.values())
    assert min(r.value for r in h.filter("metric = 'f1'").collect() if r.epoch == last[r.fold, r.seed]) > 0.75


def test_a_pass_equals_member_by_member_sums(rows):
    """Rows of any number of features; gradients and counts by plain loops over rows and members."""
    members, rng = [(0, 0), (1, 0), (2, 1)], np.random.default_rng(1)
    w = rng.normal(0, 0.1, (3, training.FEATURES, 3))
    known = rows.filter("label IS NOT NULL")
    gradient, counts = training._pass(known, members, w)
    want, seen = np.zeros_like(w), np.zeros((3, 3, 3))
    for r in known.collect():
        for i, (out, seed) in enumerate(members):
            e = np.exp(w[i][r.features].sum(axis=0))
            p = e / e.sum()
            if r.fold == out:
                seen[i, r.label, p.argmax()] += 1
            elif training._kept(np.array([r.key]), seed)[0]:
                np.add.at(want[i], r.features, r.weight * (p - np.eye(3)[r.label]))
    assert np.allclose(gradient, want) and (counts == seen).all()
    nothing, again = training._pass(known, members, w, learn=False)
    assert not nothing.any() and (again == seen).all()


def test_folds_equal_stored_predictions(trained, rows, tmp_path):
    predictions = training.held_out(trained, rows.filter("label IS NOT NULL"), ["id"])
    predictions.write.parquet(str(tmp_path / "predictions"))
    sql = f"""WITH m AS (SELECT fold, seed, count(*) FILTER (label = predicted AND label > 0) AS hit, count(*) FILTER (predicted > 0) AS said, count(*) FILTER (label > 0) AS there
      FROM '{tmp_path}/predictions/*.parquet' GROUP BY 1, 2), f AS (SELECT fold, avg(hit / said) AS p, avg(hit / there) AS r FROM m GROUP BY 1)
      SELECT fold, p, r, 2 * p * r / (p + r) FROM f ORDER BY 1"""
    want = duckdb.sql(sql).fetchall()
    folds, averages = scoring.fold_metrics(trained.history)
    got = folds.orderBy("fold").collect()
    assert np.allclose([(r.fold, r.precision, r.recall, r.f1) for r in got], want)
    assert averages.first().avg_f1 == pytest.approx(np.mean([w[3] for w in want]), abs=1e-4)


def test_ensemble_is_the_mean_of_its_members(trained, rows):
    known = rows.filter("label IS NOT NULL")
    alone: dict = {}
    for r in training.held_out(trained, known, ["id"]).collect():
        alone.setdefault(r.id, []).append(r.scores)
    out = training.ensemble(trained, known, ["id"])
    for r in out.collect():
        mean = np.mean(alone[r.id], axis=0)
        assert len(alone[r.id]) == 2 and np.allclose(r.scores, mean) and r.predicted == mean.argmax()
    plan = out._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") <= 4 and "Join" not in plan  # one pass, in each of four plan sections


def test_scores_equal_the_coefficients(trained, rows):
    w = dict(zip(trained.members, trained.coefficients))
    features = {r.id: (r.fold, r.features) for r in rows.collect()}
    for r in training.held_out(trained, rows.filter("label IS NOT NULL"), ["id"]).limit(300).collect():
        fold, places = features[r.id]
        z = w[fold, r.seed][places].sum(axis=0)
        e = np.exp(z - z.max())
        assert np.allclose(r.scores, e / e.sum())


def test_gradient_and_counts(rows, trained):
    """One pass equals the sums in plain numpy."""
    members, w = trained.members[:2], trained.coefficients[:2]
    local = [r for r in rows.filter("label IS NOT NULL").collect()]
    gradient, counts = training._pass(rows.filter("label IS NOT NULL"), members, w)
    for m, (fold, seed) in enumerate(members):
        g, c = np.zeros_like(w[m]), np.zeros((3, 3))
        for r in local:
            z = w[m][r.features].sum(axis=0)
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if r.fold == fold:
                c[r.label, p.argmax()] += 1
            elif training._kept(np.array([r.key]), seed)[0]:
                p[r.label] -= 1
                np.add.at(g, r.features, p)
        assert np.allclose(gradient[m], g) and (counts[m] == c).all()


def test_no_rows(spark, rows):
    t = training.cross_validate(rows.limit(0), 3, [1, 2], folds=2, seeds=(0,), epochs=2)
    assert {r.value for r in t.history.collect()} == {0.0}
    assert training.ensemble(t, rows.limit(0), ["id"]).count() == 0


def test_pipeline_scorers_on_rows_held_back(spark):
    """Spark ML scorers (token, text): held-out accuracy, and probabilities from the coefficients."""
    rng = np.random.default_rng(9)
    words = ["or", "when", "and", "tea", "cup", "ink"]
    tokens = [(d, 0, i, str(rng.choice(words))) for d in range(120) for i in range(8)]
    rows = spark.createDataFrame([(*t, 2.0 if t[3] in ("or", "when") else 1.0, 1.0) for t in tokens], "doc_id int, sentence_idx int, token_idx int, token string, label double, weight double")
    train, test = rows.filter("doc_id < 90"), rows.filter("doc_id >= 90")
    model = scoring.fit_tokens(train, iterations=15)
    out = model.transform(scoring.token_features(test)).collect()
    assert np.mean([r.label == r.prediction for r in out]) > 0.98
    lr = model.stages[-1]
    for r in out[:50]:
        z = lr.coefficientMatrix.toArray() @ r.features.toArray() + lr.interceptVector.toArray()
        assert np.allclose(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), r.probability.toArray())
    texts = spark.createDataFrame([(i, f"{rng.choice(words)} {rng.choice(words)}") for i in range(400)], "id int, text string")
    texts = texts.withColumn("label", F.when(F.contains("text", F.lit("and")), 1.0).when(F.contains("text", F.lit("or")), 2.0).otherwise(0.0))
    fitted = scoring.fit_texts(texts.filter("id < 300"), iterations=15)
    scored = fitted.transform(scoring.text_words(texts.filter("id >= 300"))).collect()
    assert np.mean([r.label == r.prediction for r in scored]) > 0.95
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in scored)


def test_full_training_stores_the_model(spark, tmp_path):
    rows = spark.createDataFrame([(d, 0, i, w, float(w == "or"), 1.0) for d in range(40) for i, w in enumerate(["or", "tea"])], "doc_id int, sentence_idx int, token_idx int, token string, label double, weight double")
    again = scoring.full_training(rows, str(tmp_path / "model"), iterations=10)
    direct = scoring.fit_tokens(rows, iterations=10)
    p = lambda m: [tuple(r.probability) for r in m.transform(scoring.token_features(rows)).orderBy("doc_id", "token_idx").collect()]
    assert np.allclose(p(again), p(direct))


def test_runs_are_pruned_by_their_parameters(spark, tmp_path):
    from flowloom.operators import analysis

    rows = [(f, s, e, m, float(f + s + e)) for f in range(3) for s in range(4) for e in range(2) for m in ("precision", "recall", "loss")]
    spark.createDataFrame(rows, "fold int, seed int, epoch int, metric string, value double").write.partitionBy("fold", "seed").parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    top = analysis.ranked_runs(runs, ["fold", "seed"], ("precision", "recall"), most=2, where=F.col("seed") < 2)
    assert [(r.fold, r.seed, r.total, r.place) for r in top.orderBy("place").collect()] == [(2, 1, 7.0, 1), (1, 1, 5.0, 2)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seed" in plan and "PushedFilters" in plan


def test_cube_of_no_rows_and_nulls(spark):
    from flowloom.operators import analysis

    rows = [(1, 1, [0.9, 0.7], 0, True, False, "or or"), (1, 0, [0.6, 0.6], 2, True, True, "if or"), (0, None, None, 1, False, False, None), (0, 0, [], 1, None, False, "x")]
    df = spark.createDataFrame(rows, "label int, real_label int, predictions array<double>, distance int, start1 boolean, start2 boolean, pair string")
    got = {(r.grouping, r.label, r.real_label): r for r in analysis.classification_cube(df).filter("grouping IN ('label', 'all', 'label+real_label')").collect()}
    assert got["all", None, None].n == 4 and got["label", 1, None].n == 2 and got["label", 0, None].var_max is None
    assert abs(got["label+real_label", 1, 1].score_mean - 0.8) < 1e-12 and abs(got["label", 1, None].var_max - 0.01) < 1e-12
    assert (got["label", 1, None].distance_min, got["label", 1, None].distance_max) == (0, 2)
    assert analysis.classification_cube(df.limit(0)).filter("grouping <> 'all'").count() == 0


def odd_texts(spark, n=300):
    """Texts with blanks of all kinds, phrases that overlap, capitals beyond ASCII, copies and nulls."""
    import random

    rng = random.Random(41)
    words = ["a", "Or", "ΑΣ", "İs", "it", "is", "It", "only", "and", "the", "AND", "with", "日本", "x" * 40, "yy" * 17, " ", "\x0b", "-", "station"]
    ends = [" ", "\t", "\r", "  ", ". ", "!", "?", "\n", ".", ""]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(30))) for _ in range(n)] + [None, "", "... ", " it is it is is"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_blocks_hold_the_rows_of_their_texts(spark, tmp_path, monkeypatch):
    """Features, labels, weights and keys of tagged token rows, from texts in blocks; and the same training."""
    from flowloom.functions.shared import stored as kept
    from flowloom.operators import blocks, trainset
    from flowloom.plans import analysis
    from flowloom.plans import fixtures as fx

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    odd_texts(spark).write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    rows = training.hashed(trainset.encode_tokens(scoring.sentence_features(fx.tagged(spark, d)), "filtered"))
    own = F.xxhash64("doc_id", "sentence_idx", "token_idx").alias("key")
    rows = kept(rows.select("doc_id", "sentence_idx", "token_idx", training.fold_of(F.col("doc_id"), 5).alias("fold"), (F.col("label") - 1).alias("label"), "weight", own, "features"))
    packed = analysis.training_blocks(spark, d, blocks.xx_places(training.FEATURES))
    assert packed.count() > 5
    got = {}
    for block in blocks.opened(packed.toArrow().combine_chunks().to_batches()):
        folds = np.repeat(block.folds, block.tokens())
        for doc, s, t, fold, label, key, f in zip(*block.places(), folds, block.labels, block.keys(), block.features.T):
            got[block.docs[doc], s, t] = (fold, label, analysis.WEIGHTS[label], key, (0, *f))
    assert got == {(r.doc_id, r.sentence_idx, r.token_idx): (r.fold, r.label, r.weight, r.key, tuple(r.features)) for r in rows.collect()}
    members = [(f, s) for f in range(5) for s in (0, 1)]
    w = np.random.default_rng(3).normal(0, 0.1, (10, training.FEATURES, 3))
    (g1, c1), (g2, c2) = training._pass(rows, members, w), training._pass(packed, members, w, weights=analysis.WEIGHTS)
    assert np.allclose(g1, g2, atol=1e-5) and (c1 == c2).all() and c1.sum() == 2 * len(got)
    assert (training._pass(packed, members, w, False, analysis.WEIGHTS)[1] == c1).all()
    t1 = training.cross_validate(rows, 3, [1, 2], seeds=(0, 1), epochs=4)
    t2 = training.cross_validate(packed, 3, [1, 2], seeds=(0, 1), epochs=4, weights=analysis.WEIGHTS)
    assert np.allclose([r.value for r in t1.history.orderBy("fold", "seed", "epoch", "metric").collect()], [r.value for r in t2.history.orderBy("fold", "seed", "epoch", "metric").collect()])
    keys = ["doc_id", "sentence_idx", "token_idx"]
    one, other = (df.orderBy(*keys).collect() for df in (training.ensemble(t1, rows, keys), training.block_ensemble(t1, packed)))
    assert [(*r[:5], r.predicted) for r in one] == [(*r[:5], r.predicted) for r in other]
    assert np.allclose([r.scores for r in one], [r.scores for r in other], atol=1e-5)


def test_hashes_are_those_of_spark(spark):
    import pyarrow as pa
    from pyspark.ml.feature import HashingTF

    from flowloom.functions import words

    texts = ["", "a", "äöü", *("z" * n + "é" * (n % 3) for n in range(1, 75))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, w string").coalesce(1)
    rows = df.select(F.xxhash64(F.concat(F.lit("-1="), "w")).alias("h"), F.xxhash64(F.lit(5).cast("long"), F.col("i"), F.lit(-3)).alias("k")).collect()
    binary = pa.array([t.encode() for t in texts], pa.large_binary())
    assert [r.h for r in rows] == words.xxhash64_texts(binary, b"-1=").view(np.int64).tolist()
    n = np.arange(len(texts))
    with np.errstate(over="ignore"):
        key = words.xxhash64_int(np.full(len(n), -3), words.xxhash64_int(n, words.xxhash64_long(np.full(len(n), 5), np.uint64(42))))
    assert [r.k for r in rows] == key.view(np.int64).tolist()
    tf = HashingTF(numFeatures=1 << 14)
    assert [tf.indexOf(f"-1={t}") for t in texts] == (words.murmur3_texts(binary, b"-1=") % (1 << 14)).tolist()


def test_regression_over_blocks_is_spark_mls(spark, tmp_path, monkeypatch):
    """Coefficients, intercepts and predictions of Spark ML on the rows, with words that share places; stored and read again."""
    from flowloom.functions.shared import stored as kept
    from flowloom.operators import blocks, regression, trainset
    from flowloom.plans import analysis
    from flowloom.plans import fixtures as fx

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    odd_texts(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = kept(trainset.encode_tokens(scoring.sentence_features(fx.tagged(spark, str(tmp_path))), "filtered"))
    size = 32
    packed = analysis.training_blocks(spark, str(tmp_path), blocks.tf_places(size))
    for iterations in (0, 5, 30):
        pipeline = scoring.fit_tokens(rows, features=size, iterations=iterations)
        lr = pipeline.stages[-1]
        model = regression.fit(packed, analysis.WEIGHTS, size, first=1, iterations=iterations)
        assert np.allclose(model.coefficients, lr.coefficientMatrix.toArray(), atol=1e-6)
        assert np.allclose(model.intercepts, lr.interceptVector.toArray(), atol=1e-6)
    model.save(spark, str(tmp_path / "model"))
    again = regression.Regression.load(spark, str(tmp_path / "model"))
    assert (again.coefficients == model.coefficients).all() and (again.intercepts == model.intercepts).all()
    keys = ["doc_id", "sentence_idx", "token_idx", "label", "prediction"]
    want = sorted(tuple(r) for r in pipeline.transform(rows).select(*keys).collect())
    assert sorted(tuple(r) for r in regression.predicted(again, packed, first=1).collect()) == want and len({w[-1] for w in want}) == 3


def test_descent_goes_on_through_steep_and_flat_places():
    from flowloom.operators import regression

    def loss(x):
        """Rosenbrock's valley."""
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert np.allclose(regression.descend(loss, np.array([-1.2, 1.0]), 200, 1e-12), 1, atol=1e-3)
    assert regression.descend(lambda x: (0.0, 0 * x), np.ones(3), 5).tolist() == [1, 1, 1]


def test_regression_over_stretches_is_spark_mls(spark, tmp_path, monkeypatch):
    """Activity pairs and their texts: rows, labels, coefficients and predictions as from rows with texts of their own."""
    from collections import Counter

    from flowloom.functions.shared import stored as kept
    from flowloom.operators import blocks, regression, stretches
    from flowloom.plans import analysis

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(stretches, "FEATURES_AT_ONCE", 100)
    docs = odd_texts(spark, 400).unionAll(spark.createDataFrame([(900 + i, f"tested and created {w}ed with that ed Station it is zzed or ëed. asked NATION bed") for i, w in enumerate("abc")], "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = kept(analysis.relation_texts(spark, str(tmp_path)))
    size = 32
    packed = kept(stretches.stretch_blocks(docs, analysis.activity_pairs, size))
    assert packed.count() > 5 and rows.count() > 30
    for iterations in (0, 5, 20):
        pipeline = scoring.fit_texts(rows, features=size, iterations=iterations)
        lr = pipeline.stages[-1]
        model = regression.fit(packed, (1.0,) * 4, size, iterations=iterations, opened=stretches.opened)
        assert np.allclose(model.coefficients, lr.coefficientMatrix.toArray(), atol=1e-5)
        assert np.allclose(model.intercepts, lr.interceptVector.toArray(), atol=1e-5)
    want = Counter((r.doc_id, r.label, r.prediction) for r in pipeline.transform(scoring.text_words(rows)).collect())
    got = regression.predicted(model, packed, opened=stretches.opened, keys=stretches.KEYS).collect()
    assert Counter((r.doc_id, r.label, r.prediction) for r in got) == want and len({w[1] for w in want}) == 3
    pairs = {(r.doc_id, *r.pair_id) for r in analysis.related_activities(spark, str(tmp_path)).collect()}
    assert {tuple(r[:3]) for r in got} == pairs and len(got) == len(pairs)


def test_texts_without_rows(spark, tmp_path):
    from flowloom import plans

    odd_texts(spark, 0).filter("text IS NULL OR text = ''").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("m1_token_scores", "m3_relation_scores", "m7_full_training", "m4_trained_ensemble", "k1_mined_lexicon"):
        assert plans.QUERIES[name](spark, str(tmp_path)).isEmpty()
    assert {r.value for r in plans.QUERIES["m8_trained_history"](spark, str(tmp_path)).collect()} == {0.0}
