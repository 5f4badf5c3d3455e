"""Training-table queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import stored
from ..functions.text import joined
from ..operators import trainset as ops
from ..schemas import AND, XOR
from . import fixtures as fx
from .fixtures import ENT, SENT, TAG, monthly, sql
from .gateways import REL, relations
from .tagging import gateways

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def samples(spark, d):
    """``sample_id, tokens, ner_tags``: sentences of documents, with unique ids."""
    rows = fx.tagged(spark, d)
    return stored(rows.select((F.col("doc_id") * 100_000 + F.col("sentence_idx")).alias("sample_id"), "tokens", "ner_tags"), "samples")


SAM = (
    TAG
    + """,
sam AS MATERIALIZED (SELECT doc_id * 100000 + sentence_idx AS sample_id, bool_or(ner_tag LIKE '%Gateway') AS g FROM tag GROUP BY doc_id, sentence_idx),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(concat(sample_id, ':42'))) - 1 AS r FROM sam),
n AS (SELECT count(*) FILTER (g) AS ng, count(*) FILTER (NOT g) AS no FROM sam)"""
)


@query("t1_gateway_samples", sql(SAM, "SELECT sample_id FROM sam WHERE g"))
def t1(spark, d):
    return ops.gateway_samples(samples(spark, d)).select("sample_id")


@query("t2_up_sampling", sql(SAM, "SELECT sample_id FROM sam WHERE NOT g UNION ALL SELECT sample_id FROM (SELECT sample_id, unnest(range(CAST(greatest(1, ceil((no - r) / ng)) AS INT))) FROM rk, n WHERE g AND r < no)"))
def t2(spark, d):
    return ops.sample(samples(spark, d), "up")


@query("t3_down_sampling", sql(SAM, "SELECT sample_id FROM rk, n WHERE g OR r < ng"))
def t3(spark, d):
    return ops.sample(samples(spark, d), "down")


@query("t4_normal_sampling", sql(SAM, "SELECT sample_id FROM sam"))
def t4(spark, d):
    return ops.sample(samples(spark, d), "normal")


CLASS = "CASE WHEN ner_tag = 'O' THEN 1 WHEN ner_tag LIKE '%XOR Gateway' THEN 2 WHEN ner_tag LIKE '%AND Gateway' THEN 3 ELSE {} END"


@query("t5_encoded_tokens", sql(TAG, f"SELECT {CLASS.format(4)} AS label, {CLASS.format(1)} AS filtered, count(*) AS n, round(sum(CASE WHEN ner_tag LIKE '%Gateway' THEN 1.0 ELSE 0.1 END), 3) AS weight FROM tag GROUP BY 1, 2"))
def t5(spark, d):
    rows = ops.encode_tokens(fx.tagged_tokens(spark, d).withColumn("k", F.lit(0)))
    rows = ops.encode_tokens(rows.withColumnRenamed("label", "l").drop("weight"), "filtered").withColumnRenamed("label", "filtered")
    return rows.groupBy(F.col("l").alias("label"), "filtered").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight"))


@query("a14_label_counts", sql(TAG, f"SELECT {CLASS.format(4)} AS label, count(*) AS n FROM tag GROUP BY 1"))
def a14(spark, d):
    return ops.encode_tokens(fx.tagged_tokens(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


RANKS = TAG + ",\nrk AS MATERIALIZED (SELECT low, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, low) - 1 AS r FROM tag WHERE ner_tag = 'B-Activity' GROUP BY 1)"


@query("t6_multi_mask", sql(RANKS, "SELECT m.doc_id, m.sentence_idx, m.token_idx, coalesce(rk.low, token) AS token FROM (SELECT *, CASE WHEN ner_tag LIKE '%Activity' THEN sum((ner_tag LIKE '%Activity')::INT) OVER (PARTITION BY doc_id, sentence_idx ORDER BY token_idx) - 1 END AS place FROM tag) m LEFT JOIN rk ON r = place WHERE ner_tag LIKE '%Activity'"))
def t6(spark, d):
    rows = ops.mask_activities(stored(fx.tagged_tokens(spark, d), "tokens"), "multi_mask")
    return rows.filter(F.endswith("ner_tag", F.lit("Activity"))).select("doc_id", "sentence_idx", "token_idx", "token")


@query("t6_dummy_mask", sql(TAG, "SELECT CASE WHEN ner_tag LIKE '%Activity' THEN 'activity' ELSE low END AS token, count(*) AS n FROM tag GROUP BY 1"))
def t6_dummy(spark, d):
    return ops.mask_activities(fx.tagged_tokens(spark, d), "dummy").groupBy(F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("t7_activity_ranks", sql(RANKS, "SELECT low AS token, n, r AS rank FROM rk"))
def t7(spark, d):
    return ops.activity_ranks(fx.tagged_tokens(spark, d))


SYN = [(XOR, "or", "otherwise"), (XOR, "or", "else"), (XOR, "when", "whenever"), (AND, "and", "plus"), (AND, "with", "alongside")]


def copies(spark, d, of=None):
    """The synonym copies of the samples ``of``, by default of all documents'."""
    return ops.synonym_samples(samples(spark, d) if of is None else of, spark.createDataFrame(SYN, "gateway_type string, keyword string, synonym string"))


@query("t8_synonym_samples", sql(TAG + ",\nsyn(k, w, x) AS (VALUES ('XOR Gateway','or','otherwise'), ('XOR Gateway','or','else'), ('XOR Gateway','when','whenever'), ('AND Gateway','and','plus'), ('AND Gateway','with','alongside')),\nhit AS (SELECT DISTINCT doc_id, sentence_idx, k, w, x FROM tag JOIN syn ON low = w AND ner_tag LIKE '%' || k)", "SELECT h.doc_id * 100000 + h.sentence_idx AS original_id, 500 + row_number() OVER (ORDER BY k = 'AND Gateway', h.doc_id * 100000 + h.sentence_idx, w, x) - 1 AS sample_id, md5(string_agg(CASE WHEN t.low = w AND t.ner_tag LIKE '%' || k THEN x ELSE t.token END, ' ' ORDER BY token_idx)) AS words FROM hit h JOIN tag t USING (doc_id, sentence_idx) GROUP BY h.doc_id, h.sentence_idx, k, w, x"))
def t8(spark, d):
    return copies(spark, d).select("original_id", "sample_id", F.md5(joined("tokens")).alias("words"))


SYN_SQL = TAG + ",\nsyn(k, w, x) AS (VALUES ('XOR Gateway','or','otherwise'), ('XOR Gateway','or','else'), ('XOR Gateway','when','whenever'), ('AND Gateway','and','plus'), ('AND Gateway','with','alongside')),\nhit AS (SELECT DISTINCT doc_id, sentence_idx, k, w, x FROM tag JOIN syn ON low = w AND ner_tag LIKE '%' || k),\nlong AS (SELECT doc_id, sentence_idx, count(*) AS n FROM tag GROUP BY 1, 2),\ncopy AS (SELECT doc_id * 100000 + sentence_idx AS original_id, 500 + row_number() OVER (ORDER BY k = 'AND Gateway', doc_id * 100000 + sentence_idx, w, x) - 1 AS sample_id, n FROM hit JOIN long USING (doc_id, sentence_idx))"


@query("t9_training_with_copies", sql(SYN_SQL, "SELECT doc_id * 100000 + sentence_idx AS sample_id, n FROM long WHERE (doc_id * 100000 + sentence_idx) % 5 <> 0 UNION ALL SELECT sample_id, n FROM copy WHERE original_id % 5 <> 0"))
def t9(spark, d):
    every = samples(spark, d)
    return ops.with_copies(every.filter("sample_id % 5 <> 0"), copies(spark, d, every)).select("sample_id", F.size("tokens").alias("n"))


@query("t10_folds", "SELECT fold, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, ntile(7) OVER (ORDER BY md5(concat(doc_id, ':42'))) - 1 AS fold FROM documents) GROUP BY 1")
def t10(spark, d):
    rows = ops.folds(fx.read(spark, d, "documents").select("doc_id"), "doc_id", 7)
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def places(spark, d):
    return ops.tagged_places(fx.tagged_documents(spark, d), f"B-{XOR}")


DT = TAG + ",\ndt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx, token_idx) - 1 AS di, lead(ner_tag) OVER (PARTITION BY doc_id ORDER BY sentence_idx, token_idx) LIKE 'I-%' AS more FROM tag)"


@query("t11_n_grams", sql(DT, "SELECT a.doc_id, a.di AS i, string_agg(b.token, ' ' ORDER BY b.di) AS gram FROM dt a JOIN dt b ON b.doc_id = a.doc_id AND b.di BETWEEN a.di - 3 AND a.di + 3 + CASE WHEN a.more THEN 1 ELSE 0 END WHERE a.ner_tag = 'B-XOR Gateway' GROUP BY 1, 2"))
def t11(spark, d):
    return ops.n_grams(places(spark, d), 3).select("doc_id", F.col("i").cast("long").alias("i"), "gram")


PAIRS = "(SELECT doc_id, pos, s, ns FROM (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS ns FROM gw WHERE kind = 'XOR Gateway') WHERE ns - s <= 1)"


@query("t12_contexts", sql(ENT, f"SELECT p.doc_id, p.pos AS pair_id, md5(string_agg(array_to_string(tokens, ' '), ' ' ORDER BY sentence_idx)) AS context FROM {PAIRS} p JOIN sentences x ON x.doc_id = p.doc_id AND sentence_idx BETWEEN s - 1 AND ns + 1 GROUP BY 1, 2"))
def t12(spark, d):
    from ..operators.neighbors import adjacent

    near = adjacent(gateways(spark, d).filter(F.col("kind") == XOR))
    pairs = near.select("doc_id", (F.col("s") * F.lit(1_000_000).cast("long") + F.col("t")).alias("pair_id"), F.col("s").alias("s1"), F.col("n_s").alias("s2"))
    return ops.contexts(pairs, fx.corpus(spark, d), 1).select("doc_id", "pair_id", F.md5("context").alias("context"))


@query("t13_padded_labels", sql(TAG, "SELECT doc_id, sentence_idx, CAST(sum(CASE WHEN token_idx < 20 THEN CASE WHEN ner_tag LIKE '%Activity' THEN 2 ELSE 1 END * (token_idx + 1) ELSE 0 END) AS BIGINT) AS checksum FROM tag GROUP BY 1, 2"))
def t13(spark, d):
    rows = fx.tagged(spark, d).select("doc_id", "sentence_idx", ops.padded(ops.context_labels(F.col("ner_tags")), 20).alias("l"))
    return rows.select("doc_id", "sentence_idx", F.aggregate(F.transform("l", lambda v, i: (v * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("checksum"))


@query("t15_relation_rows", sql(monthly(REL), "SELECT relation_type, list_position(['directly_following', 'eventually_following', 'exclusive', 'concurrent'], relation_type) - 1 AS label, count(*) AS n FROM rel GROUP BY 1, 2"))
def t15(spark, d):
    return ops.relation_rows(relations(spark, d, True)).groupBy("relation_type", "label").agg(F.count(F.lit(1)).alias("n"))


@query("t16_document_split", sql(REL, "SELECT doc_id % 6 = 0 AS test, count(*) AS n FROM rel GROUP BY 1"))
def t16(spark, d):
    rel = relations(spark, d)
    train, test = ops.split_by_docs(rel, rel.filter("doc_id % 6 = 0").select("doc_id").distinct())
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True))).groupBy("test").agg(F.count(F.lit(1)).alias("n"))


@query("t16_share_split", "SELECT r < CAST(floor(n * 0.1) AS BIGINT) AS test, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, ':42'))) - 1 AS r, count(*) OVER () AS n FROM documents) GROUP BY 1")
def t16_share(spark, d):
    train, test = ops.split_by_share(fx.read(spark, d, "documents").select("doc_id"), "doc_id", 0.1)
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True))).groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("t16_head_tail", "SELECT r > round(n * 0.9) AS test, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) GROUP BY 1")
def t16_head_tail(spark, d):
    train, test = ops.split_head_tail(fx.read(spark, d, "documents").select("doc_id"), "doc_id", 0.1)
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True))).groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("t17_capped_relations", sql(REL, "SELECT relation_type, count(*) AS n, CAST(sum(a1) AS BIGINT) AS a FROM (SELECT *, row_number() OVER (PARTITION BY relation_type ORDER BY md5(concat(doc_id, '-', a1, '-', a2, ':42'))) AS r FROM rel) WHERE relation_type <> 'eventually_following' OR r <= 500 GROUP BY 1"))
def t17(spark, d):
    rel = relations(spark, d).withColumn("id", F.concat_ws("-", "doc_id", "a1", "a2"))
    return ops.cap_eventually(rel, "id").groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.sum("a1").alias("a"))


@query("t18_over_long", sql(SENT, "SELECT lang AS label, count(*) AS n FROM (SELECT doc_id, sum(len(tokens)) AS n FROM sentences GROUP BY 1) JOIN documents USING (doc_id) WHERE n >= 512 GROUP BY 1"))
def t18(spark, d):
    words = fx.corpus(spark, d).groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("w"))
    texts = words.join(fx.read(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("label"), F.repeat(F.lit("w "), (F.col("w") - 1).cast("int")).alias("text"))
    return ops.over_long(texts)


@query("j9_pair_labels", sql(ENT, "SELECT doc_id, s, t, CASE WHEN (s + t + ns + nt) % 3 = 0 THEN 1 ELSE 0 END AS label FROM (SELECT *, lead(s) OVER w AS ns, lead(t) OVER w AS nt FROM gw WHERE kind = 'XOR Gateway' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE ns IS NOT NULL"))
def j9(spark, d):
    from ..operators.neighbors import adjacent

    gates = stored(gateways(spark, d).filter(F.col("kind") == XOR), "gateways")
    gold = adjacent(gates, None).filter("(s + t + n_s + n_t) % 3 = 0")
    return ops.pair_labels(gates, gold).select("doc_id", "s", "t", "label")


VARIANTS = (
    ENT
    + """,
syn(k, w, x) AS (VALUES ('XOR Gateway','or','otherwise'), ('XOR Gateway','or','else'), ('XOR Gateway','when','whenever'), ('AND Gateway','and','plus'), ('AND Gateway','with','alongside')),
hit AS (SELECT DISTINCT doc_id, sentence_idx, k, w, x FROM tag JOIN syn ON low = w AND ner_tag LIKE '%' || k),
body AS MATERIALIZED (SELECT doc_id, sentence_idx, array_to_string(tokens, ' ') AS b FROM sentences),
opt AS MATERIALIZED (SELECT doc_id, sentence_idx, '' AS v, b FROM body UNION ALL
  SELECT h.doc_id, h.sentence_idx, k || w || x, string_agg(CASE WHEN low = w AND ner_tag LIKE '%' || k THEN x ELSE token END, ' ' ORDER BY token_idx) FROM hit h JOIN tag t USING (doc_id, sentence_idx) GROUP BY h.doc_id, h.sentence_idx, k, w, x),
pr AS (SELECT * FROM (SELECT doc_id, pos, s, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS ns FROM gw WHERE kind = 'XOR Gateway') WHERE ns - s <= 1),
variant AS MATERIALIZED (SELECT p.*, a.v AS v1, b.v AS v2, a.b AS b1, b.b AS b2 FROM pr p JOIN opt a ON a.doc_id = p.doc_id AND a.sentence_idx = s JOIN opt b ON b.doc_id = p.doc_id AND b.sentence_idx = ns WHERE s <> ns OR a.v = '')"""
)


@query("j12_synonym_contexts", sql(VARIANTS, "SELECT p.doc_id, pos AS pair_id, md5(string_agg(CASE WHEN x.sentence_idx = ns THEN b2 WHEN x.sentence_idx = s THEN b1 ELSE b END, ' ' ORDER BY x.sentence_idx)) AS context FROM variant p JOIN body x ON x.doc_id = p.doc_id AND x.sentence_idx BETWEEN s - 1 AND ns + 1 GROUP BY p.doc_id, pos, v1, v2"))
def j12(spark, d):
    from ..operators.neighbors import adjacent

    near = adjacent(gateways(spark, d).filter(F.col("kind") == XOR))
    sample = lambda s: F.col("doc_id") * 100_000 + F.col(s)
    pairs = near.select("doc_id", (F.col("s") * F.lit(1_000_000).cast("long") + F.col("t")).alias("pair_id"), F.col("s").alias("s1"), F.col("n_s").alias("s2"), sample("s").alias("sample1"), sample("n_s").alias("sample2"))
    made = stored(copies(spark, d).select("original_id", "sample_id", "tokens"), "copies")
    variants = ops.synonym_variants(pairs, made)
    return ops.variant_contexts(variants, fx.corpus(spark, d), made, 1).select("doc_id", "pair_id", F.md5("context").alias("context"))


FEATURES = (
    DT
    + """,
xg AS MATERIALIZED (SELECT doc_id, di, sentence_idx AS s, lead(di) OVER w AS ndi, lead(sentence_idx) OVER w AS ns FROM dt WHERE ner_tag = 'B-XOR Gateway' WINDOW w AS (PARTITION BY doc_id ORDER BY di)),
gram AS MATERIALIZED (SELECT a.doc_id, a.di, string_agg(b.token, ' ' ORDER BY b.di) AS gram FROM dt a JOIN dt b ON b.doc_id = a.doc_id AND b.di BETWEEN a.di - 3 AND a.di + 3 + CASE WHEN a.more THEN 1 ELSE 0 END WHERE a.ner_tag = 'B-XOR Gateway' GROUP BY 1, 2),
pr AS MATERIALIZED (SELECT * FROM xg WHERE ns - s <= 1),
ctx AS MATERIALIZED (SELECT p.doc_id, p.di, string_agg(x.token, ' ' ORDER BY x.di) AS context, array_to_string(list_resize(list(CASE WHEN x.ner_tag LIKE '%Activity' THEN 2 ELSE 1 END ORDER BY x.di), 350, 0), ',') AS labels FROM pr p JOIN dt x ON x.doc_id = p.doc_id AND x.sentence_idx BETWEEN s - 1 AND ns + 1 GROUP BY 1, 2),
f AS MATERIALIZED (SELECT p.doc_id, p.di AS pair_id, a.gram AS g1, b.gram AS g2, context, labels, p.di AS i1, p.ndi AS i2 FROM pr p JOIN gram a ON a.doc_id = p.doc_id AND a.di = p.di JOIN gram b ON b.doc_id = p.doc_id AND b.di = p.ndi JOIN ctx c ON c.doc_id = p.doc_id AND c.di = p.di)"""
)
MODES = {
    "n_gram": "g1, g2",
    "context_n_gram": "context, g1, g2",
    "context_index": "context, i1, i2",
    "context_labels_n_gram": "labels, g1, g2",
    "context_text_and_labels_n_gram": "context, labels, g1, g2",
}


@query("t14_feature_modes", sql(FEATURES, " UNION ALL ".join(f"SELECT doc_id, pair_id, '{m}' AS mode, md5(concat_ws('|', {c})) AS features FROM f" for m, c in MODES.items())))
def t14(spark, d):
    rows = ops.features_by_mode(ops.pair_rows(places(spark, d), 3, 1), list(MODES))
    return rows.select("doc_id", F.col("pair_id").cast("long").alias("pair_id"), "mode", F.md5("features").alias("features"))
