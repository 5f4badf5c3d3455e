"""Evaluation queries with oracles. Gold are the tags of a smaller lexicon."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.metrics import metric_row
from ..functions.shared import stored
from ..operators import evaluate as ops
from ..operators import tagging
from ..schemas import AND, XOR
from . import fixtures as fx
from .fixtures import TAG, monthly, sql
from .gateways import REL, relations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


TAGS = ("gold_tag", "ner_tag")


def elements(spark, d):
    """``doc_id, label, keyword, sentence_idx, token_idx`` of gateway tokens that open a span, of gold
    and of predictions: the corpus is tagged once, and what opens a span of either is kept."""
    opens = lambda tag: F.startswith(tag, F.lit("B-")) & F.endswith(tag, F.lit("Gateway"))
    rows = fx.tagged_tokens(spark, d)
    rows = stored(rows.filter(opens("gold_tag") | opens("ner_tag")).select("doc_id", "sentence_idx", "token_idx", F.lower("token").alias("keyword"), *TAGS), "elements")
    return tuple(rows.filter(opens(tag)).select("doc_id", F.substring(tag, 3, 50).alias("label"), "keyword", "sentence_idx", "token_idx") for tag in TAGS)


def same_gateways(gold):
    """Gold gateways whose next one in the document has their type and sentence."""
    w = Window.partitionBy("doc_id").orderBy("sentence_idx", "token_idx")
    after = lambda c: F.lead(c).over(w)
    return gold.withColumn("same", (F.col("label") == after("label")) & (F.col("sentence_idx") == after("sentence_idx"))).filter("same").select("doc_id", "label")


EL = (
    TAG
    + """,
ge AS MATERIALIZED (SELECT doc_id, substr(gold_tag, 3) AS label, low AS keyword FROM tag WHERE gold_tag LIKE 'B-%Gateway'),
pe AS MATERIALIZED (SELECT doc_id, substr(ner_tag, 3) AS label, low AS keyword FROM tag WHERE ner_tag LIKE 'B-%Gateway'),
grid AS (SELECT doc_id, label FROM documents, (VALUES ('XOR Gateway'), ('AND Gateway')) v(label)),
sge AS MATERIALIZED (SELECT doc_id, label FROM (SELECT doc_id, substr(gold_tag, 3) AS label, sentence_idx, lead(substr(gold_tag, 3)) OVER w AS l2, lead(sentence_idx) OVER w AS s2 FROM tag WHERE gold_tag LIKE 'B-%Gateway' WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_idx, token_idx)) WHERE label = l2 AND sentence_idx = s2),
cnt AS MATERIALIZED (SELECT doc_id, label, (SELECT count(*) FROM ge WHERE ge.doc_id = grid.doc_id AND ge.label = grid.label) - (SELECT count(*) FROM sge WHERE sge.doc_id = grid.doc_id AND sge.label = grid.label) AS g, (SELECT count(*) FROM pe WHERE pe.doc_id = grid.doc_id AND pe.label = grid.label) AS p FROM grid),
raw AS (SELECT doc_id, label, least(g, p) AS tp, greatest(p - g, 0) AS fp, greatest(g - p, 0) AS fn, g AS support FROM cnt),
m0 AS (SELECT *, tp / (tp + fp + 1e-10) AS pr, tp / (tp + fn + 1e-10) AS re FROM raw),
met AS MATERIALIZED (SELECT doc_id, label, tp, fp, fn, support, round(pr, 2) AS precision, round(re, 2) AS recall, round(2 * pr * re / (pr + re + 1e-10), 2) AS f1 FROM m0)"""
)


def doc_metrics(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id")
    gold, predicted = elements(spark, d)
    return ops.count_benchmark(gold, predicted, docs, [XOR, AND], same=same_gateways(gold))


@query("e5_count_benchmark", sql(EL, "SELECT doc_id, label, tp, fp, fn, support, precision, recall, f1 FROM met"))
def e5(spark, d):
    return doc_metrics(spark, d).select("doc_id", "label", "tp", "fp", "fn", "support", "precision", "recall", "f1")


@query("e1_e2_metric_rows", sql("r AS (SELECT doc_id, quality + 1 AS tp, toxic AS fp, doc_id % 3 AS fn FROM labels), m AS (SELECT *, tp / (tp + fp + 1e-10) AS p, tp / (tp + fn + 1e-10) AS q FROM r)", "SELECT doc_id, round(p, 2) AS precision, round(q, 2) AS recall, round(2 * p * q / (p + q + 1e-10), 2) AS f1, tp + fn AS support FROM m"))
def e1(spark, d):
    rows = fx.read(spark, d, "labels").select("doc_id", (F.col("quality") + 1).alias("tp"), F.col("toxic").alias("fp"), (F.col("doc_id") % 3).alias("fn"))
    return metric_row(rows).select("doc_id", "precision", "recall", "f1", "support")


@query("e3_weighted_average", sql(EL, "SELECT label, round(CASE WHEN sum(support) = 0 THEN 0 ELSE sum(precision * support) / sum(support) END, 2) AS precision, round(CASE WHEN sum(support) = 0 THEN 0 ELSE sum(recall * support) / sum(support) END, 2) AS recall, round(CASE WHEN sum(support) = 0 THEN 0 ELSE sum(f1 * support) / sum(support) END, 2) AS f1, CAST(sum(support) AS BIGINT) AS support FROM met GROUP BY 1"))
def e3(spark, d):
    return ops.average(doc_metrics(spark, d), ["label"], weighted=True)


@query("e3_plain_average", sql(EL, "SELECT label, round(avg(precision) FILTER (support > 0), 2) AS precision, round(avg(recall) FILTER (support > 0), 2) AS recall, round(avg(f1) FILTER (support > 0), 2) AS f1, CAST(sum(support) AS BIGINT) AS support FROM met GROUP BY 1"))
def e3_plain(spark, d):
    return ops.average(doc_metrics(spark, d), ["label"], weighted=False)


@query("e4_class_scores", sql(TAG, "SELECT c AS class, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM (SELECT c, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS p, CASE WHEN nr = 0 THEN 0 ELSE tp / nr END AS r FROM (SELECT c, count(*) FILTER (gold_tag = c AND ner_tag = c) AS tp, count(*) FILTER (ner_tag = c) AS np, count(*) FILTER (gold_tag = c) AS nr FROM tag, (VALUES ('B-XOR Gateway'), ('B-AND Gateway')) v(c) GROUP BY c))"))
def e4(spark, d):
    return ops.class_scores(fx.tagged_tokens(spark, d), ["B-XOR Gateway", "B-AND Gateway"], "gold_tag", "ner_tag").select("class", "precision", "recall", "f1")


@query("e6_keyword_confusion", sql(EL + ",\nk AS (SELECT doc_id, keyword, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM (SELECT doc_id, keyword, count(*) AS g FROM ge GROUP BY ALL) FULL JOIN (SELECT doc_id, keyword, count(*) AS p FROM pe GROUP BY ALL) USING (doc_id, keyword))", "SELECT keyword, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS fn, count(*) FILTER (least(g, p) > 0) AS tp_docs, count(*) FILTER (p > g) AS fp_docs, count(*) FILTER (g > p) AS fn_docs FROM k GROUP BY 1"))
def e6(spark, d):
    return ops.keyword_confusion(*elements(spark, d))


@query("e7_exact_matches", sql(EL, "SELECT doc_id, label, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS fn, CAST(sum(g) AS BIGINT) AS support FROM (SELECT doc_id, label, keyword, sum(x) AS g, sum(y) AS p FROM (SELECT *, 1 AS x, 0 AS y FROM ge UNION ALL SELECT *, 0, 1 FROM pe) GROUP BY ALL) GROUP BY 1, 2"))
def e7(spark, d):
    return ops.multiset_scores(*elements(spark, d), ["keyword"], ["doc_id", "label"])


@query("e7_relaxed_matches", sql(EL, "SELECT doc_id, label, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS fn FROM (SELECT doc_id, label, keyword, sum(x) AS g, sum(y) AS p FROM (SELECT *, 1 AS x, 0 AS y FROM (SELECT doc_id, substr(gold_tag, 3) AS label, low AS keyword FROM tag WHERE gold_tag LIKE 'B-%') UNION ALL SELECT *, 0, 1 FROM (SELECT doc_id, substr(ner_tag, 3), low FROM tag WHERE ner_tag LIKE 'B-%')) GROUP BY ALL) GROUP BY 1, 2"))
def e7_relaxed(spark, d):
    head = lambda tag: F.startswith(tag, F.lit("B-"))
    heads = stored(fx.tagged_tokens(spark, d, lambda tag, gold: head(tag) | head(gold)), "heads")

    def pairs(tag):
        rows = heads.filter(head(tag))
        order = (F.col("sentence_idx") * 100_000 + F.col("token_idx")).cast("long")
        return rows.select("doc_id", F.substring(tag, 3, 50).alias("label"), order.alias("ord"), F.array("token").alias("source"), F.array(F.lower("token")).alias("target"))

    return ops.relaxed_matches(pairs("gold_tag"), pairs("ner_tag"))


@query("e9_micro", sql(EL + ",\nt AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM raw GROUP BY ROLLUP (label)), u AS (SELECT *, tp / (tp + fp + 1e-10) AS p, tp / (tp + fn + 1e-10) AS r FROM t)", "SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-10), 6) AS f1 FROM u"))
def e9(spark, d):
    return ops.micro(doc_metrics(spark, d).select("label", "tp", "fp", "fn")).drop("support")


@query("e10_macro", sql(EL, "SELECT label, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM met GROUP BY 1"))
def e10(spark, d):
    by, _ = ops.macro(doc_metrics(spark, d))
    return by.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("e10_macro_overall", sql(EL, "SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM (SELECT avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM met GROUP BY label)"))
def e10_overall(spark, d):
    _, all_ = ops.macro(doc_metrics(spark, d))
    return all_.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("e11_weighted", sql(EL, "SELECT label, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM met GROUP BY ROLLUP (label)"))
def e11(spark, d):
    return ops.weighted(doc_metrics(spark, d)).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("e12_supports", sql(EL, "SELECT label, CAST(sum(support) AS BIGINT) AS support FROM met GROUP BY ROLLUP (label)"))
def e12(spark, d):
    return ops.supports(doc_metrics(spark, d))


@query("e13_empty_grid", sql(EL, "SELECT doc_id, label FROM grid"))
def e13(spark, d):
    return ops.empty_grid(fx.read(spark, d, "documents").select("doc_id"), [XOR, AND])


@query("e14_gold_by_type", sql(EL, "SELECT doc_id, label AS entity_type, string_agg(keyword, ',' ORDER BY keyword) AS items FROM ge GROUP BY 1, 2"))
def e14(spark, d):
    rows = elements(spark, d)[0].select("doc_id", F.col("label").alias("entity_type"), F.array("keyword").alias("tokens"))
    return ops.gold_by_type(rows).select("doc_id", "entity_type", F.array_join("items", ",").alias("items"))


GUESS = "CASE WHEN (a1 + a2) % 4 = 0 THEN 'exclusive' ELSE relation_type END"


@query("e15_scores_by_distance", sql(monthly(REL) + f""",
r AS (SELECT relation_type AS label, {GUESS} AS predicted, a2 - a1 AS dist FROM rel),
x AS (SELECT n, l, count(*) FILTER (label = l AND predicted = l) AS tp, count(*) FILTER (label <> l AND predicted = l) AS fp, count(*) FILTER (label = l AND predicted <> l) AS fn
  FROM r, (VALUES (1), (2), (5), (10), (30)) v(n), (SELECT DISTINCT label AS l FROM r) WHERE dist <= n GROUP BY 1, 2),
y AS (SELECT *, tp / (tp + fp + 1e-10) AS p, tp / (tp + fn + 1e-10) AS q FROM x WHERE tp + fp + fn > 0)""", "SELECT n, l AS label, tp, fp, fn, round(p, 2) AS precision, round(q, 2) AS recall, round(2 * p * q / (p + q + 1e-10), 2) AS f1 FROM y"))  # fmt: skip
def e15(spark, d):
    rows = relations(spark, d, True).select(F.col("relation_type").alias("label"), F.expr(GUESS).alias("predicted"), (F.col("a2") - F.col("a1")).alias("distance"))
    return ops.by_distance(rows, [1, 2, 5, 10, 30]).drop("support")


@query("a6_f1_by_distance", sql(monthly(REL) + f""",
r AS (SELECT relation_type AS label, {GUESS} AS predicted, a2 - a1 AS dist FROM rel),
x AS (SELECT n, l, count(*) FILTER (label = l AND predicted = l) AS tp, count(*) FILTER (label <> l AND predicted = l) AS fp, count(*) FILTER (label = l AND predicted <> l) AS fn
  FROM r, (VALUES (1), (5), (30)) v(n), (SELECT DISTINCT label AS l FROM r) WHERE dist <= n GROUP BY 1, 2),
y AS (SELECT l, n, round(2 * p * q / (p + q + 1e-10), 2) AS f1 FROM (SELECT *, tp / (tp + fp + 1e-10) AS p, tp / (tp + fn + 1e-10) AS q FROM x WHERE tp + fp + fn > 0))""", "SELECT l AS label, max(f1) FILTER (n = 1) AS n1, max(f1) FILTER (n = 5) AS n5, max(f1) FILTER (n = 30) AS n30 FROM y GROUP BY 1"))  # fmt: skip
def a6(spark, d):
    rows = relations(spark, d, True).select(F.col("relation_type").alias("label"), F.expr(GUESS).alias("predicted"), (F.col("a2") - F.col("a1")).alias("distance"))
    wide = ops.by_distance(rows, [1, 5, 30]).groupBy("label").pivot("n", [1, 5, 30]).agg(F.max("f1"))
    return wide.select("label", *(F.col(f"{n}").alias(f"n{n}") for n in (1, 5, 30)))


@query("a12_filter_quality", sql(TAG, "SELECT low AS keyword, count(*) FILTER (k AND c) AS kept_right, count(*) FILTER (k AND NOT c) AS kept_wrong, count(*) FILTER (NOT k AND NOT c) AS dropped_right, count(*) FILTER (NOT k AND c) AS dropped_wrong FROM (SELECT low, NOT (ner_tag LIKE '%XOR Gateway' AND (doc_id * 31 + sentence_idx * 17 + token_idx) % 3 + 1 <> 2) AS k, gold_tag = ner_tag AS c FROM tag WHERE ner_tag LIKE '%Gateway') GROUP BY 1"))
def a12(spark, d):
    gateway = lambda tag, _: F.contains(tag, F.lit("Gateway"))
    toks = tagging.keep_tags(stored(fx.tagged_tokens(spark, d, gateway), "gateway-tokens"), "Gateway")
    predicted = toks.select("doc_id", "sentence_idx", "token_idx", F.expr("(doc_id * 31 + sentence_idx * 17 + token_idx) % 3 + 1").alias("predicted"))
    rows = tagging.filter_predicted(toks, predicted, 2, log_only=True)
    kept, right = F.col("action") == "kept", F.col("gold_tag") == F.col("ner_tag")
    n = [F.count_if(a & b).alias(name) for name, a, b in (("kept_right", kept, right), ("kept_wrong", kept, ~right), ("dropped_right", ~kept, ~right), ("dropped_wrong", ~kept, right))]
    return rows.groupBy(F.lower("token").alias("keyword")).agg(*n)


@query("a13_first_tokens", sql(TAG, "SELECT first, avg(CASE WHEN gold_tag = ner_tag THEN 1.0 ELSE 0.0 END) AS right_rate, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_idx ORDER BY token_idx) = 1 AS first FROM tag WHERE ner_tag LIKE '%Gateway') GROUP BY 1"))
def a13(spark, d):
    toks = tagging.keep_tags(fx.tagged_tokens(spark, d), "Gateway")
    first = F.row_number().over(Window.partitionBy("doc_id", "sentence_idx").orderBy("token_idx")) == 1
    return toks.withColumn("first", first).groupBy("first").agg(F.avg(F.when(F.col("gold_tag") == F.col("ner_tag"), 1.0).otherwise(0.0)).alias("right_rate"), F.count(F.lit(1)).alias("n"))


@query("a18_gold_phrases", sql(EL, "SELECT label, keyword, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ge GROUP BY 1, 2"))
def a18(spark, d):
    return elements(spark, d)[0].groupBy("label", "keyword").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("a19_missed_documents", sql(EL, "SELECT * FROM (SELECT doc_id, label, round(least(g, p) / (p + 1e-10), 2) AS recall, p AS support FROM (SELECT doc_id, label, (SELECT count(*) FROM ge WHERE ge.doc_id = grid.doc_id AND ge.label = grid.label) AS g, (SELECT count(*) FROM pe WHERE pe.doc_id = grid.doc_id AND pe.label = grid.label) AS p FROM grid)) WHERE recall <> 1 AND support <> 0"))
def a19(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id")
    fewer, more = elements(spark, d)  # the larger lexicon is gold here, so that some is missed
    swapped = ops.count_benchmark(more, fewer, docs, [XOR, AND])
    return swapped.filter("recall <> 1 AND support <> 0").select("doc_id", "label", "recall", "support")


@query("e8_element_scores", sql(EL, "SELECT doc_id, label, tp, fp, fn FROM raw"))
def e8(spark, d):
    docs = stored(fx.read(spark, d, "documents").select("doc_id"), "docs")
    gold, predicted = elements(spark, d)
    return ops.count_benchmark(gold, predicted, docs, [XOR, AND], same=same_gateways(gold)).select("doc_id", "label", "tp", "fp", "fn")


