"""Readers and sinks with oracles: each query writes files from the tables and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import shared_dir, stored
from ..functions.text import joined
from ..schemas import AND, XOR
from ..sources import corpus, lexicons
from . import fixtures as fx
from .fixtures import ENT, TAG, sql
from .tagging import document_entities

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def folder(spark, name):
    return f"{shared_dir(spark)}/flowloom/{name}-{uuid.uuid4().hex}"


def lines(df, path):
    df.select(df.columns[0]).write.text(path)
    return path


@query("s1_phrase_files", "SELECT 'parts' AS lex_set, 'XOR Gateway' AS gateway_type, p_name AS phrase, count(*) AS n FROM part GROUP BY p_name UNION ALL SELECT 'parts', 'AND Gateway', p_type, count(*) FROM part GROUP BY p_type")
def s1(spark, d):
    part, base = fx.read(spark, d, "part"), folder(spark, "phrases")
    blank = lambda c: F.explode(F.array(F.concat(F.lit(" "), c), F.lit("")))
    xor = lexicons.read_phrases(spark, lines(part.select(blank("p_name")), f"{base}/xor"), "parts", XOR)
    and_ = lexicons.read_phrases(spark, lines(part.select(blank("p_type")), f"{base}/and"), "parts", AND)
    return xor.unionAll(and_).groupBy("lex_set", "gateway_type", "phrase").agg(F.count(F.lit(1)).alias("n"))


@query("s2_kept_phrases", "SELECT 'custom' AS lex_set, 'XOR Gateway' AS gateway_type, p_name AS phrase, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY p_name")
def s2(spark, d):
    keep = F.when(F.col("p_size") % 3 == 0, "keep").otherwise("")
    path = lines(fx.read(spark, d, "part").select(F.concat_ws(";", "p_name", "p_brand", keep)), folder(spark, "custom"))
    return lexicons.read_kept_phrases(spark, path, "custom", XOR).groupBy("lex_set", "gateway_type", "phrase").agg(F.count(F.lit(1)).alias("n"))


@query("s5_phrase_pairs", "SELECT 'parts' AS lex_set, p_name AS p1, p_type AS p2, count(*) AS n FROM part GROUP BY p_name, p_type")
def s5(spark, d):
    path = lines(fx.read(spark, d, "part").select(F.concat_ws(";", "p_name", "p_type")), folder(spark, "pairs"))
    return lexicons.read_pairs(spark, path, "parts").groupBy("lex_set", joined("p1").alias("p1"), joined("p2").alias("p2")).agg(F.count(F.lit(1)).alias("n"))


def nations(spark, d):
    return fx.read(spark, d, "nation").join(F.broadcast(fx.read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))


@query("s7_synonyms", "SELECT 'XOR Gateway' AS gateway_type, r_name AS keyword, n_name AS synonym FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'AND Gateway', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def s7(spark, d):
    """The rule file is one record, so the small tables feed it."""
    n = nations(spark, d)
    table = lambda key, value, name: n.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct(key, "v"))).alias(name))
    both = table("r_name", "n_name", "xor").withColumn("k", F.lit(1)).join(table("n_name", "r_name", "and").withColumn("k", F.lit(1)), "k")
    return lexicons.read_synonyms(spark, lines(both.select(F.to_json(F.struct("xor", "and"))), folder(spark, "synonyms")))


@query("s8_loop_edges", "SELECT n_name AS doc_id, n_nationkey AS s, n_regionkey AS t, 'a ' || n_name AS words, 'XOR Gateway' AS kind FROM nation")
def s8(spark, d):
    entity = lambda c, kind: F.concat(F.lit("[0,"), F.col(c).cast("string"), F.lit(',["a","'), "n_name", F.lit(f'"],"{kind}"]'))
    flow = F.create_map(F.lit("source"), entity("n_nationkey", XOR), F.lit("target"), entity("n_regionkey", AND))
    whole = fx.read(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", flow))).alias("loop_flows"))
    loops = lexicons.read_loops(spark, lines(whole.select(F.to_json(F.struct("loop_flows"))), folder(spark, "loops")))
    return loops.select("doc_id", F.col("source.token_idx").alias("s"), F.col("target.token_idx").alias("t"), joined("source.tokens").alias("words"), F.col("source.entity_type").alias("kind"))


@query("s9_document_lists", "SELECT n_name AS doc_id FROM nation")
def s9(spark, d):
    names = fx.read(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("v"))
    whole = names.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_regionkey").cast("string"), "v"))).alias("lists"))
    return lexicons.read_names(spark, lines(whole.select(F.to_json("lists")), folder(spark, "lists")))


def predictions(spark, d):
    """Elements and relations of every document, written, with the folder."""
    span = F.transform("spans", lambda x: F.struct(x["entity"]["entity_type"].alias("entity_type"), joined(x["low"]).alias("phrase")))
    found = document_entities(spark, d).select("doc_id", span.alias("spans"))
    elements = stored(found.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("entities")), "spans")
    elements = elements.filter(F.size("entities") > 0)  # here, or the spans would be found once more for the test
    related = F.transform(F.filter("entities", lambda x: x["entity_type"] == XOR), lambda x: x["phrase"])
    related = elements.select("doc_id", F.sort_array(related).alias("relations")).filter(F.size("relations") > 0)
    path = folder(spark, "predictions")
    corpus.write_predictions(elements, related, path)
    return path


PRED = "doc_id LONG, entities ARRAY<STRUCT<entity_type: STRING, phrase: STRING>>, relations ARRAY<STRING>"


@query("s11_prediction_files", sql(ENT, "SELECT 'elements' AS task, doc_id, count(*) AS n FROM ent GROUP BY doc_id UNION ALL SELECT 'relations', doc_id, count(*) FROM ent WHERE kind = 'XOR Gateway' GROUP BY doc_id"))
def s11(spark, d):
    rows = corpus.read_predictions(spark, predictions(spark, d), PRED)
    return rows.select("task", "doc_id", F.coalesce(F.size("entities"), F.lit(0)).alias("e"), F.coalesce(F.size("relations"), F.lit(0)).alias("r")).select("task", "doc_id", F.greatest("e", "r").cast("long").alias("n"))


@query("s13_written_elements", sql(ENT, "SELECT doc_id, kind AS entity_type, phrase, count(*) AS n FROM ent GROUP BY ALL"))
def s13(spark, d):
    rows = spark.read.schema(PRED).json(f"{predictions(spark, d)}/elements")
    return rows.select("doc_id", F.explode("entities").alias("e")).groupBy("doc_id", "e.entity_type", "e.phrase").agg(F.count(F.lit(1)).alias("n"))


@query("s12_run_metrics", "SELECT CAST(doc_id % 4 AS VARCHAR) AS fold, CASE toxic WHEN 1 THEN 'ensemble' ELSE 'single' END AS model, doc_id, quality FROM labels")
def s12(spark, d):
    model = F.when(F.col("toxic") == 1, "ensemble").otherwise("single")
    path = folder(spark, "runs")
    fx.read(spark, d, "labels").select("doc_id", "quality", model.alias("model"), (F.col("doc_id") % 4).alias("fold")).write.partitionBy("model", "fold").json(path)
    rows = corpus.read_runs(spark, path, "doc_id LONG, quality INT")
    return rows.select(F.col("params")["fold"].alias("fold"), F.col("params")["model"].alias("model"), "doc_id", "quality")


@query("s14_written_gateways", sql(TAG, "SELECT doc_id, sentence_idx, token_idx, low AS keyword, substr(ner_tag, 3) AS kind FROM tag WHERE ner_tag LIKE 'B-%Gateway'"))
def s14(spark, d):
    tags = fx.tagged_tokens(spark, d).filter(F.startswith("ner_tag", F.lit("B-")) & F.endswith("ner_tag", F.lit("Gateway")))
    path = folder(spark, "gateways")
    corpus.write_gateways(tags.select("doc_id", "sentence_idx", "token_idx", F.lower("token").alias("keyword"), F.substring("ner_tag", 3, 50).alias("kind")), path)
    return spark.read.schema("doc_id LONG, sentence_idx INT, token_idx INT, keyword STRING, kind STRING").json(path)


@query("s15_metric_tables", "SELECT 'doc' AS level, CAST(doc_id AS VARCHAR) AS name, quality AS n FROM labels UNION ALL SELECT 'label', CAST(toxic AS VARCHAR), CAST(count(*) AS INTEGER) FROM labels GROUP BY toxic UNION ALL SELECT 'overall', 'all', CAST(count(*) AS INTEGER) FROM labels")
def s15(spark, d):
    rows, path = fx.read(spark, d, "labels"), folder(spark, "metrics")
    doc = rows.select(F.col("doc_id").cast("string").alias("name"), F.col("quality").alias("n"))
    label = rows.groupBy(F.col("toxic").cast("string").alias("name")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    corpus.write_metrics(doc, label, rows.agg(F.lit("all").alias("name"), F.count(F.lit(1)).cast("int").alias("n")), path, "csv")
    read = lambda level: spark.read.option("header", "true").schema("name STRING, n INT").csv(f"{path}/{level}").select(F.lit(level).alias("level"), "name", "n")
    return read("doc").unionAll(read("label")).unionAll(read("overall"))


@query("s17_run_params", "SELECT 'classes' AS name, CAST(count(DISTINCT quality) AS VARCHAR) AS value FROM labels UNION ALL SELECT 'labelled', CAST(count(*) AS VARCHAR) FROM labels")
def s17(spark, d):
    found = fx.read(spark, d, "labels").agg(F.count(F.lit(1)).alias("labelled"), F.countDistinct("quality").alias("classes")).first()
    path = folder(spark, "params")
    corpus.write_params(spark, found.asDict(), path)
    return spark.read.schema("name STRING, value STRING").json(path)
