"""Readers of rule tables: phrase lexicons, phrase pairs, synonyms, loop edges, document lists.

These tables are written by hand and small; callers broadcast them or take their phrases as values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grams
from ..functions.shared import stored
from ..schemas import AND, ENTITY, XOR


def read_phrases(spark: SparkSession, path: str, lex_set: str, gateway_type: str) -> DataFrame:
    """``lex_set, gateway_type, phrase`` of a file with one phrase a line; blank lines go."""
    return spark.read.text(path).select(F.lit(lex_set).alias("lex_set"), F.lit(gateway_type).alias("gateway_type"), F.trim("value").alias("phrase")).filter("phrase <> ''")


def read_kept_phrases(spark: SparkSession, path: str, lex_set: str, gateway_type: str) -> DataFrame:
    """The same of a ``phrase;source;keep`` file, rows marked ``keep`` only."""
    rows = spark.read.csv(path, sep=";", schema="phrase STRING, source STRING, keep STRING")
    return rows.filter(F.trim("keep") == "keep").select(F.lit(lex_set).alias("lex_set"), F.lit(gateway_type).alias("gateway_type"), F.trim("phrase").alias("phrase"))


def keywords(lexicon: DataFrame, lex_set: str) -> tuple[list[str], list[str]]:
    """(XOR phrases, AND phrases) of one set, sorted."""
    rows = lexicon.filter(F.col("lex_set") == lex_set).select("gateway_type", "phrase").distinct().collect()
    return tuple(sorted(r.phrase for r in rows if r.gateway_type == kind) for kind in (XOR, AND))


def flat_tokens(lexicon: DataFrame) -> DataFrame:
    """``gateway_type, token``: the distinct words of a lexicon's phrases."""
    return lexicon.select("gateway_type", F.explode(F.split("phrase", " ")).alias("token")).distinct()


def read_pairs(spark: SparkSession, path: str, lex_set: str) -> DataFrame:
    """``lex_set, p1, p2`` of lines ``a b;c d``, longest pairs first; blanks around phrases go."""
    part = lambda i: F.split(F.trim(F.get(F.split("value", ";"), F.lit(i))), " ")
    pairs = spark.read.text(path).filter("value LIKE '%;%'").select(F.lit(lex_set).alias("lex_set"), part(0).alias("p1"), part(1).alias("p2"))
    return pairs.orderBy(F.desc(F.size("p1") + F.size("p2")), F.array_join("p1", " "), F.array_join("p2", " "))


def mine_phrases(spans: DataFrame) -> DataFrame:
    """``gateway_type, phrase``: the distinct lower-case phrases of annotated gateway spans
    (``gateway_type, tokens``), in alphabetical order."""
    return spans.select("gateway_type", F.lower(F.array_join("tokens", " ")).alias("phrase")).distinct().orderBy("gateway_type", "phrase")


def mine_n_grams(sents: DataFrame, sizes: tuple[int, ...], least_docs: int) -> DataFrame:
    """``phrase, n, n_docs``: the lower-case word sequences of the given lengths within sentences
    (``doc_id, tokens``) that occur in ``least_docs`` documents or more. The sentences are shuffled by
    document, so what a document repeats goes before its word sequences are shuffled, and they are once."""
    low = sents.repartition("doc_id").select("doc_id", F.transform("tokens", lambda w: F.lower(w)).alias("low"))
    every = lambda n: F.transform(F.sequence(F.lit(1), F.size("low") - n + 1), lambda i: F.struct(F.array_join(F.slice("low", i, n), " ").alias("phrase"), F.lit(n).alias("n")))
    kind = "array<struct<phrase:string,n:int>>"
    grams = F.concat(*(F.when(F.size("low") >= n, every(n)).otherwise(F.array().cast(kind)) for n in sizes))
    once = low.select("doc_id", F.explode(grams).alias("g")).select("doc_id", "g.*").distinct()
    return once.groupBy("phrase", "n").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= least_docs)


def mine_keys(docs: DataFrame, sizes: tuple[int, ...], least_docs: int) -> DataFrame:
    """``n, a, b, n_docs``: what :func:`mine_n_grams` finds, as keys of :mod:`grams` instead of phrases, in documents
    with all their lower-case sentences (``doc_id, sents``, words without blanks).

    The shortest sequences are counted first. A longer one can be in ``least_docs`` documents only if every shortest
    one within it is, so those that hold another are not shuffled: a bitmap tells most of them, the counts the rest.
    Of a sequence its key and how many documents of a task have it are shuffled. A document that comes in several rows is
    brought together first.
    """
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.flatten(F.collect_list("sents")).alias("sents"))
    a, b = grams.word_hashes(F.flatten("sents"))
    rows = docs.select(F.transform("sents", lambda s: F.size(s)).alias("lengths"), a.alias("a"), b.alias("b"))
    first, rest = min(sizes), tuple(sorted(set(sizes) - {min(sizes)}))
    found = stored(_key_counts(rows, (first,), first, None, least_docs), "keys")
    if not rest:
        return found
    bits = grams.bitmap(found.select("a").toArrow().column("a").to_numpy().view(np.uint64))
    return found.unionAll(stored(_key_counts(rows, rest, first, bits, least_docs), "keys"))


def _key_counts(rows: DataFrame, sizes: tuple[int, ...], first: int, bits: np.ndarray | None, least_docs: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = sent.value
        for batch in batches:
            for i, j in grams.portions(batch.column("a")):
                part = batch.slice(i, j - i)
                (wa, n), (wb, _) = grams.values(part.column("a"), np.int64), grams.values(part.column("b"), np.int32)
                words = wa.view(np.uint64), wb.view(np.uint32)
                doc, room = np.repeat(np.arange(len(n)), n), grams.room(grams.values(part.column("lengths"), np.int64)[0])
                if known is not None:
                    *_, (_, shortest, _) = grams.keys(words, (first,))
                    fits = grams.may_hold(known, shortest)
                for size, a, b in grams.keys(words, sizes):
                    here = room[: len(a)] >= size
                    if known is not None:
                        for k in range(size - first + 1):
                            here &= fits[k : k + len(a)]
                    at = np.flatnonzero(here)
                    at = at[np.lexsort((doc[at], b[at], a[at]))]
                    if not len(at):
                        continue
                    new = np.r_[True, (a[at[1:]] != a[at[:-1]]) | (b[at[1:]] != b[at[:-1]])]
                    once = new | np.r_[True, doc[at[1:]] != doc[at[:-1]]]
                    start = np.flatnonzero(new)
                    counts = np.add.reduceat(once, start, dtype=np.int32)
                    columns = [np.full(len(start), size, np.int32), a[at[start]].view(np.int64), b[at[start]].view(np.int32), counts]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["n", "a", "b", "docs"])

    counts = rows.mapInArrow(run, "n int, a long, b int, docs int")
    return counts.groupBy("n", "a", "b").agg(F.sum("docs").alias("n_docs")).filter(F.col("n_docs") >= least_docs)


def mine_pairs(same_gateway: DataFrame) -> DataFrame:
    """``p1, p2``: the distinct lower-case phrase pairs of same-gateway relations (``source``,
    ``target`` entities)."""
    low = lambda c: F.transform(F.col(f"{c}.tokens"), lambda t: F.lower(t))
    return same_gateway.select(low("source").alias("p1"), low("target").alias("p2")).distinct()


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``gateway_type, keyword, synonym`` of a JSON file ``{xor: {keyword: [synonym]}, and: ...}``."""
    kind = "MAP<STRING, ARRAY<STRING>>"
    raw = spark.read.json(path, schema=f"xor {kind}, `and` {kind}", multiLine=True)
    part = lambda c, name: raw.select(F.lit(name).alias("gateway_type"), F.explode(c).alias("keyword", "list"))
    return part("xor", XOR).unionAll(part("and", AND)).select("gateway_type", "keyword", F.explode("list").alias("synonym"))


def _json_entity(c: str, kind: str):
    """An entity of a mixed JSON array ``[sentence, token, [words], type]``."""
    get = lambda i: F.get_json_object(c, f"$[{i}]")
    return F.struct(
        get(0).cast("int").alias("sentence_idx"), get(1).cast("int").alias("token_idx"), F.from_json(get(2), "ARRAY<STRING>").alias("tokens"), get(3).alias("entity_type")
    ).cast(kind)


def read_loops(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, source, target``: the loop edge of each document."""
    raw = spark.read.json(path, schema="loop_flows MAP<STRING, MAP<STRING, STRING>>", multiLine=True)
    rows = raw.select(F.explode("loop_flows").alias("doc_id", "flow")).select("doc_id", F.col("flow")["source"].alias("a"), F.col("flow")["target"].alias("b"))
    return rows.select("doc_id", _json_entity("a", ENTITY).alias("source"), _json_entity("b", ENTITY).alias("target"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` of every string in the lists of a JSON file."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit('"([^"]*)"(?=\\s*[,\\]])'), F.lit(1))).alias("doc_id")).distinct()
