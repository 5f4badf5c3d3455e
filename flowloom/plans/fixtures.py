"""The driver's tables in the shape of an annotated corpus, in Spark and, as ``WITH`` parts, in SQL.

``documents`` give sentences and tokens; gateway tags come from a fixture lexicon, activities are
words ending in ``tion`` or ``ed``. ``conversations`` give a second corpus, ``events`` flow graphs (a
document is a user's week of the month, all months together, or with ``by_month`` of one month),
``labels`` a gold standard for metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import add_spans, first_tag, phrase_spans, sentences, span_tags, tokens
from ..schemas import ACTIVITY, AND, XOR

# The fixture lexicon and pair set.
XOR_PHRASES = ["or", "only", "when", "that", "for", "it is"]
AND_PHRASES = ["and", "and the", "as", "with"]
PAIRS = [("that", "or"), ("for", "or"), ("or", "or"), ("that", "that"), ("for", "for")]
#: A second, smaller lexicon whose tags stand for gold in evaluation queries.
GOLD_XOR, GOLD_AND = ["or", "when", "that", "it is"], ["and", "with"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores by ``key`` where the table has fewer files than cores; a table of many
    files stays as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if len(rows.inputFiles()) < cores else rows


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, sentence_idx, tokens``."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_idx", "sentence"))
    return docs.select("doc_id", "sentence_idx", tokens(F.col("sentence")).alias("tokens"))


def lower_documents(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, sents``: the sentences of :func:`corpus` as lower-case tokens, a row a document."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.transform(sentences(F.col("text")), lambda s: tokens(F.lower(s))).alias("sents"))


def is_activity(t):
    return F.endswith(t, F.lit("tion")) | (F.endswith(t, F.lit("ed")) & (F.length(t) >= 4))


def tags_of(xor, and_, words="tokens"):
    """Tags of a token array by two columns of spans; activities where no gateway is."""
    w, xor, and_ = (F.col(c) if isinstance(c, str) else c for c in (words, xor, and_))
    acts = F.transform(w, lambda t: F.when(is_activity(t), f"B-{ACTIVITY}").otherwise("O"))
    return first_tag(span_tags(w, xor, XOR), span_tags(w, and_, AND), acts)


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, sentence_idx, tokens, ner_tags``."""
    rows = add_spans(corpus(spark, d), {"x": XOR_PHRASES, "a": AND_PHRASES})
    return rows.select("doc_id", "sentence_idx", "tokens", tags_of("x", "a").alias("ner_tags"))


def tagged_documents(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, sents``: the sentences of :func:`tagged`, ``(tokens, ner_tags)`` in text order, a row a document."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", F.transform(sentences(F.col("text")), tokens).alias("words"))
    low = words.select("*", F.transform("words", lambda ws: F.transform(ws, lambda w: F.lower(w))).alias("low"))
    both = F.transform("low", lambda ws: F.struct(phrase_spans(ws, XOR_PHRASES).alias("x"), phrase_spans(ws, AND_PHRASES).alias("a")))
    found = low.select("doc_id", "words", both.alias("spans"))
    sents = F.zip_with("words", "spans", lambda ws, s: F.struct(ws.alias("tokens"), tags_of(s["x"], s["a"], ws).alias("ner_tags")))
    return found.select("doc_id", sents.alias("sents"))


def tagged_tokens(spark: SparkSession, d: str, kept=None) -> DataFrame:
    """``doc_id, sentence_idx, token_idx, token, ner_tag, gold_tag``; only the tokens for whose ``ner_tag`` and
    ``gold_tag`` the condition ``kept`` holds, told before a token gets a row of its own."""
    rows = add_spans(corpus(spark, d), {"x": XOR_PHRASES, "a": AND_PHRASES, "gx": GOLD_XOR, "ga": GOLD_AND})
    both = rows.select("doc_id", "sentence_idx", "tokens", tags_of("x", "a").alias("ner_tags"), tags_of("gx", "ga").alias("gold_tags"))
    zipped = F.arrays_zip(F.col("tokens").alias("token"), F.col("ner_tags").alias("ner_tag"), F.col("gold_tags").alias("gold_tag"))
    if kept is None:
        return both.select("doc_id", "sentence_idx", F.posexplode(zipped).alias("token_idx", "z")).select("doc_id", "sentence_idx", "token_idx", "z.*")
    placed = F.transform(zipped, lambda z, i: F.struct(i.alias("token_idx"), z["token"].alias("token"), z["ner_tag"].alias("ner_tag"), z["gold_tag"].alias("gold_tag")))
    few = F.filter(placed, lambda z: kept(z["ner_tag"], z["gold_tag"]))
    return both.select("doc_id", "sentence_idx", F.explode(few).alias("z")).select("doc_id", "sentence_idx", "z.*")


def events(spark: SparkSession, d: str, by_month: bool = False) -> DataFrame:
    """``doc_id, idx, kind``: the nodes of the flow graphs, a document for each user and week of the month,
    all months together or month by month."""
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    doc = F.col("user_id") * 1_000_000 + (F.year("ts") * 12 + F.month("ts")) * 5 + week if by_month else F.col("user_id") * 10 + week
    e = read(spark, d, "events").select(doc.cast("long").alias("doc_id"), "ts", "event_id", "event_type")
    kind = F.when(F.col("event_type") == "error", XOR).when(F.col("event_type") == "signup", AND).otherwise(ACTIVITY)
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "event_id")) - 1
    return e.select("doc_id", idx.cast("int").alias("idx"), kind.alias("kind"))


def flow_edges(spark: SparkSession, d: str, by_month: bool = False) -> DataFrame:
    """``doc_id, flow_ord, s, s_kind, t, t_kind``: each event to the next, gateways also to the one
    after; ordered by source, then target."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    n = events(spark, d, by_month)
    n = n.select("*", F.lead("kind", 1).over(w).alias("k1"), F.lead("kind", 2).over(w).alias("k2"))
    hops = F.array(F.when(F.col("k1").isNotNull(), F.struct(F.lit(1).alias("h"), F.col("k1").alias("k"))), F.when(F.col("k2").isNotNull() & (F.col("kind") != ACTIVITY), F.struct(F.lit(2).alias("h"), F.col("k2").alias("k"))))
    e = n.select("doc_id", F.col("idx").alias("s"), F.col("kind").alias("s_kind"), F.explode(F.filter(hops, lambda h: h.isNotNull())).alias("h"))
    e = e.select("doc_id", "s", "s_kind", (F.col("s") + F.col("h.h")).alias("t"), F.col("h.k").alias("t_kind"))
    return e.withColumn("flow_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("s", "t")) - 1)


def node(idx, kind):
    """A graph node as an entity: one sentence, the index as position."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.struct(F.lit(0).alias("sentence_idx"), idx.cast("int").alias("token_idx"), F.array(F.concat(F.lit("n"), idx.cast("string"))).alias("tokens"), F.col(kind).alias("entity_type"))


def flows(spark: SparkSession, d: str, by_month: bool = False) -> DataFrame:
    """``doc_id, flow_ord, source, target`` entities of :func:`flow_edges`."""
    return flow_edges(spark, d, by_month).select("doc_id", "flow_ord", node("s", "s_kind").alias("source"), node("t", "t_kind").alias("target"))


def same_gateways(spark: SparkSession, d: str, by_month: bool = False) -> DataFrame:
    """``doc_id, source, target``: each gateway with the next one of its type, up to 5 nodes on."""
    w = Window.partitionBy("doc_id", "kind").orderBy("idx")
    n = events(spark, d, by_month).filter(F.col("kind") != ACTIVITY).withColumn("nxt", F.lead("idx").over(w)).filter("nxt - idx <= 5")
    return n.select("doc_id", node("idx", "kind").alias("source"), node("nxt", "kind").alias("target"))


SENT = r"""
sentences AS MATERIALIZED (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_idx, string_split_regex(ss[i], '[ \t\r]+') AS tokens FROM (
  SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x, E' \t\r')), lambda x: x <> '') AS ss FROM documents)))"""

TOK = (
    SENT
    + r""",
tok AS MATERIALIZED (SELECT doc_id, sentence_idx, CAST(i - 1 AS INTEGER) AS token_idx, tokens[i] AS token, lower(tokens[i]) AS low, lower(tokens[i + 1]) AS nxt,
          CASE WHEN i > 1 THEN lower(tokens[i - 1]) END AS prv FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM sentences))"""
)


def _sql_tag(xor: str, and_: str, and_the: bool) -> str:
    alone = "low IN (%s)" % and_
    the = "WHEN low = 'the' AND prv = 'and' THEN 'I-AND Gateway'" if and_the else ""
    return f"""CASE WHEN low IN ({xor}) OR (low = 'it' AND nxt = 'is') THEN 'B-XOR Gateway' WHEN low = 'is' AND prv = 'it' THEN 'I-XOR Gateway'
  WHEN {alone} THEN 'B-AND Gateway' {the} WHEN token LIKE '%tion' OR (token LIKE '%ed' AND length(token) >= 4) THEN 'B-Activity' ELSE 'O' END"""


TAG = (
    TOK
    + f""",
tag AS MATERIALIZED (SELECT doc_id, sentence_idx, token_idx, token, low, {_sql_tag("'or','only','when','that','for'", "'and','as','with'", True)} AS ner_tag,
          {_sql_tag("'or','when','that'", "'and','with'", False)} AS gold_tag FROM tok)"""
)

#: Gateways and activities with a scalar position; phrases of two words are joined.
ENT = (
    TAG
    + r""",
ent AS MATERIALIZED (SELECT doc_id, sentence_idx AS s, token_idx AS t, sentence_idx * 1000000::BIGINT + token_idx AS pos, substr(ner_tag, 3) AS kind,
          CASE WHEN nx LIKE 'I-%' THEN low || ' ' || nlow ELSE low END AS phrase FROM (
  SELECT *, lead(ner_tag) OVER w AS nx, lead(low) OVER w AS nlow FROM tag WINDOW w AS (PARTITION BY doc_id, sentence_idx ORDER BY token_idx)) WHERE ner_tag LIKE 'B-%'),
act AS MATERIALIZED (SELECT doc_id, s, t, pos, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS o FROM ent WHERE kind = 'Activity'),
gw AS MATERIALIZED (SELECT doc_id, s, t, pos, phrase, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS o FROM ent WHERE kind <> 'Activity')"""
)

_KIND = "CASE event_type WHEN 'error' THEN 'XOR Gateway' WHEN 'signup' THEN 'AND Gateway' ELSE 'Activity' END AS kind FROM"
_NODE = f"""node AS MATERIALIZED (SELECT user_id * 10 + (day(ts) - 1) // 7 AS doc_id, CAST(row_number() OVER (PARTITION BY user_id, (day(ts) - 1) // 7 ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
          {_KIND} events),"""
_MONTH_NODE = f"""node AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
          {_KIND} (SELECT *, user_id * 1000000 + (year(ts) * 12 + month(ts)) * 5 + (day(ts) - 1) // 7 AS doc_id FROM events)),"""

GRAPH = f"""
{_NODE}
edge AS MATERIALIZED (SELECT a.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.idx, b.idx) - 1 AS flow_ord, a.idx AS s, a.kind AS s_kind, b.idx AS t, b.kind AS t_kind
         FROM node a JOIN node b ON a.doc_id = b.doc_id AND (b.idx = a.idx + 1 OR (b.idx = a.idx + 2 AND a.kind <> 'Activity'))),
sg AS MATERIALIZED (SELECT a.doc_id, a.idx AS s, min(b.idx) AS t, a.kind FROM node a JOIN node b ON a.doc_id = b.doc_id AND a.kind = b.kind AND b.idx > a.idx
       WHERE a.kind <> 'Activity' GROUP BY ALL HAVING min(b.idx) - a.idx <= 5)"""


def monthly(parts: str) -> str:
    """``WITH`` parts with :data:`GRAPH` in them, documents being of one month."""
    return parts.replace(_NODE, _MONTH_NODE)


def sql(parts: str, query: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{parts.lstrip()}\n{query}"
