"""Queries over sentences, tags and neighbours (scans, projections, tagging, joins) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import SMALL_ROWS, broadcast_if, stored
from ..functions.text import FULL_STOPS, joined
from ..operators import neighbors, tagging
from ..schemas import ACTIVITY, AND, XOR
from ..sources import corpus as corpus_io
from ..sources import lexicons
from . import fixtures as fx
from .fixtures import ENT, SENT, TAG, TOK, sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def lexicon(spark):
    rows = [("fixture", k, p) for k, ps in ((XOR, fx.XOR_PHRASES), (AND, fx.AND_PHRASES)) for p in ps]
    return spark.createDataFrame(rows, "lex_set string, gateway_type string, phrase string")


def gateways(spark, d):
    """``doc_id, s, t, tokens, low, kind``."""
    spans = tagging.tag_phrases(fx.corpus(spark, d), fx.XOR_PHRASES, fx.AND_PHRASES)
    return spans.select("doc_id", F.col("sentence_idx").alias("s"), F.col("start").alias("t"), "tokens", F.transform("tokens", lambda x: F.lower(x)).alias("low"), F.col("gateway_type").alias("kind"))


def activities(spark, d):
    """``doc_id, s, t, tokens``."""
    rows = fx.tagged(spark, d).select("doc_id", F.col("sentence_idx").alias("s"), F.posexplode(F.arrays_zip("tokens", "ner_tags")).alias("t", "z"))
    return rows.filter(F.col("z.ner_tags") == f"B-{ACTIVITY}").select("doc_id", "s", "t", F.array("z.tokens").alias("tokens"))


def entities(spark, d):
    return document_entities(spark, d).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*")


def document_entities(spark, d):
    return tagging.document_spans(fx.tagged_documents(spark, d))


@query("s3_lexicon_token_hits", sql(TOK, "SELECT k AS gateway_type, low AS token, count(*) AS n FROM tok JOIN (VALUES ('XOR Gateway','or'),('XOR Gateway','only'),('XOR Gateway','when'),('XOR Gateway','that'),('XOR Gateway','for'),('XOR Gateway','it'),('XOR Gateway','is'),('AND Gateway','and'),('AND Gateway','the'),('AND Gateway','as'),('AND Gateway','with')) l(k, w) ON low = w GROUP BY 1, 2"))
def s3(spark, d):
    words = fx.corpus(spark, d).select(F.explode("tokens").alias("t")).select(F.lower("t").alias("token"))
    return words.join(broadcast_if(lexicons.flat_tokens(lexicon(spark)), SMALL_ROWS), "token").groupBy("gateway_type", "token").agg(F.count(F.lit(1)).alias("n"))


@query("s4_mined_phrases", sql(ENT, "SELECT DISTINCT kind AS gateway_type, phrase FROM gw"))
def s4(spark, d):
    return lexicons.mine_phrases(gateways(spark, d).select(F.col("kind").alias("gateway_type"), "tokens"))


@query("s6_mined_pairs", sql(ENT, "SELECT DISTINCT phrase AS p1, nx AS p2 FROM (SELECT *, lead(phrase) OVER w AS nx, lead(s) OVER w AS ns FROM gw WHERE kind = 'XOR Gateway' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE ns - s <= 1"))
def s6(spark, d):
    near = neighbors.adjacent(gateways(spark, d).filter(F.col("kind") == XOR))
    rel = near.select(F.struct(F.col("low").alias("tokens")).alias("source"), F.struct(F.col("n_low").alias("tokens")).alias("target"))
    return lexicons.mine_pairs(rel).select(joined("p1").alias("p1"), joined("p2").alias("p2"))


@query("s10_corpus_tokens", sql(TAG, "SELECT ner_tag, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(sum(token_idx) AS BIGINT) AS places FROM tag GROUP BY 1"))
def s10(spark, d):
    rows = corpus_io.to_tokens(fx.tagged(spark, d))
    return rows.groupBy("ner_tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("token_idx").alias("places"))


@query("s16_gold_standard", sql(ENT, "SELECT doc_id, kind AS entity_type, phrase, count(*) AS n FROM gw GROUP BY ALL"))
def s16(spark, d):
    flat = entities(spark, d).select("doc_id", "entity.entity_type", F.col("low").alias("tokens"))
    gold = corpus_io.gold_standard(flat, [XOR, AND])
    return gold.groupBy("doc_id", "entity_type", joined("tokens").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


@query("p1_sentence_tokens", sql(SENT, "SELECT doc_id, sentence_idx, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS words FROM sentences"))
def p1(spark, d):
    rows = tagging.split_sentences(fx.read(spark, d, "documents"))
    return rows.select("doc_id", "sentence_idx", F.size("tokens").cast("long").alias("n_tokens"), F.md5(joined("tokens")).alias("words"))


@query("p1_full_stop_sentences", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, E' \t\r')), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_idx, CAST(len(string_split_regex(ss[i], '[ \t\r]+')) AS BIGINT) AS n_tokens FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)""")  # fmt: skip
def p1_full_stops(spark, d):
    rows = tagging.split_sentences(fx.read(spark, d, "documents"), ends=FULL_STOPS)
    return rows.select("doc_id", "sentence_idx", F.size("tokens").cast("long").alias("n_tokens"))


@query("p1_conversation_tokens", "SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_sentences FROM (SELECT conv_id, turn, len(string_split_regex(s, '[ \\t\\r]+')) AS n FROM (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '')) AS s FROM conversations)) GROUP BY ALL")
def p1_conversations(spark, d):
    turns = fx.read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return tagging.split_sentences(turns).groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_sentences")).select("doc_id.conv_id", "doc_id.turn", "n_tokens", "n_sentences")


@query("p2_document_tokens", sql(TAG, "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx, token_idx) - 1 AS doc_token_idx, ner_tag, CASE WHEN nx LIKE 'I-%' THEN 1 ELSE 0 END AS n_following_i FROM (SELECT *, lead(ner_tag) OVER (PARTITION BY doc_id ORDER BY sentence_idx, token_idx) AS nx FROM tag)"))
def p2(spark, d):
    rows = tagging.document_tokens(fx.tagged_tokens(spark, d))
    return rows.select("doc_id", F.col("doc_token_idx").cast("long").alias("doc_token_idx"), "ner_tag", F.col("n_following_i").cast("int").alias("n_following_i"))


@query("p3_kept_tags", sql(TAG, "SELECT doc_id, sentence_idx, token_idx, low FROM tag WHERE ner_tag IN ('B-XOR Gateway', 'I-XOR Gateway')"))
def p3(spark, d):
    return tagging.keep_tags(fx.tagged_tokens(spark, d), XOR, exact=True).select("doc_id", "sentence_idx", "token_idx", F.lower("token").alias("low"))


@query("p8_phrase_in_context", sql(SENT, "SELECT doc_id, sentence_idx, md5(sentence) AS sentence, md5(b) AS b, md5(a) AS a FROM (SELECT doc_id, sentence_idx, array_to_string(tokens, ' ') AS sentence, lag(array_to_string(tokens, ' ')) OVER w AS b, lead(array_to_string(tokens, ' ')) OVER w AS a FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_idx)) WHERE concat(' ', lower(sentence), ' ') LIKE '% for the %'"))
def p8(spark, d):
    rows = tagging.in_context(fx.corpus(spark, d), "for the")
    return rows.select("doc_id", "sentence_idx", F.md5("sentence").alias("sentence"), F.md5("before").alias("b"), F.md5("after").alias("a"))


@query("p9_activity_positions", sql(ENT, "SELECT doc_id, s, t, phrase FROM act"))
def p9(spark, d):
    acts = activities(spark, d)
    listed = acts.select("doc_id", F.col("s").alias("sentence_idx"), F.col("t").alias("ordinal"), "tokens")
    heads = fx.tagged_tokens(spark, d).filter(F.col("ner_tag") == f"B-{ACTIVITY}")
    found = tagging.attach_positions(listed, heads)
    return found.select("doc_id", F.col("sentence_idx").alias("s"), F.col("token_idx").alias("t"), F.lower(joined("tokens")).alias("phrase"))


@query("p10_flat_activities", sql(ENT, "SELECT doc_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM act GROUP BY 1"))
def p10(spark, d):
    pos = F.col("s") * F.lit(1_000_000).cast("long") + F.col("t")
    return activities(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"))


@query("p11_profile", sql(ENT, "SELECT doc_id, CAST(sum((kind = 'Activity')::INT) AS BIGINT) AS n_activities, CAST(sum((kind <> 'Activity')::INT) AS BIGINT) AS n_gateways FROM ent GROUP BY 1"))
def p11(spark, d):
    rel = neighbors.adjacent(gateways(spark, d)).select("doc_id", F.struct("tokens").alias("source"), F.struct(F.col("n_low").alias("tokens")).alias("target"))
    rows = tagging.profile(fx.read(spark, d, "documents").select("doc_id", "text"), entities(spark, d), rel)
    return rows.filter("activities IS NOT NULL").select("doc_id", F.size("activities").cast("long").alias("n_activities"), F.size("gateways").cast("long").alias("n_gateways"))


@query("p12_class_mask", sql(TAG, "SELECT doc_id, CAST(sum(CASE WHEN ner_tag LIKE '%AND Gateway' THEN 1 ELSE 0 END) AS BIGINT) AS y, count(*) AS n FROM tag GROUP BY 1"))
def p12(spark, d):
    return tagging.mask_class(fx.tagged_tokens(spark, d), AND).groupBy("doc_id").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))


@query("k1_phrase_spans", sql(ENT, "SELECT doc_id, s AS sentence_idx, t AS start, kind AS gateway_type, phrase FROM gw"))
def k1(spark, d):
    rows = tagging.tag_phrases(fx.corpus(spark, d), fx.XOR_PHRASES, fx.AND_PHRASES)
    return rows.select("doc_id", "sentence_idx", "start", "gateway_type", F.lower(joined("tokens")).alias("phrase"))


@query("k1_phrase_counts", sql(ENT, "SELECT kind AS gateway_type, phrase, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM gw GROUP BY ALL"))
def k1_counts(spark, d):
    """The flagship: how often each gateway phrase occurs, and in how many documents."""
    return k1(spark, d).groupBy("gateway_type", "phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


#: Phrases of two to four words that this many documents share; those of three words are of the other type.
MINED_SIZES, MINED_DOCS = (2, 3, 4), 5

MINED = SENT + f""",
low AS MATERIALIZED (SELECT doc_id, sentence_idx, list_transform(tokens, lambda t: lower(t)) AS low FROM sentences),
gram AS MATERIALIZED (SELECT doc_id, sentence_idx, start, n, array_to_string(low[start + 1:start + n], ' ') AS phrase FROM (
  SELECT *, unnest({list(MINED_SIZES)}) AS n FROM (SELECT *, unnest(range(len(low))) AS start FROM low)) WHERE start + n <= len(low)),
lex AS MATERIALIZED (SELECT phrase, CASE n WHEN 3 THEN '{AND}' ELSE '{XOR}' END AS gateway_type FROM gram GROUP BY phrase, n HAVING count(DISTINCT doc_id) >= {MINED_DOCS}),
cand AS MATERIALIZED (SELECT g.*, l.gateway_type, row_number() OVER (PARTITION BY doc_id, sentence_idx, l.gateway_type ORDER BY n DESC, phrase, start) AS o FROM gram g JOIN lex l USING (phrase)),
fold AS (SELECT doc_id, sentence_idx, gateway_type, 0::BIGINT AS o, []::INTEGER[] AS taken, NULL::BIGINT AS start, NULL::INTEGER AS n, NULL::VARCHAR AS phrase FROM (SELECT DISTINCT doc_id, sentence_idx, gateway_type FROM cand)
  UNION ALL SELECT f.doc_id, f.sentence_idx, f.gateway_type, c.o, CASE WHEN clash THEN f.taken ELSE list_concat(f.taken, range(c.start, c.start + c.n)::INTEGER[]) END, CASE WHEN NOT clash THEN c.start END, c.n, c.phrase
    FROM fold f JOIN cand c ON c.doc_id = f.doc_id AND c.sentence_idx = f.sentence_idx AND c.gateway_type = f.gateway_type AND c.o = f.o + 1, LATERAL (SELECT list_has_any(f.taken, range(c.start, c.start + c.n)::INTEGER[]) AS clash))"""


@query("k1_mined_lexicon", sql(MINED, "SELECT doc_id, sentence_idx, gateway_type, CAST(start AS INTEGER) AS start, n AS n_words, phrase FROM fold WHERE start IS NOT NULL", True))
def k1_mined(spark, d):
    """A lexicon of thousands of phrases, mined from the documents, over all of them."""
    docs = stored(fx.lower_documents(spark, d), "documents")
    keys = lexicons.mine_keys(docs, MINED_SIZES, MINED_DOCS)
    sents = docs.select("doc_id", F.posexplode("sents").alias("sentence_idx", "low"))
    return tagging.tag_keys(sents, keys.select(F.when(F.col("n") == 3, AND).otherwise(XOR).alias("gateway_type"), "n", "a", "b"))


@query("k2_gateway_entities", sql(ENT, "SELECT doc_id, s, t, kind, phrase FROM gw"))
def k2(spark, d):
    toks = tagging.keep_tags(fx.tagged_tokens(spark, d), "Gateway")
    e = tagging.spans_of_tags(toks)
    return e.select("doc_id", F.col("entity.sentence_idx").alias("s"), F.col("entity.token_idx").alias("t"), F.col("entity.entity_type").alias("kind"), joined("low").alias("phrase"))


@query("k3_benchmark_spans", sql(ENT, "SELECT doc_id, kind, string_agg(phrase, ',' ORDER BY pos) AS spans FROM gw GROUP BY 1, 2"))
def k3(spark, d):
    e = tagging.spans_of_tags(tagging.keep_tags(fx.tagged_tokens(spark, d), "Gateway"))
    item = F.struct("entity.sentence_idx", "entity.token_idx", joined("low").alias("p"))
    grouped = e.groupBy("doc_id", F.col("entity.entity_type").alias("kind")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return grouped.select("doc_id", "kind", F.array_join(F.transform("l", lambda x: x["p"]), ",").alias("spans"))


PREDICTED = "(doc_id * 31 + sentence_idx * 17 + token_idx) % 3 + 1"


@query("k4_filtered_gateways", sql(TAG, f"SELECT doc_id, sentence_idx, token_idx, CASE WHEN ner_tag LIKE '%XOR Gateway' AND {PREDICTED} <> 2 THEN 'dropped' ELSE 'kept' END AS action FROM tag WHERE ner_tag LIKE '%Gateway'"))
def k4(spark, d):
    gateway = lambda tag, _: F.contains(tag, F.lit("Gateway"))
    toks = tagging.keep_tags(stored(fx.tagged_tokens(spark, d, gateway), "gateway-tokens"), "Gateway")
    predicted = toks.select("doc_id", "sentence_idx", "token_idx", F.expr(PREDICTED).alias("predicted"))
    return tagging.filter_predicted(toks, predicted, 2, log_only=True).select("doc_id", "sentence_idx", "token_idx", "action")


@query("k5_gold_gateways", sql(TAG, "SELECT doc_id, sentence_idx, token_idx, gold_tag FROM tag WHERE gold_tag LIKE '%Gateway'"))
def k5(spark, d):
    return tagging.keep_tags(fx.tagged_tokens(spark, d), "Gateway", tag="gold_tag").select("doc_id", "sentence_idx", "token_idx", "gold_tag")


@query("j1_neighbours", sql(ENT, """SELECT g.doc_id, g.s, g.t, g.kind, p.pos AS pa, pp.pos AS ppa, f.pos AS fa, ff.pos AS ffa FROM gw g
  ASOF LEFT JOIN act p ON g.doc_id = p.doc_id AND g.pos > p.pos LEFT JOIN act pp ON pp.doc_id = g.doc_id AND pp.o = p.o - 1
  ASOF LEFT JOIN act f ON g.doc_id = f.doc_id AND g.pos < f.pos LEFT JOIN act ff ON ff.doc_id = g.doc_id AND ff.o = f.o + 1"""))  # fmt: skip
def j1(spark, d):
    rows = neighbors.neighbours(gateways(spark, d), activities(spark, d))
    pos = lambda c: (F.col(f"{c}.s") * F.lit(1_000_000).cast("long") + F.col(f"{c}.t")).alias(c)
    return rows.select("doc_id", "s", "t", "kind", *(pos(c) for c in ("pa", "ppa", "fa", "ffa")))


@query("j2_adjacent_gateways", sql(ENT, "SELECT doc_id, s, t, ns, nt FROM (SELECT *, lead(s) OVER w AS ns, lead(t) OVER w AS nt FROM gw WHERE kind = 'XOR Gateway' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE ns - s <= 1"))
def j2(spark, d):
    near = neighbors.adjacent(gateways(spark, d).filter(F.col("kind") == XOR))
    return near.select("doc_id", "s", "t", F.col("n_s").alias("ns"), F.col("n_t").alias("nt"))


#: Contradictory pairs: a recursive walk along the gateways decides which matches stand.
PAIR = (
    ENT
    + """,
adj AS (SELECT *, lead(s) OVER w AS ns, lead(t) OVER w AS nt, lead(phrase) OVER w AS np FROM gw WHERE kind = 'XOR Gateway' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cand AS MATERIALIZED (SELECT *, t = 0 AND ns - s <= 1 AND (phrase, np) IN (('that','or'), ('for','or'), ('or','or'), ('that','that'), ('for','for')) AS hit FROM adj),
walk AS (SELECT doc_id, o, coalesce(hit, false) AS taken FROM cand WHERE o = 1
         UNION ALL SELECT c.doc_id, c.o, coalesce(c.hit, false) AND NOT w.taken FROM walk w JOIN cand c ON c.doc_id = w.doc_id AND c.o = w.o + 1),
pair AS MATERIALIZED (SELECT c.* FROM cand c JOIN walk w USING (doc_id, o) WHERE taken)"""
)


@query("j3_contradictory_pairs", sql(PAIR, "SELECT doc_id, s, t, phrase, ns, nt, np FROM pair", True))
def j3(spark, d):
    hit = neighbors.contradictory(gateways(spark, d).filter(F.col("kind") == XOR), fx.PAIRS)
    return hit.select("doc_id", "s", "t", joined("low").alias("phrase"), F.col("n_s").alias("ns"), F.col("n_t").alias("nt"), joined("n_low").alias("np"))


@query("j3_all_contradictory_pairs", sql(PAIR, "SELECT doc_id, s, t, ns, nt FROM cand WHERE hit", True))
def j3_multiple(spark, d):
    hit = neighbors.contradictory(gateways(spark, d).filter(F.col("kind") == XOR), fx.PAIRS, multiple=True)
    return hit.select("doc_id", "s", "t", F.col("n_s").alias("ns"), F.col("n_t").alias("nt"))


@query("p6_selected_documents", sql(SENT, "SELECT doc_id, count(*) AS n_sentences FROM sentences WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1"))
def p6(spark, d):
    labels = fx.read(spark, d, "labels")
    rows = tagging.select_documents(fx.corpus(spark, d), labels, labels.filter("toxic = 1"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"))
