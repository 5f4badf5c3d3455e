"""Queries over sequence-flow rules with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import joined, phrase_spans, sentences, tokens
from ..functions.shared import stored
from ..operators import flows as ops
from ..schemas import ACTIVITY, AND, XOR
from . import fixtures as fx
from .fixtures import ENT, sql
from .tagging import PAIR, activities, gateways

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


POS = "{0}.s * 1000000 + {0}.t"


def flat(flows, *more):
    pos = lambda c: (F.col(f"{c}.s") * F.lit(1_000_000).cast("long") + F.col(f"{c}.t")).alias(c)
    return flows.select("doc_id", *more, pos("src"), F.col("src.kind").alias("src_kind"), pos("tgt"), F.col("tgt.kind").alias("tgt_kind"))


def base(spark, d):
    """``doc_id, places``: gateways and activities of each document (:func:`ops.placed`), found in its row without a
    shuffle and written once."""
    docs = fx.spread(fx.read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", F.transform(sentences(F.col("text")), tokens).alias("words"))
    low = words.select("*", F.transform("words", lambda ws: F.transform(ws, lambda w: F.lower(w))).alias("low"))
    spans = F.transform("low", lambda ws: F.struct(phrase_spans(ws, fx.XOR_PHRASES).alias("x"), phrase_spans(ws, fx.AND_PHRASES).alias("a")))
    both = low.select("doc_id", F.arrays_zip(F.col("words").alias("w"), spans.alias("p")).alias("sents"))

    def found(z, s):
        w, x, a = z["w"], z["p"]["x"], z["p"]["a"]
        at = lambda t, side, words, k: F.struct(s.alias("s"), t.alias("t"), F.lit(side).alias("side"), words.alias("tokens"), F.lit(k).alias("kind"))
        gates = lambda c, k: F.transform(c, lambda p: at(p["start"], 0, F.slice(w, p["start"] + 1, p["n"]), k))
        free = lambda c, t: ~F.exists(c, lambda p: (p["start"] <= t) & (t < p["start"] + p["n"]))
        acts = F.filter(F.transform(w, lambda v, t: F.when(fx.is_activity(v), at(t, 1, F.array(v), ACTIVITY))), lambda p: p.isNotNull())
        acts = F.filter(acts, lambda p: free(x, p["t"]) & free(a, p["t"]))
        return F.array_sort(F.concat(gates(x, XOR), gates(a, AND), acts))

    places = both.select("doc_id", F.flatten(F.transform("sents", found)).cast(ops.PLACES).alias("places"))
    return stored(places, "places")


def ruled(spark, d):
    return ops.ruled(base(spark, d), fx.PAIRS)


def merged(spark, d):
    return ops.merged(ruled(spark, d))


#: Neighbours as columns; rules as unions of edges.
NB = """,
nb AS MATERIALIZED (SELECT g.*, p.pos AS pa, pp.pos AS ppa, f.pos AS fa, ff.pos AS ffa, p.s AS pas, f.s AS fas FROM gw g
  ASOF LEFT JOIN act p ON g.doc_id = p.doc_id AND g.pos > p.pos LEFT JOIN act pp ON pp.doc_id = g.doc_id AND pp.o = p.o - 1
  ASOF LEFT JOIN act f ON g.doc_id = f.doc_id AND g.pos < f.pos LEFT JOIN act ff ON ff.doc_id = g.doc_id AND ff.o = f.o + 1)"""
RULES = (
    PAIR
    + NB
    + """,
two AS MATERIALIZED (SELECT a.*, b.pos AS pos2, b.fa AS fa2, b.ffa AS ffa2, b.phrase AS phrase2, a.fa IS NOT DISTINCT FROM b.fa AND a.fa IS NOT NULL AS empty
  FROM pair JOIN nb a USING (doc_id, s, t, kind) JOIN nb b ON b.doc_id = pair.doc_id AND b.kind = pair.kind AND b.s = ns AND b.t = nt),
used AS (SELECT doc_id, pos FROM two UNION SELECT doc_id, pos2 FROM two),
lone AS MATERIALIZED (SELECT *, coalesce(pas = s, false) AS wp, coalesce(fas = s, false) AS wf FROM nb WHERE kind = 'XOR Gateway' AND (doc_id, pos) NOT IN (SELECT doc_id, pos FROM used)),
ors AS (SELECT * FROM lone WHERE phrase = 'or' AND wp AND wf),
sing AS MATERIALIZED (SELECT * FROM (SELECT *, CASE WHEN pa IS NULL AND wf THEN 1 WHEN fa IS NULL AND wp THEN 2 WHEN pa IS NOT NULL AND NOT wp AND wf THEN 3 WHEN fa IS NOT NULL AND wp AND NOT wf THEN 4 END AS c FROM lone WHERE phrase <> 'or') WHERE c IS NOT NULL),
par AS (SELECT * FROM nb WHERE kind = 'AND Gateway'),
A AS (SELECT 'Activity' AS A, 'XOR Gateway' AS X, 'AND Gateway' AS P),
raw AS MATERIALIZED (
  SELECT 'pair' AS rel, doc_id, pa AS src, A AS src_kind, pos AS tgt, X AS tgt_kind FROM two, A
  UNION ALL SELECT 'pair', doc_id, pos, X, fa, A FROM two, A WHERE NOT empty UNION ALL SELECT 'pair', doc_id, fa, A, ffa2, A FROM two, A WHERE NOT empty
  UNION ALL SELECT 'pair', doc_id, pos, X, ffa2, A FROM two, A WHERE empty
  UNION ALL SELECT 'pair', doc_id, pos2, X, fa2, A FROM two, A UNION ALL SELECT 'pair', doc_id, fa2, A, ffa2, A FROM two, A
  UNION ALL SELECT 'or', doc_id, ppa, A, pos, X FROM ors, A UNION ALL SELECT 'or', doc_id, pos, X, pa, A FROM ors, A UNION ALL SELECT 'or', doc_id, pos, X, fa, A FROM ors, A
  UNION ALL SELECT 'or', doc_id, pa, A, ffa, A FROM ors, A UNION ALL SELECT 'or', doc_id, fa, A, ffa, A FROM ors, A
  UNION ALL SELECT 'single', doc_id, pa, A, pos, X FROM sing, A WHERE c = 3 UNION ALL SELECT 'single', doc_id, ppa, A, pos, X FROM sing, A WHERE c = 4
  UNION ALL SELECT 'single', doc_id, pos, X, fa, A FROM sing, A WHERE c IN (1, 3) UNION ALL SELECT 'single', doc_id, pos, X, ffa, A FROM sing, A WHERE c IN (1, 3)
  UNION ALL SELECT 'single', doc_id, fa, A, ffa, A FROM sing, A WHERE c IN (1, 3) UNION ALL SELECT 'single', doc_id, pos, X, pa, A FROM sing, A WHERE c IN (2, 4)
  UNION ALL SELECT 'single', doc_id, pa, A, fa, A FROM sing, A WHERE c = 4
  UNION ALL SELECT 'and', doc_id, ppa, A, pos, P FROM par, A UNION ALL SELECT 'and', doc_id, pos, P, pa, A FROM par, A UNION ALL SELECT 'and', doc_id, pos, P, fa, A FROM par, A
  UNION ALL SELECT 'and', doc_id, pa, A, ffa, A FROM par, A UNION ALL SELECT 'and', doc_id, fa, A, ffa, A FROM par, A),
flow AS MATERIALIZED (SELECT * FROM raw WHERE src IS NOT NULL AND tgt IS NOT NULL),
dflt AS (SELECT doc_id, pos AS src, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS tgt FROM act),
frame AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos) - 1 AS i FROM (
  SELECT doc_id, 1 AS rule, pos, pos AS a, coalesce(fa2, pos2) AS b, phrase AS split FROM two UNION ALL SELECT doc_id, 2, pos, pa, fa, phrase FROM ors
  UNION ALL SELECT doc_id, 3, pos, CASE WHEN c IN (1, 3) THEN pos ELSE pa END, CASE WHEN c = 2 THEN pos ELSE fa END, phrase FROM sing
  UNION ALL SELECT doc_id, 4, pos, pa, fa, phrase FROM par) WHERE a IS NOT NULL AND b IS NOT NULL),
word AS MATERIALIZED (SELECT doc_id, s * 1000000::BIGINT + t AS pos, string_agg(token, ' ' ORDER BY k) AS words FROM (
  SELECT e.doc_id, e.s, e.t, k, g.token FROM ent e, unnest(range(len(string_split(e.phrase, ' ')))) u(k) JOIN tag g ON g.doc_id = e.doc_id AND g.sentence_idx = e.s AND g.token_idx = e.t + k) GROUP BY 1, 2),
every AS MATERIALIZED (SELECT doc_id, src, src_kind, tgt, tgt_kind FROM flow
  UNION SELECT d.doc_id, d.src, 'Activity', d.tgt, 'Activity' FROM dflt d JOIN word w ON w.doc_id = d.doc_id AND w.pos = d.src WHERE d.tgt IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM flow f JOIN word v ON v.doc_id = f.doc_id AND v.pos = f.src WHERE f.doc_id = d.doc_id AND v.words = w.words)),
ends AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, src AS p FROM every UNION ALL SELECT doc_id, tgt FROM every)),
held AS MATERIALIZED (SELECT e.doc_id, p, coalesce(min(i) FILTER (i > 0), min(i)) AS i FROM ends e JOIN frame f ON f.doc_id = e.doc_id AND (
    (p // 1000000 = a // 1000000 AND p >= a) OR (p // 1000000 > a // 1000000 AND p // 1000000 < b // 1000000) OR (p // 1000000 = b // 1000000 AND p <= b)) GROUP BY 1, 2),
led AS MATERIALIZED (SELECT DISTINCT e.doc_id, src, src_kind, CASE WHEN go THEN f.pos ELSE tgt END AS tgt, CASE WHEN go THEN CASE f.rule WHEN 4 THEN 'AND Gateway' ELSE 'XOR Gateway' END ELSE tgt_kind END AS tgt_kind
  FROM (SELECT e.*, h2.i AS ti, h2.i IS NOT NULL AND h1.i IS DISTINCT FROM h2.i AND tw.words <> sw.words AS go FROM every e
        LEFT JOIN held h1 ON h1.doc_id = e.doc_id AND h1.p = e.src LEFT JOIN held h2 ON h2.doc_id = e.doc_id AND h2.p = e.tgt
        JOIN word tw ON tw.doc_id = e.doc_id AND tw.pos = e.tgt
        LEFT JOIN frame fr ON fr.doc_id = e.doc_id AND fr.i = h2.i LEFT JOIN word sw ON sw.doc_id = e.doc_id AND sw.pos = fr.pos) e
  LEFT JOIN frame f ON f.doc_id = e.doc_id AND f.i = e.ti)"""
)


@query("f1_default_flows", sql(ENT, "SELECT doc_id, pos AS src, nx AS tgt FROM (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM act) WHERE nx IS NOT NULL"))
def f1(spark, d):
    return flat(ops.default_flows(activities(spark, d))).select("doc_id", "src", "tgt")


def rule(rel):
    return lambda spark, d: flat(ops.document_rows(ruled(spark, d), "flows", lambda e: e["rel"] == rel))


for _name, _rel in (("f2_pair_flows", "pair"), ("f3_or_flows", "or"), ("f4_single_flows", "single"), ("f5_concurrent_flows", "and")):
    query(_name, sql(RULES, f"SELECT doc_id, src, src_kind, tgt, tgt_kind FROM flow WHERE rel = '{_rel}'", True))(rule(_rel))


@query("f2_same_gateways", sql(RULES, "SELECT doc_id, pos AS src, pos2 AS tgt FROM two", True))
def f2_same(spark, d):
    return flat(ops.document_rows(ruled(spark, d), "same")).select("doc_id", "src", "tgt")


@query("j4_frames", sql(RULES, "SELECT doc_id, rule, a, b FROM frame", True))
def j4_frames(spark, d):
    frames = ops.document_rows(ruled(spark, d), "frames")
    pos = lambda c, n: (F.col(f"{c}.s") * F.lit(1_000_000).cast("long") + F.col(f"{c}.t")).alias(n)
    return frames.select("doc_id", "rule", pos("start", "a"), pos("end", "b"))


@query("j5_kept_defaults", sql(RULES, "SELECT doc_id, src, tgt FROM every EXCEPT SELECT doc_id, src, tgt FROM flow", True))
def j5(spark, d):
    return flat(ops.document_rows(ops.with_defaults(ruled(spark, d)), "defaults")).select("doc_id", "src", "tgt")


@query("f6_decided_pairs", sql(ENT, "SELECT doc_id, s, t, comment, CASE WHEN comment = 'score' AND (doc_id * 31 + s * 17 + t) % 100 > 50 THEN 1 ELSE 0 END AS joined FROM (SELECT *, CASE WHEN ns - s > 3 THEN 'distance' WHEN phrase = 'or' OR np = 'or' THEN 'or' ELSE 'score' END AS comment FROM (SELECT *, lead(s) OVER w AS ns, lead(phrase) OVER w AS np FROM gw WHERE kind = 'XOR Gateway' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE ns IS NOT NULL)"))
def f6(spark, d):
    xor = stored(gateways(spark, d).filter(F.col("kind") == XOR).drop("kind"), "gateways")
    scores = xor.select("doc_id", "s", "t", (F.expr("(doc_id * 31 + s * 17 + t) % 100") / 100.0).alias("score"))
    return ops.decide_pairs(xor, scores).select("doc_id", "s", "t", "comment", "joined")


@query("f7_merged_flows", sql(RULES, "SELECT doc_id, src, src_kind, tgt, tgt_kind FROM led", True))
def f7(spark, d):
    return flat(ops.document_rows(merged(spark, d), "flows"))


@query("f8_flow_counts", sql(RULES, "SELECT l.doc_id, count(*) AS n_flows, count(DISTINCT tgt) AS n_targets FROM led l GROUP BY 1", True))
def f8(spark, d):
    count = F.struct(F.size("flows").cast("long").alias("n_flows"), F.size(F.array_distinct(F.transform("flows", lambda e: e["tgt"]))).cast("long").alias("n_targets"))
    # a filter on a count would be pushed down to the texts, with all that the count is made of
    return merged(spark, d).select("doc_id", F.explode(F.filter(F.array(count), lambda c: c["n_flows"] > 0)).alias("c")).select("doc_id", "c.*")


@query("p4_gateway_flows", sql(RULES, "SELECT doc_id, src, tgt FROM led WHERE src_kind = 'XOR Gateway' OR tgt_kind = 'XOR Gateway'", True))
def p4(spark, d):
    return flat(ops.document_rows(merged(spark, d), "flows")).filter((F.col("src_kind") == XOR) | (F.col("tgt_kind") == XOR)).select("doc_id", "src", "tgt")


@query("p7_benchmark_flows", sql(RULES, "SELECT l.doc_id, lower(a.words) AS source, lower(b.words) AS target, count(*) AS n FROM led l JOIN word a ON a.doc_id = l.doc_id AND a.pos = src JOIN word b ON b.doc_id = l.doc_id AND b.pos = tgt GROUP BY ALL", True))
def p7(spark, d):
    flows = ops.document_rows(merged(spark, d), "flows")
    low = lambda c: F.lower(joined(f"{c}.tokens"))
    return flows.groupBy("doc_id", low("src").alias("source"), low("tgt").alias("target")).agg(F.count(F.lit(1)).alias("n"))
