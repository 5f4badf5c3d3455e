"""Queries that rebuild gateways from relations, with oracles. Activities are the events of a week, of all
months or of one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import gateways as ops
from ..operators import tagging
from . import fixtures as fx
from .fixtures import GRAPH, monthly, sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


KIND = "CASE (a1 * 7 + a2 * 3) % 3 WHEN 0 THEN 'eventually_following' WHEN 1 THEN 'exclusive' ELSE 'concurrent' END"


def relations(spark, d, by_month=False):
    """Flow edges follow directly; all other pairs of a week get a relation by arithmetic."""
    nodes = fx.events(spark, d, by_month).select("doc_id", F.col("idx").alias("a"))
    edges = fx.flow_edges(spark, d, by_month).select("doc_id", F.col("s").alias("a1"), F.col("t").alias("a2"), F.lit(True).alias("edge"))
    rows = ops.all_pairs(nodes).join(edges, ["doc_id", "a1", "a2"], "left")
    kind = F.when(F.col("edge"), "directly_following").otherwise(F.expr(KIND))
    return stored(rows.select("doc_id", "a1", "a2", kind.alias("relation_type"), (F.col("a1") * 1000 + F.col("a2")).cast("long").alias("ord")), "relations")


REL = GRAPH + f""",
rel AS MATERIALIZED (SELECT a.doc_id, a.idx AS a1, b.idx AS a2, CASE WHEN e.s IS NOT NULL THEN 'directly_following' ELSE {KIND.replace('a1', 'a.idx').replace('a2', 'b.idx')} END AS relation_type
  FROM node a JOIN node b ON a.doc_id = b.doc_id AND a.idx < b.idx LEFT JOIN edge e ON e.doc_id = a.doc_id AND e.s = a.idx AND e.t = b.idx),
dfr AS MATERIALIZED (SELECT doc_id, a1, a2, a1 * 1000 + a2 AS ord FROM rel WHERE relation_type = 'directly_following'
  UNION ALL SELECT doc_id, -1, a1, (row_number() OVER (PARTITION BY doc_id ORDER BY a1)) - 1000000 FROM (SELECT DISTINCT doc_id, a1 FROM rel r WHERE relation_type = 'directly_following'
    AND NOT EXISTS (SELECT 1 FROM rel q WHERE q.doc_id = r.doc_id AND q.a2 = r.a1 AND q.relation_type = 'directly_following')))"""


def directly(spark, d, by_month=False):
    return ops.with_start(ops.directly(relations(spark, d, by_month)), F.lit(-1))


def show(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("x1_split_points", sql(REL, "SELECT doc_id, a1, string_agg(a2, ',' ORDER BY ord) AS receiving FROM dfr GROUP BY 1, 2 HAVING count(*) > 1"))
def x1(spark, d):
    return ops.split_points(directly(spark, d)).select("doc_id", F.col("pointing")[0].alias("a1"), show("receiving").alias("receiving"))


@query("x2_started_relations", sql(REL, "SELECT doc_id, a1, a2 FROM dfr"))
def x2(spark, d):
    return directly(spark, d).select("doc_id", "a1", "a2")


@query("x3_merge_points", sql(REL, "SELECT doc_id, a2, string_agg(a1, ',' ORDER BY ord) AS pointing FROM dfr GROUP BY 1, 2 HAVING count(*) > 1"))
def x3(spark, d):
    return ops.merge_points(directly(spark, d)).select("doc_id", F.col("receiving")[0].alias("a2"), show("pointing").alias("pointing"))


@query("x4_merged_candidates", sql(monthly(REL), "SELECT doc_id, receiving, string_agg(a1, ',' ORDER BY o) AS pointing FROM (SELECT doc_id, a1, min(ord) AS o, string_agg(a2, ',' ORDER BY ord) AS receiving FROM dfr GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1, 2"))
def x4(spark, d):
    return ops.merge_candidates(ops.split_points(directly(spark, d, True)), "receiving").select("doc_id", show("receiving").alias("receiving"), show("pointing").alias("pointing"))


def extracted(spark, d, full=True, by_month=False):
    return ops.extract_gateways(relations(spark, d, by_month), F.lit(-1), full)


def pairs(spark, d, by_month=False):
    df = stored(directly(spark, d, by_month), "directly")
    return stored(ops.pair_points(ops.merge_candidates(ops.split_points(df), "receiving"), ops.merge_candidates(ops.merge_points(df), "pointing")), "pairs")


#: Gateways in SQL: points, their pairing as a fold, branches, votes.
POINTS = REL + """,
s0 AS (SELECT doc_id, a1, min(ord) AS o, list(a2 ORDER BY ord) AS rec FROM dfr GROUP BY 1, 2 HAVING count(*) > 1),
s1 AS (SELECT doc_id, rec, min(o) AS o, list(a1 ORDER BY o) AS poi FROM s0 GROUP BY 1, 2),
m0 AS (SELECT doc_id, a2, min(ord) AS o, list(a1 ORDER BY ord) AS poi FROM dfr GROUP BY 1, 2 HAVING count(*) > 1),
m1 AS (SELECT doc_id, poi, min(o) AS o, list(a2 ORDER BY o) AS rec FROM m0 GROUP BY 1, 2),
pts AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_min(poi), k, o, poi, rec) AS i, k, poi, rec FROM (SELECT doc_id, 0 AS k, o, poi, rec FROM s1 UNION ALL SELECT doc_id, 1, o, poi, rec FROM m1)),
fold AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, []::BIGINT[] AS open, NULL::BIGINT AS split, NULL::BIGINT AS merge FROM pts
  UNION ALL SELECT f.doc_id, p.i, CASE WHEN p.k = 0 THEN list_append(f.open, p.i) ELSE f.open[:greatest(len(f.open) - 1, 0)] END, CASE WHEN p.k = 1 THEN f.open[-1] END, CASE WHEN p.k = 1 AND len(f.open) > 0 THEN p.i END
  FROM fold f JOIN pts p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
gwy AS MATERIALIZED (SELECT s.doc_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY s.i) - 1 AS INTEGER) AS gateway_idx, s.poi, s.rec, m.rec AS mrec
  FROM pts s LEFT JOIN fold f ON f.doc_id = s.doc_id AND f.split = s.i LEFT JOIN pts m ON m.doc_id = f.doc_id AND m.i = f.merge WHERE s.k = 0),
heads AS MATERIALIZED (SELECT doc_id, gateway_idx, mrec, CAST(j - 1 AS INTEGER) AS branch, kept[j] AS a FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS j FROM (SELECT *, list_filter(rec, lambda x: NOT list_contains(coalesce(mrec, []), x)) AS kept FROM gwy)))"""
FULL = POINTS + """,
adj AS MATERIALIZED (SELECT doc_id, a1, list(a2 ORDER BY ord DESC) AS nxt FROM dfr GROUP BY 1, 2),
dfs AS (SELECT doc_id, gateway_idx, mrec, branch, [a] AS stack, []::INTEGER[] AS seen FROM heads
  UNION ALL SELECT f.doc_id, f.gateway_idx, f.mrec, f.branch,
    CASE WHEN list_contains(f.seen, f.stack[-1]) THEN f.stack[:len(f.stack) - 1] ELSE list_concat(f.stack[:len(f.stack) - 1], list_filter(coalesce(j.nxt, []), lambda x: NOT list_contains(coalesce(f.mrec, []), x))) END,
    CASE WHEN list_contains(f.seen, f.stack[-1]) THEN f.seen ELSE list_append(f.seen, f.stack[-1]) END
    FROM dfs f LEFT JOIN adj j ON j.doc_id = f.doc_id AND j.a1 = f.stack[-1] WHERE len(f.stack) > 0),
members AS MATERIALIZED (SELECT doc_id, gateway_idx, branch, seen[i] AS a, i - 1 AS ord FROM (SELECT *, unnest(range(1, len(seen) + 1)) AS i FROM dfs WHERE len(stack) = 0))"""
STARTS = POINTS + ",\nmembers AS MATERIALIZED (SELECT doc_id, gateway_idx, branch, a, 0 AS ord FROM heads)"
VOTES = """,
met AS (SELECT l.doc_id, l.gateway_idx, r.relation_type AS k, {'b1': l.branch, 'b2': q.branch, 'o1': l.ord, 'a1': l.a, 'o2': q.ord, 'a2': q.a} AS o
  FROM members l JOIN members q ON q.doc_id = l.doc_id AND q.gateway_idx = l.gateway_idx AND l.branch < q.branch AND l.a <> q.a LEFT JOIN rel r ON r.doc_id = l.doc_id AND r.a1 = least(l.a, q.a) AND r.a2 = greatest(l.a, q.a)),
cnt AS (SELECT doc_id, gateway_idx, count(*) AS n, count(*) FILTER (k = 'exclusive') AS x, count(*) FILTER (k = 'concurrent') AS c, min(o) FILTER (k = 'exclusive') AS fx, min(o) FILTER (k = 'concurrent') AS fc FROM met GROUP BY 1, 2),
sz AS (SELECT doc_id, gateway_idx, CAST(count(*) AS INTEGER) AS size FROM members GROUP BY 1, 2),
vote AS (SELECT g.doc_id, g.gateway_idx, array_to_string(g.poi, ',') AS split, array_to_string(g.mrec, ',') AS merge, coalesce(size, 0) AS size,
  CASE WHEN n IS NULL THEN 'XOR Gateway optional' WHEN greatest(x, c) = 0 THEN 'no_gateway_relations' WHEN x > c OR (x = c AND fx < fc) THEN 'XOR Gateway' ELSE 'AND Gateway' END AS type,
  CASE WHEN n IS NULL THEN 1.0::DOUBLE WHEN greatest(x, c) = 0 THEN -1.0::DOUBLE ELSE round(greatest(x, c) / n, 4) END AS confidence
  FROM gwy g LEFT JOIN cnt USING (doc_id, gateway_idx) LEFT JOIN sz USING (doc_id, gateway_idx)),
final AS (SELECT *, CASE type WHEN 'XOR Gateway optional' THEN 'XOR Gateway' ELSE type END AS eval_type FROM vote)"""


@query("x5_paired_points", sql(monthly(POINTS), "SELECT doc_id, gateway_idx, array_to_string(poi, ',') AS split, array_to_string(mrec, ',') AS merge FROM gwy", True))
def x5(spark, d):
    return pairs(spark, d, True).select("doc_id", "gateway_idx", show("split.pointing").alias("split"), show("merge.receiving").alias("merge"))


@query("x6_branch_starts", sql(POINTS, "SELECT doc_id, gateway_idx, branch, a AS start FROM heads", True))
def x6(spark, d):
    return ops.branch_starts(pairs(spark, d))


@query("x7_full_branches", sql(monthly(FULL), "SELECT doc_id, gateway_idx, branch, a, CAST(ord AS INTEGER) AS ord FROM members", True))
def x7(spark, d):
    return ops.full_branches(pairs(spark, d, True), directly(spark, d, True))


@query("x9_start_votes", sql(STARTS + VOTES, "SELECT doc_id, gateway_idx, type, confidence, size FROM vote", True))
def x9(spark, d):
    return extracted(spark, d, full=False).select("doc_id", "gateway_idx", "type", "confidence", "size")


@query("x11_gateways", sql(FULL + VOTES, "SELECT doc_id, gateway_idx, split, merge, type, eval_type, confidence, size FROM final", True))
def x11(spark, d):
    g = extracted(spark, d)
    return g.select("doc_id", "gateway_idx", show("split.pointing").alias("split"), show("merge.receiving").alias("merge"), "type", "eval_type", "confidence", "size")


@query("a4_confidence_by_size", sql(monthly(FULL) + VOTES, "SELECT eval_type, size, round(avg(confidence), 6) AS confidence, count(*) AS n FROM final GROUP BY 1, 2", True))
def a4(spark, d):
    return extracted(spark, d, by_month=True).groupBy("eval_type", "size").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("n"))


@query("a5_confidence_by_type", sql(monthly(FULL) + VOTES, "SELECT eval_type, round(avg(confidence), 6) AS confidence FROM final WHERE eval_type IN ('XOR Gateway', 'AND Gateway') GROUP BY 1", True))
def a5(spark, d):
    return extracted(spark, d, by_month=True).filter(F.col("eval_type").isin("XOR Gateway", "AND Gateway")).groupBy("eval_type").agg(F.round(F.avg("confidence"), 6).alias("confidence"))


def activity_pairs(spark, d, by_month=False):
    return ops.all_pairs(fx.events(spark, d, by_month).select("doc_id", F.col("idx").alias("a")))


@query("j6_activity_pairs", sql(monthly(GRAPH), "SELECT a.doc_id, a.idx AS a1, b.idx AS a2 FROM node a JOIN node b ON a.doc_id = b.doc_id AND a.idx < b.idx"))
def j6(spark, d):
    return activity_pairs(spark, d, True)


BRANCH = "(SELECT doc_id, a1 AS gateway_idx, a2 AS a, row_number() OVER (PARTITION BY doc_id, a1 ORDER BY a2) - 1 AS branch FROM dfr WHERE a1 >= 0)"


def fixture_branches(spark, d):
    from pyspark.sql import Window

    b = F.row_number().over(Window.partitionBy("doc_id", "a1").orderBy("a2")) - 1
    return directly(spark, d).filter("a1 >= 0").select("doc_id", F.col("a1").alias("gateway_idx"), b.alias("branch"), F.col("a2").alias("a"), F.lit(0).alias("ord"))


@query("j7_branch_products", sql(REL, f"SELECT l.doc_id, l.gateway_idx, l.a AS a1, r.a AS a2 FROM {BRANCH} l JOIN {BRANCH} r USING (doc_id, gateway_idx) WHERE l.branch < r.branch AND l.a <> r.a"))
def j7(spark, d):
    return ops.branch_relations(fixture_branches(spark, d), relations(spark, d)).select("doc_id", "gateway_idx", "a1", "a2")


@query("x8_branch_relations", sql(REL, f"SELECT l.doc_id, l.gateway_idx, l.a AS a1, r.a AS a2, relation_type FROM {BRANCH} l JOIN {BRANCH} r USING (doc_id, gateway_idx) LEFT JOIN rel x ON x.doc_id = l.doc_id AND x.a1 = l.a AND x.a2 = r.a WHERE l.branch < r.branch AND l.a <> r.a"))
def x8(spark, d):
    return ops.branch_relations(fixture_branches(spark, d), relations(spark, d)).select("doc_id", "gateway_idx", "a1", "a2", "relation_type")


@query("j8_symmetric_lookup", sql(REL, "SELECT n.doc_id, n.idx + 1 AS a1, n.idx AS a2, relation_type FROM node n JOIN node m ON m.doc_id = n.doc_id AND m.idx = n.idx + 1 LEFT JOIN rel r ON r.doc_id = n.doc_id AND r.a1 = n.idx AND r.a2 = n.idx + 1"))
def j8(spark, d):
    back = relations(spark, d).filter("a2 = a1 + 1").select("doc_id", F.col("a2").alias("a1"), F.col("a1").alias("a2"))
    return ops.lookup(back, relations(spark, d))


@query("x10_sizes", sql(REL, f"SELECT doc_id, gateway_idx, count(*) AS size FROM {BRANCH} GROUP BY 1, 2"))
def x10(spark, d):
    b = fixture_branches(spark, d)
    gates = b.select("doc_id", "gateway_idx", F.lit("XOR Gateway optional").alias("type")).distinct()
    return ops.sized(gates, b).select("doc_id", "gateway_idx", F.col("size").cast("long").alias("size"))


@query("x12_random_labels", sql(GRAPH, "SELECT doc_id, a1, a2, (['directly_following', 'eventually_following', 'exclusive', 'concurrent'])[CAST(('0x' || substr(md5(concat(doc_id, ':', a1, ':', a2)), 1, 4)) AS BIGINT) % 4 + 1] AS relation_type FROM (SELECT a.doc_id, a.idx AS a1, b.idx AS a2 FROM node a JOIN node b ON a.doc_id = b.doc_id AND a.idx < b.idx)"))
def x12(spark, d):
    return ops.label_random(activity_pairs(spark, d), F.concat_ws(":", "doc_id", "a1", "a2"))


@query("x13_direct_labels", sql(GRAPH, "SELECT a.doc_id, a.idx AS a1, b.idx AS a2, 'directly_following' AS relation_type FROM node a JOIN node b ON a.doc_id = b.doc_id AND a.idx < b.idx"))
def x13(spark, d):
    return ops.label_directly(activity_pairs(spark, d))


@query("p5_relations_but_exclusive", sql(REL, "SELECT doc_id, a1, a2, relation_type FROM rel WHERE relation_type <> 'exclusive'"))
def p5_exclude(spark, d):
    return tagging.filter_relations(relations(spark, d), exclude="exclusive").select("doc_id", "a1", "a2", "relation_type")


@query("p5_exclusive_relations", sql(REL, "SELECT doc_id, a1, a2 FROM rel WHERE relation_type = 'exclusive'"))
def p5_keep(spark, d):
    return tagging.filter_relations(relations(spark, d), label="exclusive").select("doc_id", "a1", "a2")
