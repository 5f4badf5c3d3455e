"""Queries over flow graphs with oracles. A graph is a user's week of events, of all months or of one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import graph as ops
from ..schemas import ACTIVITY, GATEWAYS, XOR
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


def idx(c: str, name: str | None = None):
    return F.col(f"{c}.token_idx").alias(name or c)


def graph(spark, d, by_month=False):
    return stored(fx.flows(spark, d, by_month), "flows"), stored(fx.same_gateways(spark, d, by_month), "same")


@query("g1_degrees", sql(monthly(GRAPH), "SELECT doc_id, x, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT doc_id, t AS x, 1 AS i, 0 AS o FROM edge UNION ALL SELECT doc_id, s, 0, 1 FROM edge) GROUP BY 1, 2"))
def g1(spark, d):
    flows, _ = graph(spark, d, True)
    both = ops.in_degree(flows).join(ops.out_degree(flows), ["doc_id", "entity"], "full_outer")
    return both.select("doc_id", idx("entity", "x"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


SGC = GRAPH + ",\nsgc AS (SELECT doc_id, s, t FROM sg UNION SELECT c.doc_id, c.s, g.t FROM sgc c JOIN sg g ON g.doc_id = c.doc_id AND g.s = c.t)"
REACH = SGC + ",\nhop AS MATERIALIZED (SELECT doc_id, s, t FROM edge UNION SELECT doc_id, s, t FROM sgc),\nreach AS (SELECT doc_id, s, t FROM hop UNION SELECT r.doc_id, r.s, h.t FROM reach r JOIN hop h ON h.doc_id = r.doc_id AND h.s = r.t)"


@query("g2_same_gateway_closure", sql(SGC, "SELECT doc_id, s, t FROM sgc", True))
def g2(spark, d):
    return ops.same_gateway_closure(graph(spark, d)[1]).select("doc_id", idx("source", "s"), idx("target", "t"))


@query("g3_following_flows", sql(GRAPH, "SELECT n.doc_id, n.idx AS x, count(*) AS n, CAST(sum(e.t) AS BIGINT) AS targets FROM node n JOIN edge e ON e.doc_id = n.doc_id AND e.s >= n.idx WHERE n.kind <> 'Activity' GROUP BY 1, 2"))
def g3(spark, d):
    flows, _ = graph(spark, d)
    gates = flows.filter(F.col("source.entity_type") != ACTIVITY).select("doc_id", F.col("source").alias("element")).distinct()
    return ops.following_flows(gates, flows).groupBy("doc_id", idx("element", "x")).agg(F.count(F.lit(1)).alias("n"), F.sum("target.token_idx").alias("targets"))


@query("g3_previous_flows", sql(monthly(GRAPH), "SELECT n.doc_id, n.idx AS x, count(*) AS n, CAST(sum(e.t) AS BIGINT) AS targets FROM node n JOIN edge e ON e.doc_id = n.doc_id AND e.s <= n.idx WHERE n.kind <> 'Activity' AND n.idx IN (SELECT s FROM edge x WHERE x.doc_id = n.doc_id) GROUP BY 1, 2"))
def g3_before(spark, d):
    flows, _ = graph(spark, d, True)
    gates = flows.filter(F.col("source.entity_type") != ACTIVITY).select("doc_id", F.col("source").alias("element")).distinct()
    return ops.following_flows(gates, flows, before=True).groupBy("doc_id", idx("element", "x")).agg(F.count(F.lit(1)).alias("n"), F.sum("target.token_idx").alias("targets"))


#: Merge points from the scan, with running sums in SQL.
MERGE = (
    GRAPH
    + """,
gate AS MATERIALIZED (SELECT DISTINCT doc_id, t AS g, t_kind AS kind FROM edge WHERE t_kind <> 'Activity'),
scope AS (SELECT g.doc_id, g.g, e.* EXCLUDE (doc_id) FROM gate g JOIN edge e ON e.doc_id = g.doc_id AND e.s >= g.g AND e.t <> g.g),
scan AS (SELECT *, row_number() OVER w AS o, (t_kind <> 'Activity' AND (SELECT count(*) FROM edge x WHERE x.doc_id = scope.doc_id AND x.t = scope.t) = 1) AS opens,
   row_number() OVER (PARTITION BY doc_id, g, t ORDER BY s, flow_ord) > 1 AS rep FROM scope WINDOW w AS (PARTITION BY doc_id, g ORDER BY s, flow_ord)),
run AS MATERIALIZED (SELECT *, 1 + sum(opens::INT - rep::INT) OVER (PARTITION BY doc_id, g ORDER BY o) AS open FROM scan),
ends AS MATERIALIZED (SELECT doc_id, g, min(o) FILTER (rep AND open = 0) AS e FROM run GROUP BY 1, 2),
merge AS MATERIALIZED (SELECT r.doc_id, r.g, r.t AS m FROM run r JOIN ends USING (doc_id, g) WHERE o = e),
nested AS (SELECT DISTINCT r.doc_id, r.g, r.t FROM run r JOIN ends USING (doc_id, g) WHERE opens AND (e IS NULL OR o <= e))"""
)


def merges(spark, d):
    flows, _ = graph(spark, d)
    gates = flows.filter(F.col("target.entity_type").isin(*GATEWAYS)).select("doc_id", F.col("target").alias("element")).distinct()
    return ops.merge_points(gates, flows)


@query("g4_merge_points", sql(MERGE, "SELECT doc_id, g, m FROM merge"))
def g4(spark, d):
    return merges(spark, d)[0].select("doc_id", idx("element", "g"), idx("merge", "m"))


@query("g15_nested_gateways", sql(MERGE, "SELECT doc_id, g, t FROM nested"))
def g15(spark, d):
    return merges(spark, d)[1].select("doc_id", idx("parent", "g"), idx("nested_gateway", "t"))


@query("a2_nested_per_parent", sql(MERGE, "SELECT doc_id, g, count(*) AS n FROM nested GROUP BY 1, 2"))
def a2(spark, d):
    return g15(spark, d).groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n"))


UNTIL = MERGE.replace("\nnode AS", "\nnode AS") + """,
sgc AS (SELECT doc_id, s, t FROM sg UNION SELECT c.doc_id, c.s, x.t FROM sgc c JOIN sg x ON x.doc_id = c.doc_id AND x.s = c.t),
within AS (SELECT DISTINCT e.doc_id, e.t AS st, m.m, e.t AS x FROM edge e LEFT JOIN merge m ON m.doc_id = e.doc_id AND m.g = e.s WHERE e.s_kind <> 'Activity'
  UNION SELECT w.doc_id, w.st, w.m, unnest(list_prepend(e.t, coalesce((SELECT list(c.t) FROM sgc c WHERE c.doc_id = e.doc_id AND c.s = e.t), []))) FROM within w JOIN edge e ON e.doc_id = w.doc_id AND e.s = w.x AND (w.m IS NULL OR e.t < w.m))"""


@query("g5_until_merge", sql(UNTIL, "SELECT doc_id, st, coalesce(m, -1) AS m, count(*) AS n, CAST(sum(x) AS BIGINT) AS places FROM within GROUP BY ALL", True))
def g5(spark, d):
    flows, same = graph(spark, d)
    gates = flows.filter(F.col("target.entity_type").isin(*GATEWAYS)).select("doc_id", F.col("target").alias("element")).distinct()
    merge = ops.merge_points(gates, flows)[0].withColumnRenamed("element", "source")
    starts = flows.filter(F.col("source.entity_type") != ACTIVITY).join(merge, ["doc_id", "source"], "left").select("doc_id", F.col("target").alias("start"), "merge").distinct()
    rows = ops.until_merge(starts, flows, same)
    return rows.groupBy("doc_id", idx("start", "st"), F.coalesce("merge.token_idx", F.lit(-1)).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum("entity.token_idx").alias("places"))


@query("g6_last_activities", sql(monthly(GRAPH) + ",\nback AS (SELECT doc_id, t AS x, s AS p, s_kind AS k FROM edge WHERE t_kind <> 'Activity' UNION SELECT b.doc_id, b.x, e.s, e.s_kind FROM back b JOIN edge e ON e.doc_id = b.doc_id AND e.t = b.p AND b.k <> 'Activity')", "SELECT doc_id, x, p FROM back WHERE k = 'Activity'", True))
def g6(spark, d):
    return ops.last_activities(graph(spark, d, True)[0]).select("doc_id", idx("entity", "x"), idx("activity", "p"))


@query("g7_reachability", sql(REACH, "SELECT doc_id, s, t FROM reach", True))
def g7(spark, d):
    return ops.reachability(*graph(spark, d)).select("doc_id", idx("source", "s"), idx("target", "t"))


@query("g8_started_flows", sql(monthly(GRAPH), "SELECT doc_id, s, t FROM edge UNION ALL SELECT doc_id, -1, min(s) FROM edge GROUP BY 1"))
def g8(spark, d):
    return ops.with_start(graph(spark, d, True)[0]).select("doc_id", idx("source", "s"), idx("target", "t"))


@query("g9_without_loops", sql(monthly(GRAPH), "SELECT doc_id, s, t FROM edge WHERE NOT (s = 2 AND t = 3)"))
def g9(spark, d):
    flows, _ = graph(spark, d, True)
    return ops.without_loops(flows, flows.filter("source.token_idx = 2 AND target.token_idx = 3")).select("doc_id", idx("source", "s"), idx("target", "t"))


@query("g10_without_merge", sql(MERGE, "SELECT e.doc_id, e.s, e.t FROM edge e LEFT JOIN merge m ON m.doc_id = e.doc_id AND m.g = e.s WHERE e.s_kind = 'XOR Gateway' AND e.t_kind <> 'AND Gateway' AND e.t IS DISTINCT FROM m.m"))
def g10(spark, d):
    flows, _ = graph(spark, d)
    merge = merges(spark, d)[0].withColumnRenamed("element", "source")
    rows = flows.filter(F.col("source.entity_type") == XOR).join(merge, ["doc_id", "source"], "left").withColumnRenamed("target", "entity")
    return ops.without(rows, "merge", condition=GATEWAYS[1]).select("doc_id", idx("source", "s"), idx("entity", "t"))


@query("j10_linked", sql(monthly(GRAPH), "SELECT a.doc_id, a.s, a.t AS via, b.t FROM edge a JOIN edge b ON b.doc_id = a.doc_id AND b.s = a.t WHERE a.t_kind = 'AND Gateway' AND a.s_kind = 'XOR Gateway'"))
def j10(spark, d):
    flows, _ = graph(spark, d, True)
    rows = flows.filter(F.col("source.entity_type") == XOR)
    via = ops.links_via_condition(flows, condition=GATEWAYS[1]).join(rows.select("doc_id", F.col("source").alias("entity")).distinct(), ["doc_id", "entity"]).distinct()
    hop = ops.links(flows).select("doc_id", "entity", F.col("linked").alias("mid")).filter(F.col("mid.entity_type") == GATEWAYS[1])
    last = ops.links(flows).select("doc_id", F.col("entity").alias("mid"), "linked")
    return via.join(hop.join(last, ["doc_id", "mid"]), ["doc_id", "entity", "linked"]).select("doc_id", idx("entity", "s"), idx("mid", "via"), idx("linked", "t"))


@query("j11_untouched_pairs", sql(GRAPH, "SELECT a.doc_id, a.idx AS s, b.idx AS t FROM node a JOIN node b ON a.doc_id = b.doc_id AND a.idx < b.idx AND a.kind = 'Activity' AND b.kind = 'Activity' WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.doc_id = a.doc_id AND e.s = a.idx AND e.t = b.idx)"))
def j11(spark, d):
    nodes = fx.events(spark, d).filter(F.col("kind") == ACTIVITY).select("doc_id", fx.node("idx", "kind").alias("entity"))
    known = graph(spark, d)[0].select("doc_id", F.col("target").alias("a1"), F.col("source").alias("a2"))
    return ops.untouched_pairs(nodes, known).select("doc_id", idx("a1", "s"), idx("a2", "t"))


@query("g13_remaining_relations", sql(REACH, "SELECT a.doc_id, a.idx AS s, b.idx AS t, CASE WHEN r.s IS NOT NULL THEN 'eventually_following' ELSE 'exclusive' END AS relation_type FROM node a JOIN node b ON a.doc_id = b.doc_id AND a.idx < b.idx AND a.kind = 'Activity' AND b.kind = 'Activity' LEFT JOIN reach r ON r.doc_id = a.doc_id AND r.s = a.idx AND r.t = b.idx WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.doc_id = a.doc_id AND e.s = a.idx AND e.t = b.idx)", True))
def g13(spark, d):
    flows, same = graph(spark, d)
    known = flows.select("doc_id", F.col("source").alias("a1"), F.col("target").alias("a2"))
    return ops.remaining(known, flows, same).select("doc_id", idx("a1", "s"), idx("a2", "t"), "relation_type")


@query("g14_final_relations", sql(monthly(GRAPH), "SELECT DISTINCT doc_id, least(s, t) AS s, greatest(s, t) AS t, s_kind AS relation_type FROM edge"))
def g14(spark, d):
    flows, _ = graph(spark, d, True)
    one = flows.select("doc_id", F.col("source").alias("a1"), F.col("target").alias("a2"), F.col("source.entity_type").alias("relation_type"), F.lit("x").alias("comment"))
    mirrored = one.unionAll(one.select("doc_id", F.col("a2").alias("a1"), F.col("a1").alias("a2"), "relation_type", "comment")).unionAll(one.withColumn("a2", F.col("a1")))
    return ops.final_relations(mirrored).select("doc_id", idx("a1", "s"), idx("a2", "t"), "relation_type")


#: The composed relations from the pieces' SQL: flows with the start edge, merge points, branches.
BRANCH = MERGE.replace("\nedge AS MATERIALIZED", "\nedge0 AS MATERIALIZED").replace(
    "\nsg AS MATERIALIZED",
    "\nedge AS MATERIALIZED (SELECT * FROM edge0 UNION ALL SELECT doc_id, -1, -1, 'start', arg_min(s, flow_ord), arg_min(s_kind, flow_ord) FROM edge0 GROUP BY doc_id),\nsg AS MATERIALIZED",
) + """,
sgc AS (SELECT doc_id, s, t FROM sg UNION SELECT c.doc_id, c.s, x.t FROM sgc c JOIN sg x ON x.doc_id = c.doc_id AND x.s = c.t),
starts AS MATERIALIZED (SELECT g.doc_id, g.g, g.kind, e.t, e.t_kind, 'g -> a' AS how FROM gate g JOIN edge e ON e.doc_id = g.doc_id AND e.s = g.g
  UNION ALL SELECT g.doc_id, g.g, g.kind, e.t, e.t_kind, 'g -> sg -> a' FROM gate g JOIN sgc c ON c.doc_id = g.doc_id AND c.s = g.g JOIN edge e ON e.doc_id = c.doc_id AND e.s = c.t),
heads AS MATERIALIZED (SELECT DISTINCT s.doc_id, s.g, s.kind, m.m, s.t AS st FROM starts s LEFT JOIN merge m ON m.doc_id = s.doc_id AND m.g = s.g WHERE NOT (how = 'g -> a' AND s.t IS NOT DISTINCT FROM m.m)),
within AS (SELECT DISTINCT doc_id, st, m, st AS x FROM heads
  UNION SELECT w.doc_id, w.st, w.m, unnest(list_prepend(e.t, coalesce((SELECT list(c.t) FROM sgc c WHERE c.doc_id = e.doc_id AND c.s = e.t), []))) FROM within w JOIN edge e ON e.doc_id = w.doc_id AND e.s = w.x AND (w.m IS NULL OR e.t < w.m)),
act AS MATERIALIZED (SELECT doc_id, idx FROM node WHERE kind = 'Activity'),
branch AS MATERIALIZED (SELECT DISTINCT h.doc_id, h.g, h.kind, h.st, w.x FROM heads h JOIN within w ON w.doc_id = h.doc_id AND w.st = h.st AND w.m IS NOT DISTINCT FROM h.m JOIN act a ON a.doc_id = w.doc_id AND a.idx = w.x)"""
ALL_RELATIONS = BRANCH + """,
back AS (SELECT doc_id, t AS x, s AS p, s_kind AS k FROM edge WHERE t_kind <> 'Activity' UNION SELECT b.doc_id, b.x, e.s, e.s_kind FROM back b JOIN edge e ON e.doc_id = b.doc_id AND e.t = b.p AND b.k <> 'Activity'),
before AS (SELECT doc_id, t AS g, s AS a FROM edge WHERE t_kind LIKE '%Gateway' AND s_kind = 'Activity'
  UNION ALL SELECT e.doc_id, e.t, b.p FROM edge e JOIN back b ON b.doc_id = e.doc_id AND b.x = e.s AND b.k = 'Activity' WHERE e.t_kind LIKE '%Gateway' AND e.s_kind LIKE '%Gateway'),
known AS MATERIALIZED (SELECT doc_id, s, t, 'directly_following' AS relation_type, 'normal df' AS comment FROM edge WHERE s_kind = 'Activity' AND t_kind = 'Activity'
  UNION ALL SELECT f.doc_id, f.a, s.t, 'directly_following', s.how FROM before f JOIN starts s ON s.doc_id = f.doc_id AND s.g = f.g AND s.t_kind = 'Activity'
  UNION ALL SELECT DISTINCT l.doc_id, l.x, r.x, CASE l.kind WHEN 'XOR Gateway' THEN 'exclusive' ELSE 'concurrent' END, 'branch' FROM branch l JOIN branch r ON r.doc_id = l.doc_id AND r.g = l.g AND l.st < r.st AND l.x <> r.x),
hop AS MATERIALIZED (SELECT doc_id, s, t FROM edge UNION SELECT doc_id, s, t FROM sgc),
reach AS (SELECT doc_id, s, t FROM hop UNION SELECT r.doc_id, r.s, h.t FROM reach r JOIN hop h ON h.doc_id = r.doc_id AND h.s = r.t),
touched AS MATERIALIZED (SELECT DISTINCT doc_id, least(s, t) AS x, greatest(s, t) AS y FROM known),
rest AS (SELECT a.doc_id, a.idx AS s, b.idx AS t, CASE WHEN r.s IS NULL THEN 'exclusive' ELSE 'eventually_following' END AS relation_type, CASE WHEN r.s IS NULL THEN 'fallback' ELSE 'path' END AS comment
  FROM act a JOIN act b ON b.doc_id = a.doc_id AND a.idx < b.idx LEFT JOIN reach r ON r.doc_id = a.doc_id AND r.s = a.idx AND r.t = b.idx
  WHERE NOT EXISTS (SELECT 1 FROM touched k WHERE k.doc_id = a.doc_id AND k.x = a.idx AND k.y = b.idx)),
final AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, least(s, t), greatest(s, t), relation_type, comment ORDER BY s, t) AS n FROM (SELECT * FROM known UNION ALL SELECT * FROM rest) WHERE s <> t) WHERE n = 1)"""


def composed_relations(spark, d, by_month=False):
    rel, _, _ = ops.activity_relations(*graph(spark, d, by_month))
    return rel.select("doc_id", idx("a1", "s"), idx("a2", "t"), "relation_type", "comment")


@query("g16_activity_relations", sql(ALL_RELATIONS, "SELECT doc_id, s, t, relation_type, comment FROM final", True))
def g16(spark, d):
    return composed_relations(spark, d)


@query("g11_directly_following", sql(ALL_RELATIONS, "SELECT doc_id, s, t, relation_type, comment FROM final WHERE relation_type = 'directly_following'", True))
def g11(spark, d):
    return g16(spark, d).filter("relation_type = 'directly_following'")


@query("g12_branch_relations", sql(ALL_RELATIONS, "SELECT doc_id, s, t, relation_type, comment FROM final WHERE comment = 'branch'", True))
def g12(spark, d):
    return g16(spark, d).filter("comment = 'branch'")


@query("a3_branch_lengths", sql(monthly(BRANCH), "SELECT count(*) AS n, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS std, min(b) AS min, quantile_cont(b, 0.25) AS p25, quantile_cont(b, 0.5) AS p50, quantile_cont(b, 0.75) AS p75, max(b) AS max FROM (SELECT count(DISTINCT x) AS b FROM branch GROUP BY doc_id, g, st)", True))
def a3(spark, d):
    lengths = ops.branch_lengths(ops.activity_relations(*graph(spark, d, True))[2])
    p = lambda q: F.percentile("branch_length", q).alias(f"p{int(q * 100)}")
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("branch_length"), 6).alias("mean"), F.round(F.stddev_samp("branch_length"), 6).alias("std"), F.min("branch_length").alias("min"), p(0.25), p(0.5), p(0.75), F.max("branch_length").alias("max"))


