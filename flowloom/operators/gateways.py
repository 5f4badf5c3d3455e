"""Activity relations to gateways: split and merge points, branches, votes.

Relations are ``doc_id, a1, a2, relation_type, ord`` with activities of any comparable type whose
order is the order of the text (entities are: sentence first, then token).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.documents import by_document, keyed, value_of
from ..functions.shared import stored
from ..schemas import CONCURRENT, DIRECTLY, EXCLUSIVE, RELATION_LABELS


def directly(relations: DataFrame) -> DataFrame:
    return relations.filter(F.col("relation_type") == DIRECTLY).select("doc_id", "a1", "a2", "ord")


def with_start(df_relations: DataFrame, start: Column) -> DataFrame:
    """Adds edges from the artificial ``start`` to every activity that nothing leads to."""
    firsts = df_relations.select("doc_id", "a1").distinct().join(df_relations.select("doc_id", F.col("a2").alias("a1")), ["doc_id", "a1"], "left_anti")
    kind = df_relations.schema["a1"].dataType
    # in the order of the text, before all others: ord ends at -1, however many starts there are
    edges = firsts.select("doc_id", start.cast(kind).alias("a1"), F.col("a1").alias("a2"), (-F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("a1")))).cast("long").alias("ord"))
    return edges.unionByName(df_relations.select("doc_id", "a1", "a2", F.col("ord").cast("long").alias("ord")))


def _members(c: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("x")))), lambda r: r["x"])


def split_points(df_relations: DataFrame) -> DataFrame:
    """``doc_id, ord, pointing, receiving``: activities with several successors, those in order."""
    g = df_relations.groupBy("doc_id", "a1").agg(F.min("ord").alias("ord"), _members("a2").alias("receiving"))
    return g.filter(F.size("receiving") > 1).select("doc_id", "ord", F.array("a1").alias("pointing"), "receiving")


def merge_points(df_relations: DataFrame) -> DataFrame:
    """The mirror image: activities with several predecessors."""
    g = df_relations.groupBy("doc_id", "a2").agg(F.min("ord").alias("ord"), _members("a1").alias("pointing"))
    return g.filter(F.size("pointing") > 1).select("doc_id", "ord", "pointing", F.array("a2").alias("receiving"))


def merge_candidates(points: DataFrame, same: str) -> DataFrame:
    """Points of a document with equal ``same`` lists become one; the other lists follow in order."""
    other = "pointing" if same == "receiving" else "receiving"
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(other).alias("x")))), lambda r: r["x"])
    g = points.groupBy("doc_id", same).agg(F.min("ord").alias("ord"), F.flatten(listed).alias(other))
    return g.select("doc_id", "ord", "pointing", "receiving")


def pair_points(splits: DataFrame, merges: DataFrame) -> DataFrame:
    """``doc_id, gateway_idx, split, merge``: points in the order of their earliest pointing activity,
    splits first; a merge closes the newest open split and is ignored if there is none. A fold over
    the few points of a document."""
    point = lambda k: F.struct(F.array_min("pointing").alias("at"), F.lit(k).alias("merge"), "ord", "pointing", "receiving").alias("p")
    points = splits.select("doc_id", point(0)).unionByName(merges.select("doc_id", point(1)))
    docs = points.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("points"))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<split:int,merge:int>>").alias("pairs"), F.lit(0).alias("i"))

    def step(s, p):
        top = F.element_at(s["open"], -1)
        closes = (p["merge"] == 1) & (F.size(s["open"]) > 0)
        return F.struct(
            F.when(p["merge"] == 0, F.concat(s["open"], F.array(s["i"]))).when(closes, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"]).alias("open"),
            F.when(closes, F.concat(s["pairs"], F.array(F.struct(top.alias("split"), s["i"].alias("merge"))))).otherwise(s["pairs"]).alias("pairs"),
            (s["i"] + 1).alias("i"),
        )

    docs = docs.withColumn("pairs", F.aggregate("points", start, step, lambda s: s["pairs"]))
    rows = docs.select("doc_id", "points", "pairs", F.posexplode("points").alias("i", "split")).filter("split.merge = 0")
    mine = F.get(F.filter("pairs", lambda x: x["split"] == F.col("i")), F.lit(0))
    rows = rows.withColumn("merge", F.when(mine.isNotNull(), F.get("points", mine["merge"])))
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.pointing", f"{c}.receiving")).alias(c)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1
    return rows.select("doc_id", order.alias("gateway_idx"), side("split"), side("merge"))


def branch_starts(gateways: DataFrame) -> DataFrame:
    """``doc_id, gateway_idx, branch, start``: what the split leads to but the merge does not."""
    stop = F.coalesce(F.col("merge.receiving"), F.slice("split.receiving", 1, 0))
    kept = F.filter("split.receiving", lambda a: ~F.array_contains(stop, a))
    return gateways.select("doc_id", "gateway_idx", F.posexplode(kept).alias("branch", "start"))


def _depth_first(what: list, gateway: list, branch: list, x: list, y: list, stops: list, _: list):
    """Members of each branch of a document: ``what`` is 0 for a hop from ``x`` to ``y``, 1 for a start ``x``."""
    after: dict = {}
    for w, a, b in zip(what, x, y):
        if not w:
            after.setdefault(a, []).append(b)
    for w, g, n, start, stop in zip(what, gateway, branch, x, stops):
        if w:
            yield from ((g, n, a, i) for i, a in enumerate(paths.depth_first(start, after, set(stop or ()))))


def full_branches(gateways: DataFrame, df_relations: DataFrame) -> DataFrame:
    """``doc_id, gateway_idx, branch, a, ord``: each branch start with all successors before the merge
    activities, in depth-first order: an activity, then all that its first successor leads to, and so on, by
    the order of the relations. One scan by document; cycles are walked once."""
    none = lambda kind: F.lit(None).cast(kind)
    hops = df_relations.select("doc_id", F.lit(0).alias("what"), none("int").alias("gateway_idx"), none("int").alias("branch"), keyed("a1").alias("x"), keyed("a2").alias("y"), none("array<string>").alias("stops"), "ord")
    merge = F.transform("merge.receiving", lambda a: F.to_json(F.struct(a.alias("v"))))
    starts = branch_starts(gateways).join(gateways.select("doc_id", "gateway_idx", merge.alias("stops")), ["doc_id", "gateway_idx"])
    starts = starts.select("doc_id", F.lit(1).alias("what"), F.col("gateway_idx").cast("int").alias("gateway_idx"), "branch", keyed("start").alias("x"), none("string").alias("y"), "stops", none("long").alias("ord"))
    found = by_document(hops.unionByName(starts), _depth_first, "gateway_idx int, branch int, k string, ord int", ("what", "ord", "gateway_idx", "branch"))
    return found.select("doc_id", "gateway_idx", "branch", value_of("k", df_relations.schema["a1"].dataType).alias("a"), "ord")


def lookup(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """``pairs`` (``doc_id, a1, a2``) with the first relation of the pair in either direction;
    ``relation_type`` is null where there is none."""
    norm = lambda df: df.withColumn("x", F.least("a1", "a2")).withColumn("y", F.greatest("a1", "a2"))
    first = norm(relations).groupBy("doc_id", "x", "y").agg(F.min_by("relation_type", "ord").alias("relation_type"))
    return norm(pairs).join(first, ["doc_id", "x", "y"], "left").drop("x", "y")


def branch_relations(branches: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations of activities in different branches of a gateway, in branch and member order."""
    left = branches.select("doc_id", "gateway_idx", F.col("branch").alias("b1"), F.col("a").alias("a1"), F.col("ord").alias("o1"))
    right = branches.select("doc_id", "gateway_idx", F.col("branch").alias("b2"), F.col("a").alias("a2"), F.col("ord").alias("o2"))
    pairs = left.join(right, ["doc_id", "gateway_idx"]).filter("b1 < b2").filter(F.col("a1") != F.col("a2"))
    return lookup(pairs, relations)


def vote(gateways: DataFrame, voted: DataFrame) -> DataFrame:
    """``doc_id, gateway_idx, type, confidence``: the majority of exclusive and concurrent votes, the
    first met on a tie; no votes at all give no type, no pairs an optional XOR."""
    order = F.struct("b1", "b2", "o1", "a1", "o2", "a2")
    is_ = lambda k: F.col("relation_type") == k
    counts = voted.groupBy("doc_id", "gateway_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_(EXCLUSIVE)).alias("x"), F.count_if(is_(CONCURRENT)).alias("c"), F.min(F.when(is_(EXCLUSIVE), order)).alias("fx"), F.min(F.when(is_(CONCURRENT), order)).alias("fc")
    )
    rows = gateways.join(counts, ["doc_id", "gateway_idx"], "left")
    xor = (F.col("x") > F.col("c")) | ((F.col("x") == F.col("c")) & (F.col("fx") < F.col("fc")))
    kind = F.when(F.col("n").isNull(), "XOR Gateway optional").when(F.greatest("x", "c") == 0, "no_gateway_relations").when(xor, "XOR Gateway").otherwise("AND Gateway")
    sure = F.when(F.col("n").isNull(), F.lit(1.0)).when(F.greatest("x", "c") == 0, F.lit(-1.0)).otherwise(F.round(F.greatest("x", "c") / F.col("n"), 4))
    return rows.withColumn("type", kind).withColumn("confidence", sure).drop("n", "x", "c", "fx", "fc")


def sized(gateways: DataFrame, branches: DataFrame) -> DataFrame:
    """Adds ``branches``, ``size`` (activities over all of them) and ``eval_type``, which folds the
    optional XOR into XOR."""
    by_branch = branches.groupBy("doc_id", "gateway_idx", "branch").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "a"))), lambda x: x["a"]).alias("m"))
    listed = by_branch.groupBy("doc_id", "gateway_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("branch", "m"))), lambda x: x["m"]).alias("branches"))
    rows = gateways.join(listed, ["doc_id", "gateway_idx"], "left")
    return rows.withColumn("size", F.coalesce(F.size(F.flatten("branches")), F.lit(0))).withColumn("eval_type", F.when(F.col("type") == "XOR Gateway optional", "XOR Gateway").otherwise(F.col("type")))


def extract_gateways(relations: DataFrame, start: Column, full_vote: bool = True) -> DataFrame:
    """All gateways of all documents from their activity relations."""
    df = stored(with_start(directly(relations), start), "directly")
    splits, merges = merge_candidates(split_points(df), "receiving"), merge_candidates(merge_points(df), "pointing")
    gates = stored(pair_points(splits, merges), "gateways")
    members = full_branches(gates, df) if full_vote else branch_starts(gates).withColumnRenamed("start", "a").withColumn("ord", F.lit(0))
    members = stored(members, "members")
    return sized(vote(gates, branch_relations(members, relations)), members)


def all_pairs(activities: DataFrame, most: int | None = None) -> DataFrame:
    """``doc_id, a1, a2`` in text order. Pairs grow with the square of a document: ``most`` bounds the
    distance in activities where a caller wants a window."""
    w = Window.partitionBy("doc_id").orderBy("a")
    rows = activities.withColumn("o", F.row_number().over(w))
    a, b = rows.select("doc_id", F.col("a").alias("a1"), F.col("o").alias("o1")), rows.select("doc_id", F.col("a").alias("a2"), F.col("o").alias("o2"))
    near = F.col("o1") < F.col("o2")
    return a.join(b, "doc_id").filter(near if most is None else near & (F.col("o2") - F.col("o1") <= most)).drop("o1", "o2")


def label_random(pairs: DataFrame, key: Column) -> DataFrame:
    """A uniformly random label that depends on ``key`` alone."""
    i = F.pmod(F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("long"), F.lit(len(RELATION_LABELS))).cast("int")
    return pairs.withColumn("relation_type", F.element_at(F.array(*map(F.lit, RELATION_LABELS)), i + 1))


def label_directly(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("relation_type", F.lit(DIRECTLY))
