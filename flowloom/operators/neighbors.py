"""As-of neighbours of gateways among activities, adjacent gateways, contradictory pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(gateways: DataFrame, activities: DataFrame) -> DataFrame:
    """``gateways`` (``doc_id, s, t, ...``) with ``pa, ppa, fa, ffa``: the activities strictly before
    and after in text order, as ``(s, t, tokens)``, null at the ends of a document.

    One union, one partitioning by document and running windows; no inequality join.
    """
    keep = [c for c in gateways.columns if c not in ("doc_id", "s", "t")]
    w = Window.partitionBy("doc_id").orderBy("s", "t")
    me = F.struct("s", "t", "tokens")
    acts = activities.select("doc_id", "s", "t", me.alias("a")).select("*", F.lag("a").over(w).alias("before"), F.lead("a").over(w).alias("next"))
    acts = acts.select("doc_id", "s", "t", F.lit(0).alias("side"), F.struct("a", "before", "next").alias("act"), F.lit(None).alias("g"))
    gates = gateways.select("doc_id", "s", "t", F.lit(1).alias("side"), F.lit(None).alias("act"), F.struct(*keep).alias("g"))
    rows = acts.unionByName(gates)
    # at one place the gateway comes first looking back and last looking ahead: neighbours are strict
    back = F.last("act", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("s", "t", F.desc("side")).rowsBetween(Window.unboundedPreceding, -1))
    # both frames run from the start of their order: each row adds to the last one's result
    ahead = F.last("act", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(F.desc("s"), F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("p", back).withColumn("f", ahead).filter("side = 1")
    return rows.select("doc_id", "s", "t", "g.*", F.col("p.a").alias("pa"), F.col("p.before").alias("ppa"), F.col("f.a").alias("fa"), F.col("f.next").alias("ffa"))


def adjacent(gateways: DataFrame, threshold: int | None = 1) -> DataFrame:
    """Every gateway with the next one of its document (``n_s, n_t, n_low``) and their sentence
    ``distance``; only those within ``threshold`` sentences unless it is None."""
    w = Window.partitionBy("doc_id").orderBy("s", "t")
    rows = gateways.select("*", F.row_number().over(w).alias("o"), F.lead("s").over(w).alias("n_s"), F.lead("t").over(w).alias("n_t"), F.lead("low").over(w).alias("n_low"))
    rows = rows.filter("n_s IS NOT NULL").withColumn("distance", F.col("n_s") - F.col("s"))
    return rows if threshold is None else rows.filter(F.col("distance") <= threshold)


def contradictory(gateways: DataFrame, pairs: list[tuple[str, str]], threshold: int = 1, multiple: bool = False) -> DataFrame:
    """The adjacent gateways whose lower-case phrases are a listed pair and whose first opens its
    sentence. Unless ``multiple``, a gateway serves in one pair: a match conflicts only with the
    match just before it, so of each run of consecutive matches the odd ones stand."""
    listed = F.array(*(F.lit(f"{a}\n{b}") for a, b in pairs))
    hit = adjacent(gateways, threshold).filter("t = 0").filter(F.array_contains(listed, F.concat_ws("\n", F.array_join("low", " "), F.array_join("n_low", " "))))
    if multiple:
        return hit
    run = F.col("o") - F.row_number().over(Window.partitionBy("doc_id").orderBy("o"))
    place = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("o"))
    return hit.withColumn("run", run).withColumn("place", place).filter("place % 2 = 1").drop("run", "place")
