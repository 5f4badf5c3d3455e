"""Analyses of classified pairs and of runs: one scan for all groupings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that classified pairs are grouped by, and the groupings of them.
BY = ("label", "real_label", "match", "start1", "start2", "pair")
GROUPINGS = (("label",), ("real_label",), ("label", "real_label"), ("match",), ("match", "label"), ("label", "start1", "start2"), ("real_label", "start1", "start2"), ("pair", "label", "match"), ())


def spread(values: Column) -> Column:
    """Population variance of the numbers in an array; null for none."""
    total = lambda f: F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))
    n = F.size(values)
    mean = total(lambda x: x) / n
    return F.when(n > 0, total(lambda x: (x - mean) * (x - mean)) / n)


def classification_cube(rows: DataFrame, groupings: tuple = GROUPINGS) -> DataFrame:
    """Counts and statistics of classified pairs for every grouping, from one scan.

    ``rows`` have ``label, real_label, predictions`` (one score for each member), ``distance`` (sentences),
    ``start1, start2`` (whether each stands first in its sentence) and ``pair``. A row of the result has the
    columns of its ``grouping``, null in the others: ``n``, mean and standard deviation of the mean score,
    mean, deviation, least and greatest distance, mean and greatest variance and mean deviation over members.
    """
    mean = F.try_divide(F.aggregate("predictions", F.lit(0.0), lambda s, x: s + x), F.size("predictions"))
    rows = rows.withColumn("match", F.col("label").eqNullSafe(F.col("real_label"))).withColumn("score", mean).withColumn("var", spread(F.col("predictions")))
    found = rows.groupingSets([[F.col(c) for c in g] for g in groupings], *(F.col(c) for c in BY)).agg(
        F.grouping_id(*BY).alias("gid"), F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"),
        F.avg("distance").alias("distance_mean"), F.stddev_pop("distance").alias("distance_std"), F.min("distance").alias("distance_min"), F.max("distance").alias("distance_max"),
        F.avg("var").alias("var_mean"), F.max("var").alias("var_max"), F.avg(F.sqrt("var")).alias("std_mean"),
    )
    bit = {c: 1 << (len(BY) - 1 - i) for i, c in enumerate(BY)}
    everything = sum(bit.values())
    name = reduce(lambda w, g: w.when(F.col("gid") == everything - sum(bit[c] for c in g), F.lit("+".join(g) or "all")), groupings, F.when(F.lit(False), F.lit("")))
    return found.withColumn("grouping", name).drop("gid")


def extreme_predictions(rows: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """``list, keys, score``: the surest predictions of each label, ``best``, and the surest wrong ones, ``worst``,
    at most ``most`` of each; ties by ``keys``."""
    sure = F.when(F.col("label") == 1, F.col("score")).otherwise(-F.col("score"))
    lists = F.array(F.lit("best"), F.when(F.col("label") != F.col("real_label"), F.lit("worst")))
    each = rows.select(*keys, "label", "score", sure.alias("sure"), F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("list"))
    place = F.row_number().over(Window.partitionBy("list", "label").orderBy(F.desc("sure"), *keys))
    return each.withColumn("place", place).filter(F.col("place") <= most).select("list", "label", "place", *keys, "score")


def ranked_runs(history: DataFrame, run: list[str], metrics: tuple[str, ...], most: int = 4, where: Column | None = None) -> DataFrame:
    """``run, total, place``: the ``most`` runs with the greatest sum of the means of ``metrics``, among those that
    ``where`` selects (a condition on the run's parameters, so stored runs are pruned by it)."""
    chosen = history if where is None else history.filter(where)
    means = chosen.filter(F.col("metric").isin(*metrics)).groupBy(*run, "metric").agg(F.avg("value").alias("m"))
    total = means.groupBy(*run).agg(F.round(F.sum("m"), 6).alias("total"))
    top = total.orderBy(F.desc("total"), *run).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), *run)))


def variability(history: DataFrame, by: list[str]) -> DataFrame:
    """Mean, deviation and range of ``value`` for each of ``by``."""
    v = F.col("value")
    return history.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (F.max(v) - F.min(v)).alias("range"))
