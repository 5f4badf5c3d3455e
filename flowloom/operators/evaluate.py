"""Scores of predictions against gold: counts by class, averages, matching, confusion, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import by_document
from ..functions.metrics import metric_row, ratio


def class_scores(rows: DataFrame, classes: list, truth: str = "y", predicted: str = "p", by: tuple = ()) -> DataFrame:
    """Token precision, recall and F1 of each class; 0 where a denominator is 0."""
    c = F.explode(F.array(*map(F.lit, classes))).alias("class")
    hit = (F.col(truth) == F.col("class")) & (F.col(predicted) == F.col("class"))
    g = rows.select(*by, truth, predicted, c).groupBy(*by, "class").agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col(predicted) == F.col("class")).alias("predicted"), F.count_if(F.col(truth) == F.col("class")).alias("real")
    )
    p, r = ratio("tp", "predicted"), ratio("tp", "real")
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r))


def multiset_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``tp, fp, fn, support`` for each ``by``: rows match one to one where all ``keys`` are equal."""
    count = lambda df, n: df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count(F.lit(1)).alias(n))
    both = count(gold, "g").join(count(predicted, "p"), [*by, *[k for k in keys if k not in by]], "full_outer").fillna(0, ["g", "p"])
    tp = F.least("g", "p")
    return both.groupBy(*by).agg(F.sum(tp).alias("tp"), F.sum(F.col("p") - tp).alias("fp"), F.sum(F.col("g") - tp).alias("fn"), F.sum("g").alias("support"))


def count_benchmark(gold: DataFrame, predicted: DataFrame, docs: DataFrame, types: list[str], compat: bool = False, same: DataFrame | None = None) -> DataFrame:
    """Gateway counts by document and type: tp the smaller count, the rest missed or wrong. Gold counts
    are less by the same-gateway relations (``same``: ``doc_id, label`` of their sources), since what
    these relate is one gateway. ``compat`` books what is missing as false positives too where there are no more predictions than gold."""
    grid = empty_grid(docs, types)
    g = gold.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("g"))
    p = predicted.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("p"))
    rows = grid.join(g, ["doc_id", "label"], "left").join(p, ["doc_id", "label"], "left").fillna(0, ["g", "p"])
    if same is not None:
        s = same.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("same"))
        rows = rows.join(s, ["doc_id", "label"], "left").withColumn("g", F.col("g") - F.coalesce("same", F.lit(0))).drop("same")
    more = F.greatest(F.col("p") - F.col("g"), F.lit(0))
    fp = F.when(F.col("p") <= F.col("g"), F.col("g") - F.col("p")).otherwise(more) if compat else more
    rows = rows.select("doc_id", "label", F.least("g", "p").alias("tp"), fp.alias("fp"), F.greatest(F.col("g") - F.col("p"), F.lit(0)).alias("fn"), F.col("g").alias("support"))
    return metric_row(rows)


def average(rows: DataFrame, by: list[str], weighted: bool, digits: int = 2) -> DataFrame:
    """Averages of ``precision, recall, f1``: weighted by support (0 without any) or plain over the
    rows that have support; supports add up."""
    has, total = F.col("support") > 0, F.sum("support")

    def mean(m):
        out = F.when(total == 0, F.lit(0.0)).otherwise(F.sum(F.col(m) * F.col("support")) / total) if weighted else F.coalesce(F.avg(F.when(has, F.col(m))), F.lit(0.0))
        return F.round(out, digits).alias(m)

    return rows.groupBy(*by).agg(mean("precision"), mean("recall"), mean("f1"), total.alias("support"))


def keyword_confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """For each ``keyword``: matches and misses by multiset in each document, and in how many
    documents each kind occurs."""
    n = lambda df, c: df.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias(c))
    both = n(gold, "g").join(n(predicted, "p"), ["doc_id", "keyword"], "full_outer").fillna(0, ["g", "p"])
    tp = F.least("g", "p")
    both = both.select("doc_id", "keyword", tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("g") - tp).alias("fn"))
    docs = [F.count_if(F.col(c) > 0).alias(f"{c}_docs") for c in ("tp", "fp", "fn")]
    return both.groupBy("keyword").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *docs)


def _forms(words: list, width: int) -> set:
    """Lower-case forms of a token list with up to ``width`` tokens dropped on each side, never all."""
    w = tuple(x.lower() for x in words)
    return {w[i : len(w) - j] for i in range(width + 1) for j in range(width + 1) if i + j < len(w)} | {w}


def _greedy(width: int):
    """One-to-one matching of a document's relations, label by label: a queue of predictions for each pair
    of forms, from which a gold relation takes the first that is free."""

    def run(side: list, label: list, _: list, source: list, target: list):
        number: dict = {}
        of = lambda words: [number.setdefault(f, len(number)) for f in _forms(words, width)]
        found = [[(a, b) for a in of(s) for b in of(t)] for s, t in zip(source, target)]
        labels: dict = {}
        for i, name in enumerate(label):
            labels.setdefault(name, ([], []))[side[i]].append(i)
        for name, (gold, predicted) in labels.items():
            queues: dict = {}
            for k, i in enumerate(predicted):
                for pair in found[i]:
                    queues.setdefault(pair, []).append(k)
            at, taken, tp = dict.fromkeys(queues, 0), bytearray(len(predicted)), 0
            for i in gold:
                first = None
                for pair in found[i]:
                    queue = queues.get(pair, ())
                    n = at.get(pair, 0)
                    while n < len(queue) and taken[queue[n]]:
                        n += 1
                    if n < len(queue):
                        first = queue[n] if first is None else min(first, queue[n])
                    if queue:
                        at[pair] = n
                if first is not None:
                    taken[first] = 1
                    tp += 1
            yield name, tp, len(predicted) - tp, len(gold) - tp

    return run


def relaxed_matches(gold: DataFrame, predicted: DataFrame, width: int = 1) -> DataFrame:
    """``doc_id, label, tp, fp, fn`` with one-to-one greedy matching in gold order of relations
    (``doc_id, label, ord, source, target`` as token arrays): lists match if equal in lower case after
    dropping up to ``width`` tokens on the left and right of either. Documents pass in one scan, and the
    work follows their relations, not the pairs of them; relations without a list are left out."""
    side = lambda df, n: df.filter("source IS NOT NULL AND target IS NOT NULL").select("doc_id", F.lit(n).alias("side"), "label", F.col("ord").cast("long").alias("ord"), "source", "target")
    return by_document(side(gold, 0).unionByName(side(predicted, 1)), _greedy(width), "label string, tp long, fp long, fn long", ("side", "ord"))


def empty_grid(docs: DataFrame, labels: list[str]) -> DataFrame:
    """``doc_id, label`` for every document and every one of the few labels."""
    return docs.select("doc_id", F.explode(F.array(*map(F.lit, labels))).alias("label"))


def micro(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 from summed counts, for each label and (label null) overall."""
    g = rows.rollup("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return metric_row(g, 6)


def macro(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(by label, overall)``: means over documents, then over labels."""
    m = ["precision", "recall", "f1"]
    by = rows.groupBy("label").agg(*(F.avg(c).alias(c) for c in m))
    return by, by.agg(*(F.avg(c).alias(c) for c in m))


def weighted(rows: DataFrame) -> DataFrame:
    """Means weighted by support, for each label and overall; null where the weight is zero."""
    total = F.sum("support")
    return rows.rollup("label").agg(*(F.when(total != 0, F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")), total.alias("support"))


def supports(rows: DataFrame) -> DataFrame:
    return rows.rollup("label").agg(F.sum("support").alias("support"))


def gold_by_type(elements: DataFrame) -> DataFrame:
    """``doc_id, entity_type, items``: the gold phrases of each document and type, sorted."""
    return elements.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(F.array_join("tokens", " "))).alias("items"))


def by_distance(rows: DataFrame, limits: list[int]) -> DataFrame:
    """Scores of relation labels (``label, predicted, distance``) within each distance limit."""
    n = rows.select("label", "predicted", "distance", F.explode(F.array(*map(F.lit, limits))).alias("n")).filter("distance <= n")
    each = n.select("n", F.explode(F.array_distinct(F.array(F.struct(F.col("label").alias("l")), F.struct(F.col("predicted").alias("l"))))).alias("x"), "label", "predicted").select("n", "x.l", "label", "predicted")
    g = each.groupBy("n", "l").agg(F.count_if((F.col("label") == F.col("l")) & (F.col("predicted") == F.col("l"))).alias("tp"), F.count_if((F.col("label") != F.col("l"))).alias("fp"), F.count_if((F.col("predicted") != F.col("l"))).alias("fn"))
    return metric_row(g.withColumnRenamed("l", "label"))
