"""Model scoring on Spark ML, ensembles, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import SMALL_ROWS, broadcast_if


def token_features(tokens: DataFrame, width: int = 2) -> DataFrame:
    """``words``: each token with its neighbours in the sentence, marked by their offset."""
    w = Window.partitionBy("doc_id", "sentence_idx").orderBy("token_idx")
    near = [F.concat(F.lit(f"{i}="), F.lower(F.coalesce(F.lag("token", -i).over(w) if i < 0 else F.lead("token", i).over(w) if i else F.col("token"), F.lit("-")))) for i in range(-width, width + 1)]
    return tokens.withColumn("words", F.array(*near))


def sentence_features(sents: DataFrame, width: int = 2) -> DataFrame:
    """The rows of :func:`token_features` for whole sentences (``doc_id, sentence_idx, tokens, ner_tags``): their
    neighbours stand in the same array, so nothing is shuffled."""
    low = sents.withColumn("low_", F.transform("tokens", lambda w: F.lower(w)))
    near = lambda i: F.array(*(F.concat(F.lit(f"{k}="), F.coalesce(F.get("low_", i + k), F.lit("-"))) for k in range(-width, width + 1)))
    rows = F.transform("tokens", lambda w, i: F.struct(i.alias("token_idx"), w.alias("token"), F.get("ner_tags", i).alias("ner_tag"), near(i).alias("words")))
    return low.select("doc_id", "sentence_idx", F.explode(rows).alias("z")).select("doc_id", "sentence_idx", "z.*")


def text_pipeline(label: str = "label", weight: str | None = None, features: int = 1 << 14, iterations: int = 20):
    """Hashed word counts into logistic regression; binary or multinomial by the labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    counts = HashingTF(inputCol="words", outputCol="features", numFeatures=features)
    model = LogisticRegression(labelCol=label, maxIter=iterations, regParam=1e-3)
    return Pipeline(stages=[counts, model.setWeightCol(weight) if weight else model])


def fit_tokens(tokens: DataFrame, width: int = 2, **options):
    """Token-class scorer of rows with ``label`` and ``weight``, which may have their ``words`` already."""
    rows = tokens if "words" in tokens.columns else token_features(tokens, width)
    return text_pipeline(weight="weight", **options).fit(rows)


def full_training(tokens: DataFrame, path: str, width: int = 2, **options):
    """The token-class scorer fitted on all rows, none held back, stored at ``path`` and read again."""
    from pyspark.ml import PipelineModel

    fit_tokens(tokens, width, **options).write().overwrite().save(path)
    return PipelineModel.load(path)


def fit_texts(rows: DataFrame, **options):
    """Pair or relation scorer of rows with ``text`` and ``label``."""
    return text_pipeline(**options).fit(text_words(rows))


def text_words(rows: DataFrame) -> DataFrame:
    """``words``: the words of ``text`` and its pairs of neighbours."""
    rows = rows.withColumn("words", F.split(F.lower("text"), " "))  # a column: the lambda reads it for every pair
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, 2), " "))
    return rows.withColumn("words", F.concat("words", two))


def scores(model, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, class, score`` of a fitted pipeline: one row for each class."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows).select(*keys, F.posexplode(vector_to_array("probability")).alias("class", "score"))
    return out


def ensemble(member_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of each class over the members, and the best class (the smaller on a tie)."""
    mean = member_scores.groupBy(*keys, "class").agg(F.avg("score").alias("score"))
    return mean.groupBy(*keys).agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("class"), F.max("score").alias("score"))


def accepted(member_scores: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Binary ensemble: ``positive`` where the mean score exceeds the threshold."""
    return member_scores.groupBy(*keys).agg(F.avg("score").alias("score")).withColumn("positive", F.col("score") > threshold)


def word_labels(piece_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces to words: the best class of each piece (the smaller on a tie), then the highest class
    among the pieces of a word."""
    piece = piece_scores.groupBy(*keys, "piece").agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("class"))
    return piece.groupBy(*keys).agg(F.max("class").alias("label"))


def fold_metrics(history: DataFrame, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(by fold, averages)`` of ``fold, seed, epoch, metric, value``: a fold's value is the mean of its
    seeds' last epochs; F1 comes from precision and recall."""
    last = history.groupBy("fold", "seed", "metric").agg(F.max_by("value", "epoch").alias("value"))
    wide = last.groupBy("fold").pivot("metric", ["precision", "recall"]).agg(F.avg("value"))
    p, r = F.col("precision"), F.col("recall")
    folds = wide.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))
    return folds, folds.agg(*(F.round(F.avg(c), digits).alias(f"avg_{c}") for c in ("precision", "recall", "f1")))


def mean_history(history: DataFrame) -> DataFrame:
    """Mean over seeds for each metric and epoch."""
    return history.groupBy("metric", "epoch").agg(F.avg("value").alias("value"))


def last_epochs(history: DataFrame) -> DataFrame:
    """The last epoch's value for each fold, metric and seed."""
    return history.groupBy("fold", "metric", "seed").agg(F.max_by("value", "epoch").alias("value"))


def stopping_epoch(history: DataFrame, monitor: str, patience: int = 1, min_delta: float = 1e-4) -> DataFrame:
    """``fold, seed, epoch`` at which training stops: the first epoch from which ``patience`` epochs in
    a row brought no gain of more than ``min_delta`` over the best before, else the last."""
    w = Window.partitionBy("fold", "seed").orderBy("epoch")
    best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.filter(F.col("metric") == monitor).withColumn("gain", F.coalesce(F.col("value") > best + min_delta, F.lit(True)))
    run = F.sum(F.col("gain").cast("int")).over(w)
    rows = rows.withColumn("run", run).withColumn("idle", F.row_number().over(Window.partitionBy("fold", "seed", "run").orderBy("epoch")) - 1)
    return rows.groupBy("fold", "seed").agg(F.coalesce(F.min(F.when(F.col("idle") >= patience, F.col("epoch"))), F.max("epoch")).alias("epoch"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs between two runs, as ``old`` and ``new``."""
    both = a.select(*keys, F.col(value).alias("old")).join(b.select(*keys, F.col(value).alias("new")), keys)
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def label_names(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Predicted label numbers back to names through a small label table."""
    return rows.join(broadcast_if(labels, SMALL_ROWS), "label", "left")


def gold_flags(pairs: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` with ``gold``: whether the listed relations hold the same keys."""
    return pairs.join(gold.select(*keys).distinct().withColumn("g_", F.lit(True)), keys, "left").withColumn("gold", F.coalesce("g_", F.lit(False))).drop("g_")


def describe(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, standard deviation, minimum, quartiles and maximum of ``value``."""
    q: list[Column] = [F.percentile(value, p).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *q, F.max(value).alias("max"))
