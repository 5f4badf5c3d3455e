"""Cross-validated training of many classifiers at once: every fold and seed in one pass an epoch.

A member is a softmax regression over hashed words for one held-out fold and one seed. Each epoch is one Spark
job: tasks add up the gradients of all members over their rows and count what each predicts for its
own held-out fold; sums leave the tasks in slices and are added by key. The driver holds the members'
coefficients (members x features x classes, whatever the rows) and takes one adaptive step a pass.
Training writes its own history and stops a member when its measure no longer rises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from . import blocks

FEATURES = 1 << 12
#: Numbers of a slice of a member's gradient; rows that are scored at a time.
SLICE, BLOCK = 1 << 12, 1 << 12


def hashed(rows: DataFrame, words: str = "words", size: int = FEATURES) -> DataFrame:
    """``rows`` with ``features``: the hashed places of their words, 0 being that of all rows."""
    return rows.withColumn("features", F.concat(F.array(F.lit(0)), F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(size - 1)) + 1).cast("int"))))


def _probabilities(coefficients: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    scores = np.add.reduceat(coefficients[flat], first, axis=0)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat features, the first place and the number of each row's."""
    lists = batch.column(batch.schema.get_field_index("features"))
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets[:-1] - offsets[0], np.diff(offsets)


def _kept(keys: np.ndarray, seed: int) -> np.ndarray:
    """Which rows a seed trains on: four of five, by a hash of the row's key."""
    with np.errstate(over="ignore"):
        h = (keys.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40)) % np.uint64(5) != 0


def _equally_long(flat: np.ndarray, first: np.ndarray, n: np.ndarray):
    """(rows, their features as length x rows) for up to ``BLOCK`` rows with as many features at a time."""
    for length in np.unique(n).tolist():
        at = np.flatnonzero(n == length)
        for k in range(0, len(at), BLOCK):
            rows = at[k : k + BLOCK]
            yield rows, flat[first[rows] + np.arange(length)[:, None]]


def _pass(rows: DataFrame, members: list[tuple[int, int]], coefficients: np.ndarray, learn: bool = True, weights: tuple[float, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (0 without ``learn``) and confusion counts (label, prediction) of all members over all rows, or over
    :mod:`blocks` with the ``weights`` of their labels.
    The coefficients of all members for a feature lie side by side, so a row looks each feature up once."""
    m, size, classes = coefficients.shape
    side_by_side = np.ascontiguousarray(coefficients.transpose(1, 2, 0)).reshape(size, classes * m) if weights is None else blocks.against_first(coefficients).astype(np.float32)
    sent = rows.sparkSession.sparkContext.broadcast(side_by_side)
    given = size * classes if learn else 0

    def sums(batches):
        w = sent.value
        gradient, counts = np.zeros((classes * m, size)), np.zeros((m, classes * classes))
        for b in batches:
            fold, label, weight, key = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("fold", "label", "weight", "key"))
            kept = {seed: weight * _kept(key, seed) for _, seed in members}
            for at, features in _equally_long(*_columns(b)):
                p, one = np.zeros((len(at), classes * m)), np.empty((len(at), classes * m))
                for f in features:
                    p += np.take(w, f, axis=0, out=one, mode="clip")
                p = p.reshape(len(at), classes, m)
                p -= p.max(axis=1, keepdims=True)
                np.exp(p, out=p)
                p /= p.sum(axis=1, keepdims=True)
                for i, (out, _) in enumerate(members):
                    held = np.flatnonzero(fold[at] == out)
                    counts[i] += np.bincount(label[at[held]] * classes + p[held, :, i].argmax(axis=1), minlength=classes * classes)
                if not learn:
                    continue
                p[np.arange(len(at)), label[at]] -= 1
                p *= np.stack([kept[seed][at] * (fold[at] != out) for out, seed in members], axis=1)[:, None]
                places, sides = features.ravel(), np.ascontiguousarray(p.reshape(len(at), classes * m).T)
                for g, side in zip(gradient, sides):
                    g += np.bincount(places, np.tile(side, len(features)), size)
        return gradient, counts

    def sums_of_blocks(batches):
        gradient, counts = np.zeros((classes, m, size)), np.zeros((m, classes, classes))
        for block in blocks.opened(batches):
            blocks.add_gradients(gradient[1:], counts, block, members, sent.value, np.asarray(weights), _kept, learn)
        gradient[0] = -gradient[1:].sum(axis=0)
        return gradient, counts.reshape(m, -1)

    def run(batches):
        gradient, counts = (sums if weights is None else sums_of_blocks)(batches)
        for i in range(m):
            whole = np.concatenate([gradient.reshape(classes, m, size)[:, i].T.ravel()[:given], counts[i]])
            for k in range(0, len(whole), SLICE):
                part = pa.array([whole[k : k + SLICE]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([k], pa.int32()), part], names=["member", "at", "part"])

    parts = rows.mapInArrow(run, "member int, at int, part array<double>").withColumn("v", array_to_vector("part"))
    sums = parts.groupBy("member", "at").agg(Summarizer.sum(F.col("v")).alias("v")).select("member", "at", vector_to_array("v").alias("part")).collect()
    sent.destroy()
    whole = np.zeros((m, given + classes * classes))
    for r in sums:
        whole[r.member, r["at"] : r["at"] + len(r.part)] = r.part
    gradient = whole[:, :given].reshape(m, size, classes) if learn else np.zeros((m, size, classes))
    return gradient, whole[:, given:].reshape(m, classes, classes)


def measures(counts: np.ndarray, positive: list[int]) -> tuple[float, float, float]:
    """Precision, recall and F1 over the classes ``positive`` together; 0 where there is nothing to divide by."""
    hit = sum(counts[c, c] for c in positive)
    said, there = counts[:, positive].sum(), counts[positive].sum()
    p, r = (hit / said if said else 0.0), (hit / there if there else 0.0)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


class Trained:
    """``members`` (fold, seed), their ``coefficients``, and ``history``: ``fold, seed, epoch, metric, value``."""

    def __init__(self, members: list, coefficients: np.ndarray, history: DataFrame):
        self.members, self.coefficients, self.history = members, coefficients, history


def cross_validate(rows: DataFrame, classes: int, positive: list[int], folds: int = 5, seeds: tuple[int, ...] = (0, 1, 2), epochs: int = 10, patience: int = 1, min_delta: float = 1e-4, rate: float = 0.5, size: int = FEATURES, weights: tuple[float, ...] | None = None) -> Trained:
    """Train a member for each fold and seed on stored ``rows`` (``fold, label, weight, key, features``), or on stored
    :mod:`blocks` with the ``weights`` of their labels.

    A member sees four fifths of the rows of the other folds, chosen by seed and ``key``, and starts from small
    numbers drawn by its seed. After every epoch it predicts its own fold; once F1 has not risen by more than
    ``min_delta`` over the best before for ``patience`` epochs in a row it is left as it is, so its last
    epoch in the history is the one it stopped at. Labels are 0 to ``classes`` - 1; null labels are left
    out; a fold without rows has measures 0.
    """
    if weights is None:
        rows = rows.filter("label IS NOT NULL").select("fold", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), F.col("key").cast("long").alias("key"), F.col("features").cast("array<int>").alias("features"))
    members = [(f, s) for f in range(folds) for s in seeds]
    w = np.stack([np.random.default_rng(1000 + s).normal(0, 0.01, (size, classes)) for _, s in members])
    squares = np.zeros_like(w)
    best, idle, history = np.full(len(members), -np.inf), np.zeros(len(members), int), []
    active = list(range(len(members)))
    for epoch in range(-1, epochs):
        gradient, counts = _pass(rows, [members[i] for i in active], w[active], epoch + 1 < epochs, weights)
        going = []
        for k, i in enumerate(active):
            if epoch >= 0:
                p, r, f1 = measures(counts[k], positive)
                history += [(*members[i], epoch, name, float(v)) for name, v in (("precision", p), ("recall", r), ("f1", f1))]
                idle[i] = 0 if f1 > best[i] + min_delta else idle[i] + 1
                best[i] = max(best[i], f1)
            if idle[i] < patience and epoch + 1 < epochs:
                squares[i] += gradient[k] ** 2
                w[i] -= rate * gradient[k] / (np.sqrt(squares[i]) + 1e-8)
                going.append(i)
        active = going
        if not active:
            break
    schema = StructType([*(StructField(c, IntegerType()) for c in ("fold", "seed", "epoch")), StructField("metric", StringType()), StructField("value", DoubleType())])
    return Trained(members, w, rows.sparkSession.createDataFrame(history, schema))


def block_ensemble(trained: Trained, rows: DataFrame) -> DataFrame:
    """``doc_id, sentence_idx, token_idx, fold, label, scores, predicted`` of each token of :mod:`blocks`, as
    :func:`ensemble` has them."""
    members = trained.members
    sent = rows.sparkSession.sparkContext.broadcast(blocks.against_first(trained.coefficients).astype(np.float32))

    def score(batches):
        w = sent.value
        for block in blocks.opened(batches):
            for fold, at, p in blocks.probabilities(block, w, len(members)):
                mean = p[:, [i for i, (f, _) in enumerate(members) if f == fold]].mean(axis=1)
                scores = pa.FixedSizeListArray.from_arrays(pa.array(mean.T.ravel()), len(mean)).cast(pa.list_(pa.float64()))
                more = [np.full(at.stop - at.start, fold, np.int32), block.labels[at].astype(np.int32), scores, mean.argmax(axis=0).astype(np.int32)]
                yield blocks.token_rows(block, at, more, ["fold", "label", "scores", "predicted"])

    return rows.mapInArrow(score, "doc_id long, sentence_idx int, token_idx int, fold int, label int, scores array<double>, predicted int")


def held_out(trained: Trained, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fold, label, seed, scores, predicted``: each row scored by the members that did not see its fold,
    a row for each seed."""
    return _scored(trained, rows, keys, "seed int, scores array<double>, predicted int", False)


def ensemble(trained: Trained, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fold, label, scores, predicted``: the mean over the seeds that did not see the row's fold and its
    best class (the smaller on a tie); all members are scored in one pass over the rows."""
    return _scored(trained, rows, keys, "scores array<double>, predicted int", True)


def _scored(trained: Trained, rows: DataFrame, keys: list[str], more: str, mean: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((trained.members, trained.coefficients))
    own = [*keys, "fold", "label"]
    schema = StructType([rows.schema[c] for c in own])
    for f in StructType.fromDDL(more):
        schema.add(f)

    def score(batches):
        members, w = sent.value
        for b in batches:
            flat, first, n = _columns(b)
            fold = b.column(b.schema.get_field_index("fold")).to_numpy()
            for out in np.unique(fold).tolist():
                at = np.flatnonzero(fold == out)
                mine = np.repeat(first[at], n[at]) + np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
                start = np.cumsum(n[at]) - n[at]
                found = [(s, _probabilities(w[i], flat[mine], start)) for i, (f, s) in enumerate(members) if f == out]
                for s, p in [(None, np.mean([p for _, p in found], axis=0))] if mean else found:
                    columns = [b.column(b.schema.get_field_index(c)).take(pa.array(at)) for c in own]
                    columns += [] if mean else [pa.array(np.full(len(at), s, np.int32))]
                    columns += [pa.array(list(p), pa.list_(pa.float64())), pa.array(p.argmax(axis=1).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(*own, "features").mapInArrow(score, schema)


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """A fold by a hash of ``key`` alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")
