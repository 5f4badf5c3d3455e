"""Softmax regression over blocks of rows (:mod:`blocks`, :mod:`stretches`): the objective and the steps of Spark ML's ``LogisticRegression``.

Spark ML keeps a vector for each row; here a pass reads some bytes of a word, tasks add up loss and
gradient, and the driver holds coefficients alone (classes x places, whatever the rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

#: Numbers of a slice of what tasks add up; past steps that a direction looks at.
SLICE, MEMORY = 1 << 12, 10


class Regression:
    """``coefficients`` (classes x places) and ``intercepts``."""

    def __init__(self, coefficients: np.ndarray, intercepts: np.ndarray):
        self.coefficients, self.intercepts = coefficients, intercepts

    def save(self, spark: SparkSession, path: str) -> None:
        """Parquet with a row for each place, and one for the intercepts at -1."""
        values = np.c_[self.intercepts, self.coefficients].T
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))
        table = pa.table([pa.array(np.arange(len(values)) - 1), lists], names=["place", "weights"])
        spark.createDataFrame(table).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Regression:
        values = np.array([r.weights for r in spark.read.parquet(path).orderBy("place").collect()]).T
        return Regression(np.ascontiguousarray(values[:, 1:]), values[:, 0].copy())


def _added(rows: DataFrame, work: Callable[[Iterator], np.ndarray], opened: Callable) -> np.ndarray:
    """The sum over all tasks of the numbers that ``work`` gives for a task's blocks."""

    def run(batches):
        whole = work(opened(batches))
        for k in range(0, len(whole), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([whole[k : k + SLICE]], pa.list_(pa.float64()))], names=["at", "part"])

    parts = rows.mapInArrow(run, "at int, part array<double>").withColumn("v", array_to_vector("part"))
    sums = parts.groupBy("at").agg(Summarizer.sum(F.col("v")).alias("v")).select("at", vector_to_array("v").alias("part")).collect()
    return np.concatenate([np.array(r.part) for r in sorted(sums, key=lambda r: r["at"])]) if sums else np.empty(0)


def _counted(rows: DataFrame, labels: int, size: int, opened: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each label the rows, and at each place the sums of their features and of the squares."""

    def work(found):
        n, sums, squares = np.zeros(labels), np.zeros((labels, size)), np.zeros((labels, size))
        for block in found:
            n += np.bincount(block.labels, minlength=labels)
            one, two = block.counted(labels, size)
            sums += one
            squares += two
        return np.concatenate([n, sums.ravel(), squares.ravel()])

    whole = _added(rows, work, opened)
    whole = whole if len(whole) else np.zeros(labels * (1 + 2 * size))
    return whole[:labels], *whole[labels:].reshape(2, labels, size)


def fit(rows: DataFrame, weights: tuple[float, ...], size: int, first: int = 0, iterations: int = 5, penalty: float = 1e-3, tolerance: float = 1e-6, opened: Callable = blocks.opened) -> Regression:
    """Fit stored blocks (as ``opened`` gives them) with the ``weights`` of their labels: class ``first`` + label for each row; classes
    before ``first`` have none, and those after the last label with rows are left out. Without rows all is 0.

    Features are divided by their standard deviations (those without any are left out) and centred, the squares of the
    coefficients are penalised, intercepts begin at the logarithms of the classes' weights.
    """
    tokens, sums, squares = _counted(rows, len(weights), size, opened)
    if not tokens.any():
        return Regression(np.zeros((first + len(weights), size)), np.zeros(first + len(weights)))
    last = int(np.flatnonzero(tokens)[-1]) + 1
    tokens, sums, squares, each = tokens[:last], sums[:last], squares[:last], np.array(weights[:last], float)
    classes, weight = first + last, float(tokens @ each)
    mean = each @ sums / weight
    spread = weight - float(tokens @ each**2) / weight
    std = np.sqrt(np.maximum(each @ squares - weight * mean**2, 0) / spread) if spread > 0 else np.zeros(size)
    inverse = np.divide(1, std, out=np.zeros(size), where=std > 0)
    centre = mean * inverse

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        own = x.reshape(classes, size + 1)
        c = own[:, :size]
        w = (c * inverse).T
        w = np.ascontiguousarray(w[:, 1:] - w[:, :1])
        base = own[:, size] - c @ centre
        sent = rows.sparkSession.sparkContext.broadcast((w, base[1:] - base[0]))

        def work(found):
            w, base = sent.value
            total, gradient, bias = 0.0, np.zeros((classes - 1, size)), np.zeros(classes - 1)
            for block in found:
                label, mine = block.labels + np.intp(first), each[block.labels]
                x = block.scores(w) + base[:, None]
                real = np.where(label > 0, x[label - 1, np.arange(len(label))], 0) if classes > 1 else 0
                p, whole = blocks.shares(x)
                for i in range(1, classes):
                    p[i - 1] -= label == i
                p *= mine
                total += float(((whole - real) * mine).sum())
                bias += p.sum(axis=1)
                gradient += block.back(p, size)
            return np.concatenate([[total], bias, gradient.ravel()])

        whole = _added(rows, work, opened) / weight
        sent.destroy()
        bias, gradient = whole[1:classes], whole[classes:].reshape(classes - 1, size) * inverse
        gradient -= np.outer(bias, centre)
        gradient = np.vstack([-gradient.sum(axis=0), gradient]) + penalty * c
        return whole[0] + penalty * float((c**2).sum()) / 2, np.c_[gradient, np.r_[-bias.sum(), bias]].ravel()

    start = np.zeros((classes, size + 1))
    start[:, size] = np.log1p(np.r_[np.zeros(first), tokens * each])
    start[:, size] -= start[:, size].mean()
    own = descend(loss, start.ravel(), iterations, tolerance).reshape(classes, size + 1)
    intercepts = own[:, size] - own[:, :size] @ centre
    return Regression(own[:, :size] * inverse, intercepts - intercepts.mean())


def descend(loss: Callable, x: np.ndarray, iterations: int, tolerance: float = 1e-6) -> np.ndarray:
    """The least of ``loss`` (value and gradient) by limited-memory BFGS, after ``iterations`` steps at most."""
    value, g = loss(x)
    first, values, steps = value, [value], []
    for n in range(iterations):
        if np.linalg.norm(g) <= max(tolerance * abs(value), 1e-8):
            break
        direction, back = g.copy(), []
        for s, y in steps:
            back.append((s @ direction) / (s @ y))
            direction -= back[-1] * y
        if steps:
            direction *= (steps[0][0] @ steps[0][1]) / (steps[0][1] @ steps[0][1])
        for (s, y), a in zip(reversed(steps), reversed(back)):
            direction += (a - (y @ direction) / (s @ y)) * s
        direction = -direction
        t, found = _step(loss, x, direction, value, g, 1.0 if n else 1 / np.linalg.norm(direction))
        if found is None:
            break
        new, (value, h) = x + t * direction, found
        steps = [(new - x, h - g), *steps][:MEMORY]
        x, g = new, h
        if abs(value - np.mean(values)) <= tolerance * abs(first):
            break
        values = [*values, value][-20:]
    return x


def _step(loss: Callable, x: np.ndarray, direction: np.ndarray, value: float, g: np.ndarray, t: float, rounds: int = 10):
    """A step length by the strong Wolfe conditions, with the loss there; None where none is found."""
    slope, seen = float(g @ direction), {}

    def at(t):
        seen[t] = loss(x + t * direction)
        return t, seen[t][0], float(seen[t][1] @ direction)

    def between(left, right):
        if left[0] > right[0]:
            left, right = right, left
        d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
        d2 = np.sqrt(max(d1 * d1 - left[2] * right[2], 0))
        gap, down = right[0] - left[0], right[2] - left[2] + 2 * d2
        return float(np.clip(right[0] - gap * (right[2] + d2 - d1) / down if down else left[0] + gap / 2, left[0] + 0.1 * gap, left[0] + 0.9 * gap))

    low, high = (0.0, value, slope), None
    for n in range(2 * rounds):
        c = at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and (n > 0 or high)):
            high = c
        elif abs(c[2]) <= 0.9 * abs(slope):
            return t, seen[t]
        elif high is None and c[2] < 0:
            low, t = c, t * 1.5
            continue
        else:
            if high is None or c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        t = between(low, high)
    return (low[0], seen[low[0]]) if low[0] else (0.0, None)


def predicted(model: Regression, rows: DataFrame, first: int = 0, opened: Callable = blocks.opened, keys: str = "doc_id long, sentence_idx int, token_idx int") -> DataFrame:
    """The rows of blocks: ``keys``, ``label, prediction``."""
    w, base = model.coefficients.T, model.intercepts
    sent = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(w[:, 1:] - w[:, :1]), base[1:] - base[0]))

    def run(batches):
        w, base = sent.value
        for block in opened(batches):
            best = blocks.best(block.scores(w) + base[:, None])
            yield block.rows([block.labels.astype(np.int32) + np.int32(first), best.astype(np.float64)], ["label", "prediction"])

    return rows.mapInArrow(run, f"{keys}, label int, prediction double")
