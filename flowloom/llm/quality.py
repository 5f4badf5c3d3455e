"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token has a sparse random index vector. One pass over all documents adds up, for each token,
the index vectors of the tokens around it: its context vector. Tokens are hashed to a fixed number
of slots, so the table of vectors is as large for 100 TB as for a test. A document is the mean of
its tokens' vectors with their spread; a two-layer network scores it, and a temperature fitted on
labels that the network has not seen makes the scores probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, fresh, scanned, stored, table, with_row
from .kernels import slices, tidy, tokens

SLOTS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: At most so many labelled documents are fitted (those with the smallest hashes of their ids).
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 64, 3e-3, 1e-4, 11
#: One of so many sampled documents sets the temperature instead of the weights.
CALIBRATION = 5
FEATURES = 2 * DIM + 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each slot's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (SLOTS, NONZERO)), rng.choice([-1.0, 1.0], (SLOTS, NONZERO))


def _slots(data, offsets):
    text, hashes = tokens(data, offsets)
    return text, (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def context_sums(docs: DataFrame) -> DataFrame:
    """``slot, n, v0, v1, ...``: tokens of each slot over all documents, and the sum of the index
    vectors of the tokens up to ``WINDOW`` places away in the same document."""

    def run(batches):
        place, sign = index_vectors()
        sums, seen = np.zeros(SLOTS * DIM), np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, data, offsets in slices(b.column(0)):
                text, slot = _slots(data, offsets)
                seen += np.bincount(slot, minlength=SLOTS)
                for d in range(1, WINDOW + 1):
                    near = text[d:] == text[:-d]
                    left, right = slot[:-d][near], slot[d:][near]
                    for a, c in ((left, right), (right, left)):
                        sums += np.bincount((a[:, None] * DIM + place[c]).ravel(), sign[c].ravel(), SLOTS * DIM)
        used = np.flatnonzero(seen)
        flat = pa.array(sums.reshape(SLOTS, DIM)[used].astype(np.int64).astype(np.int32).ravel())
        columns = [pa.array(used), pa.array(seen[used]), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * DIM, pa.int32()), flat)]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", "v"])

    parts = docs.select("text").mapInArrow(tidy(run), "slot long, n long, v array<int>")
    return parts.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)))


def word_vectors(sums: DataFrame) -> np.ndarray:
    """A unit vector for each slot: what its contexts have beyond the average context, and the
    slot's own index vector. ``sums`` has at most ``SLOTS`` rows."""
    place, sign = index_vectors()
    own = np.zeros((SLOTS, DIM))
    np.add.at(own, (np.arange(SLOTS)[:, None], place), sign)
    context, n = np.zeros((SLOTS, DIM)), np.zeros(SLOTS)
    for r in sums.collect():
        context[r["slot"]], n[r["slot"]] = r[2:], r["n"]
    mean = context.sum(0) / max(1.0, n.sum())
    context = context / np.maximum(n, 1)[:, None] - mean
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return unit(unit(context) + unit(own)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text; a text without tokens is all zero."""
    out = np.zeros((len(column), FEATURES), np.float32)
    for first, data, offsets in slices(column):
        text, slot = _slots(data, offsets)
        if not len(text):
            continue
        start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        n = np.diff(np.r_[start, len(text)]).astype(np.float32)
        v = vectors[slot]
        mean = np.add.reduceat(v, start) / n[:, None]
        square = np.add.reduceat(v * v, start) / n[:, None]
        out[first + text[start]] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.log1p(n)[:, None] / 10])
    return out


class Network:
    """Two layers, tanh and sigmoid, with a temperature on the logit."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale, self.temperature = np.zeros(FEATURES), np.ones(FEATURES), 1.0
        self.w = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def _logits(self, x):
        self._h = np.tanh(x @ self.w[0] + self.w[1])
        return self._h @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, cal: np.ndarray) -> Network:
        """Fit the weights on rows not in ``cal`` (Adam) and the temperature on those that are."""
        self.mean, self.scale = x[~cal].mean(0), x[~cal].std(0) + 1e-3
        x = (x - self.mean) / self.scale
        xt, yt = x[~cal], y[~cal]
        rng = np.random.default_rng(SEED)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(xt))
            for at in range(0, len(order), BATCH):
                xb, yb = xt[order[at : at + BATCH]], yt[order[at : at + BATCH]]
                z = self._logits(xb)
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(yb)
                dh = dz[:, None] * self.w[2] * (1 - self._h**2)
                grads = [xb.T @ dh + DECAY * self.w[0], dh.sum(0), self._h.T @ dz + DECAY * self.w[2], dz.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        z, yc = self._logits(x[cal]), y[cal]
        grid = np.geomspace(0.25, 16, 97)
        loss = [np.mean(np.logaddexp(0, z / s) - yc * z / s) if len(z) else abs(np.log(s)) for s in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        del self._h
        return self


def held_out(doc_id="doc_id"):
    """True for the rows whose labels are never learnt from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network | float]:
    """Word vectors from all of ``docs`` and a network from at most ``sample`` labelled documents.

    Labels come from rows of ``labels`` (``doc_id, quality``) that :func:`held_out` lets through;
    nulls are no labels, of several labels of a document the largest counts. Without labels of both
    kinds the second value is the constant score to give.
    """
    vectors = word_vectors(context_sums(docs))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = stored(chosen, "quality-labels")
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches):
        for b in batches:
            x = pool(b.column(2), held.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    rows = labelled.mapInArrow(tidy(pooled), f"doc_id {kind}, quality int, x array<float>").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    y = rows["quality"].to_numpy(float) if len(rows) else np.empty(0)
    if len(set(y)) < 2:
        return vectors, float((y.sum() + 1) / (len(y) + 2))
    return vectors, Network().fit(np.stack(rows["x"].to_numpy()).astype(float), y, np.arange(len(y)) % CALIBRATION == 0)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network | float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if
    the score is at least a half). A null text counts as empty; empty texts are scored like others;
    repeated rows get equal scores; an empty table gives an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "score", "predicted"]

    def run(batches):
        vectors, net = held.value
        for b in batches:
            x = pool(b.column(len(keep)), vectors)
            s = np.full(len(x), net) if isinstance(net, float) else net.score(x)
            columns = [*(b.column(i) for i in range(len(keep))), pa.array(s.astype(float)), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{c}` {docs.select(c).schema[0].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(tidy(run), f"{schema}, score double, predicted int")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows that the classifier predicts as 0."""
    docs, row = scanned(docs), fresh(docs, "row")
    numbered = with_row(docs, row)
    low = score_quality(numbered.select(row, "text"), fit(docs, labels), (row,)).filter("predicted = 0").select(row)
    return numbered.join(broadcast_if(stored(low, "quality-low"), 2_000_000), row, "left_anti").drop(row)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document. Null and empty texts are scored like others; a null doc_id is held
    out; repeated rows get equal scores; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    scores = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
#: A trained model has no SQL form; tests measure held-out accuracy and calibration.
ORACLES: dict = {}
