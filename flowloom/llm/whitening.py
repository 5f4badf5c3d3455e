"""Embedding whitening with MLlib's distributed block matrices.

Entries become whole numbers, the distinct vectors are the fit list. Centred rows are indexed into a
block matrix; its transpose times itself, split along the long side, is the scatter matrix, the only
thing besides sums that reaches the driver (dimensions squared). The whitening matrix comes from a
local eigendecomposition; multiplying the blocks of all rows by it projects them.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, discard, fresh, stored, table

SCALE = 256
COMPONENTS = 4
#: Rows and columns of a block.
BLOCK = 1024
#: Sorted lists with one row for each stored file are broadcast up to this count.
BROADCAST_FILES = 200_000
#: An eigenvalue of at most this share of the largest counts as none: no variance in that direction.
FLAT = 1e-12


def whole_numbers(vectors: DataFrame, vector: str) -> DataFrame:
    """``vectors`` with ``x``, ``floor(256 * entry)`` for each entry, of the rows whose vector is neither
    null nor holds null or non-finite entries; entries beyond the range of a long end at its limits."""
    usable = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = vectors.filter(F.col(vector).isNotNull() & usable & (F.size(vector) > 0))
    return kept.withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """Stored ``rows`` numbered from 0 without gaps, by file and place in the file."""
    where, at = fresh(rows, "where"), fresh(rows, "at")
    placed = rows.select("*", F.col("_metadata.file_path").alias(where), F.col("_metadata.row_index").alias(at))
    files = placed.groupBy(where).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(where).rowsBetween(Window.unboundedPreceding, -1)
    shift = stored(files.select(where, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift")), "shift")
    return placed.join(broadcast_if(shift, BROADCAST_FILES), where).withColumn(name, F.col(at) + F.col("shift")).drop(where, at, "shift")


def block_matrix(rows: DataFrame, index: str, mean: list[float]) -> BlockMatrix:
    """The centred vectors ``x`` of ``rows`` as blocks, in the order of ``index``."""
    centred = F.zip_with("x", F.array(*map(F.lit, mean)), lambda x, m: x - m)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).cast("long").alias("index"), array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, 0, len(mean)).toBlockMatrix(BLOCK, BLOCK)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``left`` times ``right``; the side they share is dealt over ``splits`` tasks, whose products are
    added up, so that no task gathers all blocks of a tall matrix."""
    wrapped = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(wrapped, left.rowsPerBlock, right.colsPerBlock)


def scatter(tall: BlockMatrix) -> np.ndarray:
    """Transpose times self, a small square matrix."""
    blocks = -(-tall.numRows() // tall.rowsPerBlock)
    cores = tall._java_matrix_wrapper._sc.defaultParallelism
    out = product(tall.transpose(), tall, max(1, min(blocks, 4 * cores))).toLocalMatrix().toArray()
    return (out + out.T) / 2


def local_blocks(spark: SparkSession, matrix: np.ndarray) -> BlockMatrix:
    parts = [((i // BLOCK, j // BLOCK), Matrices.dense(*(b := matrix[i : i + BLOCK, j : j + BLOCK]).shape, b.ravel(order="F").tolist())) for i in range(0, matrix.shape[0], BLOCK) for j in range(0, matrix.shape[1], BLOCK)]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), BLOCK, BLOCK, *matrix.shape)


def rows_of(matrix: BlockMatrix, index: str) -> DataFrame:
    """``index`` and ``values`` of each row."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias(index), vector_to_array("vector").alias("values"))


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit eigenvectors as columns, whose largest entries are positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1][:components], 0.0), vectors[:, ::-1][:, :components]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1.0, 1.0)


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Whitened principal components of ``vectors``: a row for each usable row and component.

    Returns ``key, component, n, deviation, whitened, explained, identity_error``. Vectors of another
    length than most have (of equally frequent lengths the greatest) and empty ones are unusable too.
    There are no more components than dimensions. Directions without variance (all vectors equal, say)
    have ``whitened`` 0, and the error, then 1, says so; where there is no variance at all ``explained``
    is 0. A ``deviation`` beyond a long is null. Rows that repeat stay rows of their own and weigh
    once in the fit; keys can be null. A table without usable rows gives none.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    kept = whole_numbers(vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")), "v").select("key", "x")
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], f"`{key}` {kind}, {_OUT}")
    d = lengths.d
    kept = stored(kept.filter(F.size("x") == d), "vectors")
    fit = stored(kept.select("x").distinct(), "fit")
    sums = fit.select(F.posexplode("x").alias("i", "e")).groupBy("i").agg(F.sum(F.col("e").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    n, s = sums[0].n, [int(r.s) for r in sums]
    mean = [a / n for a in s]  # of whole numbers, correctly rounded

    tall = block_matrix(indexed(fit, "index"), "index", mean)
    covariance = scatter(tall) / n
    values, directions = principal(covariance, min(components, d))
    trace = math.fsum(np.diag(covariance))
    real = values > FLAT * max(values[0], np.finfo(float).tiny)
    weights = np.where(real, directions / np.sqrt(np.where(real, values, 1.0)), 0.0)
    whitener = local_blocks(spark, weights)
    error = float(np.abs(scatter(product(tall, whitener)) / n - np.eye(len(values))).max())
    explained = [v / trace if trace > 0 else 0.0 for v in values.tolist()]

    rows = indexed(kept, "index")
    projected = rows_of(product(block_matrix(rows, "index", mean), whitener), "index")
    wide = "decimal(38,0)"
    offsets = F.zip_with("x", F.array(*(F.lit(Decimal(a)).cast(wide) for a in s)), lambda x, a: x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - a)
    squares = F.aggregate(F.transform(offsets, lambda o: F.try_multiply(o.cast(wide), o.cast(wide)).cast(wide)), F.lit(0).cast(wide), lambda a, q: F.try_add(a, q).cast(wide))
    deviation = rows.select("index", "key", squares.try_cast("long").alias("deviation"))
    parts = F.arrays_zip(F.col("values").alias("whitened"), F.array(*map(F.lit, explained)).alias("explained"))
    out = deviation.join(projected, "index").select("key", "deviation", F.posexplode(parts).alias("i", "p"))
    return out.select(
        F.col("key").alias(key),
        (F.col("i") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("p.whitened").alias("whitened"),
        F.col("p.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable embedding; edge cases as in :func:`whiten`."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
#: Eigenvectors have no SQL form; tests compare with numpy on the driver's table and on odd ones.
ORACLES: dict = {}
