"""Precision, recall and F1 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def precision(tp="tp", fp="fp") -> Column:
    return _c(tp) / (_c(tp) + _c(fp) + EPSILON)


def recall(tp="tp", fn="fn") -> Column:
    return _c(tp) / (_c(tp) + _c(fn) + EPSILON)


def f1(p="precision", r="recall") -> Column:
    return 2 * _c(p) * _c(r) / (_c(p) + _c(r) + EPSILON)


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(_c(b) == 0, F.lit(0.0)).otherwise(_c(a) / _c(b))


def metric_row(df, digits: int = 2):
    """Adds rounded precision, recall, f1 to ``tp, fp, fn``; support is ``tp + fn`` unless there."""
    p, r = precision(), recall()
    out = df.withColumn("precision", F.round(p, digits)).withColumn("recall", F.round(r, digits)).withColumn("f1", F.round(f1(p, r), digits))
    return out if "support" in df.columns else out.withColumn("support", F.col("tp") + F.col("fn"))
