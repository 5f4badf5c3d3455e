"""Helpers that the training-data operators share: stored tables, row keys, bounded broadcasts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.shared import discard, shared_dir, stored

__all__ = ["ascii_lower", "broadcast_if", "discard", "fresh", "running_total", "scanned", "shared_dir", "stored", "table", "text_or_empty", "with_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scanned(df: DataFrame) -> DataFrame:
    """``df`` if it reads Parquet files, whose rows have a place of their own; else a stored copy."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return stored(df, "rows")
    return df


def with_row(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a scan of Parquet files by file and place in the file, so two passes over
    one table can meet on this column even where ids repeat or are null, however each is split into
    tasks. What reads no Parquet is stored first: for two passes, start both from ``scanned``."""
    df = scanned(df)
    place = F.col("_metadata.row_index")
    files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
    if len(files) < 2:
        return df.withColumn(name, place)
    path, number = fresh(df, "file_path"), fresh(df, "file_number")
    numbers = df.sparkSession.range(1).select(F.posexplode(F.lit(files)).alias(number, path))
    at = df.select("*", F.col("_metadata.file_path").alias(path), place.alias(name)).join(F.broadcast(numbers), path)
    return at.withColumn(name, F.shiftleft(F.col(number).cast("long"), 40).bitwiseOR(F.col(name))).drop(path, number)


def running_total(rows: DataFrame, part: str, number: str, value: str, name: str, block: int = 1000) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each, in the order of the whole numbers
    ``part`` and ``number``. Blocks of ``block`` parts are summed on their own, then the blocks' totals."""
    group, total = fresh(rows, "block"), fresh(rows, "total")
    blocks = rows.withColumn(group, F.floor(F.col(part) / block))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(group).agg(F.sum(value).alias(total))
    totals = totals.select(group, F.coalesce(F.sum(total).over(earlier(Window.orderBy(group))), F.lit(0)).alias(total))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(group).orderBy(part, number))), F.lit(0))
    return blocks.withColumn(name, inside).join(totals, group).withColumn(name, F.col(name) + F.col(total)).drop(group, total)


def broadcast_if(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast of a stored table only where its counted rows stay within ``most_rows``;
    beyond that the join shuffles, and adaptive execution splits its skewed partitions."""
    return F.broadcast(df) if df.count() <= most_rows else df.hint("merge")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
