"""Tables written once to the folder that driver and executors share, and read many times."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Small tables (synonyms, labels, lexicon words) are broadcast up to so many counted rows.
SMALL_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and Spark is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"flowloom-shared-{os.getpid()}")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read back, for inputs that a plan uses many times and for the
    rounds of closures: lineage ends there, and work done before survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/flowloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def appended(whole: DataFrame, more: DataFrame) -> DataFrame:
    """The table ``whole`` of :func:`stored` with the rows of ``more``, for closures: a round writes
    what it found and nothing again. Frames that were read before stay as they were."""
    more.select(*whole.columns).write.mode("append").parquet(whole.stored_path)
    out = whole.sparkSession.read.schema(whole.schema).parquet(whole.stored_path)
    out.stored_path = whole.stored_path
    return out


def broadcast_if(df: DataFrame, most_rows: int, beyond: str = "merge") -> DataFrame:
    """Hint a broadcast of a stored table only where its counted rows stay within ``most_rows``;
    beyond that the join shuffles, and adaptive execution splits its skewed partitions. With ``beyond``
    as ``shuffle_hash`` only ``df``'s partitions are held, and the other side is not sorted."""
    return F.broadcast(df) if df.count() <= most_rows else df.hint(beyond)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that no later action reads; others are left alone."""
    for df in tables:
        path = df.__dict__.get("stored_path")
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
