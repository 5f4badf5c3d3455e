"""Phrase tagging on streams. Tagging looks at one row at a time, so the batch operators run on a
``readStream`` unchanged: no state, no watermark, exactly once by the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.tagging import split_sentences, tag_phrases


def tag_stream(spark: SparkSession, path: str, schema: str, xor: list[str], and_: list[str]) -> DataFrame:
    """Gateway phrases of the documents (``doc_id, text``) that arrive as Parquet files in ``path``."""
    return tag_phrases(split_sentences(spark.readStream.schema(schema).parquet(path)), xor, and_)


def write_stream(tags: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append tags to Parquet files, everything there is and then stop."""
    return tags.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
