"""The training-data pipeline: five stages over ``documents``, each on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read back as the next stage's ``docs``. All but the last return the columns of ``docs``. Null texts
count as empty; of equal or near texts a row with a null doc_id stays only where no other is; rows
that repeat an id are rows of their own; an empty table passes through every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.bpe import VOCABULARY, bpe_encode
from flowloom.llm.common import shared_dir, table
from flowloom.llm.decontaminate import decontaminate
from flowloom.llm.exact import drop_exact_duplicates
from flowloom.llm.overlap import drop_near_copies
from flowloom.llm.quality import drop_low_quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id
    stays: 256-bit SimHash fingerprints compared in bit-sliced form, then the sets themselves."""
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with digests of ids and decoded bytes."""
    return bpe_encode(docs, public_tokenizers.path(VOCABULARY), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", bpe_encoding),
]

#: A trained model and XXH64 have no SQL form; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages are tables in the shared folder."""
    base = f"{shared_dir(spark)}/flowloom/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
