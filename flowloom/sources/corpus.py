"""Annotated-corpus source, prediction files, run histories, and all sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SENTENCES


def write_corpus(sentences: DataFrame, path: str, buckets: int = 64) -> None:
    """Store sentences (``doc_id, sentence_idx, sample_id, tokens, ner_tags``) in folders of a
    ``doc_bucket``, so that readers of few documents prune the rest."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    sentences.withColumn("doc_bucket", bucket).repartition("doc_bucket", F.pmod(F.xxhash64("doc_id", F.lit("file")), F.lit(8))).write.partitionBy("doc_bucket").parquet(path)


def read_corpus(spark: SparkSession, path: str, doc_ids: list | None = None, buckets: int = 64) -> DataFrame:
    """The stored sentences; with ``doc_ids`` only their buckets are read."""
    rows = spark.read.parquet(path)
    if doc_ids is not None:
        kind = rows.schema["doc_id"].dataType.simpleString()
        wanted = spark.createDataFrame([(i,) for i in doc_ids], f"doc_id {kind}")
        hit = [r[0] for r in wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).distinct().collect()]
        rows = rows.filter(F.col("doc_bucket").isin(hit) & F.col("doc_id").isin(doc_ids))
    return rows.drop("doc_bucket")


def to_tokens(sentences: DataFrame) -> DataFrame:
    """``doc_id, sentence_idx, token_idx, token, ner_tag``."""
    pairs = F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("ner_tags").alias("ner_tag")))
    keep = [c for c in ("doc_id", "sentence_idx", "sample_id") if c in sentences.columns]
    return sentences.select(*keep, pairs.alias("token_idx", "z")).select(*keep, "token_idx", "z.token", "z.ner_tag")


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of one file or of a directory of runs, with their ``file`` and ``task``: element
    predictions have ``entities``, relation predictions ``relations``."""
    rows = spark.read.option("recursiveFileLookup", "true").schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))
    kinds = [F.when(F.col(c).isNotNull(), t) for c, t in (("entities", "elements"), ("relations", "relations")) if c in rows.columns]
    return rows.withColumn("task", F.coalesce(*kinds) if kinds else F.lit(None).cast("string"))


def read_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Metric records below ``root`` with the ``name=value`` steps of their paths as map ``params``."""
    rows = spark.read.option("recursiveFileLookup", "true").schema(schema).json(root).withColumn("file", F.col("_metadata.file_path"))
    steps = F.regexp_extract_all("file", F.lit("([A-Za-z_]+=[^/]+)/"), F.lit(1))
    return rows.withColumn("params", F.str_to_map(F.array_join(steps, "\n"), F.lit("\n"), F.lit("=")))


def write_predictions(elements: DataFrame, relations: DataFrame, path: str) -> None:
    """One JSON record for each document: element spans by type, relations by type."""
    elements.write.json(f"{path}/elements")
    relations.write.json(f"{path}/relations")


def write_gateways(gateways: DataFrame, path: str) -> None:
    gateways.select(F.to_json(F.struct(*gateways.columns)).alias("value")).write.text(path)


def write_metrics(doc_level: DataFrame, label_level: DataFrame, overall: DataFrame, path: str, form: str = "parquet") -> None:
    """Document, label and overall metrics as three tables."""
    for name, df in (("doc", doc_level), ("label", label_level), ("overall", overall)):
        writer = df.write.option("header", "true") if form == "csv" else df.write
        writer.format(form).save(f"{path}/{name}")


def gold_standard(elements: DataFrame, types: list[str]) -> DataFrame:
    """``doc_id, entity_type, tokens`` of the relevant types."""
    return elements.filter(F.col("entity_type").isin(types)).select("doc_id", "entity_type", "tokens")


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """Run parameters as one record next to the results."""
    spark.createDataFrame([(k, str(v)) for k, v in sorted(params.items())], "name STRING, value STRING").coalesce(1).write.json(path)


__all__ = ["SENTENCES", *(n for n in dir() if n.startswith(("read_", "write_", "to_", "gold_")))]
