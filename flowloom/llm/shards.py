"""Sharding by jump consistent hashing: no ring table, and a new last shard takes rows from the
others only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, fresh, stored, table, text_or_empty
from .kernels import tidy

SHARDS = 16
#: Offsets (a row for each partition and shard) are broadcast up to this count.
BROADCAST_OFFSETS = 500_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: a key jumps to ever later shards, by a generator
    seeded with itself, and stays at the last one below ``shards``."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (key[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        after = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        stays = after >= shards
        moving, after = moving[~stays], after[~stays]
        shard[moving] = after
    return shard


def stable_key(doc_id) -> int:
    """The key of a doc_id, the same on every platform and in every run."""
    return xxhash.xxh64_intdigest(b"" if doc_id is None else str(doc_id).encode())


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and place in its shard for every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. The law is ``key``: doc_id
    and the shard count alone decide, so equal texts may part while equal ids never do; null ids
    share one key. A null text has no bytes (size 1, crc32 of nothing). Slots count from 0 without
    gaps within a shard. No shard passes through one task: partitions number their own rows and
    the offsets come from a table of partition by shard counts.
    """
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    body = text_or_empty("text")
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    names = ["doc_id", "size", "text_crc32", "part", "shard", "at", "grown_shard"]

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            keys = np.array([stable_key(x) for x in b.column(0).to_pylist()], np.uint64)
            shard, grown = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            at = np.empty(len(shard), np.int64)
            at[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts) + seen[shard[order]]
            seen += counts
            columns = [*(b.column(i) for i in range(3)), *map(pa.array, (np.full(len(shard), part), shard, at, grown))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    placed = stored(rows.mapInArrow(tidy(number), f"doc_id {kind}, size long, text_crc32 long, part long, shard long, at long, grown_shard long"), "shards")
    counts = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shard-offsets")
    return placed.join(broadcast_if(offsets, BROADCAST_OFFSETS), ["part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("at")).alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write all columns of ``docs`` below ``path``, a folder for each shard.

    The folders' column is ``shard``, or ``shard_`` and so on where ``docs`` has that already. Rows stay in their partitions, so no shard gathers
    in one task; a shard is as many files as partitions that hold rows of it.
    """

    @F.pandas_udf("int")
    def shard_of(ids):
        return pd.Series(jump_hash(np.array([stable_key(None if x != x else x) for x in ids], np.uint64), shards))

    name = fresh(docs, "shard")
    docs.withColumn(name, shard_of(F.col("doc_id").cast("string"))).write.partitionBy(name).parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. A null text has size 1; null doc_ids share a shard, as rows
    that repeat an id do, each in a slot of its own; an empty table gives no rows."""
    return assign_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sharding": op5_sharding}
#: The wrapping 64-bit generator has no SQL form; tests compare with a loop in plain integers.
ORACLES: dict = {}
