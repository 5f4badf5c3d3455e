"""Exact deduplication through counting quotient filters.

Every partition builds counting quotient filters (one for each range of quotients) over the
64-bit fingerprints of its normalised texts. A filter keeps quotient and remainder of every
fingerprint, so nothing is lost: filters of one quotient range merge by walking their sorted
remainders, and counts add up. Fingerprints counted more than once route their texts, and only
those, to a comparison of the bytes themselves. Equal fingerprints alone never decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, fresh, scanned, stored, table, text_or_empty, with_row
from .kernels import tidy

#: A quotient range holds about so many rows.
ROWS_PER_RANGE = 500_000
#: The recurring fingerprints are broadcast up to this count (16 MB), else the join shuffles.
BROADCAST_FINGERPRINTS = 2_000_000

BLANKS = "[\\x20\\x09-\\x0D]+"


def encode_filter(values: np.ndarray, counts: np.ndarray, prefix_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct fingerprints that share ``prefix_bits`` bits.

    Slots hold remainders; a remainder counted more than once is followed by a slot with its
    count. Three bit vectors tell occupied quotients, run ends and counter slots.
    """
    q = max(1, int(len(values) - 1).bit_length())
    shift = np.uint64(64 - prefix_bits - q)
    local = values & np.uint64((1 << (64 - prefix_bits)) - 1)
    quotient = (local >> shift).astype(np.int64)
    remainder = local & np.uint64((1 << int(shift)) - 1)
    item = np.repeat(np.arange(len(values)), 1 + (counts > 1))
    is_counter = np.r_[False, item[1:] == item[:-1]]
    at = quotient[item]
    order = np.arange(len(item))
    slot = order + np.maximum.accumulate(at - order)
    n_slots = int(slot[-1]) + 1
    slots = np.zeros(n_slots, np.uint64)
    slots[slot] = np.where(is_counter, counts[item].astype(np.uint64), remainder[item])
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotient] = 1
    run_end = np.zeros(n_slots, np.uint8)
    run_end[slot[np.r_[at[1:] != at[:-1], True]]] = 1
    counter = np.zeros(n_slots, np.uint8)
    counter[slot[is_counter]] = 1
    head = np.array([q, n_slots], np.int64).tobytes()
    return head + b"".join(np.packbits(x).tobytes() for x in (occupied, run_end, counter)) + slots.tobytes()


def decode_filter(block: bytes, prefix: int, prefix_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts of a filter."""
    q, n_slots = (int(x) for x in np.frombuffer(block, np.int64, 2))
    at = 16
    bits = []
    for n in (1 << q, n_slots, n_slots):
        size = (n + 7) // 8
        bits.append(np.unpackbits(np.frombuffer(block, np.uint8, size, at), count=n))
        at += size
    slots = np.frombuffer(block, np.uint64, n_slots, at)
    quotient, end = np.flatnonzero(bits[0]), np.flatnonzero(bits[1])
    start = np.maximum(quotient, np.r_[0, end[:-1] + 1])
    length = end - start + 1
    used = np.arange(length.sum()) + np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length)
    is_counter = bits[2][used].astype(bool)
    shift = np.uint64(64 - prefix_bits - q)
    value = (np.repeat(quotient, length).astype(np.uint64) << shift) | slots[used]
    if prefix_bits:
        value |= np.uint64(prefix << (64 - prefix_bits))
    first = np.flatnonzero(~is_counter)
    counts = np.ones(len(first), np.int64)
    follows = np.flatnonzero(is_counter)
    counts[np.searchsorted(first, follows) - 1] = slots[used[follows]].astype(np.int64)
    return value[first], counts


def merge_two(one: bytes, other: bytes, prefix: int, prefix_bits: int) -> bytes:
    """The filter of two filters of one quotient range. Both hold their runs in order of quotient and
    remainder, so the second's remainders are put between the first's, or their counts added."""
    values, counts = decode_filter(one, prefix, prefix_bits)
    more, by = decode_filter(other, prefix, prefix_bits)
    at = np.searchsorted(values, more)
    known = values[np.minimum(at, len(values) - 1)] == more
    counts[at[known]] += by[known]
    new = ~known
    return encode_filter(np.insert(values, at[new], more[new]), np.insert(counts, at[new], by[new]), prefix_bits)


def merge_filters(blocks: list[bytes], prefix: int, prefix_bits: int) -> bytes:
    """The filter of all filters of one quotient range, merged two by two; counts add up."""
    while len(blocks) > 1:
        pairs = [merge_two(a, b, prefix, prefix_bits) for a, b in zip(blocks[::2], blocks[1::2])]
        blocks = pairs + blocks[len(blocks) - len(blocks) % 2 :]
    return blocks[0]


def partition_filters(fingerprints: DataFrame, prefix_bits: int) -> DataFrame:
    """``(prefix, filter)``: the counting quotient filters of each partition of one long column."""

    def build(batches):
        chunks = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not chunks or not sum(map(len, chunks)):
            return
        values, counts = np.unique(np.concatenate(chunks), return_counts=True)
        prefix = (values >> np.uint64(64 - prefix_bits)).astype(np.int64) if prefix_bits else np.zeros(len(values), np.int64)
        cuts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        for a, b in zip(cuts, [*cuts[1:], len(values)]):
            block = encode_filter(values[a:b], counts[a:b], prefix_bits)
            yield pa.RecordBatch.from_pydict({"prefix": pa.array([int(prefix[a])], pa.int64()), "filter": pa.array([block], pa.binary())})

    return fingerprints.mapInArrow(tidy(build), "prefix long, filter binary")


def recurring(fingerprints: DataFrame, rows: int) -> DataFrame:
    """``(fp, n)`` of the fingerprints that occur more than once."""
    prefix_bits = max(4, int(rows // ROWS_PER_RANGE).bit_length())

    def merge(key, blocks):
        prefix = key[0].as_py()
        values, counts = decode_filter(merge_filters(blocks.column("filter").to_pylist(), prefix, prefix_bits), prefix, prefix_bits)
        many = counts > 1
        return pa.table({"fp": pa.array(values[many].view(np.int64)), "n": pa.array(counts[many])})

    return partition_filters(fingerprints, prefix_bits).groupBy("prefix").applyInArrow(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, row: str = "row") -> DataFrame:
    """Class, size and survivor of every row of ``docs`` (a table scan with ``doc_id``, ``text``).

    Returns ``row, doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal if identical
    after each run of blanks became one space; a null text counts as empty. The smallest doc_id
    stays; a null doc_id sorts after all others, and of rows that repeat text and doc_id exactly
    one is kept. An empty table gives an empty result; other columns are not read.
    """
    norm = F.regexp_replace(text_or_empty("text"), BLANKS, " ")
    rows = with_row(docs.select("doc_id", "text"), row)
    keys = stored(
        rows.select(row, "doc_id", norm.alias("norm")).select(row, "doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha")),
        "exact-keys",
    )
    many = stored(recurring(keys.select("fp"), keys.count()), "exact-recurring").select("fp")
    near = broadcast_if(many, BROADCAST_FINGERPRINTS)
    checked = (
        docs.select(norm.alias("norm")).select("norm", F.xxhash64("norm").alias("fp")).join(near, "fp", "left_semi")
        .groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size"))
        .select("fp", F.sha2("norm", 256).alias("sha"), "group_size")
    )
    first = keys.join(near, "fp", "left_semi").groupBy("fp", "sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)).alias("first"))
    groups = stored(checked.join(first, ["fp", "sha"]).select("fp", "sha", "group_size", F.col("first.doc_id").alias("keep_id"), F.col(f"first.{row}").alias("keep_row")), "exact-groups")
    k, g = keys.alias("k"), broadcast_if(groups, BROADCAST_FINGERPRINTS // 10).alias("g")
    return k.join(g, (F.col("k.fp") == F.col("g.fp")) & (F.col("k.sha") == F.col("g.sha")), "left").select(
        F.col(f"k.{row}"),
        F.col("k.doc_id"),
        F.when(F.col("g.fp").isNull(), F.col("k.doc_id")).otherwise(F.col("g.keep_id")).alias("keep_id"),
        F.coalesce("g.group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col(f"k.{row}") == F.col("g.keep_row"), F.lit(True)).alias("kept"),
        F.col("k.sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows that :func:`exact_duplicates` drops."""
    docs, row = scanned(docs), fresh(docs, "row")
    gone = stored(exact_duplicates(docs, row).filter(~F.col("kept")).select(row), "exact-dropped")
    return with_row(docs, row).join(broadcast_if(gone, BROADCAST_FINGERPRINTS), row, "left_anti").drop(row)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and survivor of every document. Null and empty texts are equal; a null doc_id stays only
    where its class has no other; of rows that repeat text and doc_id one stays; an empty table gives
    no rows."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM n"""
}
