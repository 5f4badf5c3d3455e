"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most two of 64 bits agree in two of four 16-bit blocks, so each
distinct fingerprint goes to six buckets (one for each pair of blocks) and every pair within the
radius meets in at least one. Inside a bucket the fingerprints lie as vertical bit planes: one
word holds one bit of 64 fingerprints, carry-save counters add up the differing bits of all of
them at once, and words whose 64 fingerprints have all left the radius are abandoned early.
Buckets of any size are compared in full: large ones as pairs of bounded chunks in many tasks.
A bucket hands on a spanning star of each class found in it, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, discard, fresh, scanned, stored, table, with_row
from .kernels import tidy

RADIUS = 2
WIDTH = 3
#: Buckets beyond this are compared chunk by chunk, so no task holds more than two chunks.
CHUNK = 8192
#: Up to this many fingerprints of a bucket are compared by shifts along the sorted batch.
SMALL = 64
BROADCAST_ROWS = 1_000_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of one text over its word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.r_[0, ends[: n - 1] + 1]
    stops = ends[-n:]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())])
    bytes_ = np.frombuffer(hashes, np.uint8).reshape(n, 8)[:, ::-1]
    ones = np.concatenate([np.bincount(bytes_[:, i], minlength=256) @ _BITS for i in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, row: str = "row") -> DataFrame:
    """``row, doc_id, fp`` of every row of ``docs``."""
    schema = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=[row, "doc_id", "fp"])

    return with_row(docs.select("doc_id", "text"), row).select(row, "doc_id", "text").mapInArrow(tidy(run), f"`{row}` long, doc_id {schema}, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(bits, words): bit t of word w of plane j is bit j of ``values[64 * w + t]``. Fingerprints
    are one 64-bit number each, or rows of several."""
    width = 1 if values.ndim == 1 else values.shape[1]
    padded = np.zeros((-(-len(values) // 64) * 64, width), np.uint64)
    padded[: len(values)] = values.reshape(len(values), width)
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def flips_of(value: np.ndarray) -> np.ndarray:
    """All ones or zero for each bit of one fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(value).reshape(-1).view(np.uint8), bitorder="little")
    return np.where(bits == 1, ~np.uint64(0), np.uint64(0))


def first_bits(n: int, words: int) -> np.ndarray:
    """Words whose first ``n`` bits are set."""
    out = np.zeros(words, np.uint64)
    out[: n // 64] = ~np.uint64(0)
    if n % 64:
        out[n // 64] = np.uint64((1 << (n % 64)) - 1)
    return out


def within(planes: np.ndarray, flips: np.ndarray | None, alive: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the fingerprints at ``radius`` or fewer set bits, as words like ``alive``.

    ``flips``: per plane all ones or zero, a query to compare with. ``count`` and ``over`` are the
    carry-save counters of 64 distances a word; two planes enter at each full adder, and words that
    hold no distance within the radius any more are given up.
    """
    out = np.zeros_like(alive)
    live = np.flatnonzero(alive)
    size = max(1, radius.bit_length())
    count = [np.zeros(len(live), np.uint64) for _ in range(size)]
    over = np.zeros(len(live), np.uint64)
    near = alive[live]
    for j in range(0, len(planes), 2):
        x, y = planes[j, live], planes[j + 1, live]
        if flips is not None:
            x, y = x ^ flips[j], y ^ flips[j + 1]
        half = count[0] ^ x
        carry = (count[0] & x) | (half & y)
        count[0] = half ^ y
        for i in range(1, size):
            carry, count[i] = count[i] & carry, count[i] ^ carry
        over |= carry
        if j % 8 == 6:
            equal, more = ~np.uint64(0), over
            for i in reversed(range(size)):
                if radius >> i & 1:
                    equal = equal & count[i]
                else:
                    more = more | (equal & count[i])
                    equal = equal & ~count[i]
            near = ~more & alive[live]
            keep = near != 0
            if not keep.all():
                live, over, near = live[keep], over[keep], near[keep]
                count = [c[keep] for c in count]
                if not len(live):
                    return out
    out[live] = near
    return out


def set_bits(words: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(words)
    bits = np.unpackbits(words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(bits)
    return at[r] * 64 + c


def classes_of_bucket(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct ``values`` the index of the first member of its class. Members
    that a class has taken are not compared again."""
    n = len(values)
    planes = bit_planes(values)
    alive = first_bits(n, planes.shape[1])
    root = np.arange(n)

    def take(i: int) -> None:
        alive[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))

    for i in range(n):
        if not (int(alive[i >> 6]) >> (i & 63)) & 1:
            continue
        take(i)
        todo = [i]
        while todo and alive.any():
            found = set_bits(within(planes, flips_of(values[todo.pop()]), alive, radius))
            for k in found.tolist():
                take(k)
            root[found] = i
            todo.extend(found.tolist())
    return root


def classes_of_small(bucket: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The same for many small buckets at once: the batch is compared with itself shifted by 1, 2,
    ..., the differences are counted in bit-sliced form, and classes take their first index."""
    a, b = [], []
    for s in range(1, SMALL):
        at = np.flatnonzero(bucket[s:] == bucket[:-s]) if s < len(bucket) else np.empty(0, int)
        if not len(at):
            break
        planes = bit_planes(values[at] ^ values[at + s])
        near = at[set_bits(within(planes, None, first_bits(len(at), planes.shape[1]), radius))]
        a.append(near)
        b.append(near + s)
    root = np.arange(len(bucket))
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (root == before).all():
                break
    return root


def bucket_links(batches, width: int = 1, radius: int = RADIUS):
    """``a, b``: stars of the classes in each bucket. Rows are ``key, part, node`` and ``width``
    columns of fingerprints, sorted by bucket; a bucket may span batches."""
    held = None

    def links(key, part, node, *prints):
        values = np.stack(prints, axis=1).view(np.uint64)
        change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[change, len(key)])
        bucket = np.repeat(np.arange(len(change)), size)
        fits = np.flatnonzero((size[bucket] > 1) & (size[bucket] <= SMALL))
        root = np.arange(len(key))
        root[fits] = fits[classes_of_small(bucket[fits], values[fits], radius)]
        for s, m in zip(change[size > SMALL].tolist(), size[size > SMALL].tolist()):
            root[s : s + m] = s + classes_of_bucket(values[s : s + m], radius)
        moved = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"])

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + width)]
        rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        key, part = rows[:2]
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [x[cut:] for x in rows]
        if cut:
            yield links(*(x[:cut] for x in rows))
    if held is not None and len(held[0]):
        yield links(*held)


def chunk_pairs(buckets: DataFrame, node: str, most: int, weight: Column | None = None) -> DataFrame:
    """``buckets`` (``key``, ``node`` and more) with ``part``: buckets of up to ``most`` rows (or of
    another summed ``weight``) are one part, the rows of larger ones go to every pair of their
    chunks, so all pairs still meet."""
    hot = stored(buckets.groupBy("key").agg(F.ceil((F.count(F.lit(1)) if weight is None else weight) / most).cast("long").alias("chunks")).filter("chunks > 1"), "simhash-hot")
    if hot.isEmpty():
        return buckets.withColumn("part", F.lit(0).cast("long"))
    own = F.pmod(F.xxhash64(node, F.lit("chunk")), F.col("chunks"))
    met = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return (
        buckets.join(broadcast_if(hot, BROADCAST_ROWS), "key", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
        .withColumn("own", own)
        .withColumn("other", met)
        .withColumn("part", F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
        .drop("chunks", "own", "other")
    )


def near_links(distinct: DataFrame) -> DataFrame:
    """``(a, b)`` edges whose closure links exactly the fingerprints of column ``fp`` (distinct
    longs) that a chain of steps within the radius connects."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for t, (i, j) in enumerate(pairs)]
    buckets = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    chunked = chunk_pairs(buckets, "fp", CHUNK).select("key", "part", F.col("fp").alias("node"), "fp")
    return chunked.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(tidy(bucket_links), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges(a, b)``: alternating large-star and small-star
    rounds, each stored, until no edge changes. Roots are the smallest nodes."""
    flat = lambda df: df.filter(F.col("u") != F.col("v")).distinct()
    edges = stored(flat(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "components")

    size = edges.count()
    while size:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(flat(large), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, stored(flat(small), "components")
        # distinct rows on both sides: equal counts and none missing is equality
        was, size = size, edges.count()
        if size == was and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
        discard(before, large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, row: str = "row") -> DataFrame:
    """Fingerprint and class of every row of ``docs`` (a table scan with ``doc_id``, ``text``).

    Returns ``row, doc_id, fingerprint, component_id, first`` where ``component_id`` is the smallest
    doc_id that links reach (null only if all ids of the class are null) and ``first`` marks the one
    row of each class that represents it. Null texts count as empty; texts without words share
    fingerprint zero and link like any other. Repeated rows join one class.
    """
    prints = stored(fingerprints(docs, row), "simhash-prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)).alias("least")
    distinct = stored(prints.groupBy("fp").agg(least), "simhash-distinct")
    links = near_links(distinct.select("fp"))
    roots = stored(components(links), "simhash-roots")
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "least")
    of_root = linked.groupBy("root").agg(F.min("least").alias("best"))
    best = linked.select("fp", "root").join(of_root, "root").select("fp", "best")
    # stored, so that both sides of the last join are exchanges whose skewed partitions Spark can split
    per_print = stored(distinct.join(best, "fp", "left").select(F.col("fp").alias("print"), F.coalesce("best", "least").alias("of")), "simhash-classes")
    return prints.join(per_print, F.col("fp") == F.col("print")).select(
        row,
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("of.doc_id").alias("component_id"),
        (F.col(row) == F.col(f"of.{row}")).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row (the smallest doc_id) of each class."""
    docs, row = scanned(docs), fresh(docs, "row")
    gone = stored(near_duplicates(docs, row).filter(~F.col("first")).select(row), "simhash-dropped")
    return with_row(docs, row).join(broadcast_if(gone, 2 * BROADCAST_ROWS), row, "left_anti").drop(row)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document. Null and empty texts have fingerprint zero and link
    like any other; repeated rows share a class; the smallest doc_id names it (null only where all
    its ids are); an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row", "first")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
#: SQL has no XXH64; tests compare with brute force.
ORACLES: dict = {}
