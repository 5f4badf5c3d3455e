"""SimHash near copies at a stated overlap of word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at
least 0.8; chains of near copies form a class. Fingerprints of 64 bits can't tell 0.8 from 0.6, so
these have 256, and the comparison is that of ``simhash``: bit planes, carry-save counters, words
given up once all their fingerprints are beyond the radius.

1. Sets that similar share a shingle among the first few of each in any fixed order of shingles.
   The order puts rare shingles first: every distinct shingle of every document is counted in a
   fixed number of slots.
2. Documents that share such a shingle form a bucket. Buckets are compared in bit-sliced form and
   hand on stars, whose closure holds every pair within the radius: the candidate classes.
3. A candidate class is checked on the sets themselves, first against its best connected member.
   Where that leaves members apart, all that are apart are compared, in bounded pairs of chunks.

The radius is far beyond what similarity 0.8 gives: at 0.8 fingerprints differ in 39 bits on average
with a standard deviation of 6 (48 and 6 for the shortest sets), and 80 are let through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, fresh, scanned, stored, with_row
from .kernels import LOWER, blank_separated, grams, mix, slices, tidy
from .simhash import BROADCAST_ROWS, SMALL, bit_planes, bucket_links, chunk_pairs, components, flips_of, set_bits, within
from .substrings import bloom, maybe_in

WIDTH, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, and how many of its bits may differ.
WORDS, RADIUS = 4, 80
#: Slots in which shingles are counted (2 MB, whatever the corpus).
SLOT_BITS = 18
#: Shingles in one chunk of a candidate class that is compared in full.
CHUNK_ITEMS, CHUNK_ROWS = 200_000, 8192
#: Keeps ratios of whole numbers that equal the similarity from failing by rounding.
SLACK = 1e-9
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
PRINTS = [f"p{i}" for i in range(WORDS)]


def shingle_sets(column: pa.Array, width: int = WIDTH):
    """``(first, texts, of, items)`` of slices of texts: sorted distinct shingles of each, ``of``
    telling the text. Fewer words than ``width`` are one shingle, none at all are one of their own."""
    for first, data, offsets in slices(column):
        text, words = blank_separated(LOWER[data] if len(data) else data, offsets)
        texts = len(offsets) - 1
        g = grams(words, width)
        at = np.flatnonzero(text[: len(g)] == text[width - 1 :]) if len(g) else np.empty(0, np.int64)
        of, items = [text[at]], [g[at]]
        count = np.bincount(text, minlength=texts)
        start = np.cumsum(count) - count
        for n in range(width):
            few = np.flatnonzero(count == n)
            h = np.full(len(few), n, np.uint64)
            for i in range(n):
                h = mix(h * _SEEDS[0] + words[start[few] + i])
            of.append(few)
            items.append(h)
        of, items = np.concatenate(of), np.concatenate(items)
        order = np.lexsort((items, of))
        of, items = of[order], items[order]
        new = np.r_[True, (of[1:] != of[:-1]) | (items[1:] != items[:-1])]
        yield first, texts, of[new], items[new]


def prints_of(of: np.ndarray, items: np.ndarray, texts: int) -> np.ndarray:
    """(texts, WORDS): a bit is 1 if set in over half the hashes of the shingles."""
    start = np.searchsorted(of, np.arange(texts))
    size = np.diff(np.r_[start, len(of)])[:, None]
    out = np.empty((texts, WORDS), np.uint64)
    for w in range(WORDS):
        bits = np.unpackbits(mix(items * _SEEDS[w] + _SEEDS[w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        out[:, w] = np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _slot(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all documents fall in each slot."""

    def run(batches):
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for *_, items in shingle_sets(b.column(0), width):
                seen += np.bincount(_slot(items), minlength=1 << SLOT_BITS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], names=["slot", "n"])

    out = np.zeros(1 << SLOT_BITS, np.int64)
    sums = texts.select("text").mapInArrow(tidy(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for b in sums.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out


def prefixes(texts: DataFrame, counts: np.ndarray, width: int, similarity: float, bitmap: np.ndarray | None = None) -> DataFrame:
    """``key, node`` of ``node, text``: the first shingles of each set, as many as the similarity
    asks for; with a filter only those that it lets through."""
    held = texts.sparkSession.sparkContext.broadcast((counts, bitmap))

    def run(batches):
        for b in batches:
            node, (counts, bitmap) = b.column(0).to_numpy(), held.value
            for first, n_texts, of, items in shingle_sets(b.column(1), width):
                order = np.lexsort((items, counts[_slot(items)], of))
                start = np.searchsorted(of, np.arange(n_texts))
                size = np.diff(np.r_[start, len(of)])
                most = size - np.ceil(similarity * size - SLACK).astype(np.int64) + 1
                keys = items[order[np.arange(len(of)) - start[of] < most[of]]]
                nodes = node[first + np.repeat(np.arange(n_texts), most)]
                if bitmap is not None:
                    maybe = maybe_in(bitmap, keys)
                    keys, nodes = keys[maybe], nodes[maybe]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes)], names=["key", "node"])

    return texts.select("node", "text").mapInArrow(tidy(run), "key long, node long")


def fingerprints(texts: DataFrame, width: int) -> DataFrame:
    """``node, p0, p1, ...`` of each text."""

    def run(batches):
        for b in batches:
            for first, n_texts, of, items in shingle_sets(b.column(1), width):
                prints = prints_of(of, items, n_texts).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n_texts), *map(pa.array, prints.T.copy())], names=["node", *PRINTS])

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, " + ", ".join(f"{p} long" for p in PRINTS))


def listed(texts: DataFrame, width: int) -> DataFrame:
    """``node, items``: the shingles of each text."""

    def run(batches):
        for b in batches:
            for first, n_texts, of, items in shingle_sets(b.column(1), width):
                offsets = pa.array(np.r_[np.searchsorted(of, np.arange(n_texts)), len(of)], pa.int32())
                sets = pa.ListArray.from_arrays(offsets, pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n_texts), sets], names=["node", "items"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, items array<long>")


def links_between(nodes, classes, prints, items, offsets, similarity: float) -> list[tuple[int, int]]:
    """Pairs of near copies that join the classes they are known to have, no more than it takes."""
    _, codes = np.unique(items, return_inverse=True)
    size = np.diff(offsets)
    mark = np.zeros(codes.max(initial=-1) + 1, bool)
    root, out = classes.copy(), []
    planes = bit_planes(prints) if len(nodes) > SMALL else None
    for i in range(len(nodes)):
        apart = root != root[i]
        apart[:i] = False
        if planes is not None and apart.any():
            alive = np.zeros(8 * planes.shape[1], np.uint8)
            packed = np.packbits(apart, bitorder="little")
            alive[: len(packed)] = packed
            near = set_bits(within(planes, flips_of(prints[i]), alive.view(np.uint64), RADIUS))
            apart[:] = False
            apart[near] = True
        if not apart.any():
            continue
        own = codes[offsets[i] : offsets[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[codes].astype(np.int32), offsets[:-1])
        mark[own] = False
        for j in np.flatnonzero(apart & (common >= similarity * (size + size[i] - common) - SLACK)).tolist():
            if root[j] != root[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                root[root == root[j]] = root[i]
    return out


def near_copies(docs: DataFrame, row: str = "row", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``row, first`` of those rows of ``docs`` that have near copies, ``first`` telling the one row
    of each class that stays: the smallest doc_id, a null one last. Texts without words, nulls among
    them, are copies of each other; so are repeated rows."""
    rows = with_row(docs.select("doc_id", "text"), row).withColumnRenamed(row, "node")
    counts = slot_counts(rows, width)
    recurring = stored(prefixes(rows, counts, width, similarity).groupBy("key").count().filter("count > 1").select("key"), "overlap-keys")
    # a bounded filter keeps most other keys from the join, which is exact
    bitmap = bloom(recurring.select(F.col("key").alias("anchor")), recurring.count())
    shared = stored(prefixes(rows, counts, width, similarity, bitmap).join(broadcast_if(recurring, BROADCAST_ROWS // 10), "key"), "overlap-shared")
    nodes = stored(shared.select("node").distinct(), "overlap-nodes")
    prints = stored(fingerprints(rows.join(broadcast_if(nodes, BROADCAST_ROWS), "node", "left_semi"), width), "overlap-prints")

    buckets = shared.join(broadcast_if(prints, BROADCAST_ROWS // 10), "node")
    parts = chunk_pairs(buckets, "node", CHUNK_ROWS).select("key", "part", "node", *PRINTS)
    stars = parts.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(tidy(lambda b: bucket_links(b, WORDS, RADIUS)), "a long, b long")
    stars = stored(stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "overlap-stars")
    discard(recurring, shared, nodes)

    # members of the candidate classes against the best connected of each; only their sets are listed
    members = stored(components(stars), "overlap-candidates")
    sets = stored(listed(rows.join(broadcast_if(members.select("node"), BROADCAST_ROWS), "node", "left_semi"), width), "overlap-sets")
    degree = stars.groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("n"))
    ranked = members.join(degree, "node", "left").select("root", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "node").alias("best"))
    leads = stored(ranked.groupBy("root").agg(F.max("best").alias("best")).select("root", F.col("best.node").alias("lead")), "overlap-leads")
    placed = members.join(broadcast_if(leads, BROADCAST_ROWS), "root")
    lead_sets = stored(sets.join(leads, sets.node == leads.lead).select("lead", F.col("items").alias("lead_items")), "overlap-lead-sets")
    common, total = F.size(F.array_intersect("items", "lead_items")), F.size("items") + F.size("lead_items")
    both = placed.join(sets.select("node", "items"), "node").join(broadcast_if(lead_sets, BROADCAST_ROWS // 50), "lead")
    placed = stored(both.select("root", "node", "lead", (common >= similarity * (total - common) - SLACK).alias("linked")), "overlap-placed")

    # members of classes that this did not close, against all that are apart from them
    still = placed.groupBy("root").agg(F.min("linked").alias("closed")).filter("NOT closed").select(F.col("root").alias("key"))
    apart = placed.join(still, placed.root == still.key).select("key", "node", F.when(F.col("linked"), F.col("lead")).otherwise(F.col("node")).alias("class"))
    apart = chunk_pairs(apart.join(sets, "node").join(prints, "node"), "node", CHUNK_ITEMS, F.sum(F.size("items") + 64))

    def compare(t):
        offsets = t.column("items").combine_chunks()
        offsets, items = offsets.offsets.to_numpy(), offsets.values.to_numpy()
        prints = np.stack([t.column(p).to_numpy() for p in PRINTS], axis=1).view(np.uint64)
        found = links_between(t.column("node").to_numpy(), t.column("class").to_numpy(), prints, items[offsets[0] : offsets[-1]], offsets - offsets[0], similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rest = apart.groupBy("key", "part").applyInArrow(compare, "a long, b long")
    links = placed.filter("linked AND node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).unionByName(rest)
    roots = stored(components(links), "overlap-roots")
    discard(sets, prints, stars, members, leads, lead_sets, placed)
    of_class = rows.select("node", "doc_id").join(broadcast_if(roots, BROADCAST_ROWS), "node")
    best = of_class.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("best"))
    return roots.join(best, "root").select(F.col("node").alias(row), (F.col("node") == F.col("best.node")).alias("first"))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with all its columns, one row (the smallest doc_id) of each class of near copies.
    Null and empty texts are copies of each other; an empty table gives an empty one."""
    docs, row = scanned(docs), fresh(docs, "row")
    gone = stored(near_copies(docs, row, width, similarity).filter("NOT first").select(row), "overlap-dropped")
    return with_row(docs, row).join(broadcast_if(gone, 2 * BROADCAST_ROWS), row, "left_anti").drop(row)
