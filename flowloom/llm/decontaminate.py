"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised word windows form a broadcast hash set of n-grams, each filed under the
hash of those two neighbouring words of it that are rarest in the benchmark. Document words stream
past it inside one generated stage: a pair that is in the set proposes the windows around it, and the
document's own word window is compared with each, word by word. Nothing but documents' hits and one row per document is ever shuffled. A benchmark larger
than one broadcast is taken in blocks, each a pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, discard, fresh, scanned, stored, table, text_or_empty, with_row

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Bytes of the windows in a broadcast block, each taken as its words and so much beside.
BLOCK_BYTES, WINDOW_BYTES = 32 << 20, 200
#: Contaminated rows are broadcast up to this count (16 MB), else the join shuffles.
BROADCAST_ROWS = 2_000_000
#: What separates words: everything of ASCII but digits and lower-case letters.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str | Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text_or_empty(text)), SEPARATORS), "")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Of a table ``item_id, text`` its distinct windows, ``window, gram, offset, anchor``, and their
    items, ``window, item_id``, which no broadcast holds.

    An item shorter than ``size`` words is one window; one without words has none. ``anchor`` is the
    hash of the two neighbouring words that fewest windows hold (of equals the first), or of the only
    word, and ``offset`` their place in the window.
    """
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w"))
    last = F.greatest(F.size("w") - size, F.lit(0))
    grams = w.filter(F.size("w") > 0).select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("gram"))
    pairs = stored(grams.distinct(), "benchmark-grams")
    windows = stored(pairs.select("gram").distinct().select(F.monotonically_increasing_id().alias("window"), "gram"), "benchmark-windows")
    steps = F.sequence(F.lit(0), F.size("gram") - 2)
    places = windows.filter(F.size("gram") > 1).select("window", F.posexplode(F.transform(steps, lambda i: F.xxhash64(F.get("gram", i), F.get("gram", i + 1)))).alias("offset", "anchor"))
    counts = places.groupBy("anchor").agg(F.countDistinct("window").alias("windows"))
    rarest = places.join(counts, "anchor").groupBy("window").agg(F.min(F.struct("windows", "offset", "anchor")).alias("rarest"))
    anchored = windows.join(rarest, "window", "left").select(
        "window",
        "gram",
        F.coalesce("rarest.offset", F.lit(0)).alias("offset"),
        F.coalesce("rarest.anchor", F.xxhash64(F.get("gram", F.lit(0)))).alias("anchor"),
    )
    members = stored(pairs.filter("item_id IS NOT NULL").join(windows, "gram").select("window", "item_id"), "benchmark-items")
    anchored = stored(anchored, "benchmark-anchors")
    discard(pairs, windows)
    return anchored, members


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, row: str = "row", block: int = BLOCK_BYTES) -> DataFrame:
    """Hits of every row of ``docs`` (a table scan with ``doc_id``, ``text``): ``row, doc_id, n_words,
    hits, items`` with hits an array of ``(start, length)``, counted in words from 0, and the sorted
    item_ids whose windows they are.

    Nulls have no words; benchmark rows with a null item_id have windows that count as hits of no
    item. Repeated items count once, repeated rows each get their own hits.
    """
    grams, members = item_windows(benchmark, size)
    weight = F.coalesce(F.sum(F.octet_length(F.array_join("gram", " ")) + WINDOW_BYTES), F.lit(0))
    bytes_, single = grams.agg(weight, F.count_if(F.size("gram") == 1)).first()
    blocks = max(1, -(-bytes_ // block))
    text = with_row(docs.select("doc_id", "text"), row).select(row, "doc_id", words("text").alias("w"))
    stream = text.select(row, "doc_id", "w", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    keyed = stream.withColumn("key", F.xxhash64("word", F.get("w", F.col("pos") + 1)))
    start, n = F.col("pos") - F.col("offset"), F.size("gram")
    same = (F.col("key") == F.col("anchor")) & (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, n) == F.col("gram"))
    found = None
    for b in range(blocks):
        part = grams if blocks == 1 else grams.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        hit = F.when(F.col("anchor").isNotNull(), F.struct(start.alias("start"), n.alias("length"), F.col("window")))
        met = keyed.join(F.broadcast(part.filter(F.size("gram") > 1)), same, "left").filter(F.col("pos").isNull() | (F.col("pos") == 0) | F.col("anchor").isNotNull()).select(row, "doc_id", "n_words", hit.alias("hit"))
        if single:  # windows of one word have no pair
            lone = stream.withColumn("key", F.xxhash64("word")).join(F.broadcast(part.filter(F.size("gram") == 1)), same)
            met = met.unionAll(lone.select(row, "doc_id", "n_words", hit.alias("hit")))
        found = met if found is None else found.unionAll(met)
    found = stored(found.groupBy(row, "doc_id", "n_words").agg(F.collect_list("hit").alias("hits")), "benchmark-hits")
    seen = found.filter(F.size("hits") > 0).select(row, F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window"))
    items = seen.join(broadcast_if(members, BROADCAST_ROWS // 2), "window").groupBy(row).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    items = stored(items, "benchmark-found")
    few = items.agg(F.coalesce(F.sum(F.size("items") + 4), F.lit(0))).first()[0] <= BROADCAST_ROWS // 2
    hits = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length")))
    out = found.select(row, "doc_id", "n_words", hits.alias("hits")).join(F.broadcast(items) if few else items.hint("merge"), row, "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def judged(hits: DataFrame) -> DataFrame:
    """Adds ``n_hit`` (words inside any hit) and ``contaminated``."""
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.start, h.start + h.length - 1))))
    return (
        hits.withColumn("n_hit", F.size(covered).cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns and without its contamination.

    ``remove="documents"`` drops contaminated rows; ``"spans"`` keeps every row and takes the hit
    words out of the texts that have any (their remaining normalised words, joined by a space).
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    docs, row = scanned(docs), fresh(docs, "row")
    hits = judged(scan(docs, benchmark, size, row))
    rows = with_row(docs, row)
    if remove == "documents":
        gone = stored(hits.filter("contaminated").select(row), "contaminated")
        return rows.join(broadcast_if(gone, BROADCAST_ROWS), row, "left_anti").drop(row)
    mark = fresh(docs, "hits")
    hit = hits.filter("n_hit > 0").select(row, F.col("hits").alias(mark))
    clean = F.array_join(F.filter(words("text"), lambda w, i: ~F.exists(mark, lambda h: (i >= h.start) & (i < h.start + h.length))), " ")
    return rows.join(hit, row, "left").withColumn("text", F.when(F.col(mark).isNull(), F.col("text")).otherwise(clean)).drop(row, mark)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document. Null and empty texts have no words and no hits; repeated
    rows each have theirs; a null item_id counts hits but no item; with an empty benchmark nothing
    is hit; an empty table gives no rows."""
    found = judged(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {
    "op2_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
        list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:least(i + 12, len(w))], ' ') AS gram, least(13, len(w)) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT r, i, g.n, item_id FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p) q JOIN g USING (n, gram)),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
}
