"""Substring deduplication with repeated-phrase automata.

A window is 13 consecutive words of one document. Each window is filed under its anchor: of the
eight runs of six words inside it, the one with the smallest hash, so equal windows have equal
anchors and neighbours mostly share one.

1. Whole later copies of a text are found by digest and need no windows of their own: their first
   copy has the same windows and a smaller id.
2. Anchors are counted over all documents. Windows under an anchor of one document can't recur.
3. Documents stream again; the stretches of windows whose anchor recurs go to the anchor's shard.
   A Bloom filter of the recurring anchors keeps the rest back; a false hit costs a row, no more.
   With more anchors than the filter is good for, stretches meet the anchors in a join instead.
4. A shard confirms the recurring windows on the words themselves, compiles them into an
   Aho-Corasick automaton over words, and runs it over its stretches to locate every occurrence.
   Anchors of more than ``HOT`` stretches are split: parts report their windows, the reports merge
   by window, and a part's automaton holds those of its own windows that the merge confirmed.
5. Located words are taken out of the documents that have any.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, discard, fresh, scanned, stored, table, text_or_empty, with_row
from .kernels import blank_separated, grams, slices, sliding_min, tidy

WINDOW, ANCHOR = 13, 6
#: Most windows in one stretch; longer runs continue in the next.
STRETCH = 64
#: An anchor with more stretches than this is split into 8, 64, ... parts of at most about so many.
HOT = 1_000
#: Most bits of the Bloom filter of recurring anchors (32 MB), and the least for each anchor.
FILTER_BITS, BITS_EACH = 1 << 28, 8
#: Bytes of stretches compiled into one automaton, as far as whole anchors allow.
UNIT = 1 << 19
BROADCAST_ROWS = 1_000_000
#: Stands for a null doc_id: no id is larger.
LAST = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
BLANKS = "[\\x20\\x09-\\x0D]+"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def facts(docs: DataFrame, row: str) -> DataFrame:
    """``row, doc_id, n_words, sha``: word count and digest of the space-joined words."""
    joined = F.trim(F.regexp_replace(text_or_empty("text"), BLANKS, " "))
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), joined.alias("words")), row)
    n = F.when(F.col("words") == "", F.lit(0)).otherwise(F.size(F.split("words", " ")))
    return rows.select(row, "doc_id", n.cast("long").alias("n_words"), F.sha2("words", 256).alias("sha"))


def _windows(data, offsets):
    """Of a slice: words' texts and hashes; windows' first words and anchors."""
    text, hashes = blank_separated(data, offsets)
    anchor = sliding_min(grams(hashes, ANCHOR), WINDOW - ANCHOR + 1)
    at = np.flatnonzero(text[: len(anchor)] == text[WINDOW - 1 :]) if len(anchor) else np.empty(0, np.int64)
    return text, at, anchor[at]


def anchor_counts(rows: DataFrame) -> DataFrame:
    """``anchor, parts``: the anchors that stand in several rows, and in how many parts the stretches
    of each are compared."""

    def run(batches):
        for b in batches:
            found = []
            for first, data, offsets in slices(b.column(1)):
                anchor, of, _, _ = _runs(data, offsets)
                order = np.lexsort((of, anchor))
                found.append(np.stack([anchor[order].view(np.int64), first + of[order]]))
            anchor, of = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            order = np.lexsort((of, anchor))
            anchor, of = anchor[order], of[order]
            start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else anchor
            texts = np.add.reduceat(np.r_[True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])].astype(np.int64), start) if len(anchor) else anchor
            yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor[start], texts, np.diff(np.r_[start, len(anchor)])))], names=["anchor", "texts", "runs"])

    counts = rows.mapInArrow(tidy(run), "anchor long, texts long, runs long").groupBy("anchor").agg(F.sum("texts").alias("texts"), F.sum("runs").alias("runs"))
    tier = F.ceil(F.log(F.col("runs") / HOT) / float(np.log(8)) - 1e-9)
    return counts.filter("texts > 1").select("anchor", F.when(F.col("runs") > HOT, F.pow(F.lit(8.0), tier)).otherwise(1).cast("long").alias("parts"))


def bloom(anchors: DataFrame, count: int) -> np.ndarray:
    """A bitmap of the anchors' low bits. Its size is bounded, whatever their number."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    parts = 64

    def fill(key, rows):
        at = (rows.column("anchor").to_numpy().view(np.uint64) & np.uint64(bits // parts - 1)).astype(np.int64)
        flags = np.zeros(bits // parts, bool)
        flags[at] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    part = F.shiftrightunsigned(F.col("anchor").bitwiseAND(F.lit(bits - 1)), (bits // parts).bit_length() - 1).alias("part")
    out = np.zeros((parts, bits // parts // 8), np.uint8)
    for r in anchors.select(part, "anchor").groupBy("part").applyInArrow(fill, "part long, bits binary").toLocalIterator():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _runs(data, offsets, bitmap=None):
    """``anchor, text, first word, windows`` of the runs of windows of one anchor, cut at
    ``STRETCH``; with a bitmap only of those whose anchor may be in it. Words count within a text."""
    text, at, anchor = _windows(data, offsets)
    if bitmap is not None:
        maybe = maybe_in(bitmap, anchor)
        at, anchor = at[maybe], anchor[maybe]
    if not len(at):
        return anchor, at, at, at
    start = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])])
    length = np.diff(np.r_[start, len(at)])
    pieces = -(-length // STRETCH)
    inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(start, pieces) + inside * STRETCH
    size = np.minimum(STRETCH, np.repeat(length, pieces) - inside * STRETCH)
    word, of = at[begin], text[at[begin]]
    return anchor[begin], of, word - np.searchsorted(text, np.arange(len(offsets)))[of], size


def _bodies(data, offsets, of, word, size) -> list[bytes]:
    """The space-joined words of stretches; those of one text stand together."""
    out, known, words = [], None, []
    for k, w, n in zip(of.tolist(), word.tolist(), size.tolist()):
        if k != known:
            known, words = k, data[offsets[k] : offsets[k + 1]].tobytes().split()
        out.append(b" ".join(words[w : w + n + WINDOW - 1]))
    return out


def maybe_in(bitmap: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which anchors the filter lets through."""
    bit = (anchor & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def stretches(rows: DataFrame, row: str, anchors: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``anchor, parts, row, doc_id, at, body``: runs of windows of one anchor that may recur, as
    their space-joined words from word ``at`` on. Each number of parts (``sizes``: how many anchors
    have it) has a filter of its own; an anchor that several let through takes the most parts."""
    every = bloom(anchors, sum(sizes.values()))
    tiers = [(n, bloom(anchors.filter(F.col("parts") == n), sizes[n])) for n in sorted(sizes) if n > 1]
    held = rows.sparkSession.sparkContext.broadcast((every, tiers))

    def run(batches):
        for b in batches:
            numbers, ids = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in slices(b.column(2)):
                anchor, of, word, size = _runs(data, offsets, held.value[0])
                parts = np.ones(len(of), np.int64)
                for n, bitmap in held.value[1]:
                    parts[maybe_in(bitmap, anchor)] = n
                if len(of):
                    columns = [anchor.view(np.int64), parts, numbers[first + of], ids[first + of], word]
                    body = pa.array(_bodies(data, offsets, of, word, size), pa.binary())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), body], names=["anchor", "parts", row, "doc_id", "at", "body"])

    return rows.mapInArrow(tidy(run), f"anchor long, parts long, `{row}` long, doc_id long, at long, body binary")


def joined_stretches(rows: DataFrame, row: str, anchors: DataFrame) -> DataFrame:
    """The same by a join, whatever the number of anchors: places of runs meet the anchors first,
    and only documents with a run that stays are read for its words."""

    def places(batches):
        for b in batches:
            numbers = b.column(0).to_numpy()
            for first, data, offsets in slices(b.column(1)):
                anchor, of, word, size = _runs(data, offsets)
                if len(of):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor.view(np.int64), numbers[first + of], word, size))], names=["anchor", row, "at", "n"])

    def cut(batches):
        for b in batches:
            runs = b.column(3)
            count = np.diff(runs.offsets.to_numpy())
            of = np.repeat(np.arange(len(b)), count)
            anchor, parts, at, n = (x.to_numpy() for x in runs.flatten().flatten())
            numbers, ids = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in slices(b.column(2)):
                mine = slice(*np.searchsorted(of, [first, first + len(offsets) - 1]))
                o = of[mine]
                if len(o):
                    columns = [anchor[mine], parts[mine], numbers[o], ids[o], at[mine]]
                    body = pa.array(_bodies(data, offsets, o - first, at[mine], n[mine]), pa.binary())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), body], names=["anchor", "parts", row, "doc_id", "at", "body"])

    runs = rows.select(row, "text").mapInArrow(tidy(places), f"anchor long, `{row}` long, at long, n long")
    kept = runs.join(anchors.hint("merge"), "anchor")
    of_row = kept.groupBy(row).agg(F.collect_list(F.struct("anchor", "parts", "at", "n")).alias("runs"))
    return rows.join(of_row.hint("merge"), row).select(row, "doc_id", "text", "runs").mapInArrow(tidy(cut), f"anchor long, parts long, `{row}` long, doc_id long, at long, body binary")


class _Alphabet(dict):
    """A character for each word of a shard, so that phrases are short strings."""

    def __missing__(self, word):
        n = len(self) + 1
        self[word] = c = chr(n if n < 0xD800 else n + 0x800)
        return c


def _as_strings(bodies) -> list[str]:
    letter = _Alphabet().__getitem__
    return ["".join(map(letter, b.split(b" "))) for b in bodies]


def _recurring(strings, ids) -> dict[str, int]:
    """The windows that stand under several ids, with the smallest."""
    low: dict[str, int] = {}
    several: set[str] = set()
    for s, i in zip(strings, ids):
        for k in range(len(s) - WINDOW + 1):
            w = s[k : k + WINDOW]
            least = low.setdefault(w, i)
            if i != least:
                several.add(w)
                if i < least:
                    low[w] = i
    return {w: low[w] for w in several}


def _locate(phrases: dict[str, int], strings, ids, rows, ats, row: str) -> pa.RecordBatch:
    """Word ranges covered by occurrences of phrases that a smaller id has too."""
    found: tuple[list, list, list] = ([], [], [])
    if phrases:
        automaton = ahocorasick.Automaton()
        for phrase, smallest in phrases.items():
            automaton.add_word(phrase, smallest)
        automaton.make_automaton()
        for s, i, r, at in zip(strings, ids, rows, ats):
            begin = stop = -1
            for end, smallest in automaton.iter(s):
                if smallest < i:
                    if end - WINDOW + 1 > stop:
                        if stop > 0:
                            for x, v in zip(found, (r, at + begin, at + stop)):
                                x.append(v)
                        begin = end - WINDOW + 1
                    stop = end + 1
            if stop > 0:
                for x, v in zip(found, (r, at + begin, at + stop)):
                    x.append(v)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=[row, "begin", "stop"])


def _units(batches, key_columns: int):
    """Regroup sorted batches into tables of whole keys with about ``UNIT`` bytes of bodies."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        step = max(1, UNIT * batch.num_rows // max(1, batch.nbytes))
        for first in range(0, batch.num_rows, step):
            b = batch.slice(first, step)
            held.append(b)
            n += b.nbytes
            if n < UNIT:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([t.column(i).to_numpy() for i in range(key_columns)])
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), t.slice(cut).nbytes
    if held:
        yield pa.Table.from_batches(held)


def located(found: DataFrame, row: str, split: bool) -> DataFrame:
    """``row, begin, stop``: every range of words to take out, from stored stretches."""

    def shard(batches):
        for t in _units(batches, 1):
            strings, ids = _as_strings(t.column("body").to_pylist()), t.column("doc_id").to_pylist()
            yield _locate(_recurring(strings, ids), strings, ids, t.column(row).to_pylist(), t.column("at").to_pylist(), row)

    schema = f"`{row}` long, begin long, stop long"
    cold = found.filter("parts = 1").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(shard), schema)
    if not split:
        return cold

    part = F.pmod(F.xxhash64(row, "at"), F.col("parts"))
    hot = found.filter("parts > 1").select("anchor", part.alias("part"), row, "doc_id", "at", "body")

    def report(batches):
        for t in _units(batches, 2):
            low: dict[tuple, int] = {}
            high: dict[tuple, int] = {}
            for a, p, body, i in zip(*(t.column(c).to_pylist() for c in ("anchor", "part", "body", "doc_id"))):
                words = body.split(b" ")
                for k in range(len(words) - WINDOW + 1):
                    w = (a, p, b" ".join(words[k : k + WINDOW]))
                    low[w] = min(low.get(w, i), i)
                    high[w] = max(high.get(w, i), i)
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*low), (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(low.values()), pa.int64()), pa.array([high[w] for w in low], pa.int64())], names=["anchor", "part", "phrase", "low", "high"])

    reports = hot.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(tidy(report), "anchor long, part long, phrase binary, low long, high long")
    reports = stored(reports, "phrase-reports")
    confirmed = reports.groupBy("anchor", "phrase").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").drop("most")
    confirmed = reports.join(confirmed, ["anchor", "phrase"]).filter("least < high").select("anchor", "part", "phrase", "least")

    def locate(key, rows, phrases):
        letter = _Alphabet().__getitem__
        code = lambda b: "".join(map(letter, b.split(b" ")))
        known = {code(p): least for p, least in zip(phrases.column("phrase").to_pylist(), phrases.column("least").to_pylist())}
        strings = list(map(code, rows.column("body").to_pylist()))
        return pa.Table.from_batches([_locate(known, strings, rows.column("doc_id").to_pylist(), rows.column(row).to_pylist(), rows.column("at").to_pylist(), row)])

    warm = hot.groupBy("anchor", "part").cogroup(confirmed.groupBy("anchor", "part")).applyInArrow(locate, schema)
    return cold.unionAll(warm)


def repeats(docs: DataFrame, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """``(rows, marks)`` of a table scan ``docs`` with ``doc_id`` (whole numbers) and ``text``.

    ``rows``: ``row, doc_id, n_words, sha, copy``, one for each row; ``copy`` tells that a smaller
    doc_id has the same words (13 or more), so all words go. ``marks``: ``row, ranges``, the word
    ranges (begin, stop) that go in the other rows that have any. A window of words is marked where
    it also starts in a document with a smaller doc_id; a null id is larger than all others, rows
    that repeat an id are one document's. Null texts have no words.
    """
    docs = scanned(docs)
    known = stored(facts(docs, row), "phrase-facts")
    of = F.coalesce("doc_id", F.lit(LAST))
    firsts = stored(known.filter(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min(of).alias("smallest"), F.max(of).alias("largest")).filter("smallest < largest"), "phrase-copies")
    rows = known.join(broadcast_if(firsts.select("sha", "smallest"), BROADCAST_ROWS // 4), "sha", "left").select(row, "doc_id", "n_words", "sha", F.coalesce(F.col("smallest") < of, F.lit(False)).alias("copy"))
    rows = stored(rows, "phrase-rows")
    copies = rows.filter("copy").select(row)
    texts = with_row(docs.select(of.cast("long").alias("doc_id"), "text"), row).join(broadcast_if(copies, 2 * BROADCAST_ROWS), row, "left_anti")

    counts = stored(anchor_counts(texts.select("doc_id", "text")), "phrase-anchors")
    sizes = {r["parts"]: r["count"] for r in counts.groupBy("parts").count().collect()}
    texts = texts.select(row, "doc_id", "text")
    found = stretches(texts, row, counts, sizes) if BITS_EACH * sum(sizes.values()) <= FILTER_BITS else joined_stretches(texts, row, counts)
    found = stored(found, "phrase-stretches")
    marks = located(found, row, max(sizes, default=1) > 1).groupBy(row).agg(F.collect_list(F.struct("begin", "stop")).alias("ranges"))
    marks = stored(marks, "phrase-marks")
    discard(known, firsts, counts, found)
    return rows, marks


def _marked(docs: DataFrame, marks: DataFrame, row: str, ranges: str, how: str) -> DataFrame:
    """``docs`` with its row number and its ranges; the marks are broadcast only while small."""
    n = marks.agg(F.coalesce(F.sum(F.size("ranges") + 4), F.lit(0))).first()[0]
    marks = marks.withColumnRenamed("ranges", ranges)
    return with_row(docs, row).join(F.broadcast(marks) if n <= 3 * BROADCAST_ROWS else marks.hint("merge"), row, how)


def kept_words(text: str | None, ranges) -> list[bytes]:
    words = split_words(text)
    keep = np.ones(len(words), bool)
    for r in ranges:
        keep[r["begin"] : r["stop"]] = False
    return [words[i] for i in np.flatnonzero(keep)]


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns; texts that lose words become their kept words, space-joined."""
    docs = scanned(docs)
    row, ranges, copy = fresh(docs, "row"), fresh(docs, "ranges"), fresh(docs, "copy")
    rows, marks = repeats(docs, row)

    @F.pandas_udf("string")
    def kept(texts, ranges):
        return pd.Series([b" ".join(kept_words(t, () if r is None else r)).decode("utf-8", "surrogatepass") for t, r in zip(texts, ranges)])

    copies = rows.filter("copy").select(row, F.lit(True).alias(copy))
    out = _marked(docs, marks, row, ranges, "left").join(broadcast_if(copies, BROADCAST_ROWS), row, "left")
    text = F.when(F.col(copy), F.lit("")).when(F.col(ranges).isNotNull(), kept("text", ranges)).otherwise(F.col("text"))
    return out.withColumn("text", text).drop(row, ranges, copy)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of those kept. Null and empty texts have no
    words; a null doc_id counts as the largest; rows that repeat a doc_id are one document's and
    remove nothing from each other; ties go to the smallest doc_id; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    rows, marks = repeats(docs)

    def digest(batches):
        for b in batches:
            n, sha = [], []
            for t, r in zip(b.column(1), b.column(2)):  # one text's words at a time
                kept = kept_words(t.as_py(), r.as_py())
                n.append(len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["row", "n_kept", "kept"])

    cut = _marked(docs.select("text"), marks, "row", "ranges", "inner").select("row", "text", "ranges").mapInArrow(tidy(digest), "row long, n_kept long, kept string")
    return rows.join(cut, "row", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.col("n_words") - F.coalesce("n_kept", "n_words")).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT gram, min(doc_id) AS smallest FROM p GROUP BY gram HAVING min(doc_id) < max(doc_id)),
c AS (SELECT r, list(DISTINCT k) AS gone FROM (SELECT r, unnest(range(i, i + 13)) AS k FROM p JOIN m USING (gram) WHERE smallest < doc_id) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (r)"""
}
