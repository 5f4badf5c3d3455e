"""A Merkle manifest of a dataset: a tree for each language, a tree over their roots, proofs of rows.

Leaves lie in ascending order of doc_id and are cut into aligned blocks of ``2 ** LEVELS`` leaves. Each block
has a builder that writes the nodes of its subtree in the order in which they are completed (postorder),
an append-only log of 32-byte digests. The roots of all blocks are the leaves of the next tier, which is
built in the same way, until one block is left. Where a node lies in a log follows from subtree sizes
alone: leaf ``i`` comes after ``i`` leaves and all nodes that these complete, at ``2 i - popcount(i)``; a node
``l`` levels up comes ``l`` places after the last leaf below it. So a proof reads its siblings from
computed places, without pointers and without building anything again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, discard, fresh, stored, table
from .kernels import tidy

#: Levels of a block's subtree: a block has ``2 ** LEVELS`` leaves.
LEVELS = 10
#: Leaves of a range when they are put in order, about.
RANGE_ROWS = 500_000
#: Lists with one row for each group and sorted file, or each block, are broadcast up to this count.
BROADCAST_ROWS = 200_000
DIGEST = 32
#: Sides of a sibling in a path: there is none, it is the left one, the right one.
NONE, LEFT, RIGHT = 0, 1, 2
_STEP = 1 + DIGEST


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    return max(0, leaves - 1).bit_length()


def position(level: int, at, leaves: int):
    """Where node ``at`` of ``level`` lies in the postorder log of ``leaves`` leaves."""
    last = np.minimum((np.asarray(at, np.int64) + 1) << level, leaves) - 1
    return 2 * last - np.bitwise_count(last).astype(np.int64) + level


def parent(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def append_log(leaves: list[bytes], levels: int) -> bytes:
    """The nodes up to ``levels`` in the order of completion; a run that lacks its second node at the
    right edge is completed, alone, after the last leaf."""
    log: list[bytes] = []
    open_: list[tuple[int, bytes]] = []  # subtrees that wait for a right neighbour, levels falling
    for leaf in leaves:
        log.append(leaf)
        level, node = 0, leaf
        while open_ and open_[-1][0] == level and level < levels:
            node = parent(open_.pop()[1], node)
            level += 1
            log.append(node)
        open_.append((level, node))
    level, node = open_.pop()
    while level < levels:
        node = parent(open_.pop()[1], node) if open_ and open_[-1][0] == level else parent(node)
        level += 1
        log.append(node)
    return b"".join(log)


def siblings(log: bytes, leaves: int, levels: int) -> list[bytes]:
    """For each leaf the path to the top of the log: for each level a side and the sibling there."""
    nodes = np.frombuffer(log, np.uint8).reshape(-1, DIGEST)
    steps = np.zeros((leaves, levels, _STEP), np.uint8)
    for level in range(levels):
        at = np.arange(leaves) >> level
        other = at ^ 1
        there = other < -(-leaves >> level)
        steps[there, level, 0] = np.where(other < at, LEFT, RIGHT)[there]
        steps[there, level, 1:] = nodes[position(level, other[there], leaves)]
    return [s.tobytes() for s in steps]


def path_digests(path: bytes) -> list[bytes]:
    return [path[i + 1 : i + _STEP] for i in range(0, len(path), _STEP) if path[i] != NONE]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    node = leaf
    for i in range(0, len(path), _STEP):
        side, other = path[i], path[i + 1 : i + _STEP]
        node = parent(node) if side == NONE else parent(other, node) if side == LEFT else parent(node, other)
    return node


@dataclass
class Tree:
    """Stored tiers of blocks, the lowest first: ``grp, block, total, leaves, log, top`` and, in the
    lowest, ``payload`` columns as arrays in leaf order. ``total`` counts the tier's leaves of the group."""

    levels: int
    tiers: list[DataFrame] = field(default_factory=list)

    def tops(self) -> DataFrame:
        """``grp, top``: the root of each group."""
        done = [t.filter(F.col("total") <= 1 << self.levels).select("grp", "top") for t in self.tiers]
        whole = done[0]
        for d in done[1:]:
            whole = whole.unionByName(d)
        return whole


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) stored in ascending order of ``grp`` and ``order``, with the place of each
    in its group as ``at`` and the group's count as ``total``. No group passes through one task: the
    sorted files number their rows and a short list holds what lies before each file."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    placed = stored(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys), "in-order")
    where, row = fresh(rows, "where"), fresh(rows, "row")
    placed = placed.select("*", F.col("_metadata.file_path").alias(where), F.col("_metadata.row_index").alias(row))
    runs = placed.groupBy("grp", where).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"), F.min(F.struct(*order)).alias("least"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(whole.orderBy("least", where).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("grp", where, (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total")), "runs")
    return placed.join(broadcast_if(runs, BROADCAST_ROWS), ["grp", where]).withColumn("at", F.col(row) + F.col("shift")).drop(where, row, "shift")


def _builder(levels: int, carried: tuple[str, ...]):
    """What turns the leaves of one aligned block into the block's row."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        n, total = rows.num_rows, rows.column("total")[0].as_py()
        log = append_log(rows.column("digest").to_pylist(), min(levels, height(total)))
        columns = {c: rows.column(c).slice(0, 1) for c in ("grp", "block", "total")}
        columns |= {"leaves": pa.array([n], pa.int32()), "log": pa.array([log]), "top": pa.array([log[-DIGEST:]])}
        columns |= {c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column(c).combine_chunks()) for c in carried}
        return pa.table(columns)

    return run


def build(leaves: DataFrame, levels: int, payload: tuple[str, ...] = ()) -> Tree:
    """The trees of all groups of ``leaves``: ``grp, at, total, digest`` and the columns ``payload``."""
    tree, block, most = Tree(levels), 1 << levels, leaves.agg(F.max("total")).first()[0] or 0
    while True:
        carried = payload if not tree.tiers else ()
        kinds = {c: leaves.schema[c].dataType.simpleString() for c in carried}
        schema = "grp string, block long, total long, leaves int, log binary, top binary" + "".join(f", `{c}` array<{k}>" for c, k in kinds.items())

        blocks = leaves.select("grp", F.shiftright("at", levels).alias("block"), "at", "total", "digest", *carried).groupBy("grp", "block").applyInArrow(_builder(levels, carried), schema)
        tree.tiers.append(stored(blocks, f"tier-{len(tree.tiers)}"))
        if most <= block:
            return tree
        most = -(-most // block)
        leaves = tree.tiers[-1].filter(F.col("total") > block).select("grp", F.col("block").alias("at"), F.ceil(F.col("total") / block).alias("total"), F.col("top").alias("digest"))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The blocks of the lowest tier with ``above``, the path from each block's root to the very top,
    where ``above`` (``grp, above`` and more) has that of each group's root."""
    more, levels = [c for c in above.columns if c not in ("grp", "above")], tree.levels

    def down(batches):
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                local = siblings(r["log"], r["leaves"], min(levels, height(r["total"])))
                first, n = r["block"] << levels, len(local)
                columns = [pa.array([r["grp"]] * n), pa.array(range(first, first + n), pa.int64()), pa.array([s + r["above"] for s in local], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[c]] * n, pa.binary()) for c in more)], names=["grp", "block", "above", *more])

    schema = "grp string, block long, above binary" + "".join(f", {c} binary" for c in more)
    lower = None
    for tier in reversed(tree.tiers):
        tops = tier.filter(F.col("total") <= 1 << levels).join(broadcast_if(above, BROADCAST_ROWS), "grp")
        if lower is not None:
            tops = tops.unionByName(tier.filter(F.col("total") > 1 << levels).join(broadcast_if(lower, BROADCAST_ROWS), ["grp", "block"]))
        if tier is tree.tiers[0]:
            return tops
        lower = stored(tops.select("grp", "block", "total", "leaves", "log", "above", *more).mapInArrow(tidy(down), schema), "paths")


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: for each column ``-`` for null, else the value's bytes, ``:`` and the value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


@dataclass
class Manifest:
    documents: Tree
    languages: Tree
    subroots: DataFrame
    root: bytes | None
    kind: str
    levels: int


def manifest(docs: DataFrame, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs`` (``doc_id, source, lang, n_chars, text``). Leaves of a language ascend by
    doc_id, null ids first; rows that share one lie in the order of their digests. Languages ascend
    bytewise, null first. An empty table has no root."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    forged = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null before all others
    rows = stored(docs.select(grp.alias("grp"), "doc_id", leaf_digest(columns).alias("digest"), F.when(tampered, leaf_digest(forged)).alias("forged")), "leaves")
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = in_order(rows, ["doc_id", "digest"])
    documents = build(placed, levels, ("doc_id", "forged"))
    discard(rows)
    subroots = stored(documents.tops(), "subroots")
    names = in_order(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("digest")), ["name"])
    languages = build(names, levels, ("name",))
    top = languages.tops().first()
    return Manifest(documents, languages, subroots, top.top if top else None, kind, levels)


def proofs(m: Manifest, spark: SparkSession) -> DataFrame:
    """Every row's proof, checked: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``
    and ``siblings``, the digests that it consists of. Rows whose leaf was forged fold that one."""
    schema = f"doc_id {m.kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<string>"
    if m.root is None:
        return spark.createDataFrame([], schema)
    root, levels = m.root, m.levels

    def of_language(batches):
        for b in batches:
            for r in b.to_pylist():
                local = siblings(r["log"], r["leaves"], min(levels, height(r["total"])))
                yield pa.RecordBatch.from_arrays([pa.array(r["name"], pa.string()), pa.array([s + r["above"] for s in local], pa.binary())], names=["grp", "above"])

    over = paths(m.languages, spark.createDataFrame([("", bytearray())], "grp string, above binary"))
    above = over.select("log", "leaves", "total", "name", "above").mapInArrow(tidy(of_language), "grp string, above binary")
    above = stored(above.join(m.subroots.withColumnRenamed("top", "subroot"), "grp"), "language-paths")

    def prove(batches):
        for b in batches:
            for r in range(b.num_rows):
                yield from _proved({c: b.column(c)[r].as_py() for c in ("leaves", "total", "log", "above", "subroot")}, b.column("doc_id")[r].values, b.column("forged")[r].as_py(), root, levels)

    rows = paths(m.documents, above).select("leaves", "total", "log", "above", "subroot", "doc_id", "forged")
    return rows.mapInArrow(tidy(prove), schema)


def _proved(block: dict, ids: pa.Array, forged: list, root: bytes, levels: int):
    """The proofs of one block."""
    n, log = block["leaves"], block["log"]
    leaves = [log[p : p + DIGEST] for p in (position(0, np.arange(n), n) * DIGEST).tolist()]
    local = siblings(log, n, min(levels, height(block["total"])))
    sub, top, verified = block["subroot"].hex(), root.hex(), []
    out: list[list] = [[], [], [], []]
    for leaf, other, path in zip(leaves, forged, local):
        path += block["above"]
        folded = fold(other or leaf, path)
        found = [d.hex() for d in path_digests(path)]
        for c, x in zip(out, (leaf.hex(), hashlib.sha256("".join(found).encode()).hexdigest(), folded.hex(), found)):
            c.append(x)
        verified.append(folded == root)
    columns = [ids, pa.array(out[0]), pa.array([sub] * n), pa.array([top] * n), pa.array(out[1]), pa.array(out[2]), pa.array(verified), pa.array(out[3], pa.list_(pa.string()))]
    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, proof and verdict of every document. Any column can be null (``-``); a null doc_id is
    never tampered with, and a null n_chars stays null, so such rows verify; rows that are equal are
    leaves of their own; an empty table gives no rows."""
    return proofs(manifest(table(spark, sf_dir, "documents")), spark).drop("siblings")


_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda k: list_transform(range(8), lambda b: ((ascii(CAST(doc_id AS VARCHAR)[k + 1]) >> b::INT) & 1)::BIGINT)))),
      lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1)))"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_SQL = f"""
WITH RECURSIVE
row_ AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS grp,
    sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295::BIGINT) % 7 = 0 THEN sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars + 1", "text")))}) END AS forged FROM documents),
leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM row_),
node AS (SELECT grp, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM leaf
  UNION ALL SELECT grp, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM node WHERE n > 1 GROUP BY grp, level, i // 2),
kept AS MATERIALIZED (SELECT * FROM node),
sub AS MATERIALIZED (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS i FROM kept WHERE n = 1),
upper_ AS (SELECT 0 AS level, i, h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM upper_ WHERE n > 1 GROUP BY level, i // 2),
top AS MATERIALIZED (SELECT * FROM upper_),
root AS (SELECT h AS root FROM top WHERE n = 1),
step AS MATERIALIZED (SELECT l.grp, l.i, k.level, k.h AS other, (l.i >> k.level) & 1 AS side FROM leaf l
    JOIN (SELECT DISTINCT grp, level, n FROM kept WHERE n > 1) v ON v.grp = l.grp LEFT JOIN kept k ON k.grp = l.grp AND k.level = v.level AND k.i = xor((l.i >> v.level)::BIGINT, 1)
    WHERE k.h IS NOT NULL
  UNION ALL SELECT l.grp, l.i, 1000 + t.level, t.h, (s.i >> t.level) & 1 FROM leaf l JOIN sub s ON s.grp = l.grp JOIN top t ON t.i = xor((s.i >> t.level)::BIGINT, 1)),
proof AS MATERIALIZED (SELECT grp, i, sha256(string_agg(other, '' ORDER BY level)) AS proof_sha256 FROM step GROUP BY grp, i),
rung AS MATERIALIZED (SELECT grp, level, row_number() OVER (PARTITION BY grp ORDER BY level) - 1 AS o FROM (SELECT DISTINCT grp, level FROM kept WHERE n > 1 UNION ALL SELECT grp, 1000 + level FROM sub, (SELECT DISTINCT level FROM top WHERE n > 1))),
fold AS (SELECT grp, i, 0::BIGINT AS o, coalesce(forged, leaf) AS h FROM leaf
  UNION ALL SELECT f.grp, f.i, f.o + 1, CASE WHEN s.other IS NULL THEN sha256(f.h) WHEN s.side = 1 THEN sha256(s.other || f.h) ELSE sha256(f.h || s.other) END
    FROM fold f JOIN rung r ON r.grp = f.grp AND r.o = f.o LEFT JOIN step s ON s.grp = f.grp AND s.i = f.i AND s.level = r.level),
folded AS (SELECT grp, i, arg_max(h, o) AS folded_root FROM fold GROUP BY grp, i)
SELECT l.doc_id, l.leaf, s.h AS subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM leaf l JOIN sub s USING (grp) JOIN folded f ON f.grp = l.grp AND f.i = l.i LEFT JOIN proof p ON p.grp = l.grp AND p.i = l.i, root"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": _SQL.strip()}
