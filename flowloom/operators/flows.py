"""Sequence-flow rules: gateways and their neighbours to flows, frames and same-gateway pairs.

A flow is ``doc_id, rel, src, tgt`` with places ``(s, t, tokens, kind)``; a frame spans from a start
to an end place and knows its split point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..schemas import ACTIVITY, AND, XOR
from .neighbors import contradictory, neighbours

PLACE = "struct<s:int,t:int,tokens:array<string>,kind:string>"


def place(s, t, tokens, kind) -> Column:
    return F.struct(F.col(s).cast("int").alias("s"), F.col(t).cast("int").alias("t"), F.col(tokens).alias("tokens"), F.lit(kind).alias("kind"))


def act(c: str) -> Column:
    """An activity neighbour as a place, null for none."""
    return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.s").cast("int").alias("s"), F.col(f"{c}.t").cast("int").alias("t"), F.col(f"{c}.tokens").alias("tokens"), F.lit(ACTIVITY).alias("kind")))


def _edge(a: Column, b: Column, when: Column | None = None) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.when(both if when is None else both & when, F.struct(a.alias("src"), b.alias("tgt")))


def _edges(found: list[Column], rel: str) -> Column:
    return F.transform(F.filter(F.array(*found), lambda e: e.isNotNull()), lambda e: F.struct(F.lit(rel).alias("rel"), e["src"].alias("src"), e["tgt"].alias("tgt")))


def _exploded(rows: DataFrame, edges: Column) -> DataFrame:
    return rows.select("doc_id", F.explode(edges).alias("e")).select("doc_id", "e.*")


def _span(rule: int, start: Column, end: Column, split: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(F.lit(rule).alias("rule"), start.alias("start"), end.alias("end"), split.alias("split")))


def _frame(rows: DataFrame, span: Column) -> DataFrame:
    found = rows.select("doc_id", F.col("s").cast("int").alias("g_s"), F.col("t").cast("int").alias("g_t"), span.alias("f")).filter("f IS NOT NULL")
    return found.select("doc_id", "f.rule", "g_s", "g_t", "f.start", "f.end", "f.split")


# A rule takes gateways with their neighbours, structs of ``g, pa, ppa, fa, ffa``, and gives edges and a frame. Places are
# structs in tables of gateways, numbers in rows of documents.
def _pair_rule(a: Column, b: Column) -> tuple[Column, Column]:
    full = ~F.coalesce(a["fa"] == b["fa"], F.lit(False))
    found = [_edge(a["pa"], a["g"]), _edge(a["g"], a["fa"], full), _edge(a["fa"], b["ffa"], full), _edge(a["g"], b["ffa"], ~full), _edge(b["g"], b["fa"]), _edge(b["fa"], b["ffa"])]
    return _edges(found, "pair"), _span(1, a["g"], F.coalesce(b["fa"], b["g"]), a["g"])


def _around_rule(n: Column, rel: str, rule: int) -> tuple[Column, Column]:
    """A lone 'or' or an AND gateway between its neighbours."""
    found = [_edge(n["ppa"], n["g"]), _edge(n["g"], n["pa"]), _edge(n["g"], n["fa"]), _edge(n["pa"], n["ffa"]), _edge(n["fa"], n["ffa"])]
    return _edges(found, rel), _span(rule, n["pa"], n["fa"], n["g"])


def _case(n: Column) -> Column:
    """Which of a lone gateway's neighbours share its sentence (``with_p, with_f``), null where no rule is for it."""
    return (
        F.when(n["pa"].isNull() & n["with_f"], 1).when(n["fa"].isNull() & n["with_p"], 2)
        .when(n["pa"].isNotNull() & ~n["with_p"] & n["with_f"], 3).when(n["fa"].isNotNull() & n["with_p"] & ~n["with_f"], 4)
    )


def _single_rule(n: Column, c: Column) -> tuple[Column, Column]:
    g, pa, fa, ffa = (n[x] for x in ("g", "pa", "fa", "ffa"))
    found = [_edge(pa, g, c == 3), _edge(n["ppa"], g, c == 4), _edge(g, fa, c.isin(1, 3)), _edge(g, ffa, c.isin(1, 3)), _edge(fa, ffa, c.isin(1, 3)), _edge(g, pa, c.isin(2, 4)), _edge(pa, fa, c == 4)]
    start, end = F.when(c.isin(1, 3), g).otherwise(pa), F.when(c.isin(1, 3, 4), fa).otherwise(g)
    return _edges(found, "single"), _span(3, start, end, g)


def default_flows(activities: DataFrame) -> DataFrame:
    """Each activity to the next one of its document."""
    me = place("s", "t", "tokens", ACTIVITY)
    rows = activities.select("doc_id", me.alias("src"), F.lead(me).over(Window.partitionBy("doc_id").orderBy("s", "t")).alias("tgt"))
    return rows.filter("tgt IS NOT NULL").select("doc_id", F.lit("default").alias("rel"), "src", "tgt")


def exclusive_flows(gateways: DataFrame, activities: DataFrame, pairs: list[tuple[str, str]], threshold: int = 1, multiple: bool = False, decided: DataFrame | None = None):
    """``(flows, frames, same_gateway)`` of XOR gateways (``doc_id, s, t, tokens, low``).

    Contradictory pairs first, then lone 'or', then all other lone gateways by which neighbour
    shares their sentence. With ``decided`` (``doc_id, s, t, n_s, n_t`` of pairs that a classifier
    joined) those replace the pair list, and the later rules see every gateway.
    """
    xor = stored(neighbours(gateways.withColumn("word", F.array_join("low", " ")), activities), "neighbours")
    beside = lambda c: F.coalesce(F.col(f"{c}.s") == F.col("s"), F.lit(False))
    n = F.struct(place("s", "t", "tokens", XOR).alias("g"), *(act(c).alias(c) for c in ("pa", "ppa", "fa", "ffa")), beside("pa").alias("with_p"), beside("fa").alias("with_f"))
    xor = xor.select("doc_id", "s", "t", "word", n.alias("n"))
    n = F.col("n")
    near = stored((contradictory(gateways, pairs, threshold, multiple) if decided is None else decided).select("doc_id", "s", "t", "n_s", "n_t"), "pairs")
    second = xor.select("doc_id", F.col("s").alias("n_s"), F.col("t").alias("n_t"), n.alias("n2"))
    pair = stored(xor.join(near, ["doc_id", "s", "t"]).join(second, ["doc_id", "n_s", "n_t"]), "joined-pairs")
    edges, span = _pair_rule(n, F.col("n2"))
    rule1, frames = _exploded(pair, edges), _frame(pair, span)
    same = pair.select("doc_id", n["g"].alias("src"), F.col("n2.g").alias("tgt"))

    lone = xor
    if decided is None:
        used = near.select("doc_id", "s", "t").unionAll(near.select("doc_id", "n_s", "n_t")).distinct()
        lone = stored(xor.join(used, ["doc_id", "s", "t"], "left_anti"), "lone")
    ors = lone.filter(F.col("word") == "or").filter(n["with_p"] & n["with_f"])
    edges, span = _around_rule(n, "or", 2)
    rule2, frames = _exploded(ors, edges), frames.unionAll(_frame(ors, span))
    rest = lone.filter(F.col("word") != "or").withColumn("case", _case(n)).filter("case IS NOT NULL")
    edges, span = _single_rule(n, F.col("case"))
    return rule1.unionAll(rule2).unionAll(_exploded(rest, edges)), frames.unionAll(_frame(rest, span)), same


def concurrent_flows(gateways: DataFrame, activities: DataFrame):
    """``(flows, frames)`` of AND gateways; edges without one end are left out, and so are frames."""
    n = F.struct(place("s", "t", "tokens", AND).alias("g"), *(act(c).alias(c) for c in ("pa", "ppa", "fa", "ffa")))
    rows = stored(neighbours(gateways, activities).select("doc_id", "s", "t", n.alias("n")), "neighbours")
    edges, span = _around_rule(F.col("n"), "and", 4)
    return _exploded(rows, edges), _frame(rows, span)


def suppress_defaults(defaults: DataFrame, gateway_flows: DataFrame) -> DataFrame:
    """Default flows whose source's words start no gateway flow of the document."""
    taken = gateway_flows.select("doc_id", F.col("src.tokens").alias("words")).distinct()
    rows = defaults.withColumn("words", F.col("src.tokens"))
    return rows.join(taken, ["doc_id", "words"], "left_anti").drop("words")


#: Beyond the last token of any sentence.
_END = (1 << 31) - 1


#: Places of a document as rising numbers: the sentence, then 32 bits for the token.
_SENTENCE = 1 << 32


def _number(s: Column, t: Column) -> Column:
    return s.cast("long") * F.lit(_SENTENCE) + t


def _stretches(start: Column, end: Column, i: Column, compat: bool) -> Column:
    """Frame ``i`` as stretches ``(i, lo, hi)`` of numbered places; with ``compat`` frame 0 comes last, and one within
    a sentence covers all from its start and all up to its end."""
    rank = F.when(i == 0, _END).otherwise(i) if compat else i
    stretch = lambda lo, hi: F.struct(rank.cast("int").alias("i"), lo.alias("lo"), hi.alias("hi"))
    lo, hi = _number(start["s"], start["t"]), _number(end["s"], end["t"])
    whole = F.array(stretch(lo, hi))
    if not compat:
        return whole
    return F.when(start["s"] < end["s"], whole).otherwise(F.array(stretch(lo, _number(start["s"], F.lit(_END))), stretch(_number(end["s"], F.lit(-1)), hi)))


def least_holders(points: pa.Array, stretches: pa.Array) -> pa.Array:
    """For each list of rising ``points`` a list of the least ``i`` among the ``stretches`` (``i, lo, hi``) that hold
    each, null for none.

    A stretch is the union of two runs of ``2 ** k`` points; longest first, what a run has goes to its two halves.
    The work follows points and stretches and the logarithm of the longest, not their product.
    """
    keys, parts = points.flatten().to_numpy(), stretches.flatten()
    i, lo, hi = (parts.field(c).to_numpy() for c in ("i", "lo", "hi"))
    (at, of) = (x.offsets.to_numpy() - x.offsets[0].as_py() for x in (points, stretches))
    first, last = np.zeros((2, len(i)), np.int64)
    for d in np.flatnonzero(np.diff(of)):
        own, mine = keys[at[d] : at[d + 1]], slice(of[d], of[d + 1])
        first[mine], last[mine] = at[d] + np.searchsorted(own, lo[mine]), at[d] + np.searchsorted(own, hi[mine], "right")
    some = first < last
    first, last, i = first[some], last[some], i[some]
    level = np.frexp(last - first)[1] - 1
    none = np.iinfo(np.int64).max
    best = np.full(len(keys), none)
    for k in range(level.max(initial=0), -1, -1):
        here = level == k
        np.minimum.at(best, first[here], i[here])
        np.minimum.at(best, last[here] - (1 << k), i[here])
        if k:
            half = 1 << k - 1
            best[half:] = np.minimum(best[half:], best[:-half])
    found = pa.array(np.where(best == none, 0, best), pa.int32(), mask=best == none)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), found)


def _held(points: Column, stretches: Column) -> Column:
    return F.arrow_udf(least_holders, "array<int>")(points, stretches)


def holding_frames(places: DataFrame, numbered: DataFrame, compat: bool = True) -> DataFrame:
    """``doc_id, s, t, frame``: for each of ``places`` (``doc_id, s, t``) that frames (``i, start, end``) hold
    the first of them, or the first but 0 with ``compat``. Places and frames are shuffled once, by document."""
    points = places.select("doc_id", _number(F.col("s"), F.col("t")).alias("point"), F.lit(None).cast("struct<i:int,lo:bigint,hi:bigint>").alias("x"))
    pieces = numbered.select("doc_id", F.lit(None).cast("long").alias("point"), F.explode(_stretches(F.col("start"), F.col("end"), F.col("i"), compat)).alias("x"))
    docs = points.unionAll(pieces).groupBy("doc_id").agg(F.array_sort(F.collect_set("point")).alias("points"), F.collect_list("x").alias("stretches"))
    met = docs.select("doc_id", F.explode(F.arrays_zip(F.col("points").alias("point"), _held(F.col("points"), F.col("stretches")).alias("frame"))).alias("z")).filter("z.frame IS NOT NULL")
    s, t = F.call_function("shiftright", F.col("z.point"), F.lit(32)).cast("int"), (F.col("z.point") % F.lit(_SENTENCE)).cast("int")
    return met.select("doc_id", s.alias("s"), t.alias("t"), F.when(F.col("z.frame") == _END, 0).otherwise(F.col("z.frame")).alias("frame"))


def containing_frame(flows: DataFrame, frames: DataFrame, compat: bool = True) -> DataFrame:
    """``flows`` and the frame that holds each end: ``src_frame``, ``tgt_frame`` by index, ``tgt_split``.
    Frames are numbered in rule, then text order. ``compat`` keeps two habits: frame 0 loses to any
    later frame, and a frame within one sentence covers all of it."""
    w = Window.partitionBy("doc_id").orderBy("rule", "g_s", "g_t")
    numbered = stored(frames.withColumn("i", F.row_number().over(w) - 1).select("doc_id", "i", "start", "end", "split"), "frames")
    place = lambda p: flows.select("doc_id", f"{p}.s", f"{p}.t")
    held = stored(holding_frames(place("src").unionAll(place("tgt")), numbered, compat), "held")
    at = lambda p: held.select("doc_id", F.struct("s", "t").alias(f"{p}_at"), F.col("frame").alias(f"{p}_frame"))
    key = lambda p: F.struct(F.col(f"{p}.s").cast("int").alias("s"), F.col(f"{p}.t").cast("int").alias("t")).alias(f"{p}_at")
    splits = numbered.select("doc_id", F.col("i").alias("tgt_frame"), F.col("split").alias("tgt_split"))
    rows = flows.select("*", key("src"), key("tgt")).join(at("src"), ["doc_id", "src_at"], "left").join(at("tgt"), ["doc_id", "tgt_at"], "left")
    return rows.drop("src_at", "tgt_at").join(splits, ["doc_id", "tgt_frame"], "left")


def merge_flows(defaults: DataFrame, gateway_flows: DataFrame, frames: DataFrame, compat: bool = True) -> DataFrame:
    """All flows of each document: gateway flows and the defaults they leave, flows that enter a frame
    led to its split point, without repeats."""
    gateway_flows = stored(gateway_flows, "gateway-flows")
    flows = gateway_flows.unionAll(suppress_defaults(defaults, gateway_flows))
    rows = containing_frame(stored(flows.select("doc_id", "src", "tgt").distinct(), "flows"), frames, compat)
    enters = F.col("tgt_frame").isNotNull() & ~F.col("src_frame").eqNullSafe(F.col("tgt_frame")) & (F.col("tgt.tokens") != F.col("tgt_split.tokens"))
    return rows.select("doc_id", "src", F.when(enters, F.col("tgt_split")).otherwise(F.col("tgt")).alias("tgt")).distinct()


PLACES = "array<struct<s:int,t:int,side:int,tokens:array<string>,kind:string>>"


def placed(gateways: DataFrame, activities: DataFrame) -> DataFrame:
    """``doc_id, places``: gateways of both ``kind``s (``side`` 0) and activities (1) in text order, a row a document;
    their one shuffle."""
    one = lambda rows, side, kind: rows.select("doc_id", F.struct(F.col("s").cast("int").alias("s"), F.col("t").cast("int").alias("t"), F.lit(side).alias("side"), "tokens", kind.alias("kind")).alias("x"))
    rows = one(gateways, 0, F.col("kind")).unionAll(one(activities, 1, F.lit(ACTIVITY)))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).cast(PLACES).alias("places"))


def _contradictory(x: Column, pairs: list[tuple[str, str]], threshold: int, multiple: bool) -> Column:
    """Numbers of the gateways of ``x`` that open a pair with the next, by the rule of :func:`contradictory`."""
    listed = F.array(*(F.lit(f"{a}\n{b}") for a, b in pairs))
    hit = lambda a, b: (a["t"] == 0) & (b["s"] - a["s"] <= threshold) & F.array_contains(listed, F.concat_ws("\n", a["word"], b["word"]))
    hits = F.filter(F.transform(x, lambda a, j: F.when(hit(a, F.get(x, j + 1)), j)), lambda j: j.isNotNull())
    if multiple:
        return hits

    def stand(h: Column) -> Column:
        """Of each run of consecutive hits every other one, from the first on."""
        opens = F.filter(F.transform(h, lambda j, r: F.when(~F.coalesce(F.get(h, r - 1) + 1 == j, F.lit(False)), r)), lambda r: r.isNotNull())
        last = lambda o, k: F.get(h, F.coalesce(F.get(o, k + 1), F.size(h)) - 1)
        return _let(opens, lambda o: F.flatten(F.transform(o, lambda r, k: F.sequence(F.get(h, r), last(o, k), F.lit(2)))))

    return _let(hits, stand)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not at each place in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ruled(docs: DataFrame, pairs: list[tuple[str, str]], threshold: int = 1, multiple: bool = False) -> DataFrame:
    """``doc_id, places, acts, flows, frames, same``: what :func:`exclusive_flows` and :func:`concurrent_flows` find in
    documents of :func:`placed`, as arrays whose places are numbers in ``places``; frames in rule, then text order.

    The number of activities before a gateway is its number among all places less that among the gateways. Rows
    stay as they are: nothing is joined, sorted or shuffled.
    """
    on = lambda side: F.filter(F.transform("places", lambda p, i: F.when(p["side"] == side, i)), lambda i: i.isNotNull())
    docs = docs.select("doc_id", "places", on(0).alias("gates"), on(1).alias("acts"))

    def near(p: Column, m: Column, k: Column) -> Column:
        tied = _number(p["s"], p["t"]) == _number(F.get("places", F.get("acts", k))["s"], F.get("places", F.get("acts", k))["t"])
        after = k + F.coalesce(tied, F.lit(False)).cast("int")
        beside = lambda a: F.coalesce(F.get("places", F.get("acts", a))["s"] == p["s"], F.lit(False))
        both = {"pa": k - 1, "ppa": k - 2, "fa": after, "ffa": after + 1}
        return F.struct(
            m.alias("g"), p["s"].alias("s"), p["t"].alias("t"), p["kind"].alias("kind"), F.lower(F.array_join(p["tokens"], " ")).alias("word"),
            *(F.get("acts", a).alias(c) for c, a in both.items()), beside(k - 1).alias("with_p"), beside(after).alias("with_f"),
        )

    found = F.transform("gates", lambda m, j: _let(F.get("places", m), lambda p: near(p, m, m - j)))
    found = docs.select("doc_id", "places", "acts", found.alias("near"))
    of = lambda kind: F.filter("near", lambda n: n["kind"] == kind)
    found = found.select("doc_id", "places", "acts", of(XOR).alias("xor"), of(AND).alias("par"))
    x = F.col("xor")
    found = found.select("*", _contradictory(x, pairs, threshold, multiple).alias("first"))
    used = lambda j: F.concat(j, F.transform(j, lambda k: k + 1))
    every = F.filter(F.transform(x, lambda _, j: j), lambda j: j.isNotNull())
    lone = F.transform(F.array_except(every, used(F.col("first"))), lambda j: F.get(x, j))
    two = F.transform("first", lambda j: F.struct(F.get(x, j).alias("a"), F.get(x, j + 1).alias("b")))
    found = found.select("doc_id", "places", "acts", "par", two.alias("two"), lone.alias("lone"))
    ors = F.filter("lone", lambda n: (n["word"] == "or") & n["with_p"] & n["with_f"])
    rest = F.filter(F.transform(F.filter("lone", lambda n: n["word"] != "or"), lambda n: F.struct(n.alias("n"), _case(n).alias("c"))), lambda r: r["c"].isNotNull())
    found = found.select("doc_id", "places", "acts", "par", "two", ors.alias("ors"), rest.alias("rest"))
    by = lambda part: [
        F.transform("two", lambda r: _pair_rule(r["a"], r["b"])[part]), F.transform("ors", lambda n: _around_rule(n, "or", 2)[part]),
        F.transform("rest", lambda r: _single_rule(r["n"], r["c"])[part]), F.transform("par", lambda n: _around_rule(n, "and", 4)[part]),
    ]
    flows, frames = F.flatten(F.concat(*by(0))), F.filter(F.concat(*by(1)), lambda f: f.isNotNull())
    same = F.transform("two", lambda r: F.struct(r["a"]["g"].alias("src"), r["b"]["g"].alias("tgt")))
    return found.select("doc_id", "places", "acts", flows.alias("flows"), frames.alias("frames"), same.alias("same"))


def _place(i: Column) -> Column:
    return F.transform(F.array(F.get("places", i)), lambda p: F.struct(p["s"].alias("s"), p["t"].alias("t"), p["tokens"].alias("tokens"), p["kind"].alias("kind")))[0]


def document_rows(docs: DataFrame, column: str, kept=None) -> DataFrame:
    """``doc_id`` and the fields of the structs in an array of :func:`ruled` or :func:`merged`, those for which the
    condition ``kept`` holds, with places for their numbers."""
    names = docs.schema[column].dataType.elementType.names
    value = lambda e, c: _place(e[c]) if c in ("src", "tgt", "start", "end", "split") else e[c]
    few = F.col(column) if kept is None else F.filter(column, kept)
    rows = F.transform(few, lambda e: F.struct(*(value(e, c).alias(c) for c in names)))
    return docs.select("doc_id", F.explode(rows).alias("e")).select("doc_id", "e.*")


def _words(i: Column) -> Column:
    return F.array_join(F.get("places", i)["tokens"], "\x00")


def with_defaults(docs: DataFrame) -> DataFrame:
    """Documents of :func:`ruled` with ``defaults``, the flows from each activity to the next whose source's words start
    none of the document's gateway flows."""
    after = F.transform(F.slice("acts", F.lit(1), F.greatest(F.size("acts") - 1, F.lit(0))), lambda a, i: F.struct(a.alias("src"), F.get("acts", i + 1).alias("tgt")))
    taken = F.array_distinct(F.transform("flows", lambda e: _words(e["src"])))
    return docs.select("*", _let(taken, lambda ws: F.filter(after, lambda e: ~F.array_contains(ws, _words(e["src"])))).alias("defaults"))


def merged(docs: DataFrame, compat: bool = True) -> DataFrame:
    """``doc_id, places, flows``: documents of :func:`ruled` with all their flows, as :func:`merge_flows` gives them."""
    code = lambda src, tgt: src.cast("long") * F.lit(_SENTENCE) + tgt
    src, tgt = (lambda c: F.call_function("shiftright", c, F.lit(32)).cast("int")), (lambda c: (c % F.lit(_SENTENCE)).cast("int"))
    coded = lambda c: F.transform(c, lambda e: code(e["src"], e["tgt"]))
    points = F.transform("places", lambda p: _number(p["s"], p["t"]))
    # no lambda within this one: Spark doesn't find a Python function whose arguments have such
    frame = lambda f, i: _stretches(F.get("places", f["start"]), F.get("places", f["end"]), i, compat)
    rows = with_defaults(docs).select("doc_id", "places", "frames", F.array_distinct(F.concat(coded("flows"), coded("defaults"))).alias("codes"), points.alias("points"), F.flatten(F.transform("frames", frame)).alias("stretches"))
    rows = rows.select("doc_id", "places", "frames", "codes", _held(F.col("points"), F.col("stretches")).alias("held"))

    def led(c: Column) -> Column:
        mine, other = F.get("held", src(c)), F.get("held", tgt(c))
        split = F.get("frames", F.when(other == _END, 0).otherwise(other))["split"]
        enters = other.isNotNull() & ~mine.eqNullSafe(other) & (F.get("places", tgt(c))["tokens"] != F.get("places", split)["tokens"])
        return F.when(enters, code(src(c), split)).otherwise(c)

    rows = rows.select("doc_id", "places", F.array_distinct(F.transform("codes", led)).alias("codes"))
    return rows.select("doc_id", "places", F.transform("codes", lambda c: F.struct(src(c).alias("src"), tgt(c).alias("tgt"))).alias("flows"))


def document_flows(gateways: DataFrame, activities: DataFrame, pairs, threshold: int = 1, compat: bool = True):
    """``(flows, same_gateway)`` of all documents at once from gateways of both ``kind``s."""
    docs = ruled(placed(gateways, activities), pairs, threshold)
    return document_rows(merged(docs, compat), "flows"), document_rows(docs, "same")


def decide_pairs(gateways: DataFrame, scores: DataFrame, threshold: int = 3) -> DataFrame:
    """Adjacent XOR gateways with ``joined`` and ``comment``: never beyond ``threshold`` sentences,
    never with an 'or', else where the score (``doc_id, s, t, score``) exceeds a half."""
    from .neighbors import adjacent

    near = adjacent(gateways, None).join(scores, ["doc_id", "s", "t"], "left")
    has_or = (F.array_join("low", " ") == "or") | (F.array_join("n_low", " ") == "or")
    comment = F.when(F.col("distance") > threshold, "distance").when(has_or, "or").otherwise("score")
    return near.withColumn("comment", comment).withColumn("joined", F.when((F.col("comment") == "score") & (F.col("score") > 0.5), 1).otherwise(0))
