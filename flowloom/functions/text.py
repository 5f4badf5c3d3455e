"""Row-local text functions: sentences, tokens, phrases. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Ends of sentences: by default also question and exclamation marks and line ends; the annotated
#: corpus itself is split at full stops alone.
ENDS, FULL_STOPS = "[.!?\\n]+", "[.]"


def sentences(text: Column, ends: str = ENDS) -> Column:
    """Trimmed non-empty sentences between the ends."""
    return F.filter(F.transform(F.split(text, ends), lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: s != "")


def tokens(sentence: Column) -> Column:
    return F.split(sentence, "[ \\t\\r]+")


def lexicon(phrases: list[str]) -> dict[int, list[str]]:
    """Distinct lower-case phrases by their number of words, longest first."""
    by_length: dict[int, set[str]] = {}
    for p in phrases:
        by_length.setdefault(len(p.split(" ")), set()).add(p.lower())
    return {n: sorted(by_length[n]) for n in sorted(by_length, reverse=True)}


SPANS = "array<struct<start:int,n:int>>"


def accepted(candidates: Column, size: Column, kind: str = SPANS) -> Column:
    """Of spans (``start``, ``n`` and more, an array of type ``kind``) in falling priority those that
    overlap none accepted before, in the order of ``kind``'s fields.

    A byte for each of the ``size`` tokens says whether it is taken, so a span costs one look at its own
    tokens, however many spans there are.
    """
    start = F.struct(F.repeat(F.lit("\x00"), size).cast("binary").alias("taken"), F.array().cast(kind).alias("kept"))

    def step(state: Column, c: Column) -> Column:
        at, n = c["start"] + 1, c["n"]
        zeros = F.repeat(F.lit("\x00"), n).cast("binary")
        ones = F.repeat(F.lit("\x01"), n).cast("binary")
        taken = F.struct(F.overlay(state["taken"], ones, at, n).alias("taken"), F.concat(state["kept"], F.array(c)).alias("kept"))
        return F.when(F.substring(state["taken"], at, n) == zeros, taken).otherwise(state)

    return F.array_sort(F.aggregate(candidates, start, step, lambda state: state["kept"]))


def phrase_spans(low: Column, phrases: list[str]) -> Column:
    """Accepted spans ``(start, n)`` of ``phrases`` in a column of lower-case tokens, in text order.

    ``low`` must be a column of its own, not an expression: lambdas would evaluate that once a token.

    Case does not matter, tokens match whole, longer phrases go first, then alphabetical order, then
    place; a token belongs to at most one span. For each length of phrases every token is looked up in
    the set of first words and, where that holds it, its words in the set of phrases: the work follows
    the tokens and the lengths, not the number of phrases. Tokens that have none of the first words among
    them are not looked at one by one.
    """
    found, none = [], F.array().cast(SPANS)
    met = lambda heads: F.arrays_overlap(low, F.array(*map(F.lit, heads)))
    for n, of_length in lexicon(phrases).items():
        heads = sorted({p.split(" ")[0] for p in of_length})
        gram = (lambda i: F.get(low, i)) if n == 1 else (lambda i, n=n: F.array_join(F.slice(low, i + 1, n), " "))
        # each test is a lambda's own, so phrases are built where the first word fits alone
        places = F.filter(F.sequence(F.lit(0), F.size(low) - n), lambda i: F.get(low, i).isin(heads))
        if n > 1:
            places = F.filter(places, lambda i: gram(i).isin(of_length))
        spans = F.transform(places, lambda i: F.struct(gram(i).alias("phrase"), i.cast("int").alias("start")))
        spans = F.transform(F.array_sort(spans), lambda p: F.struct(p["start"].alias("start"), F.lit(n).alias("n")))
        found.append(F.when((F.size(low) >= n) & met(heads), spans).otherwise(none))
    if not found:
        return none
    return F.when(met(sorted({p.split(" ")[0].lower() for p in phrases})), accepted(F.concat(*found), F.size(low))).otherwise(none)


def add_spans(df: DataFrame, phrases: dict[str, list[str]], words: str = "tokens") -> DataFrame:
    """``df`` with a column of accepted spans for each named phrase list."""
    kept = df.withColumn("low_", F.transform(words, lambda w: F.lower(w)))
    return kept.select(*df.columns, *(phrase_spans(F.col("low_"), p).alias(name) for name, p in phrases.items()))


def span_tags(words: Column, spans: Column, label: str) -> Column:
    """``B-``/``I-`` tags of a token array by spans, ``O`` elsewhere."""
    inside = lambda i: F.exists(spans, lambda s: (s["start"] < i) & (i < s["start"] + s["n"]))
    first = lambda i: F.exists(spans, lambda s: s["start"] == i)
    tags = F.transform(words, lambda _, i: F.when(first(i), f"B-{label}").when(inside(i), f"I-{label}").otherwise("O"))
    return F.when((F.size(spans) == 0) & words.isNotNull(), F.array_repeat(F.lit("O"), F.size(words))).otherwise(tags)


def first_tag(*tags: Column) -> Column:
    """Token by token the first tag that is not ``O``."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x == "O", y).otherwise(x)), tags)


def joined(words: Column) -> Column:
    return F.array_join(words, " ")
