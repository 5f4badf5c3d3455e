"""Secret scans with DataFrame functions only.

Fixed patterns find assignments, access keys and long hex strings. Beside them a battery of
randomness tests judges every long token: which encoding it is written in, then three tests for
that encoding's alphabet.

First each test asks whether the token could have been drawn uniformly from its alphabet; one that
fails any of them at ``LEVEL`` is not random, whatever the others say:

- chi-squared uniformity of its characters, and of the top bits of the bytes that it packs if it
  is base64 (of text in ASCII they are all zero);
- the number of runs of characters of one class (lower case, upper case, digits, signs), against
  its mean and variance for draws: names, paths and dates keep to a class for too long;
- the largest serial correlation of lags 1 to ``LAGS``, against its spread for draws: counters,
  repeated and ordered characters, packed text.

Short tokens pass such tests easily, so what is left must also be improbable for a written token:
frequencies ``UNEVEN`` a character off uniform, ``STICK`` as many changes of class as draws have,
serial correlation of ``SERIAL``. Fisher's method combines these three p-values, and Benjamini and
Hochberg hold the false discovery rate within each encoding and length class: short tokens, which
can't prove much, don't borrow from long ones. Tokens that failed stay in the count, with p = 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, scanned, stored, table, text_or_empty, with_row

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Greedy runs of one class: asking for the least length here finds the same as dropping short runs.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LONG = "[A-Za-z0-9+/_-]{20,}"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, LONG_LEAST = 8, 16, 32, 20
KINDS = ("assign", "access", "hex", "random")

#: Encodings from the narrowest alphabet; a token has the first whose alphabet holds all of it.
#: Plain numbers and words of one case are no encodings of secrets and are not tested.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
LEVEL = 0.01
LAGS = 4
UNEVEN, STICK, SERIAL = 2.25, 0.55, 0.5
#: Characters by class, and the values of base64 in its two spellings.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_")
PACKED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FALSE_DISCOVERIES = 0.05
#: p-values are counted in steps of this factor's logarithm, up to exp(-BINS / STEPS).
STEPS, BINS = 50, 3500


def _matches(text: Column, pattern: str, least: int, group: int, kind: int, gate: Column) -> Column:
    """All matches in order, as (kind, place, characters before it, its length, kept?, token)."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.transform(
        F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(gaps, 1, F.size(whole)).alias("gap")),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("place"),
            m["gap"].alias("gap"),
            F.length(m["whole"]).alias("length"),
            (F.length(m["part"]) >= least).alias("keep"),
            F.when((F.lit(kind) == 3) & (F.length(m["whole"]) >= least), m["whole"]).alias("token"),
        ),
    )
    return F.when(gate, found)


def matches(docs: DataFrame, row: str) -> DataFrame:
    """``row, doc_id, found`` with found null where no pattern matches."""
    t = F.col("text")
    gates = (
        (F.contains(t, F.lit(":")) | F.contains(t, F.lit("="))) & F.rlike(t, F.lit(ASSIGN)),
        F.contains(t, F.lit("AKIA")),
        F.rlike(t, F.lit(HEX)),
        F.rlike(t, F.lit(LONG)),
    )
    specs = ((ASSIGN, ASSIGN_LEAST, 2), (ACCESS, ACCESS_LEAST, 0), (HEX, HEX_LEAST, 0), (LONG, LONG_LEAST, 0))
    arrays = [_matches(t, p, least, g, k, gate) for k, ((p, least, g), gate) in enumerate(zip(specs, gates))]
    rows = with_row(docs.select("doc_id", text_or_empty("text").alias("text")), row)
    return rows.select(row, "doc_id", F.filter(F.array(*arrays), lambda a: a.isNotNull()).alias("found"))


def spans(found: DataFrame, row: str) -> DataFrame:
    """``row, kind, start, end, token`` of the kept matches, in code points."""
    each = found.select(row, F.explode("found").alias("list")).select(row, F.explode("list").alias("m")).select(row, "m.*")
    upto = Window.partitionBy(row, "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    return each.withColumn("end", end).filter("keep").select(row, "kind", (F.col("end") - F.col("length")).alias("start"), "end", "token")


def _at_most(z: Column) -> Column:
    """The normal distribution function, by a logistic approximation."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def class_changes(letters: str) -> tuple[float, float]:
    """For uniform draws from ``letters``: the chance that neighbours differ in class, and that a
    character differs from both of its neighbours."""
    shares = [sum(c in letters for c in group) / len(letters) for group in CLASSES]
    return 1 - sum(q * q for q in shares), sum(q * (1 - q) ** 2 for q in shares)


def _drawn_chi(chi: Column, df: Column) -> Column:
    """The chance of a larger chi-squared value (Wilson and Hilferty)."""
    return _at_most(-(F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - 1 + 2 / (9 * df)) / F.sqrt(2 / (9 * df)))


def _clear_bits(values: str, phase: int, top: Column) -> Column:
    """How many deviations more of the bits ``top`` of base64 values are clear than drawn ones'."""
    place = lambda i: F.pmod(i + phase, F.lit(4))
    used = F.size(F.filter(values, lambda v, i: place(i) < 3)).cast("double")
    zeros = F.size(F.filter(values, lambda v, i: (place(i) < 3) & (v.bitwiseAND(F.get(top, place(i))) == 0))).cast("double")
    return (2 * zeros - used) / F.sqrt(used)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds to ``token`` rows their ``encoding``, the chances ``u_even, u_runs, u_serial`` of a drawn
    token being so far off, and ``p``, the combined chance of a written token being so near to
    random: 1 for those that one of the tests refuses. Tokens of one class of characters only are
    dropped, and so are those of no encoding."""
    token = F.col("token")
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    changes, twice = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, letters in reversed(ENCODINGS):
        fits = F.length(F.translate(token, letters, "")) == 0
        s, both = class_changes(letters)
        encoding, alphabet = F.when(fits, name).otherwise(encoding), F.when(fits, letters).otherwise(alphabet)
        changes, twice = F.when(fits, s).otherwise(changes), F.when(fits, both).otherwise(twice)
    mixed = F.rlike(token, F.lit("[0-9]")) & F.rlike(token, F.lit("[A-Za-z]")) | F.rlike(token, F.lit("[a-z]")) & F.rlike(token, F.lit("[A-Z]"))
    t = tokens.filter(mixed).select("*", encoding.alias("encoding"), alphabet.alias("alphabet"), changes.alias("changes"), twice.alias("twice"))
    t = t.filter("encoding IS NOT NULL")
    codes = lambda text, letters: F.transform(F.split(text, ""), lambda c: F.instr(letters, c) - 1)
    t = t.withColumn("x", codes(token, F.col("alphabet"))).withColumn("y", codes(F.translate("token", "-_", "+/"), F.lit(PACKED)))
    t = t.withColumn("n", F.size("x").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    n = F.col("n")

    zero = F.lit(0.0)
    total = lambda a, f: F.aggregate(a, zero, lambda s, v: s + f(v))
    squares = total(F.array_distinct("x"), lambda v: F.pow(F.size(F.filter("x", lambda y: y == v)).cast("double"), F.lit(2.0)))
    t = t.withColumn("chi", F.col("k") / n * squares - n)
    lam, df = n * UNEVEN, F.col("k") - 1
    w_even = _at_most((F.col("chi") - df - lam) / F.sqrt(2 * df + 4 * lam))

    top = F.array(F.lit(32), F.lit(8), F.lit(2), F.lit(0))  # which bit of a group's values is a byte's top bit
    clear = F.greatest(*(_clear_bits("y", phase, top) for phase in range(4)))  # the token may begin anywhere in a group
    u_packed = 1 - F.pow(_at_most(clear), F.lit(4.0))
    u_even = F.least(F.lit(1.0), 2 * F.least(_drawn_chi(F.col("chi"), df), u_packed))

    kinds = F.translate("token", "".join(CLASSES), "".join(group[0] * len(group) for group in CLASSES))
    t = t.withColumn("turns", (F.length(F.regexp_replace(kinds, "(.)\\1+", "$1")) - 1).cast("double"))
    s, steps, stick = F.col("changes"), n - 1, F.col("changes") * STICK
    spread = F.sqrt(steps * s * (1 - s) + 2 * (steps - 1) * (F.col("twice") - s * s))
    u_runs = 2 * _at_most(-F.abs(F.col("turns") - steps * s) / spread)
    w_runs = _at_most(-(F.col("turns") - steps * stick) / F.sqrt(steps * stick * (1 - stick)))

    t = t.withColumn("mean", total("x", lambda v: v) / n)
    off = lambda v: v - F.col("mean")
    t = t.withColumn("var", total("x", lambda v: off(v) * off(v)))
    r, z = [], []
    for lag in range(1, LAGS + 1):
        pairs = F.zip_with(F.slice("x", F.lit(1), F.size("x") - lag), F.slice("x", F.lit(lag + 1), F.size("x") - lag), lambda a, b: off(a) * off(b))
        t = t.withColumn(f"r{lag}", F.when(F.col("var") > 0, total(pairs, lambda v: v) / F.col("var")).otherwise(1.0))
        r.append(F.abs(f"r{lag}"))
        z.append(F.abs(F.col(f"r{lag}") + (n - lag) / n / steps) * n / F.sqrt(n - lag))
    u_serial = 1 - F.pow(1 - 2 * _at_most(-F.greatest(*z)), F.lit(float(LAGS)))
    w_serial = _at_most((F.greatest(*r) - SERIAL) * F.sqrt(n))

    t = t.select("*", u_even.alias("u_even"), u_runs.alias("u_runs"), u_serial.alias("u_serial"))
    h = -(F.log(F.greatest(w_even, F.lit(1e-300))) + F.log(F.greatest(w_runs, F.lit(1e-300))) + F.log(F.greatest(w_serial, F.lit(1e-300))))
    t = t.withColumn("h", h)
    fisher = F.exp(-F.col("h")) * (1 + F.col("h") + F.col("h") * F.col("h") / 2)
    refused = F.least("u_even", "u_runs", "u_serial") < LEVEL
    return t.select(*tokens.columns, "encoding", "u_even", "u_runs", "u_serial", F.when(refused, 1.0).otherwise(F.greatest(fisher, F.lit(1e-300))).alias("p"))


def discoveries(tested: DataFrame) -> DataFrame:
    """The rows of ``encoding, token, p`` that hold the false discovery rate in their stratum of
    encoding and length class. Counts of binned p-values (a bounded table) set the thresholds."""
    bin_ = F.least(F.floor(-F.log("p") * STEPS), F.lit(BINS)).cast("int")
    tested = tested.withColumn("class", F.floor(F.log2(F.length("token"))).cast("int")).withColumn("bin", bin_)
    counts = tested.groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("c"))
    stratum = Window.partitionBy("encoding", "class")
    ranked = counts.select("*", F.sum("c").over(stratum).alias("m"), F.sum("c").over(stratum.orderBy(F.desc("bin"))).alias("upto"))
    passes = F.exp(-F.col("bin") / STEPS) <= FALSE_DISCOVERIES * F.col("upto") / F.col("m")
    least = ranked.filter(passes).groupBy("encoding", "class").agg(F.min("bin").alias("least"))
    return tested.join(F.broadcast(least), ["encoding", "class"]).filter("bin >= least").drop("class", "bin", "least")


def find_secrets(docs: DataFrame, row: str = "row") -> DataFrame:
    """``row, doc_id, spans`` for every row of ``docs`` (a table scan with ``doc_id``, ``text``).

    ``spans``: sorted array of (start, order, kind, end) in code points; of the battery's tokens
    those that overlap no pattern match. A null text counts as empty and has no spans; repeated rows
    each have theirs; an empty table gives an empty result.
    """
    found = stored(matches(docs, row), "secret-matches")
    every = stored(spans(found, row), "secret-spans")
    tested = stored(battery(every.filter("kind = 3").select(row, "start", "end", "token")), "secret-tests")
    random = discoveries(tested).select(row, F.lit(3).alias("kind"), "start", "end")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("order"), kind.alias("kind"), "end")
    listed = every.filter("kind < 3").select(row, "kind", "start", "end").unionByName(random)
    none = found.select(row, "doc_id", F.lit(None).cast("struct<start:bigint,order:int,kind:string,end:bigint>").alias("span"))
    rows = none.unionByName(listed.select(row, F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), span.alias("span")))
    out = rows.groupBy(row).agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.array_sort(F.collect_list("span")).alias("all"))
    base = F.filter("all", lambda s: s["order"] < 3)
    free = F.filter("all", lambda s: (s["order"] < 3) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("base", base).select(row, "doc_id", free.alias("spans"))


def redact(docs: DataFrame, mask: str = "*") -> DataFrame:
    """``docs`` with all its columns and every span's characters in ``text`` replaced by ``mask``."""
    docs, row, spans_ = scanned(docs), fresh(docs, "row"), fresh(docs, "spans")
    hits = find_secrets(docs.select("doc_id", "text"), row).filter(F.size("spans") > 0).select(row, F.col("spans").alias(spans_))
    hidden = F.array_join(F.transform(F.split("text", ""), lambda c, i: F.when(F.exists(spans_, lambda s: (i >= s["start"]) & (i < s["end"])), mask).otherwise(c)), "")
    return with_row(docs, row).join(hits, row, "left").withColumn("text", F.when(F.col(spans_).isNull(), F.col("text")).otherwise(hidden)).drop(row, spans_)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. A null text counts as empty; empty texts have no spans; repeated
    rows each have theirs; of spans that start together the order is that of the kinds; an empty
    table gives no rows."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["order"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < 3)
    n = [count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *n[:3], F.sha2(show(base), 256).alias("base_sha256"), show("spans").alias("spans"), n[3])


QUERIES = {"op3_secret_scan": op3_secret_scan}
#: The battery's thresholds follow the whole corpus; tests compare with brute force.
ORACLES: dict = {}
