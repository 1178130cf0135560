"""Secret scan (operator 1): base patterns and a randomness test battery.

Base spans are the leftmost non-overlapping matches of three patterns: assigned
values, access keys and hexadecimal runs.  The method adds spans of kind
``random``: unbroken runs of at least ``MIN_TOKEN`` characters of
``[A-Za-z0-9+/_-]``, clear of base spans, that look like random data.

* *Encoding.*  hex, letters of one case, base32, base36 or base64, the smallest
  alphabet that holds the token, gives each character a code.
* *Battery, against random data.*  Under a uniform alphabet: a chi-squared test of
  uniformity (by the number of equal character pairs, an affine form of the
  statistic that stays usable on short tokens), a runs test above and below the
  alphabet's middle, and a lag-one serial-correlation test.  A token whose smallest
  p-value times three is below ``ALPHA`` is not random.
* *Battery, against ordinary text.*  Frequencies of neighbouring characters are
  counted over all words shorter than a token in all rows (with
  ``PRIOR`` pseudo-counts of a text whose neighbours change class - lower, upper,
  digit, other - with probability ``CLASS_CHANGE``, for tables with little text).
  They hold what the three tests look at: uneven use of characters, runs of a class,
  and serial dependence.  The likelihood ratio of a uniform alphabet to ordinary
  text has mean one under ordinary text, so its inverse, times the number of
  alphabets, is a p-value at every length.
* *False-discovery control.*  The Benjamini-Hochberg step-up at rate ``FDR`` runs over
  the p-values against ordinary text of all tokens of the table, separately in each
  length stratum, so long tokens, where evidence is cheap, do not lend significance to
  short ones.  P-values are counted in bins of a tenth of a decade and a bin is judged by its upper edge,
  which makes the step-up slightly conservative and its table bounded: the driver
  reads at most ``len(STRATA) * MAX_BIN`` counts, and the counts of at most
  ``len(SYMBOLS) ** 2`` pairs of characters.

Everything is DataFrame expressions.  A document's spans and token statistics are
checkpointed once (texts are not), then judged against the thresholds.  Positions
are code points, end exclusive: they are sums of the lengths of the pieces between
matches, added up in blocks so that cost stays near linear in the matches.

Defined cases: a null or empty text has no spans.  Repeated rows get equal rows
(and count as separate tokens).  A null ``doc_id`` is passed through.  Extra
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

# The patterns of the query contract, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ of 24 or more: runs are maximal
KINDS = ["assign", "access", "hex", "random"]
MIN_ASSIGNED, MIN_ACCESS = 6, 20

MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHA = 0.001
CLASS_CHANGE = 0.08
PRIOR = 100.0
FDR = 0.01
STRATA = [20, 32, 48, 64]  # smallest token length of each stratum
BINS_PER_DECADE = 10
MAX_BIN = 1000
BLOCK = 128

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SYMBOLS = _LOWER + _UPPER + _DIGITS + "+/_-"  # the characters of tokens
ALPHABETS = {"hex": _DIGITS + "abcdef", "letters": _LOWER, "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER,
             "base64": _UPPER + _LOWER + _DIGITS + "+/"}

SPAN = "struct<start:int,kind:int,stop:int>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _scan(steps: Column, begin: Column) -> Column:
    """Start of each match: ``begin`` and the gaps and sizes before it."""
    first = F.struct(begin.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"),
                                 F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out"))
    return F.aggregate(steps, first, step, lambda s: s["out"])


def match_starts(text: Column, pattern: str, matched: Column) -> Column:
    """0-based code point starts of the matches of ``pattern`` (as listed by
    ``regexp_extract_all``)."""
    def starts(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(pieces, 1, F.size(m)), m, lambda p, x: F.struct(
            F.length(p).alias("gap"), F.length(x).alias("size")))
        return let(steps, blocks)

    def blocks(steps: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK)), lambda b: F.slice(steps, b, BLOCK))
        return let(cut, lambda bs: F.flatten(F.zip_with(bs, offsets(bs), _scan)))

    def offsets(bs: Column) -> Column:
        sizes = F.transform(bs, lambda b: F.struct(F.lit(0).alias("gap"), _total(
            F.transform(b, lambda x: x["gap"] + x["size"])).alias("size")))
        return _scan(sizes, F.lit(0))

    none = F.expr("cast(array() as array<int>)")
    return F.when(F.size(matched) > 0, let(matched, starts)).otherwise(none)


def _spans(text: Column, kind: str, pattern: str, shortest: int = 0, group: int = 0) -> Column:
    """Spans of a kind; matches whose ``group`` is shorter than ``shortest`` are dropped."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matched
    found = F.arrays_zip(match_starts(text, pattern, matched).alias("start"), matched.alias("m"), judged.alias("g"))
    kept = F.filter(found, lambda x: F.length(x["g"]) >= shortest)
    return F.transform(kept, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
        (x["start"] + F.length(x["m"])).alias("stop")))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(_spans(text, "assign", ASSIGN, MIN_ASSIGNED, 2),
                                 _spans(text, "access", ACCESS, MIN_ACCESS), _spans(text, "hex", HEX)))


def upper_tail(z: Column) -> Column:
    """Upper tail of the standard normal (logistic approximation, error under 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def _encoding(token: Column) -> Column:
    return (F.when(F.rlike(token, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "hex")
            .when(F.rlike(token, F.lit("^([a-z]+|[A-Z]+)$")), "letters")
            .when(F.rlike(token, F.lit("^[A-Z2-7]+$")), "base32")
            .when(F.rlike(token, F.lit("^([0-9a-z]+|[0-9A-Z]+)$")), "base36").otherwise("base64"))


def uniform_p(token: Column) -> Column:
    """Smallest p-value of the battery times three, under a uniform alphabet."""
    def by_encoding(e: Column) -> Column:
        alphabet = F.element_at(F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv)), e)
        plain = (F.when(e.isin("hex", "letters", "base36"), F.lower(token))
                 .when(e == "base64", F.translate(token, "-_", "+/")).otherwise(token))
        size = F.length(alphabet).cast("double")
        return let(F.transform(F.split(plain, ""), lambda c: F.call_function("instr", alphabet, c) - 1),
                   lambda codes: battery(codes, size))

    def battery(codes: Column, a: Column) -> Column:
        n = F.size(codes).cast("double")
        # chi-squared uniformity: pairs of equal characters against n (n - 1) / a
        same = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda s, c: s + let(
            (F.size(codes) - F.size(F.array_remove(codes, c))).cast("double"), lambda k: k * (k - 1)))
        pairs = n * (n - 1)
        z1 = (same - pairs / a) / F.sqrt(2 * pairs / a * (1 - 1 / a))
        # runs above and below the middle of the alphabet
        high = F.transform(codes, lambda c: 2 * c >= a)
        n1 = F.size(F.filter(high, lambda h: h)).cast("double")
        changes = F.size(F.filter(codes, lambda c, i: F.coalesce(
            (2 * c >= a) != (2 * F.get(codes, i - 1) >= a), F.lit(False))))
        product = 2 * n1 * (n - n1)
        spread = F.sqrt(F.greatest(F.lit(1e-9), product * (product - n) / (n * n * (n - 1))))
        z2 = F.when(product > n, F.abs(changes - product / n) / spread).otherwise(F.lit(40.0))
        # lag-one serial correlation
        mean = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
        def products(m: Column) -> Column:
            var = F.aggregate(codes, F.lit(0.0), lambda s, c: s + (c - m) * (c - m))
            cov = F.aggregate(F.transform(codes, lambda c, i: F.coalesce((c - m) * (F.get(codes, i + 1) - m), F.lit(0.0))),
                              F.lit(0.0), lambda s, x: s + x)
            return F.when(var > 0, F.abs(cov / var) * F.sqrt(n)).otherwise(F.lit(40.0))
        z3 = let(mean, products)
        return F.least(F.lit(1.0), 3 * F.least(upper_tail(z1), 2 * upper_tail(z2), 2 * upper_tail(z3)))

    return let(_encoding(token), by_encoding)


def neighbour_counts(docs: DataFrame) -> DataFrame:
    """How often each pair of token characters stands side by side in the words,
    shorter than tokens, of all rows: pair, k."""
    # by a plain space first, so that the expression sees each distinct piece once
    pieces = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("p"))
    pieces = pieces.groupBy("p").agg(F.count("*").alias("n"))
    words = pieces.select("n", F.explode(F.split("p", "[^A-Za-z0-9+/_-]+")).alias("w"))
    words = words.where(F.length("w").between(2, MIN_TOKEN - 1))
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, 2))
    return words.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("k"))


def ordinary_model(counts: dict[str, int]) -> list[float]:
    """Decimal logarithm of the probability of each character after each other one in
    ordinary text, by rows of ``SYMBOLS``; a row's probabilities sum to one."""
    classes = [_LOWER, _UPPER, _DIGITS, SYMBOLS[-4:]]
    of = {c: group for group in classes for c in group}
    out = []
    for x in SYMBOLS:
        total = sum(counts.get(x + y, 0) for y in SYMBOLS)
        for y in SYMBOLS:
            same = of[x] is of[y]
            share = (1 - CLASS_CHANGE) / len(of[x]) if same else CLASS_CHANGE / (len(SYMBOLS) - len(of[x]))
            out.append(math.log10((counts.get(x + y, 0) + PRIOR * share) / (total + PRIOR)))
    return out


def ordinary_bin(token: Column, model: Column) -> Column:
    """Bin (tenths of a decade) of the token's p-value under ordinary text; larger is
    less ordinary.  ``model`` is the array of ``ordinary_model``."""
    sizes = F.create_map(*(F.lit(x) for k, v in ALPHABETS.items() for x in (k, float(len(v)))))
    def decades(codes: Column) -> Column:
        ordinary = F.aggregate(F.transform(codes, lambda c, i: F.when(
            i > 0, F.get(model, F.get(codes, i - 1) * len(SYMBOLS) + c)).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        uniform = (F.size(codes) - 1) * F.log10(F.element_at(sizes, _encoding(token)))
        return -ordinary - uniform - math.log10(len(ALPHABETS))
    codes = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(SYMBOLS), c) - 1)
    found = F.greatest(F.lit(0.0), let(codes, decades)) * BINS_PER_DECADE
    return F.least(F.lit(MAX_BIN), F.floor(found)).cast("int")


def stratum(length: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA):
        out = F.when(length >= least, k).otherwise(out)
    return out


def tokens(text: Column, base: Column, model: Column) -> Column:
    """Candidate tokens clear of base spans: start, stop, stratum, bin, uniform."""
    matched = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    found = F.arrays_zip(match_starts(text, TOKEN, matched).alias("start"), matched.alias("m"))
    clear = F.filter(found, lambda x: ~F.exists(base, lambda b: (
        (b["start"] < x["start"] + F.length(x["m"])) & (x["start"] < b["stop"]))))
    return F.transform(clear, lambda x: F.struct(
        x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("stop"),
        stratum(F.length(x["m"])).alias("stratum"), ordinary_bin(x["m"], model).alias("bin"),
        (uniform_p(x["m"]) >= ALPHA).alias("uniform")))


def bin_limits(counts: list[tuple[int, int, int]]) -> list[int]:
    """Benjamini-Hochberg in each stratum: the smallest bin that is discovered.
    ``counts`` holds (stratum, bin, tokens); a stratum without discoveries gets
    ``MAX_BIN + 1``."""
    limits = []
    for s in range(len(STRATA)):
        bins = sorted(((b, k) for t, b, k in counts if t == s), reverse=True)
        total, seen, limit = sum(k for _, k in bins), 0, MAX_BIN + 1
        for b, k in bins:
            seen += k
            if 10.0 ** (-b / BINS_PER_DECADE) <= FDR * seen / total:
                limit = b
        limits.append(limit)
    return limits


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base and random spans (arrays of start, kind, stop)."""
    counts = {r["pair"]: r["k"] for r in neighbour_counts(docs).collect()}  # at most len(SYMBOLS) ** 2
    # one literal: an array of numbers, folded from its text
    model = F.split(F.lit(",".join(map(repr, ordinary_model(counts)))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("_text")).withColumn("base", base_spans(F.col("_text")))
    rows = cut_lineage(base.select("doc_id", "base", tokens(F.col("_text"), F.col("base"), model).alias("tokens")))
    counted = rows.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count("*").alias("k"))
    limits = bin_limits([(r["stratum"], r["bin"], r["k"]) for r in counted.collect()])
    limit = F.array(*map(F.lit, limits))
    random = F.filter("tokens", lambda t: t["uniform"] & (t["bin"] >= F.get(limit, t["stratum"])))
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"),
                                                    t["stop"].alias("stop")))
    return rows.select("doc_id", "base", random.alias("random"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", "random"))).alias("spans"),
        F.size("random").cast("long").alias("n_random"))
