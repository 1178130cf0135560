"""Quality rules (operator 8): base counts and distribution divergence.

For every whole text the base counts are words, characters in words, symbols,
repeated lines and words inside repeated 8-word windows.  The method compares
two histograms of the document with the references of its language by the
Jensen-Shannon distance (base 2):

* character classes: a-z, A-Z, 0-9, white space, symbols, other ASCII, the rest;
* the language's twelve most common function words, and all other words.

The references are the summed histograms of *all* rows of the language
(``language_references``: one aggregate, at most one row per known language).
A distance is only judged from ``min_words`` words on, against a limit that
falls with the length: ``limit + slack / sqrt(n_words)``, because the distance
of a short clean text is mostly sampling noise.

Everything is row-local DataFrame expressions; there is no shuffle but that of
the references.  Repeated windows are found by sorting the 64-bit hashes of a
document's windows with their positions, so cost is n log n in the document's
length.

Defined cases: a null or empty text has no words (base_failed).  A row whose
language is null or has no reference is judged by the base rules alone.
Repeated rows get equal verdicts.  Extra input columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
N_CLASSES = 7

# Common function words by language, most frequent first.
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "des", "im"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "it", "was"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "du", "est"],
}
N_COMMON = 12


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    guard_words: int = 50
    char_limit: float = 0.25
    char_slack: float = 0.6
    word_limit: float = 0.13
    word_slack: float = 1.25


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _class_counts(text: Column, rest: Column) -> list[Column]:
    """Code points by class; ``rest`` is the text without a-z."""
    n = F.length(text)
    without = lambda pattern: F.length(rest) - F.length(F.regexp_replace(rest, pattern, ""))
    other = r"[\x00-\x7F&&[^a-zA-Z0-9\x20\x09-\x0D#*$%&|<>]]+"
    return [n - F.length(rest), without("[A-Z]+"), without("[0-9]+"), without(SPACE),
            without(SYMBOLS + "+"), without(other), without(r"[^\x00-\x7F]+")]


def with_histograms(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds ``_t`` (the text, never null), ``_words``, ``_n_words`` and the count
    arrays ``_c`` (character classes) and ``_w`` (common words, then all others;
    null for an unknown language)."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    known = F.create_map(*(x for k in sorted(COMMON_WORDS)
                           for x in (F.lit(k), F.array(*map(F.lit, COMMON_WORDS[k])))))
    d = docs.withColumn("_t", t).withColumn("_rest", F.regexp_replace("_t", "[a-z]+", ""))
    d = d.withColumns({"_words": words_of(F.col("_t")),
                       "_held": F.filter(words_of(F.lower("_t")), lambda w: w.isin(every)),
                       "_common": F.try_element_at(known, F.col(lang))})
    d = d.withColumns({"_n_words": F.size("_words").cast("long"),
                       "_c": F.array(*_class_counts(F.col("_t"), F.col("_rest")))})
    counts = F.transform("_common", lambda w: F.size("_held") - F.size(F.array_remove("_held", w)))
    d = d.withColumn("_counts", counts)
    others = F.col("_n_words").cast("int") - F.aggregate("_counts", F.lit(0), lambda s, x: s + x)
    return d.withColumn("_w", F.concat("_counts", F.array(others)))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list, list]]:
    """Summed histograms of all rows, for each known language that occurs."""
    known = docs.where(F.col(lang).isin(sorted(COMMON_WORDS))).select(text, lang)
    h = with_histograms(known, text, lang)
    sums = [F.sum(F.col(a)[k].cast("long")).alias(f"{a}{k}")
            for a, n in (("_c", N_CLASSES), ("_w", N_COMMON + 1)) for k in range(n)]
    rows = h.groupBy(lang).agg(*sums).collect()
    return {r[lang]: ([r[f"_c{k}"] for k in range(N_CLASSES)],
                      [r[f"_w{k}"] for k in range(N_COMMON + 1)]) for r in rows}


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of an array of counts and an array of
    shares; null if either is null or the counts are all zero."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = lambda p, q: term(p, (p + q) / 2) + term(q, (p + q) / 2)
    shares = F.transform(F.array(total), lambda n: F.transform(counts, lambda c: c / n))[0]
    terms = F.zip_with(shares, reference, both)
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2)))


def _reference(refs: dict, which: int, lang: Column) -> Column:
    shares = {g: [float(x / sum(r[which])) for x in r[which]] for g, r in sorted(refs.items()) if sum(r[which])}
    if not shares:
        return F.lit(None).cast("array<double>")
    return F.try_element_at(F.create_map(*(x for g, v in shares.items()
                                           for x in (F.lit(g), F.array(*map(F.lit, v))))), lang)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once per row: the optimiser would else move
    an expression used once inside a lambda and repeat it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(words: str) -> Column:
    """64-bit hash of the window that starts at each word."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = let(F.transform(words, lambda w: F.xxhash64(w)),
                  lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(F.size(words) >= WINDOW, windows).otherwise(F.expr("cast(array() as array<long>)"))


def _repeat_words(hashes: str) -> Column:
    """Words covered by windows that occur twice or more; ``hashes`` names the
    array of window hashes by position."""
    def repeated(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda s, x: s + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(distinct, F.lit(0)).otherwise(let(F.sort_array(let(pairs, repeated)), covered))


def with_quality(docs: DataFrame, refs: dict, limits: Limits = Limits(),
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """The input's columns and the seven result columns, replacing columns of
    the same names."""
    d = with_histograms(docs, text, lang)
    d = d.withColumn("_win", _window_hashes("_words"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("_lines", lines)
    n = F.col("_n_words")
    d = d.withColumns({
        "_word_chars": (F.length("_t") - F.col("_c")[3]).cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_repeat_words": _repeat_words("_win").cast("long"),
        "_js_char": js_distance(F.col("_c"), _reference(refs, 0, F.col(lang))),
        "_js_word": js_distance(F.col("_w"), _reference(refs, 1, F.col(lang))),
    })
    failed = (n < limits.min_words) | (100 * F.col("_n_repeat_words") > limits.max_repeat_percent * n)
    far = ((F.col("_js_char") > limits.char_limit + limits.char_slack / F.sqrt(n))
           | (F.col("_js_word") > limits.word_limit + limits.word_slack / F.sqrt(n)))
    d = d.withColumn("_failed", failed)
    diverges = (n >= limits.guard_words) & F.coalesce(far, F.lit(False))
    keep_cols = [c for c in docs.columns if c not in RESULT]
    return d.select(*(F.col(c) for c in keep_cols), n.alias("n_words"), F.col("_word_chars").alias("word_chars"),
                    F.col("_c")[4].cast("long").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
                    F.col("_n_repeat_words").alias("n_repeat_words"), F.col("_failed").alias("base_failed"),
                    (~F.col("_failed") & ~diverges).alias("kept"))


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judge_quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row: doc_id and the seven result columns."""
    d = docs.select("doc_id", "text", "lang")
    return with_quality(d, language_references(d), limits).select("doc_id", *RESULT)


def passing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows kept by the rules, with the input's columns unchanged.

    Rows are written with their verdict and filtered when read again: a filter on
    the verdict itself would be pushed below the projections and repeat the shared
    expressions at each of their uses."""
    refs = language_references(docs)
    marked = with_quality(docs.withColumn("_all", F.struct(*docs.columns)), refs, limits)
    return stored(marked.select("_all", "kept"), "quality").where("kept").select("_all.*")


def oracle_sql(limits: Limits = Limits(), table: str = "documents") -> str:
    """DuckDB: the same counts and verdict."""
    classes = ["[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x20\x09-\x0D]", "[^#*$%&|<>]",
               r"[a-zA-Z0-9\x20\x09-\x0D#*$%&|<>]|[^\x00-\x7F]", r"[\x00-\x7F]"]
    c = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g')) AS c{k}" for k, p in enumerate(classes))
    common = " ".join(f"WHEN '{g}' THEN {w!r}" for g, w in sorted(COMMON_WORDS.items()))
    w = ", ".join(f"CASE WHEN cw IS NOT NULL THEN len(list_filter(ws, lambda x: lower(x) = cw[{k + 1}])) END AS w{k}"
                  for k in range(N_COMMON))
    w += (f", CASE WHEN cw IS NOT NULL THEN len(list_filter(ws, lambda x: NOT list_contains(cw, lower(x)))) END AS w{N_COMMON}")
    sums = ", ".join(f"sum({a}{k}) AS r{a}{k}" for a, m in (("c", N_CLASSES), ("w", N_COMMON + 1)) for k in range(m))

    def distance(a: str, m: int) -> str:
        total = "(" + " + ".join(f"{a}{k}" for k in range(m)) + ")::double"
        rtotal = "(" + " + ".join(f"r{a}{k}" for k in range(m)) + ")::double"
        terms = []
        for k in range(m):
            p, q = f"({a}{k} / {total})", f"(r{a}{k} / {rtotal})"
            mid = f"(({p} + {q}) / 2)"
            terms += [f"CASE WHEN {a}{k} > 0 THEN {p} * log2({p} / {mid}) ELSE 0 END",
                      f"CASE WHEN r{a}{k} > 0 THEN {q} * log2({q} / {mid}) ELSE 0 END"]
        return f"CASE WHEN {total} > 0 AND {rtotal} > 0 THEN sqrt(greatest(0, ({' + '.join(terms)}) / 2)) END"

    return rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                     CASE lang {common} END AS cw FROM {table}),
h AS (SELECT rid, doc_id, lang, t, ws, len(ws) AS n, {c}, {w} FROM base),
refs AS (SELECT lang AS rlang, {sums} FROM h WHERE w0 IS NOT NULL GROUP BY lang),
pos AS (SELECT rid, unnest(generate_series(1, n - {WINDOW - 1})) AS i, ws FROM h WHERE n >= {WINDOW}),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM pos),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS rep
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
j AS (SELECT h.*, coalesce(cov.rep, 0) AS rep, {distance('c', N_CLASSES)} AS jc, {distance('w', N_COMMON + 1)} AS jw,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM h LEFT JOIN refs ON lang = rlang LEFT JOIN cov USING (rid)),
f AS (SELECT *, n < {limits.min_words} OR 100 * rep > {limits.max_repeat_percent} * n AS failed FROM j)
SELECT doc_id, n::bigint AS n_words, (length(t) - c3)::bigint AS word_chars, c4::bigint AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, rep::bigint AS n_repeat_words, failed AS base_failed,
       NOT failed AND NOT (n >= {limits.guard_words} AND coalesce(
         jc > {limits.char_limit} + {limits.char_slack} / sqrt(n) OR jw > {limits.word_limit} + {limits.word_slack} / sqrt(n), false)) AS kept
FROM f"""
