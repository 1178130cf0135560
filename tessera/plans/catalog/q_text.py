"""Text analytics (2.8) on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions._util import r6
from ...functions.text import clean_text
from ...operators import text as TX
from ...session import scratch_path
from . import query
from ._common import t
from .q_scalars import _WS, CLEAN_SQL

_TERMS = ["the", "and", "les", "des", "und", "que", "with"]
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def _tfidf_sql() -> str:
    n = len(_TERMS)
    cnt = ", ".join(f"CAST(len(list_filter(toks, lambda x: x = '{w}')) AS DOUBLE) AS c{i}"
                    for i, w in enumerate(_TERMS))
    dfs = ", ".join(f"count_if(c{i} > 0) AS df{i}" for i in range(n))
    ws = ", ".join(f"c{i} * (ln((n + 1) / (df{i} + 1)) + 1) AS w{i}" for i in range(n))
    norm = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in range(n)) + ")"
    outs = ", ".join(f"round(CASE WHEN {norm} > 0 THEN w{i} / {norm} ELSE 0.0 END, 6) AS tfidf_{w}"
                     for i, w in enumerate(_TERMS))
    return f"""
WITH tk AS (SELECT doc_id, {_TOK} AS toks FROM documents),
c AS (SELECT doc_id, {cnt} FROM tk),
s AS (SELECT count(*) AS n, {dfs} FROM c),
w AS (SELECT doc_id, {ws} FROM c, s)
SELECT doc_id, {outs} FROM w"""


@query("tfidf_vocab", _tfidf_sql(), "text")
def q_tfidf_vocab(spark, sf):
    out = TX.tfidf_vocab(t(spark, sf, "documents"), ["doc_id"], "text", _TERMS)
    return out.select("doc_id", *[r6(f"tfidf_{w}").alias(f"tfidf_{w}") for w in _TERMS])


# A small polarity lexicon given as an input table (the lexicon is data, not code).
_LEXICON = [("the", 0.1), ("and", 0.2), ("les", -0.3), ("des", 0.3), ("und", 0.4),
            ("que", -0.1), ("with", 0.5), ("ion", -0.5)]


@query("lexicon_sentiment", f"""
WITH lex AS (SELECT * FROM (VALUES {", ".join(f"('{w}', {p})" for w, p in _LEXICON)}) v(word, polarity)),
tk AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents),
s AS (SELECT tk.doc_id, avg(CAST(lex.polarity AS DOUBLE)) AS sentiment FROM tk JOIN lex ON tk.word = lex.word
      GROUP BY tk.doc_id)
SELECT d.doc_id, round(coalesce(s.sentiment, 0.0), 6) AS sentiment
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""", "text")
def q_lexicon_sentiment(spark, sf):
    lex = spark.createDataFrame(_LEXICON, "word string, polarity double")
    out = TX.lexicon_sentiment(t(spark, sf, "documents"), ["doc_id"], "text", lex)
    return out.select("doc_id", r6("sentiment").alias("sentiment"))


_WIDE_LEXICON = [(w, p) for w, p in _LEXICON if w != "que"] + [("que", None), ("the", 0.4), ("THE", -0.2)] + [
    (f"{a}{b}", (ord(a) - ord(b)) / 47) for a in "abcdeimno" for b in "deinorstuw"]


@query("lexicon_sentiment_wide", f"""
WITH lex AS (SELECT lower(word) AS word, avg(polarity) AS polarity FROM (VALUES {", ".join(
    f"('{w}', CAST({'NULL' if p is None else p} AS DOUBLE))" for w, p in _WIDE_LEXICON)}) v(word, polarity)
  WHERE polarity IS NOT NULL GROUP BY 1),
r AS (SELECT row_number() OVER () AS rid, source, {_TOK} AS toks FROM documents),
tk AS (SELECT rid, unnest(toks) AS word FROM r),
s AS (SELECT rid, avg(polarity) AS sentiment FROM tk JOIN lex USING (word) GROUP BY rid)
SELECT source, round(coalesce(sentiment, 0.0), 6) + 0.0 AS sentiment FROM r LEFT JOIN s USING (rid)""", "text")
def q_lexicon_sentiment_wide(spark, sf):
    """More than 64 words, words twice and without polarity, and a key with many rows."""
    lex = spark.createDataFrame(_WIDE_LEXICON, "word string, polarity double")
    out = TX.lexicon_sentiment(t(spark, sf, "documents"), ["source"], "text", lex)
    return out.select("source", r6("sentiment").alias("sentiment"))


@query("truncate_tokens", f"""
SELECT doc_id, array_to_string(({_TOK})[1:128], ' ') AS tokens FROM documents""", "text")
def q_truncate_tokens(spark, sf):
    out = TX.truncate_tokens(t(spark, sf, "documents"), "text", 128)
    return out.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("tokenize_pad", f"""
WITH tk AS (SELECT doc_id, {_TOK} AS toks FROM documents),
cnt AS (SELECT tok, count(*) AS cnt FROM (SELECT unnest(toks) AS tok FROM tk) GROUP BY tok),
voc AS (SELECT tok, row_number() OVER (ORDER BY cnt DESC, tok) + 1 AS id FROM cnt),
ex AS (SELECT doc_id, unnest(toks[1:256]) AS tok, unnest(range(1, len(toks[1:256]) + 1)) AS pos FROM tk),
ids AS (SELECT ex.doc_id, string_agg(CAST(coalesce(voc.id, 1) AS VARCHAR), ' ' ORDER BY ex.pos) AS s,
               count(*) AS n FROM ex LEFT JOIN voc ON ex.tok = voc.tok GROUP BY ex.doc_id)
SELECT d.doc_id,
       CASE WHEN ids.n IS NULL THEN ltrim(repeat(' 0', 256)) ELSE ids.s || repeat(' 0', CAST(256 - ids.n AS INTEGER)) END
         AS input_ids,
       CAST(coalesce(ids.n, 0) AS INTEGER) AS n_tokens
FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id""", "text")
def q_tokenize_pad(spark, sf):
    d = t(spark, sf, "documents")
    vocab = TX.build_vocabulary(d, "text")
    out = TX.tokenize_pad(d, ["doc_id"], "text", vocab, 256)
    return out.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"))


@query("clean_then_count_notes", f"""
SELECT source, count(*) AS n_docs,
       round(avg(len(list_filter(regexp_split_to_array({CLEAN_SQL.replace('__X__', 'text')}, '{_WS}+'),
                                 lambda w: w <> ''))), 6) AS mean_words
FROM documents GROUP BY source""", "text")
def q_clean_then_count_notes(spark, sf):
    from ...functions.text import count_words
    d = t(spark, sf, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                   r6(F.avg(count_words(clean_text("text")))).alias("mean_words"))


@query("embed_resume", """SELECT doc_id, 64 AS dim FROM documents""", "text")
def q_embed_resume(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, "embeddings")
    first = TX.embed_resume(d.where("lang = 'en'"), None, ["doc_id"], "text", path)
    full = TX.embed_resume(d, first, ["doc_id"], "text", path)
    return full.select("doc_id", F.size("embedding").alias("dim"))


# -- rows-only: model fits and the caller-supplied encoder ----------------------------

@query("batch_embed", None, "text")
def q_batch_embed(spark, sf):
    out = TX.batch_embed(t(spark, sf, "documents"), ["doc_id"], "text", dim=64, batch=16)
    return out.select("doc_id", r6(F.sqrt(F.aggregate("embedding", F.lit(0.0),
                                                       lambda a, x: a + x * x))).alias("norm"))


# Stop words given to the vectorisers here: frequent words of the four languages.
_STOP = ["the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "den", "la", "le", "les", "et", "de", "el", "que", "los"]
_KEPT = f"list_filter({_TOK}, lambda w: w NOT IN ({', '.join(repr(w) for w in _STOP)}))"


@query("exact_vocabulary", f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce({_KEPT}, []) AS w FROM documents),
g AS (SELECT rid, unnest(w) AS term FROM d),
v AS (SELECT term, count(*) AS cnt, count(DISTINCT rid) AS df FROM g GROUP BY term)
SELECT term, cnt, df, (row_number() OVER (ORDER BY cnt DESC, term) - 1)::integer AS idx FROM v
WHERE df >= 10 AND df <= 0.95 * (SELECT count(*) FROM documents)""", "text")
def q_exact_vocabulary(spark, sf):
    d = TX._kept_tokens(t(spark, sf, "documents"), "text", _STOP, "kept")
    return TX.exact_vocabulary(d, "kept", 10, 0.95)


@query("count_vectorize", f"""
WITH d AS (SELECT doc_id, coalesce({_KEPT}, []) AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS term FROM d),
c AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY doc_id, term),
v AS (SELECT term, row_number() OVER (ORDER BY sum(n) DESC, term) - 1 AS idx FROM c GROUP BY term
      HAVING count(*) >= 10 AND count(*) <= 0.95 * (SELECT count(*) FROM documents)),
s AS (SELECT doc_id, count(*) AS n_terms, sum(n) AS total, sum(n * (idx + 1)) AS weighted FROM c JOIN v USING (term) GROUP BY doc_id)
SELECT doc_id, (SELECT count(*) FROM v)::integer AS size, coalesce(n_terms, 0)::integer AS n_terms,
       coalesce(total, 0)::bigint AS total, coalesce(weighted, 0)::bigint AS weighted FROM documents LEFT JOIN s USING (doc_id)""", "text")
def q_count_vectorize(spark, sf):
    out, model = TX.count_vectorize(t(spark, sf, "documents"), "text", min_df=10, max_df=0.95, stop_words=_STOP)
    d = out.select("doc_id", TX.vector_entries("counts").alias("c"))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda a, e: a + f(e)).cast("long")
    return d.select("doc_id", F.lit(len(model.vocabulary)).alias("size"), F.size("c").alias("n_terms"),
                    total(lambda e: e["x"]).alias("total"), total(lambda e: e["x"] * (e["i"] + 1)).alias("weighted"))


@query("tfidf_ngrams", f"""
WITH d AS (SELECT doc_id, coalesce({_KEPT}, []) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
c AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY doc_id, term),
v AS (SELECT term, count(*) AS df, row_number() OVER (ORDER BY sum(n) DESC, term) - 1 AS idx FROM c GROUP BY term),
x AS (SELECT doc_id, idx, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term) WHERE idx < 20000),
s AS (SELECT doc_id, count(*) AS n_terms, sum(w * w) AS sq, sum(w * (idx % 97 + 1)) AS weighted FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_terms, 0)::integer AS n_terms, CASE WHEN sq > 0 THEN 1::double ELSE 0::double END AS norm,
       round(coalesce(weighted / sqrt(sq), 0.0), 6) AS weighted FROM documents LEFT JOIN s USING (doc_id)""", "text")
def q_tfidf_ngrams(spark, sf):
    out, _ = TX.tfidf_ngrams(t(spark, sf, "documents"), "text", n=2, max_features=20000, stop_words=_STOP)
    d = out.select("doc_id", TX.vector_entries("tfidf").alias("v"))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda a, e: a + f(e))
    return d.select("doc_id", F.size("v").alias("n_terms"), F.round(F.sqrt(total(lambda e: e["x"] * e["x"])), 6).alias("norm"),
                    r6(total(lambda e: e["x"] * (e["i"] % 97 + 1))).alias("weighted"))


@query("lda_topics", None, "text")
def q_lda_topics(spark, sf):
    counts, _ = TX.count_vectorize(t(spark, sf, "documents").select("doc_id", "text"), "text",
                                   min_df=10, max_df=0.95)
    out, _ = TX.lda_topics(counts, "counts", k=5, seed=42)
    return out.select("doc_id", *[r6(f"topic_{i}").alias(f"topic_{i}") for i in range(1, 6)])
