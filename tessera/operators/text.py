"""Text analytics: vocabulary TF-IDF, n-gram TF-IDF, count vectors, topics,
lexicon sentiment, token padding and batched embedding.

Everything except the model fits (``pyspark.ml``) and the caller-supplied
encoder of :func:`batch_embed` is a column expression or an aggregation.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import cut_lineage
from ..plans.ordered import ordered_scan

# ---------------------------------------------------------------------------
# The symptom vocabulary of the note TF-IDF features.
SYMPTOM_TERMS = [
    "pain", "anxiety", "depression", "headache", "fatigue", "sleep",
    "sad", "crying", "hopeless", "tired", "insomnia", "nausea", "vomiting",
]
# ---------------------------------------------------------------------------


def tfidf_vocab(df: DataFrame, keys: Sequence[str], text: str, terms: Sequence[str],
                prefix: str = "tfidf_") -> DataFrame:
    """TF-IDF for a fixed vocabulary, one column per term.

    tf = occurrences of the term among the word tokens; idf = ln((1+n)/(1+df)) + 1
    (smoothed); each row is L2-normalised over the vocabulary.  Counting
    happens per row with ``filter`` over the token array -- no explode, no
    shuffle -- and the document frequencies are one global aggregate.
    """
    keys = list(keys)
    terms = list(terms)
    def is_term(w):
        return lambda x: x == F.lit(w)
    # Tokenise once and keep only vocabulary words: Spark does not share the
    # tokenizer call between the per-term counts, so each count would re-run
    # the regex over the whole text.
    in_vocab = df.select(*keys, F.filter(tokens(text), lambda x: x.isin(terms)).alias("_vt"))
    # The per-document term counts (a few numbers per row) are read twice --
    # document frequencies, then weights -- so they are kept in the checkpoint
    # folder and the text itself is scanned and tokenised only once.
    counts = cut_lineage(in_vocab.select(*keys, *[F.size(F.filter("_vt", is_term(w)))
                                                  .cast("double").alias(f"_c{i}")
                                                  for i, w in enumerate(terms)]))
    stats = counts.agg(F.count(F.lit(1)).alias("n"),
                       *[F.count_if(F.col(f"_c{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    st = stats.select(F.struct(*stats.columns)).scalar()
    idf = [F.ln((st["n"] + 1) / (st[f"df{i}"] + 1)) + 1 for i in range(len(terms))]
    w = [F.col(f"_c{i}") * idf[i] for i in range(len(terms))]
    weighted = counts.select(*keys, *[w[i].alias(f"_w{i}") for i in range(len(terms))])
    norm = F.sqrt(sum((F.col(f"_w{i}") * F.col(f"_w{i}") for i in range(len(terms))), F.lit(0.0)))
    return weighted.select(*keys, *[
        F.when(norm > 0, F.col(f"_w{i}") / norm).otherwise(F.lit(0.0)).alias(f"{prefix}{t}")
        for i, t in enumerate(terms)])


def lexicon_sentiment(df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame,
                      word: str = "word", polarity: str = "polarity",
                      out: str = "sentiment") -> DataFrame:
    """Mean polarity of the lexicon words found in the text (0 when none).

    The lexicon is an input table; words are lower-cased, repeated words are
    averaged and words without a polarity do not count.  One row per input row,
    also where ``keys`` repeat.  Every row sends its words, and one empty word
    that keeps it when it has none, to one hash join with the lexicon, which the
    planner broadcasts by its size in bytes; the averages are combined map-side.
    """
    keys = list(keys)
    lex = (lexicon.select(F.lower(F.col(word)).alias("_word"), F.col(polarity).cast("double").alias("_pol"))
           .where((F.col("_word") != "") & F.col("_pol").isNotNull())
           .groupBy("_word").agg(F.avg("_pol").alias("_pol")))
    words = F.concat(F.array(F.lit("")), F.coalesce(tokens(text), F.array().cast("array<string>")))
    rows = df.select(*keys, words.alias("_words"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.select(*keys, "_row", F.explode("_words").alias("_word"))
    return (rows.join(lex, "_word", "left").groupBy("_row", *keys)
            .agg(F.coalesce(F.avg("_pol"), F.lit(0.0)).alias(out)).drop("_row"))


def truncate_tokens(df: DataFrame, col: str, n: int = 128, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, F.slice(tokens(col), 1, n))


def build_vocabulary(df: DataFrame, text: str, min_count: int = 1,
                     reserved: int = 2) -> DataFrame:
    """Token -> id by descending frequency (ties by token); ids start after
    ``reserved`` (0 = padding, 1 = unknown).  The ranking uses the skew-proof
    ordered scan, not a single-task window."""
    counts = (df.select(F.explode(tokens(text)).alias("token")).groupBy("token")
              .agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count))
    ranked = ordered_scan(counts, [("cnt", False), "token"])
    return ranked.select("token", (F.col("_rn") - 1 + reserved).cast("int").alias("id"))


def tokenize_pad(df: DataFrame, keys: Sequence[str], text: str, vocab: DataFrame,
                 max_len: int = 256, unknown_id: int = 1) -> DataFrame:
    """Token ids of the first ``max_len`` tokens, right-padded with 0, and an
    attention mask; one row per input row, also where ``keys`` repeat.

    Each row sends its distinct kept tokens, with all their positions, to the
    vocabulary join, so a word repeated in a text is one row of the join; at most
    ``max_len`` ids are gathered per row."""
    keys = list(keys)
    kept = F.coalesce(F.slice(tokens(text), 1, max_len), F.array().cast("array<string>"))
    rows = df.select(*keys, kept.alias("_kept"), F.monotonically_increasing_id().alias("_row"))
    # an empty token without positions keeps the rows that have no token
    placed = F.transform(F.array_distinct("_kept"), lambda w: F.struct(w.alias("token"), F.filter(
        F.transform("_kept", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()).alias("at")))
    none = F.array(F.struct(F.lit("").alias("token"), F.array().cast("array<int>").alias("at")))
    words = rows.select(*keys, "_row", F.explode(F.concat(none, placed)).alias("_w")).select(*keys, "_row", "_w.*")
    ids = words.join(vocab, "token", "left").withColumn("id", F.coalesce("id", F.lit(unknown_id)))
    pairs = F.transform("at", lambda i: F.struct(i.alias("pos"), F.col("id").alias("id")))
    out = ids.groupBy("_row", *keys).agg(F.transform(F.array_sort(F.flatten(F.collect_list(pairs))),
                                                     lambda e: e["id"]).alias("_ids"))
    k = F.size("_ids")
    return out.select(
        *keys,
        F.concat("_ids", F.array_repeat(F.lit(0), F.lit(max_len) - k)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.lit(max_len) - k))
        .alias("attention_mask"))


# -- vectorisers and topics ----------------------------------------------------------

def _kept_tokens(df: DataFrame, text: str, stop_words: Sequence[str] | None, out: str) -> DataFrame:
    """Word tokens without the stop words (default: the library's English list)."""
    from pyspark.ml.feature import StopWordsRemover
    sw = StopWordsRemover(inputCol="_tok", outputCol=out,
                          stopWords=list(stop_words) if stop_words is not None
                          else StopWordsRemover.loadDefaultStopWords("english"))
    toks = F.coalesce(tokens(text), F.array().cast("array<string>"))
    return sw.transform(df.withColumn("_tok", toks)).drop("_tok")


def term_statistics(df: DataFrame, terms: str) -> DataFrame:
    """(term, cnt, df): occurrences and rows of each element of an array column.

    A row's sorted array marks the first of equal terms, so one exchange, combined
    map-side, counts both."""
    firsts = df.select(F.sort_array(terms).alias("_s")).select(F.explode(F.transform("_s", lambda x, i: F.struct(
        x.alias("term"), F.when(F.get("_s", i - 1) == x, 0).otherwise(1).alias("first")))).alias("_t")).select("_t.*")
    return firsts.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"), F.sum("first").alias("df"))


def exact_vocabulary(df: DataFrame, terms: str, min_df: float = 1, max_df: float = 1.0,
                     max_features: int | None = None) -> DataFrame:
    """(term, cnt, df, idx): the terms within the document-frequency bounds, numbered
    from 0 by descending count, ties by term, so the vocabulary and its order are
    determined by the data alone.  Bounds below 1 (``min_df``) and up to 1.0 (``max_df``)
    are shares of the rows, others counts."""
    stats = term_statistics(df, terms)
    if min_df > 1 or max_df != 1.0:
        n = df.count()
        low = min_df if min_df >= 1 else min_df * n
        high = max_df * n if isinstance(max_df, float) and max_df <= 1 else max_df
        stats = stats.where((F.col("df") >= low) & (F.col("df") <= high))
    order = [("cnt", False), "term"]
    if max_features is not None:  # a top-N: each task keeps its own first N
        stats = stats.orderBy(F.col("cnt").desc(), "term").limit(max_features)
    ranked = ordered_scan(cut_lineage(stats), order)
    return ranked.select("term", "cnt", "df", (F.col("_rn") - 1).cast("int").alias("idx"))


def _vector_model(vocabulary: list, terms: str, out: str):
    from pyspark.ml.feature import CountVectorizerModel
    names = [r["term"] for r in vocabulary] or [""]  # the library wants one term at least
    return CountVectorizerModel.from_vocabulary(names, inputCol=terms, outputCol=out)


def count_vectorize(df: DataFrame, text: str, min_df: float = 10, max_df: float = 0.95,
                    stop_words: Sequence[str] | None = None, out: str = "counts"):
    """Token counts with document-frequency bounds and stop words removed.
    Every term within the bounds is kept, numbered by :func:`exact_vocabulary`.
    Returns (transformed DataFrame, model); the model holds the vocabulary, as any
    vector model does (the long form is ``exact_vocabulary``)."""
    d = _kept_tokens(df, text, stop_words, "_tok_sw")
    vocabulary = exact_vocabulary(d, "_tok_sw", min_df, max_df).orderBy("idx").collect()
    model = _vector_model(vocabulary, "_tok_sw", out)
    return model.transform(d).drop("_tok_sw"), model


def tfidf_ngrams(df: DataFrame, text: str, n: int = 2, max_features: int = 20000,
                 stop_words: Sequence[str] | None = None, out: str = "tfidf"):
    """1..n-grams, stop words removed, the ``max_features`` most frequent
    terms (ties by term), smoothed idf ln((1 + rows) / (1 + df)) + 1 and
    L2-normalised rows.  Returns (transformed DataFrame, count model)."""
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors
    d = _kept_tokens(df, text, stop_words, "_g1")
    grams = [F.col("_g1")]
    for k in range(2, n + 1):
        starts = F.when(F.size("_g1") >= k, F.sequence(F.lit(1), F.size("_g1") - (k - 1))).otherwise(F.array().cast("array<int>"))
        grams.append(_grams("_g1", starts, k))
    d = d.withColumn("_grams", F.concat(*grams))
    vocabulary = exact_vocabulary(d, "_grams", max_features=max_features).orderBy("idx").collect()
    rows = df.count()
    cv = _vector_model(vocabulary, "_grams", "_tf")
    d = cv.transform(d)
    # scaling keeps the vector sparse
    scale = Vectors.dense([math.log((1 + rows) / (1 + r["df"])) + 1 for r in vocabulary] or [1.0])
    d = ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_idf1").transform(d)
    d = Normalizer(inputCol="_idf1", outputCol=out, p=2.0).transform(d)
    return d.drop("_g1", "_grams", "_tf", "_idf1"), cv


def vector_entries(vector: str) -> Column:
    """The non-zero entries ``array<struct<x, i>>`` of an ML vector, by index.

    Of a sparse vector only what it stores is read, so a row costs its own terms and
    not the whole vocabulary."""
    v = F.unwrap_udt(vector)
    # a dense vector has no indices
    places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    entries = F.zip_with(v["values"], places, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.filter(F.when(F.size(v["values"]) > 0, entries).otherwise(F.array().cast("array<struct<x:double,i:int>>")), lambda e: e["x"] != 0)


def _grams(words: str, starts, k: int):
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))


def lda_topics(df: DataFrame, counts: str = "counts", k: int = 5, seed: int = 42,
               max_iter: int = 20, prefix: str = "topic_"):
    """Topic distribution columns ``topic_1..k`` from a count-vector column."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array
    model = LDA(k=k, seed=seed, maxIter=max_iter, featuresCol=counts,
                topicDistributionCol="_td").fit(df)
    out = model.transform(df).withColumn("_td", vector_to_array("_td"))
    return out.select(*[c for c in df.columns],
                      *[F.col("_td")[i].alias(f"{prefix}{i + 1}") for i in range(k)]), model


# -- batched embedding ---------------------------------------------------------------

def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Default encoder: signed feature hashing of word tokens (stable crc32),
    L2-normalised.  Any callable ``list[str] -> (n, dim) array`` can be used."""
    import re as _re
    word = _re.compile(r"[^\W]{2,}", _re.UNICODE)

    def enc(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for r, t in enumerate(texts):
            for w in word.findall((t or "").lower()):
                h = zlib.crc32(w.encode("utf-8"))
                out[r, h % dim] += 1.0 if (h >> 31) & 1 == 0 else -1.0
            nrm = float(np.linalg.norm(out[r]))
            if nrm > 0:
                out[r] /= nrm
        return out
    return enc


def batch_embed(df: DataFrame, keys: Sequence[str], text: str,
                encoder: Callable[[list[str]], np.ndarray] | None = None, dim: int = 64,
                batch: int = 16, out: str = "embedding") -> DataFrame:
    """Apply ``encoder`` to the text in batches of ``batch`` rows inside each
    partition (``mapInPandas``; Arrow moves the rows, the encoder sees lists)."""
    keys = list(keys)
    enc = encoder or hashing_encoder(dim)
    src = df.select(*keys, text)
    schema = T.StructType([f for f in src.schema.fields if f.name in keys]
                          + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(it):
        for pdf in it:
            vecs = []
            texts = pdf[text].tolist()
            for i in range(0, len(texts), batch):
                vecs.extend(list(enc(texts[i:i + batch])))
            res = pdf[keys].copy()
            res[out] = [np.asarray(v, dtype=np.float32) for v in vecs]
            yield res
    return src.mapInPandas(run, schema)


def embed_resume(df: DataFrame, done: DataFrame | None, keys: Sequence[str], text: str,
                 path: str, encoder=None, dim: int = 64) -> DataFrame:
    """Embed only rows whose keys are not yet in ``done`` and append them to
    ``path`` (parquet); returns the complete table read back."""
    keys = list(keys)
    todo = df if done is None else df.join(done.select(*keys), keys, "left_anti")
    batch_embed(todo, keys, text, encoder, dim).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


__all__ = ["SYMPTOM_TERMS", "tfidf_vocab", "lexicon_sentiment", "truncate_tokens",
           "build_vocabulary", "tokenize_pad", "term_statistics", "exact_vocabulary", "count_vectorize", "tfidf_ngrams", "vector_entries",
           "lda_topics",
           "hashing_encoder", "batch_embed", "embed_resume", "pd"]
