"""Toxicity (operator 5): class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary labelled
documents, score every word of a text.  Two means over the words, which do not grow
with the text's length, go through a logistic calibration: the log-likelihood ratio
of the models over all words, and the part of it that has evidence.

* *Words.*  ``p(w) = (max(k(w) - D, 0) + D V s(w)) / K``: ``k(w)`` is the continuation
  count, the number of distinct words before ``w`` in the class, ``K`` the sum of all,
  ``V`` the number of words of the class and ``s(w)`` the *shared* backoff, the share
  of ``w`` in all words of all documents of the table, labelled or not.
* *Bigrams.*  ``p(w | u) = (max(n(u, w) - D, 0) + D t(u) p(w)) / n(u)``: ``n`` counts the
  documents of the class that hold the bigram, ``t(u)`` the distinct words after
  ``u``.  Both sum to one over the words of the table.
* *Likelihood.*  Every word has the ratio of its bigram in both models.  A bigram that
  the training rows do not hold backs off to its word, with the weights that the two
  models give their backoff after ``u``; a word that they do not hold, to the shares.
* *Evidence.*  An expression (a word, or a bigram) is evident when its documents of
  the toxic class are more than ``EVIDENCE`` standard deviations from what the pooled
  count leads to expect.  In the second mean a word has its bigram's ratio if that is
  evident, else its own if that is, else 0.  The mix of languages and topics that the
  labelled rows happen to have adds up in the first mean, not in this one; how much
  each counts is fitted.
* Labels are learnt only from rows with ``crc32(doc_id) mod 5 != 0``: remainders
  1 to 3 count expressions, remainder 4 fits the calibration.  Each of the two
  fits takes at most ``MAX_PER_CLASS`` rows of each class, those with the
  smallest hash of their id.  This bound applies to labelled rows alone; the
  shared counts read every document and scoring reads every whole text.
* Words are keyed by 64-bit hashes in Spark count tables, which are joined.  The
  expressions of the training rows with their ratios are broadcast, 12 bytes each;
  their number is bounded by the labelled sample, not by the table.

A word is a lower-cased (A-Z) run between white space and ASCII punctuation.
Only the text is scored: labels, lang, source and doc_id are no inputs.

Defined cases: null and empty texts, and texts without words, have ratios 0 and
the score of that.  Without calibration rows of both classes the score is the
logistic function of the likelihood ratio.  Labels that are null, or of rows without ``doc_id``, are not
learnt; of several labels of a document the largest counts.  If either class has
no training rows, all scores are 0.  Repeated rows get equal scores.  A null
``doc_id`` is scored and never held out.  Extra columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

FOLDS = 5
MAX_PER_CLASS = 8_000
DISCOUNT = 0.75
EVIDENCE = 4.0
VOCABULARY_CACHE = 400_000
CLASSES = (0, 1)

_START = np.int64(0)  # before the first word
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class WordHashes(dict):
    """64-bit hash of a word; forgets everything when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    ws = words(text)
    return np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws)).view(np.int64)


def previous(ws: np.ndarray) -> np.ndarray:
    return np.concatenate([[_START], ws[:-1]]) if len(ws) else ws


def bigram_hashes(prev: np.ndarray, ws: np.ndarray) -> np.ndarray:
    x = (prev.view(np.uint64) ^ (prev.view(np.uint64) >> np.uint64(31))) * _MIX + ws.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(labels: DataFrame, calibration: bool, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, toxic) of one of the two fits, at most ``max_per_class`` a class."""
    rows = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
            .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    f = fold(F.col("doc_id"))
    rows = rows.where(f == FOLDS - 1 if calibration else (f > 0) & (f < FOLDS - 1))
    parts = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
             for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def _labelled_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    # at most 2 * MAX_PER_CLASS rows of 12 bytes
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("toxic", "text")


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class by bigram ``(u, w)``, by word (``u`` null), and all
    (both null), summed per batch."""
    hashes = WordHashes()
    for batch in batches:
        found = []
        for toxic, text in zip(batch.column("toxic"), batch.column("text")):
            ws = word_hashes(text.as_py(), hashes)
            pairs = np.unique(np.stack([previous(ws), ws], 1), axis=0) if len(ws) else np.empty((0, 2), np.int64)
            found.append((toxic.as_py(), pairs, np.unique(ws)))
        if not found:
            continue
        pairs, words_, docs = [], [], [0, 0]
        for c in CLASSES:
            mine = [x for x in found if x[0] == c]
            docs[c] = len(mine)
            pairs += [(c, x[1]) for x in mine]
            words_ += [(c, x[2]) for x in mine]
        rows = np.concatenate([np.column_stack([x, np.full(len(x), c)]) for c, x in pairs])
        keys, at = np.unique(rows[:, :2], axis=0, return_inverse=True)
        n = [np.bincount(at.ravel()[rows[:, 2] == c], minlength=len(keys)) for c in CLASSES]
        single = np.concatenate([np.column_stack([x, np.full(len(x), c)]) for c, x in words_])
        ws, at = np.unique(single[:, 0], return_inverse=True)
        d = [np.bincount(at.ravel()[single[:, 1] == c], minlength=len(ws)) for c in CLASSES]
        u = pa.concat_arrays([pa.array(keys[:, 0], pa.int64()), pa.nulls(len(ws) + 1, pa.int64())])
        w = pa.concat_arrays([pa.array(keys[:, 1], pa.int64()), pa.array(ws, pa.int64()), pa.nulls(1, pa.int64())])
        counts = [pa.array(np.concatenate([n[c], d[c], [docs[c]]]).astype(np.int64)) for c in CLASSES]
        yield pa.RecordBatch.from_arrays([u, w, *counts], names=["u", "w", "n0", "n1"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        every = [word_hashes(t.as_py(), hashes) for t in batch.column("text")]
        ws, n = np.unique(np.concatenate(every) if every else np.empty(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ws, pa.int64()), pa.array(n, pa.int64())], names=["w", "n"])


def count_expressions(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, w, n0, n1) of the labelled rows: see ``_expressions``."""
    counts = _labelled_texts(docs, rows).mapInArrow(_expressions, "u bigint, w bigint, n0 bigint, n1 bigint")
    return stored(counts.groupBy("u", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-counts")


def word_models(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(w, p0, p1) of every word of the table: the classes' word probabilities."""
    shared = docs.select("text").mapInArrow(_shared, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    shared = stored(shared, "toxic-shared")
    after = counts.where("u is not null").groupBy("w").agg(*(F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in CLASSES))
    after = stored(after, "toxic-continuations")
    # eight numbers
    of = after.agg(*(f(f"k{c}").alias(f"{name}{c}") for c in CLASSES for name, f in (
        ("total", F.sum), ("types", lambda k: F.count_if(F.col(k) > 0)))))
    total = shared.agg(F.sum("n").alias("words"))
    sums = {**of.first().asDict(), **total.first().asDict()}

    def p(c: int) -> Column:
        k = F.coalesce(F.col(f"k{c}"), F.lit(0))
        share = F.col("n") / float(sums["words"] or 1)
        kinds, every = float(sums[f"types{c}"] or 0), float(sums[f"total{c}"] or 0)
        if not every:
            return share
        return (F.greatest(k - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * share) / every

    return shared.join(after, "w", "left").select("w", *(p(c).alias(f"p{c}") for c in CLASSES))


def _contexts(counts: DataFrame) -> DataFrame:
    """(u, m0, m1, t0, t1): what follows ``u`` in each class, counted and distinct."""
    return counts.where("u is not null").groupBy("u").agg(
        *(F.sum(f"n{c}").alias(f"m{c}") for c in CLASSES), *(F.count_if(F.col(f"n{c}") > 0).alias(f"t{c}") for c in CLASSES))


def bigram_models(counts: DataFrame, pairs: DataFrame, models: DataFrame) -> DataFrame:
    """(u, w, p0, p1) of the given pairs ``(u, w, n0, n1)``, and their other columns."""
    both = pairs.join(_contexts(counts), "u").join(models, "w")
    more = [c for c in pairs.columns if c not in ("u", "w", "n0", "n1")]

    def p(c: int) -> Column:
        n, m, t, back = (F.col(f"{x}{c}") for x in "nmtp")
        return F.when(m > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * t * back) / m).otherwise(back)

    return both.select("u", "w", *(p(c).alias(f"p{c}") for c in CLASSES), *more)


def context_models(counts: DataFrame) -> DataFrame:
    """(u, b0, b1): the weight of each class's backoff after ``u``, 1 where the class
    does not hold ``u``."""
    context = _contexts(counts)
    return context.select("u", *(F.when(F.col(f"m{c}") > 0, DISCOUNT * F.col(f"t{c}") / F.col(f"m{c}")).otherwise(1.0).alias(f"b{c}")
                                 for c in CLASSES))


def unseen_ratio(counts: DataFrame) -> float:
    """Log ratio of a word that no training row holds: its share cancels out."""
    word = F.col("u").isNull() & F.col("w").isNotNull()
    # four numbers
    of = counts.agg(*(F.count_if(word & (F.col(f"n{c}") > 0)).alias(f"types{c}") for c in CLASSES),
                    *(F.count_if(F.col("u").isNotNull() & (F.col(f"n{c}") > 0)).alias(f"total{c}") for c in CLASSES)).first()
    weight = [DISCOUNT * of[f"types{c}"] / of[f"total{c}"] if of[f"total{c}"] else 1.0 for c in CLASSES]
    return math.log(weight[1] / weight[0])


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


class Hashes:
    """Places of 64-bit hashes in a sorted table.  They spread evenly, so their first
    bits tell nearly where one is."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys.view(np.uint64))
        self.keys = keys[self.order]
        bits = max(1, len(keys).bit_length() - 2)
        self.shift = np.uint64(64 - bits)
        lowest = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.starts = np.append(np.searchsorted(self.keys.view(np.uint64), lowest), len(keys)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        first = (wanted.view(np.uint64) >> self.shift).astype(np.int64)
        at, end = self.starts[first], self.starts[first + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], wanted[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return out


class Model:
    """The log ratios of the training rows' expressions, by hash, and of their evident
    ones apart: words (w), bigrams (key, hash of both words) and the backoff's weights
    after a word (u)."""

    def __init__(self, singles: dict, pairs: dict, contexts: dict, unseen: float):
        w, u, ratio = singles["w"], contexts["u"], singles["ratio"]
        self.words = Hashes(np.union1d(w, u))
        # the last place is that of words that are not found (-1)
        n = len(self.words) + 1
        self.every, self.evident, self.back = np.full(n, unseen, np.float32), np.zeros(n), np.zeros(n, np.float32)
        at = self.words.find(w)
        self.every[at], self.evident[at] = ratio, np.where(singles["evident"], ratio, 0.0)
        self.back[self.words.find(u)] = contexts["ratio"]
        self.start = self.words.find(np.array([_START]))
        key, ratio, evident = pairs["key"], pairs["ratio"], pairs["evident"]
        self.evident_bigrams = Hashes(key[evident])
        self.evident_ratio = ratio[evident][self.evident_bigrams.order]
        self.bigrams = Hashes(key)
        self.bigram_ratio = ratio[self.bigrams.order].astype(np.float32)
        for table in (self.words, self.bigrams, self.evident_bigrams):
            del table.order

    def means(self, ws: np.ndarray) -> tuple[float, float]:
        """Means over the words of the log-likelihood ratio of toxic to ordinary, and of
        that of the evident expressions."""
        if not len(ws):
            return 0.0, 0.0
        at, pairs = self.words.find(ws), bigram_hashes(previous(ws), ws)
        every = self.every[at].astype(float) + self.back[np.concatenate([self.start, at[:-1]])]
        evident = self.evident[at]
        pair = self.bigrams.find(pairs)
        seen = np.flatnonzero(pair >= 0)
        every[seen] = self.bigram_ratio[pair[seen]]
        pair = self.evident_bigrams.find(pairs[seen])
        evident[seen[pair >= 0]] = self.evident_ratio[pair[pair >= 0]]
        return float(every.mean()), float(evident.mean())

    def likelihood(self, ws: np.ndarray) -> float:
        return self.means(ws)[0]

    def ratio(self, ws: np.ndarray) -> float:
        return self.means(ws)[1]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = bigram_hashes(b.column("u").to_numpy(), b.column("w").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column("ratio"), b.column("evident")], names=["key", "ratio", "evident"])


def fit_counts(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model | None:
    counts = count_expressions(docs, training_rows(labels, False, max_per_class))
    n = counts.where("w is null").first()
    if n is None or not (n["n0"] and n["n1"]):
        return None
    expected = (F.col("n0") + F.col("n1")) * (n["n1"] / (n["n0"] + n["n1"]))
    evident = (F.abs(F.col("n1") - expected) > EVIDENCE * F.sqrt(expected + 1)).alias("evident")
    # expressions of the bounded training rows
    singles = counts.where("u is null and w is not null").select("w", evident)
    models = stored(word_models(counts, docs).join(singles, "w"), "toxic-words")
    ratio = F.log(F.col("p1") / F.col("p0")).alias("ratio")
    singles = models.select("w", ratio, "evident")
    pairs = counts.where("u is not null").select("*", evident)
    pairs = bigram_models(counts, pairs, models.drop("evident")).select("u", "w", ratio, "evident")
    pairs = pairs.mapInArrow(_keyed, "key bigint, ratio double, evident boolean")
    contexts = context_models(counts).select("u", F.log(F.col("b1") / F.col("b0")).alias("ratio"))
    return Model(_columns(singles), _columns(pairs), _columns(contexts), unseen_ratio(counts))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and offset of a logistic regression on the columns of ``x`` with a small
    ridge (Newton)."""
    a, scale = np.zeros(x.shape[1] + 1), np.maximum(x.std(0), 1e-9)
    m = np.column_stack([x / scale, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -30, 30)))
        gradient = m.T @ (y - p) - 1e-3 * a
        hessian = (m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(len(a))
        step = np.linalg.solve(hessian, gradient)
        a = a + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple((a[:-1] / scale).tolist()), float(a[-1])


def _means(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [model.value.means(word_hashes(t.as_py(), hashes)) for t in b.column("text")]
            columns = [pa.array([x[j] for x in found], pa.float64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[b.schema.names[0], "likelihood", "ratio"])
    return run


class Calibrated(NamedTuple):
    """The broadcast model and the calibration's numbers."""

    model: Broadcast
    slopes: tuple[float, float] = (1.0, 0.0)
    offset: float = 0.0

    def score(self, ws: np.ndarray) -> float:
        z = sum(a * x for a, x in zip(self.slopes, self.model.value.means(ws))) + self.offset
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Calibrated | None:
    """The model, or nothing if a class has no training rows."""
    model = fit_counts(docs, labels, max_per_class)
    if model is None:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(model)
    texts = _labelled_texts(docs, training_rows(labels, True, max_per_class))
    rows = texts.mapInArrow(_means(sent), "toxic int, likelihood double, ratio double").toArrow()
    x = np.column_stack([rows.column(c).to_numpy() for c in ("likelihood", "ratio")])
    y = rows.column("toxic").to_numpy().astype(float)
    if len(x) and 0 < y.sum() < len(y):
        return Calibrated(sent, *calibrate(x, y))
    return Calibrated(sent)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    d = docs.select("doc_id", "text")
    model = fit(d, labels, max_per_class)
    if model is None:
        scored = d.select("doc_id", F.lit(0.0).alias("score"))
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                s = [model.score(word_hashes(t.as_py(), hashes)) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])
        scored = d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
