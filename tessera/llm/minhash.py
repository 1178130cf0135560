"""MinHash near-dedup (operator 3): circulant MinHash, banding, exact Jaccard.

A document is the set of its distinct five-word shingles (words are runs of
non-white-space, A-Z lower-cased; a shorter document is one shingle).

1. *Sketch.*  A first permutation (a hash to ``2**20`` places) spreads the
   shingles over a circle; the second, one fixed random permutation table, is
   read at places shifted by ``0 .. COORDS - 1``.  The minimum over the set at
   each shift is a coordinate, so two permutations give the whole signature.
2. *Banding.*  ``BANDS`` bands of ``ROWS`` coordinates; documents sharing a band
   are candidates.  At Jaccard 0.75 a pair is missed with probability
   ``(1 - 0.75**4)**32 = 5e-6``.
3. *Verification.*  Candidates are linked when ``100 * |A & B| >= 75 * |A | B|``
   on the full shingle sets; components come from ``components.link_components``,
   which loses no link of a bucket and lists no bucket's pairs.

Texts with the same word sequence are one vertex (a 128-bit digest), so copies
cost one row each and never become pairs.  Shingles are compared by 64-bit
hashes.

Defined cases: null, empty or blank texts have the empty set, are linked with
nothing and kept.  A null ``doc_id`` takes part by its text; the component's id
is the smallest non-null id (null if there is none).  Rows repeated under one
``doc_id`` are one document and share its verdict.  Extra columns are ignored
(stage function: kept).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import link_components
from .stored import stored

WIDTH = 5
SIMILARITY = 75
CIRCLE = 1 << 20
COORDS = 128
ROWS = 4
BANDS = COORDS // ROWS
SEED = 20_011
VOCABULARY_CACHE = 400_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hash of a word; forgets everything when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of non-white-space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return x ^ (x >> np.uint64(29))


def shingles(ws: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a word sequence."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    width = min(WIDTH, len(ws))
    acc = np.full(len(ws) - width + 1, np.uint64(len(ws) if len(ws) < WIDTH else WIDTH))
    for k in range(width):
        acc = acc * _M2 + h[k:k + len(acc)]
        acc ^= acc >> np.uint64(32)
    return np.unique(_mix(acc))


def permutation() -> np.ndarray:
    """The second permutation, with its head repeated at the end so that every
    shifted read is one contiguous slice."""
    p = np.random.default_rng(SEED).permutation(CIRCLE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[:COORDS]]), COORDS)


def signature(shingle_hashes: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """The ``COORDS`` circulant minima of a non-empty set."""
    places = (shingle_hashes >> np.uint64(44)).astype(np.int64)
    best = None
    for at in range(0, len(places), 8192):
        low = shifted[places[at:at + 8192]].min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = _mix(acc * _M2 + rows[:, k])
    return acc.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, shifted = WordHashes(), permutation()
    for batch in batches:
        keys, sizes, bands = [], [], []
        for text in batch.column("text"):
            ws = words(text.as_py())
            s = shingles(ws, hashes)
            keys.append(xxhash.xxh3_128_digest(b" ".join(ws)))
            sizes.append(len(s))
            bands.append(band_keys(signature(s, shifted)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        keys, sets = [], []
        for text in batch.column("text"):
            ws = words(text.as_py())
            keys.append(xxhash.xxh3_128_digest(b" ".join(ws)))
            sets.append(shingles(ws, hashes).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                                         names=["key", "shingles"])


def sketch(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, digest of the word sequence, set size, band keys (null: empty set)."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _sketch, f"doc_id {kind}, key binary, n_shingles bigint, bands array<bigint>")


def prefix_pairs(vertices: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Pairs ``(a, b)`` of vertices ``(v, c, shingles)`` with different ``c``, among them
    all that reach the similarity.

    Shingles are ordered by how many of the vertices hold them, rarest first.  Sets
    ``x``, ``y`` with ``|x| <= |y|`` that are similar share one of the first ``|x| (100 -
    s) / (100 + s) + 1`` of ``x`` and ``|y| (100 - s) / 100 + 1`` of ``y``; and from the
    first shingle they share on, enough must be left of both.  A shingle of one
    vertex alone only takes its place in the order."""
    s = similarity
    each = vertices.select("v", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    held = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    mine = Window.partitionBy("v")
    each = each.join(held, "s").withColumns({
        "k": F.count("*").over(mine), "r": F.row_number().over(mine.orderBy("df", "s"))})
    each = each.withColumn("p", F.col("n") - F.col("k") + F.col("r")).where(100 * (F.col("p") - 1) <= (100 - s) * F.col("n"))
    each = stored(each.select("s", "v", "c", "n", "p"), "minhash")
    x = each.where((100 + s) * (F.col("p") - 1) <= (100 - s) * F.col("n")).select("s", *(F.col(c).alias("x" + c) for c in "vcnp"))
    y = each.select("s", *(F.col(c).alias("y" + c) for c in "vcnp"))
    shorter = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xv") < F.col("yv")))
    left = 1 + F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp"))
    enough = (100 + s) * left >= s * (F.col("xn") + F.col("yn"))
    met = x.join(y, (x["s"] == y["s"]) & shorter & (100 * F.col("xn") >= s * F.col("yn")) & enough & (F.col("xc") != F.col("yc")))
    return met.select(F.least("xv", "yv").alias("a"), F.greatest("xv", "yv").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (see the module text)."""
    rows = stored(sketch(docs), "minhash")
    classes = rows.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"),
        F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    classes = stored(classes, "minhash")
    members = classes.select(F.explode("bands").alias("bucket"), F.col("key").alias("v"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    members = stored(members.join(shared, "bucket"), "minhash")
    candidates = members.select(F.col("v").alias("key")).distinct().join(classes.select("key", "id"), "key")
    # texts are fetched once, by id, and only for candidates; the digest tells
    # rows apart that share an id
    wanted = candidates.select(F.col("id").alias("doc_id")).distinct().alias("w")
    texts = docs.select("doc_id", "text").alias("d").join(
        wanted, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "key binary, shingles array<bigint>")
    sets = stored(sets.join(candidates.select("key"), "key", "left_semi").dropDuplicates(["key"]), "minhash")

    def verify(pairs: DataFrame) -> DataFrame:
        p = (pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
             .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
             .withColumns({"na": F.size("sa"), "nb": F.size("sb")})
             .where(100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")))
        p = p.withColumn("both", F.size(F.array_intersect("sa", "sb")))
        return p.where(100 * F.col("both") >= SIMILARITY * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")

    def finish(open_: DataFrame) -> DataFrame:
        return prefix_pairs(sets.select(F.col("key").alias("v"), "shingles").join(open_.select("v", "c").distinct(), "v"))

    linked = link_components(members, verify, finish)
    grouped = classes.join(linked.select(F.col("v").alias("key"), "c"), "key", "left")
    ids = (grouped.where("c is not null").groupBy("c").agg(F.min("id").alias("component_id")))
    named = (grouped.where("c is not null or copies > 1").join(ids, "c", "left")
             .select("key", F.coalesce("component_id", "id").alias("component_id")))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key"))
    out = out.join(named, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the input's columns unchanged."""
    gone = near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
