"""Ordered per-entity procedures: sequences, last-N, padding, splits, folds.

Two patterns keep hot entities/classes from landing in one task:

* bounded top-N (``row_number() <= n``) -- Spark adds a partial
  ``WindowGroupLimit`` below the shuffle, so each map task sends at most ``n``
  rows per group;
* exact ranks over huge groups (a class label holds a third of all rows) use
  :func:`tessera.plans.ordered.ordered_scan`, which range-partitions the group
  over many tasks instead of one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sequence_to_json
from ..functions.text import WS_CLASS
from ..plans.ordered import ordered_scan
from ..session import broadcast_if_small
from .aggs import ordered_list


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# -- sequences ---------------------------------------------------------------

def event_sequence(df: DataFrame, keys, ts: str, value: str, tiebreak: str | None = None,
                   out: str = "sequence", as_json: bool = False) -> DataFrame:
    """(value, ts) pairs per entity in time order; ``as_json`` renders the
    ``[["MICU", "2101-10-20 19:10:11"], ...]`` text form."""
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    item = F.struct(F.col(value).alias("value"), F.col(ts).alias("ts"))
    seq = df.groupBy(*_k(keys)).agg(ordered_list(item, order).alias(out))
    if as_json:
        seq = seq.withColumn(out, sequence_to_json(F.col(out)))
    return seq


def nested_note_sequences(df: DataFrame, subject: str, admission: str, ts: str, text: str,
                          tiebreak: str | None = None, out: str = "notes") -> DataFrame:
    """subject -> admissions (ascending id) -> notes (time order)."""
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    per_adm = df.groupBy(subject, admission).agg(ordered_list(F.col(text), order).alias("_n"))
    return per_adm.groupBy(subject).agg(
        ordered_list(F.col("_n"), [F.col(admission)]).alias(out))


def merge_short_notes(df: DataFrame, keys, ts: str, text: str, tiebreak: str,
                      min_len: int = 40) -> DataFrame:
    """Buffer notes shorter than ``min_len``; emit the buffer as one note
    (space-joined, stripped) before the next long note, or at the end.

    Long form output: keys, ``note_order`` (increasing within the group),
    ``text``.  The running count of long notes comes from the skew-proof
    ordered scan, so a patient with millions of notes is still split.
    """
    keys = _k(keys)
    order = list(dict.fromkeys([ts, tiebreak]))
    src = df.select(*dict.fromkeys([*keys, *order, text]),
                    (F.length(text) >= min_len).cast("double").alias("_long"))
    scanned = ordered_scan(src, order, by=keys, sums=["_long"])
    g = (F.col("_cum__long") - F.col("_long")).cast("long")  # long notes before this one
    tagged = scanned.select(*keys, text, (F.col("_long") > 0).alias("_is_long"), g.alias("_g"),
                            "_rn")
    longs = tagged.where("_is_long").select(*keys, (F.col("_g") * 2 + 1).alias("note_order"),
                                            F.col(text).alias("text"))
    shorts = (tagged.where(~F.col("_is_long")).groupBy(*keys, "_g")
              .agg(F.array_join(ordered_list(F.col(text), [F.col("_rn")]), " ").alias("_t")))
    shorts = shorts.select(*keys, (F.col("_g") * 2).alias("note_order"),
                           F.regexp_replace("_t", f"^{WS_CLASS}+|{WS_CLASS}+$", "").alias("text"))
    return longs.unionByName(shorts)


# -- last N / padding ------------------------------------------------------------

def last_n_visits(df: DataFrame, subject: str, ts: str, n: int = 10,
                  tiebreak: str | None = None) -> DataFrame:
    """The last ``n`` rows per subject by time (``visit_rank`` 1 = latest)."""
    order = [F.col(ts).desc_nulls_last()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(subject).orderBy(*order)
    return df.withColumn("visit_rank", F.row_number().over(w)).where(F.col("visit_rank") <= n)


def pad_sequence_mask(df: DataFrame, subject: str, ts: str, features: Sequence[str],
                      label: str, n: int = 10, tiebreak: str | None = None) -> DataFrame:
    """Left-pad the last ``n`` visits with zero vectors; mask 0 for padding;
    label of the latest visit.  Per subject at most ``n`` rows are collected."""
    last = last_n_visits(df, subject, ts, n, tiebreak)
    vec = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    visits = last.select(subject, "visit_rank", vec.alias("_v"), F.col(label).alias("_y"))
    agg = visits.groupBy(subject).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("visit_rank")).alias("o"),
                                                          "_v"))), lambda e: e["_v"]).alias("_seq"),
        F.min_by("_y", "visit_rank").alias(label))
    k = F.size("_seq")
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(features)), F.lit(n) - k)
    return agg.select(
        subject,
        F.concat(zeros, F.col("_seq")).alias("seq"),
        F.concat(F.array_repeat(F.lit(0), F.lit(n) - k), F.array_repeat(F.lit(1), k)).alias("mask"),
        label)


def tail_n_per_group(df: DataFrame, keys, order: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows per group by ``order`` (bounded top-N)."""
    w = Window.partitionBy(*_k(keys)).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dedup_first(df: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` -- an aggregate (``min_by``) so duplicates
    of a hot key are combined map-side."""
    keys = _k(keys)
    rest = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(o) for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordk).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# -- splits and folds --------------------------------------------------------------

def split_hash(id_col, seed: int = 42) -> Column:
    """Seeded order key of an id: the md5 of ``seed:id``, so keys of different
    seeds are independent and any SQL engine can compute them."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _ranked(df: DataFrame, id_col: str, label: str | None, seed: int) -> DataFrame:
    src = df.select(id_col, *([label] if label else []), split_hash(id_col, seed).alias("_h"))
    return ordered_scan(src, ["_h", id_col], by=[label] if label else [])


def stratified_split(df: DataFrame, id_col: str, label: str, frac: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Per class, the ``round(frac * n_class)`` rows with the smallest seeded
    hash go to validation.  Output: id, label, ``is_val``.  Rows with a null label
    form a class of their own, so every input row is returned."""
    ranked = _ranked(df, id_col, label, seed).alias("r")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    out = ranked.join(broadcast_if_small(sizes).alias("s"),
                      F.col(f"r.{label}").eqNullSafe(F.col(f"s.{label}")), "left")
    return out.select(f"r.{id_col}", f"r.{label}",
                      (F.col("_rn") <= F.round(F.col("_n") * F.lit(frac))).alias("is_val"))


def split_fallback(df: DataFrame, id_col: str, label: str, frac: float = 0.2,
                   seed: int = 42) -> DataFrame:
    """Stratified when every class has two or more rows, else one global rank."""
    min_class = df.groupBy(label).count().agg(F.min("count")).collect()[0][0]
    if min_class is not None and min_class >= 2:
        return stratified_split(df, id_col, label, frac, seed)
    src = df.select(id_col, label, split_hash(id_col, seed).alias("_h"))
    n = df.agg(F.count(F.lit(1))).scalar()
    return ordered_scan(src, ["_h", id_col]).select(
        id_col, label, (F.col("_rn") <= F.round(n * F.lit(frac))).alias("is_val"))


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5,
                     seed: int = 42) -> DataFrame:
    """Fold = (position in the class by seeded hash - 1) mod k."""
    ranked = _ranked(df, id_col, label, seed)
    return ranked.select(id_col, label, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int").alias("fold"))


# -- ordering / top-k --------------------------------------------------------------

def top_k_features(df: DataFrame, score: str, k: int = 20, name: str | None = None) -> DataFrame:
    """The ``k`` largest scores (a top-k report; Spark keeps k per partition)."""
    order = [F.col(score).desc()] + ([F.col(name)] if name else [])
    return df.orderBy(*order).limit(k)


def sort_by_metric(df: DataFrame, c: str, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.col(c).asc() if ascending else F.col(c).desc())


def head_n(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def next_run_number(df: DataFrame, col: str, out: str = "next_run") -> DataFrame:
    from ..functions.codes import extract_run_number
    return df.agg((F.coalesce(F.max(extract_run_number(F.col(col))), F.lit(0)) + 1).alias(out))
