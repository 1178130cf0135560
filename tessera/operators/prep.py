"""ML preparation: assembling, scaling, projections, clusters, weights and
oversampling.

Scaling statistics are one distributed aggregate, attached to every row as a
scalar subquery (no join).  Oversampling draws rows by a seeded hash over an
exact per-class position (skew-proof ordered scan), so results do not depend
on partitioning and a dominant class is never ranked in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ordered_scan
from ..session import broadcast_if_small

MOMENT_ROWS = 16  # partial covariances that reach the driver


def assemble_features(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def scaler_stats(train: DataFrame, cols: Sequence[str]):
    """Struct column (scalar subquery) with population mean and std per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    st = train.agg(*aggs)
    return st.select(F.struct(*st.columns)).scalar()


def standardize(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
                suffix: str = "") -> tuple[DataFrame, list[DataFrame]]:
    """z = (x - mean) / std with train statistics (population std; a constant
    column is scaled by 1), applied to train and every other frame."""
    st = scaler_stats(train, cols)

    def apply(df: DataFrame) -> DataFrame:
        exprs = {}
        for c in cols:
            sd = F.when((st[f"s_{c}"].isNull()) | (st[f"s_{c}"] == 0), F.lit(1.0)).otherwise(
                st[f"s_{c}"])
            exprs[f"{c}{suffix}"] = (F.col(c).cast("double") - st[f"m_{c}"]) / sd
        return df.withColumns(exprs)
    return apply(train), [apply(o) for o in others]


def standardize_sequence(train: DataFrame, others: Sequence[DataFrame], seq: str = "seq"):
    """Feature-wise scaling of a (T x F) visit tensor column, fitted over all
    N x T visit vectors of the training rows."""
    visits = train.select(F.explode(seq).alias("_v"))
    n_feat = train.select(F.size(F.element_at(seq, 1))).first()[0]
    aggs = []
    for j in range(n_feat):
        x = F.element_at("_v", j + 1).cast("double")
        aggs += [F.avg(x).alias(f"m{j}"), F.stddev_pop(x).alias(f"s{j}")]
    st = visits.agg(*aggs)
    stc = st.select(F.struct(*st.columns)).scalar()
    means = F.array(*[stc[f"m{j}"] for j in range(n_feat)])
    sds = F.array(*[F.when((stc[f"s{j}"].isNull()) | (stc[f"s{j}"] == 0), F.lit(1.0))
                    .otherwise(stc[f"s{j}"]) for j in range(n_feat)])

    def apply(df: DataFrame) -> DataFrame:
        # statistics become plain columns first: subqueries may not sit inside lambdas
        d = df.withColumns({"_means": means, "_sds": sds})
        return d.withColumn(seq, F.transform(seq, lambda v: F.zip_with(
            F.zip_with(v, F.col("_means"), lambda a, m: a.cast("double") - m), F.col("_sds"),
            lambda a, s: a / s))).drop("_means", "_sds")
    return apply(train), [apply(o) for o in others]


def _moments(df: DataFrame, array: str, dim: int):
    """Count, mean and centred outer-product sum of an array column in one pass.

    Every task merges its batches to one row of ``dim * dim + dim + 1`` numbers, a
    second step merges these to at most ``MOMENT_ROWS`` rows; rows with nulls, NaNs
    or another length are left out."""
    def merged(parts):
        n, mean, outer = 0, np.zeros(dim), np.zeros((dim, dim))
        for k, m, o in parts:
            if k:
                delta, total = m - mean, n + k
                outer += o + np.outer(delta, delta) * (n * k / total)
                mean = mean + delta * (k / total)
                n = total
        return n, mean, outer

    def row(part):
        n, mean, outer = part
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()]), pa.array([outer.tobytes()])],
                                          names=["n", "mean", "outer"])

    def batches(it):
        for b in it:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if len(x):
                m = x.mean(0)
                yield len(x), m, (x - m).T @ (x - m)

    def parts(it):
        for b in it:
            for n, m, o in zip(*(c.to_pylist() for c in b.columns)):
                yield n, np.frombuffer(m), np.frombuffer(o).reshape(dim, dim)

    schema = "n bigint, mean binary, outer binary"
    complete = (F.size(array) == dim) & ~F.exists(array, lambda x: x.isNull() | F.isnan(x))
    first = df.where(complete).select(array).mapInArrow(lambda it: iter([row(merged(batches(it)))]), schema)
    second = first.repartition(MOMENT_ROWS).mapInArrow(lambda it: iter([row(merged(parts(it)))]), schema)
    return merged((r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["outer"]).reshape(dim, dim)) for r in second.collect())


def pca_2(df: DataFrame, vec: str, k: int = 2, prefix: str = "pca_") -> DataFrame:
    """First ``k`` principal components of the centred vectors (an ML vector or
    an array of doubles); each component's sign is fixed so that its largest
    loading is positive.

    The covariance is taken in one mergeable pass, its eigenvectors on the driver
    (``dim`` squared numbers), and rows are projected by expressions.  Rows without a
    complete vector get null components."""
    from pyspark.ml.functions import vector_to_array
    is_array = dict(df.dtypes)[vec].startswith("array")
    d = df.withColumn("_pca_x", F.transform(vec, lambda x: x.cast("double")) if is_array else vector_to_array(vec))
    dim = d.agg(F.max(F.size("_pca_x"))).first()[0] or 0
    empty = [F.lit(None).cast("double").alias(f"{prefix}{j + 1}") for j in range(k)]
    if dim < 1:
        return df.select(*df.columns, *empty)
    n, mean, outer = _moments(d, "_pca_x", dim)
    if not n:
        return df.select(*df.columns, *empty)
    _, vectors = np.linalg.eigh(outer / max(1, n - 1))
    complete = (F.size("_pca_x") == dim) & ~F.exists("_pca_x", lambda x: x.isNull() | F.isnan(x))
    out = []
    for j in range(k):
        w = vectors[:, -1 - j] if j < dim else np.zeros(dim)
        w = w if w[np.abs(w).argmax()] >= 0 else -w
        terms = F.zip_with("_pca_x", F.array(*map(F.lit, w.tolist())), lambda x, a: x * a)
        score = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) - float(mean @ w)
        out.append(F.when(complete, score).alias(f"{prefix}{j + 1}"))
    return d.select(*df.columns, *out)


def kmeans_5(df: DataFrame, vec: str, k: int = 5, seed: int = 42, out: str = "cluster"):
    from pyspark.ml.clustering import KMeans
    model = KMeans(k=k, seed=seed, featuresCol=vec, predictionCol=out).fit(df)
    return model.transform(df), model


def class_weights(df: DataFrame, label: str, form: str = "balanced",
                  out: str = "weight") -> DataFrame:
    """Per-row class weight:
    ``balanced`` n / (k * n_c); ``inverse`` (1/n_c) normalised to sum 1 over
    classes; ``pos_weight`` n_neg / n_pos on the positive class (binary)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k"),
                     F.sum(1.0 / F.col("_nc")).alias("inv"))
    st = tot.select(F.struct("n", "k", "inv")).scalar()
    if form == "balanced":
        w = st["n"] / (st["k"] * F.col("_nc"))
    elif form == "inverse":
        w = (1.0 / F.col("_nc")) / st["inv"]
    elif form == "pos_weight":
        w = F.when(F.col(label) == 1, (st["n"] - F.col("_nc")) / F.col("_nc")).otherwise(F.lit(1.0))
    else:
        raise ValueError(form)
    weights = counts.select(label, w.cast("double").alias(out))
    return df.join(broadcast_if_small(weights), label, "left")


def oversample_random(train: DataFrame, id_col: str, label: str, target: int | None = None,
                      seed: int = 42) -> DataFrame:
    """Grow every class below ``target`` (default: the largest class) with
    seeded draws, with replacement, of its own rows; originals are kept, rows
    without a label too (they are never drawn).
    Adds ``_copy`` (0 for originals, 1.. for drawn copies)."""
    ranked = ordered_scan(train.where(F.col(label).isNotNull()), [id_col], by=[label])
    counted = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_nc")).collect()
    goal = target if target is not None else max((r["_nc"] for r in counted), default=0)
    # one row per class; the draws of all classes are numbered along one range,
    # and a draw finds its class by the class's stretch of it
    spark, at, stretches = train.sparkSession, 0, []
    for r in sorted(counted, key=lambda r: str(r[label])):
        need = max(0, goal - r["_nc"])
        stretches.append((at, at + need, r["_nc"], r[label]))
        at += need
    kind = dict(train.dtypes)[label]
    which, size, first = F.lit(None).cast(kind), F.lit(1), F.lit(0)
    for lo, hi, n, value in stretches:
        inside = (F.col("id") >= lo) & (F.col("id") < hi)
        which = F.when(inside, F.lit(value).cast(kind)).otherwise(which)
        size = F.when(inside, F.lit(n)).otherwise(size)
        first = F.when(inside, F.lit(lo)).otherwise(first)
    draws = spark.range(at).select(which.alias(label), size.alias("_nc"),
                                   (F.col("id") - first + 1).cast("int").alias("_copy"))
    pick = oversample_pick(F.lit(seed), F.col(label), F.col("_copy"), F.col("_nc")).alias("_rn")
    # a row can be drawn several times; the drawn rows are joined by class and position
    copies = draws.select(label, "_copy", pick).join(ranked, [label, "_rn"], "inner").drop("_rn")
    originals = ranked.drop("_rn").withColumn("_copy", F.lit(0))
    rest = train.where(F.col(label).isNull()).withColumn("_copy", F.lit(0))
    return originals.unionByName(copies.select(*originals.columns)).unionByName(rest.select(*originals.columns))


def oversample_pick(seed, label, copy, n):
    """1-based position drawn for a class's copy: an md5 key, so that any SQL
    engine can repeat the draw."""
    text = F.concat_ws(":", seed.cast("string"), label.cast("string"), copy.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), n) + 1
