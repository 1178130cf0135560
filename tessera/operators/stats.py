"""Paired significance tests over the long metric table.

``wilcoxon_signed_rank`` reproduces the two-sided Wilcoxon signed-rank test
(zeros dropped): statistic ``min(W+, W-)`` with average ranks of ``|d|``; the
exact p-value comes from the null distribution of ``W+`` built by a dynamic
programme over an array inside one SQL expression (``aggregate`` over
``sequence(1, n)``), used when ``n <= 50`` and there are no zeros or ties;
otherwise the normal approximation with tie correction is used.

The number of rows per test is the number of paired runs (benchmark
repetitions), and the number of tests is the number of model pairs, so the
windows below are per pair and the Holm step runs over the (small) list of
tests.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_pairwise_models

EXACT_MAX_N = 50


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal, ``0.5 * erfc(z / sqrt 2)`` for
    ``z >= 0`` (Chebyshev fit, relative error below 1.2e-7)."""
    x = z / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    coeffs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        poly = F.lit(c) + t * poly
    return F.lit(0.5) * t * F.exp(-x * x + poly)


def exact_wilcoxon_cdf(n: Column, w: Column) -> Column:
    """P(W+ <= w) for n untied, non-zero differences under H0."""
    size = n * (n + 1) / 2 + 1
    init = F.transform(F.sequence(F.lit(0), size.cast("int") - 1),
                       lambda k: F.when(k == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), init,
        lambda acc, i: F.transform(
            acc, lambda x, k: x + F.when(k >= i, acc[k - i]).otherwise(F.lit(0.0))))
    below = F.aggregate(F.slice(counts, 1, F.floor(w).cast("int") + 1), F.lit(0.0),
                        lambda a, x: a + x)
    return below / F.pow(F.lit(2.0), n.cast("double"))


def wilcoxon_from_pairs(pairs: DataFrame, min_pairs: int = 5,
                        keys: Sequence[str] = ("model_1", "model_2")) -> DataFrame:
    """Test per key from (keys, value_1, value_2) rows."""
    keys = list(keys)
    d = pairs.select(*keys, (F.col("value_1") - F.col("value_2")).alias("d"))
    n_all = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    nz = d.where(F.col("d") != 0).withColumn("ad", F.abs("d"))
    w_rank = Window.partitionBy(*keys).orderBy("ad")
    w_tie = Window.partitionBy(*keys, "ad")
    ranked = (nz.withColumn("_r", F.rank().over(w_rank).cast("double"))
              .withColumn("_t", F.count(F.lit(1)).over(w_tie))
              .withColumn("rank", F.col("_r") + (F.col("_t") - 1) / 2.0))
    per = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.max("_t").alias("max_tie"),
        # each member of a tie group of size t adds t^2 - 1, i.e. t^3 - t per group
        F.sum(F.pow(F.col("_t"), 2) - 1).alias("_tt"))
    out = n_all.where(F.col("n_pairs") >= min_pairs).join(per, keys, "left").fillna(
        {"n": 0, "w_plus": 0.0, "w_minus": 0.0, "max_tie": 1, "_tt": 0.0})
    n = F.col("n")
    stat = F.least("w_plus", "w_minus")
    exact_ok = (n <= EXACT_MAX_N) & (n == F.col("n_pairs")) & (F.col("max_tie") <= 1) & (n > 0)
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tt") / 48.0
    z = F.abs(stat - n * (n + 1) / 4.0) / F.sqrt(var)
    p_norm = F.least(F.lit(1.0), 2 * normal_sf(z))
    p_exact = F.least(F.lit(1.0), 2 * exact_wilcoxon_cdf(n, stat))
    p = F.when(n == 0, F.lit(1.0)).when(exact_ok, p_exact).otherwise(p_norm)
    return out.select(*keys, F.col("n_pairs").cast("long").alias("n_pairs"),
                      stat.alias("statistic"), p.alias("p_value"))


def wilcoxon_unadjusted(df: DataFrame, run: str, model: str, value: str, min_pairs: int = 5,
                        models: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    pairs = join_pairwise_models(df, run, model, value, models)
    res = wilcoxon_from_pairs(pairs, min_pairs)
    return res.withColumn("significant", F.col("p_value") < alpha)


def holm_adjust(df: DataFrame, p: str = "p_value", alpha: float = 0.05,
                order: Sequence[str] = ("model_1", "model_2"), by: Sequence[str] = ()) -> DataFrame:
    """Holm step-down: ``p_adj_i = min(1, max_{j<=i} (m - j + 1) p_(j))``;
    ``significant_adj = p_adj <= alpha`` (before the cap)."""
    base = Window.partitionBy(*by) if by else Window.partitionBy()
    w = base.orderBy(F.col(p), *[F.col(o) for o in order])
    m = F.count(F.lit(1)).over(base)
    step = (m - F.row_number().over(w) + 1) * F.col(p)
    out = df.withColumn("_step", step)
    out = out.withColumn("_adj", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (out.withColumn("p_value_adj", F.least(F.lit(1.0), F.col("_adj")))
            .withColumn("significant_adj", F.col("_adj") <= alpha)
            .drop("_step", "_adj"))


def wilcoxon_signed_rank(df: DataFrame, run: str, model: str, value: str, min_pairs: int = 5,
                         models: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Pairwise tests with Holm correction; one row per model pair."""
    res = wilcoxon_unadjusted(df, run, model, value, min_pairs, models, alpha)
    return holm_adjust(res, "p_value", alpha)


def p_value_matrix(df: DataFrame, a: str = "model_1", b: str = "model_2",
                   p: str = "p_value_adj") -> DataFrame:
    """Symmetric long matrix over all models; diagonal and untested pairs -> 1."""
    models = df.select(F.col(a).alias("m")).union(df.select(F.col(b).alias("m")))
    ms = models.agg(F.array_sort(F.collect_set("m")).alias("ms"))  # the model catalogue
    grid = (ms.select(F.explode("ms").alias("row_model"), "ms")
            .select("row_model", F.explode("ms").alias("col_model")))
    both = (df.select(F.col(a).alias("row_model"), F.col(b).alias("col_model"), F.col(p).alias("_p"))
            .union(df.select(F.col(b).alias("row_model"), F.col(a).alias("col_model"),
                             F.col(p).alias("_p"))))
    return grid.join(both, ["row_model", "col_model"], "left").select(
        "row_model", "col_model",
        F.when(F.col("row_model") == F.col("col_model"), F.lit(1.0))
         .otherwise(F.coalesce("_p", F.lit(1.0))).alias("p"))
