"""Classification metrics as aggregations over a prediction table.

Every metric is one distributed aggregate whose output size depends on the
number of classes (or distinct scores), never on the number of predictions:
per-class precision/recall/F1 come from the ``y x pred`` count table, ROC and
AUC from counts per distinct score plus a skew-proof running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ordered_scan
from ..session import cut_lineage


def _domain(spark, classes: Sequence[int], name: str):
    return spark.createDataFrame([(int(c),) for c in classes], f"{name} int")


def confusion_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).cast("int").alias("y_true"),
                      F.col(pred).cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def metric_per_class(df: DataFrame, y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """precision, recall, F1 and support per class; zero division -> 0."""
    cc = confusion_counts(df, y, pred)
    per = cc.select(
        F.explode(F.array(
            F.struct(F.col("y_true").alias("class"), F.col("n").alias("n"),
                     F.lit("true").alias("side"), (F.col("y_true") == F.col("y_pred")).alias("hit")),
            F.struct(F.col("y_pred").alias("class"), F.col("n").alias("n"),
                     F.lit("pred").alias("side"), (F.col("y_true") == F.col("y_pred")).alias("hit")),
        )).alias("e")).select("e.*")
    stats = per.groupBy("class").agg(
        F.sum(F.when((F.col("side") == "true") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "true", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "pred", F.col("n")).otherwise(0)).alias("predicted"))
    out = _domain(df.sparkSession, classes, "class").join(stats, "class", "left").fillna(
        0, ["tp", "support", "predicted"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = out.select("class", p.alias("precision"), r.alias("recall"),
                     F.col("support").cast("long").alias("support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return out.withColumn("f1", f1)


def metric_accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def metric_macro_f1(df: DataFrame, y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    m = metric_per_class(df, y, pred, classes)
    return m.agg(F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"),
                 F.avg("recall").alias("macro_recall"))


def confusion_matrix(df: DataFrame, y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Long form (y_true, y_pred, n) over all class pairs, zeros kept."""
    spark = df.sparkSession
    pairs = spark.createDataFrame([(int(a), int(b)) for a in classes for b in classes],
                                  "y_true int, y_pred int")
    cc = confusion_counts(df, y, pred)
    return pairs.join(cc, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _score_counts(df: DataFrame, y: str, score, positive) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("score") if isinstance(score, str)
                      else score.alias("score")).agg(
        F.count_if(positive).cast("double").alias("pos"),
        F.count_if(~positive).cast("double").alias("neg"))


def roc_curve(df: DataFrame, y: str, score: str, cls: int,
              drop_intermediate: bool = True) -> DataFrame:
    """One-vs-rest ROC points (fpr, tpr, threshold) by decreasing threshold.

    Starts at (0, 0, +inf).  ``drop_intermediate`` removes points collinear
    with their neighbours, as the usual ROC implementations do.
    """
    pos = F.col(y).cast("int") == F.lit(int(cls))
    counts = cut_lineage(_score_counts(df.where(F.col(score).isNotNull()), y, score, pos))
    scanned = ordered_scan(counts, [("score", False)], sums=["pos", "neg"])
    tot = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    tot_s = tot.select(F.struct("P", "N")).scalar()
    pts = scanned.select(F.col("_rn").alias("k"), F.col("score").alias("threshold"),
                         F.col("_cum_pos").alias("tps"), F.col("_cum_neg").alias("fps"),
                         "pos", "neg")
    if drop_intermediate:
        # second differences of the cumulative counts are differences of the
        # increments of neighbouring points; keep the first and last point
        nxt = pts.select((F.col("k") - 1).alias("_kn"), F.col("pos").alias("_pn"),
                         F.col("neg").alias("_nn"))
        last = counts.agg(F.count(F.lit(1))).scalar()
        j = pts.join(nxt, pts["k"] == nxt["_kn"], "left")
        keep = ((F.col("k") == 1) | (F.col("k") == last) | (last <= 2)
                | (F.col("_pn") != F.col("pos")) | (F.col("_nn") != F.col("neg")))
        pts = j.where(keep)
    pts = pts.select("k", "threshold", "tps", "fps")
    start = df.sparkSession.createDataFrame([(0, float("inf"), 0.0, 0.0)],
                                            "k long, threshold double, tps double, fps double")
    pts = start.unionByName(pts)
    return pts.select(
        F.lit(int(cls)).alias("class"), "k", "threshold",
        F.when(tot_s["N"] > 0, F.col("fps") / tot_s["N"]).alias("fpr"),
        F.when(tot_s["P"] > 0, F.col("tps") / tot_s["P"]).alias("tpr"))


def _auc_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC per group = P(score_pos > score_neg) + P(tie) / 2 (average ranks)."""
    scanned = ordered_scan(counts, ["score"], by=by, sums=["neg"])
    contrib = F.col("pos") * (F.col("_cum_neg") - F.col("neg") + 0.5 * F.col("neg"))
    return scanned.groupBy(*by).agg(
        (F.sum(contrib) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))


def roc_auc(df: DataFrame, y: str, probs: str, classes: Sequence[int]) -> DataFrame:
    """One-vs-rest AUC per class plus ``macro`` (mean) and ``micro`` (all
    class columns stacked) rows.  ``probs`` is an array column ordered by
    ``classes``."""
    idx = list(range(len(classes)))
    long = df.select(F.col(y).cast("int").alias("_y"), F.posexplode(probs).alias("_i", "score"))
    cls_arr = F.array(*[F.lit(int(c)) for c in classes])
    long = long.withColumn("class", F.element_at(cls_arr, F.col("_i") + 1)).where(
        F.col("_i") < len(idx))
    pos = F.col("_y") == F.col("class")
    # read by the range sampling, the scan and the micro row
    counts = cut_lineage(long.groupBy("class", "score").agg(
        F.count_if(pos).cast("double").alias("pos"), F.count_if(~pos).cast("double").alias("neg")))
    per = cut_lineage(_auc_from_counts(counts, ["class"]).select(
        F.col("class").cast("string").alias("average"), "auc"))  # one row per class
    micro_counts = counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    micro = _auc_from_counts(micro_counts, []).select(F.lit("micro").alias("average"), "auc")
    macro = per.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("average"), "auc")
    return per.unionByName(macro).unionByName(micro)


def binary_auc(df: DataFrame, y: str, score: str, positive: int = 1) -> DataFrame:
    """AUC of one score column against ``y == positive``."""
    pos = F.col(y).cast("int") == F.lit(int(positive))
    counts = _score_counts(df.where(F.col(score).isNotNull()), y, score, pos)
    return _auc_from_counts(counts, []).select("auc")


def linear_shap(df: DataFrame, id_col: str, features: Sequence[str], coef: Sequence[Sequence[float]],
                class_names: Sequence[str] | None = None) -> DataFrame:
    """Exact SHAP of a linear (logit) model: ``coef[k][j] * (x_j - mean_j)``.

    Returns the mean absolute SHAP per (class, feature) -- two passes over
    the data (means, then absolute contributions), no per-row output kept.
    """
    means = df.agg(*[F.avg(f).alias(f) for f in features])
    m = means.select(F.struct(*features)).scalar()
    k_names = list(class_names) if class_names else [str(i) for i in range(len(coef))]
    items = []
    for k, row in enumerate(coef):
        for j, f in enumerate(features):
            items.append(F.struct(F.lit(k_names[k]).alias("class"), F.lit(f).alias("feature"),
                                  F.abs(F.lit(float(row[j])) * (F.col(f).cast("double") - m[f]))
                                  .alias("v")))
    long = df.select(F.explode(F.array(*items)).alias("e")).select("e.*")
    return long.groupBy("class", "feature").agg(F.avg("v").alias("mean_abs_shap"))


def coef_table(coef: Sequence[Sequence[float]], features: Sequence[str], spark,
               class_names: Sequence[str] | None = None) -> DataFrame:
    """Coefficients per (class, feature) of a fitted linear model."""
    k_names = list(class_names) if class_names else [str(i) for i in range(len(coef))]
    rows = [(k_names[k], f, float(coef[k][j])) for k in range(len(coef))
            for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "class string, feature string, coefficient double")
