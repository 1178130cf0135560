"""Classifiers, prediction tables, stacking, model selection and calibration.

Fits use ``pyspark.ml`` estimators (distributed training).  Predictions are
kept in one long table ``(run, model, id, y_true, probs)``; the stacking
matrix is a pivot of that table on the model name.  Cross-validation folds
come from :func:`tessera.operators.seq.stratified_kfold` (seeded hash), so
fold membership does not depend on partitioning.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .encode import encode_category
from .prep import assemble_features, class_weights, standardize
from .resample import METHODS, oversample
from .seq import stratified_kfold

log = logging.getLogger(__name__)

# Folded tables get a partition per this many rows, and independent fits run at once.
ROWS_PER_TASK = 20_000
FIT_THREADS = 6

Fit = Callable[[DataFrame, str, str, str | None], object]


def _vec(df: DataFrame, features: Sequence[str] | str, out: str = "features") -> DataFrame:
    if isinstance(features, str):
        return df if features == out else df.withColumn(out, F.col(features))
    return assemble_features(df, features, out)


def fit_logreg(train: DataFrame, features, label: str, weight: str | None = None,
               family: str = "multinomial", max_iter: int = 100, reg: float = 0.0):
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(featuresCol="features", labelCol=label, family=family,
                            maxIter=max_iter, regParam=reg)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(_vec(train, features))


def fit_logreg_tabular(train: DataFrame, features, label: str, weight: str | None = None):
    return fit_logreg(train, features, label, weight, family="binomial")


def fit_random_forest(train: DataFrame, features, label: str, weight: str | None = None,
                      num_trees: int = 200, seed: int = 42, max_depth: int = 5):
    from pyspark.ml.classification import RandomForestClassifier
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees,
                                seed=seed, maxDepth=max_depth)
    if weight:
        rf = rf.setWeightCol(weight)
    return rf.fit(_vec(train, features))


class OneVsRestProbabilities:
    """Binary models of each class against the rest, as one classifier.

    A binary model without probabilities (linear SVM) gets a logistic fit of the
    class on its margins (Platt).  The class probabilities are scaled to sum 1.
    """

    def __init__(self, models: list, margins: list):
        self.models, self.margins = models, margins

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        out, shares = df, []
        for c, (m, margin) in enumerate(zip(self.models, self.margins)):
            names = {"rawPrediction": f"_raw{c}", "prediction": f"_pred{c}", "probability": f"_prob{c}"}
            scored = m.transform(out)
            for name, to in names.items():
                scored = scored.withColumnRenamed(name, to)
            if margin is None:
                share = vector_to_array(f"_prob{c}")[1]
            else:
                slope, offset = margin
                share = 1 / (1 + F.exp(-(slope * vector_to_array(f"_raw{c}")[1] + offset)))
            out = scored.withColumn(f"_share{c}", share)
            out = out.drop(*names.values())
            shares.append(F.col(f"_share{c}"))
        total = sum(shares[1:], shares[0])
        probs = F.array(*[F.when(total > 0, s / total).otherwise(1.0 / len(shares)) for s in shares])
        out = out.withColumn("_probs", probs)
        best = F.array_position("_probs", F.array_max("_probs")) - 1
        return (out.withColumn("probability", array_to_vector("_probs")).withColumn("prediction", best.cast("double"))
                .drop("_probs", *[f"_share{c}" for c in range(len(shares))]))


def _fit_one_vs_rest(estimator, train: DataFrame, features, label: str, weight: str | None) -> OneVsRestProbabilities:
    from pyspark.ml.classification import LogisticRegression
    d = _vec(train, features)
    n_classes = int(d.agg(F.max(label)).first()[0]) + 1
    if weight:
        estimator = estimator.setWeightCol(weight)
    models, margins = [], []
    for c in range(n_classes):
        y = d.withColumn("_y", (F.col(label) == c).cast("double"))
        m = estimator.copy({estimator.labelCol: "_y", estimator.featuresCol: "features"}).fit(y)
        scored = m.transform(y)
        models.append(m)
        if "probability" in scored.columns:
            margins.append(None)
            continue
        from pyspark.ml.functions import array_to_vector, vector_to_array
        scored = scored.select("_y", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("_f"))
        platt = LogisticRegression(featuresCol="_f", labelCol="_y").fit(scored)
        margins.append((float(platt.coefficients[0]), float(platt.intercept)))
    return OneVsRestProbabilities(models, margins)


def fit_boosted_trees(train: DataFrame, features, label: str, weight: str | None = None,
                      max_iter: int = 20, seed: int = 42):
    """One-vs-rest gradient-boosted trees (Spark's GBT is binary), with class
    probabilities."""
    from pyspark.ml.classification import GBTClassifier
    return _fit_one_vs_rest(GBTClassifier(maxIter=max_iter, seed=seed), train, features, label, weight)


def fit_mlp(train: DataFrame, features, label: str, weight: str | None = None,
            hidden: Sequence[int] = (128, 64), seed: int = 42, max_iter: int = 100):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    d = _vec(train, features)
    n_in = len(features) if not isinstance(features, str) else d.select(
        F.col("features")).first()[0].size
    n_out = int(d.agg(F.max(label)).first()[0]) + 1
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, seed=seed,
                                         layers=[n_in, *hidden, n_out], maxIter=max_iter)
    return mlp.fit(d)


def fit_svm(train: DataFrame, features, label: str, weight: str | None = None,
            max_iter: int = 50):
    """One-vs-rest linear SVM (the RBF kernel has no distributed counterpart),
    with class probabilities from its margins."""
    from pyspark.ml.classification import LinearSVC
    return _fit_one_vs_rest(LinearSVC(maxIter=max_iter), train, features, label, weight)


def fit_naive_bayes(train: DataFrame, features, label: str, weight: str | None = None):
    from pyspark.ml.classification import NaiveBayes
    nb = NaiveBayes(featuresCol="features", labelCol=label, modelType="gaussian")
    if weight:
        nb = nb.setWeightCol(weight)
    return nb.fit(_vec(train, features))


def fit_sequence_baseline(train: DataFrame, seq: str, label: str, weight: str | None = None):
    """Visit-sequence classifier: the flattened (T x F) tensor as features."""
    from pyspark.ml.functions import array_to_vector
    d = train.withColumn("features", array_to_vector(F.flatten(seq)))
    return fit_logreg(d, "features", label, weight)


def fit_fused_baseline(train: DataFrame, seq: str, emb: str, mask: str, label: str,
                       weight: str | None = None):
    """Note embedding (mask-weighted mean over visits) + flattened visits."""
    from pyspark.ml.functions import array_to_vector
    from ..functions.arrays import masked_mean_pool
    d = train.withColumn("features", array_to_vector(
        F.concat(F.flatten(seq), masked_mean_pool(emb, mask))))
    return fit_logreg(d, "features", label, weight)


def predict(model, df: DataFrame, features, id_col: str, label: str, name: str,
            run: int = 0) -> DataFrame:
    """Long prediction rows: run, model, id, y_true, probs (array), pred."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(_vec(df, features))
    probs = vector_to_array("probability")
    return out.select(F.lit(run).alias("run"), F.lit(name).alias("model"), F.col(id_col).alias("id"),
                      F.col(label).cast("int").alias("y_true"), probs.alias("probs"),
                      F.col("prediction").cast("int").alias("pred"))


def stack_matrix(preds: DataFrame, id_col: str, models: Sequence[str], n_classes: int) -> DataFrame:
    """One row per id, columns ``{model}_class_{i}`` (ids predicted by every
    model only).  A pivot on the fixed model list; no per-model joins.  Of several
    predictions of a model for one id the smallest is taken."""
    wide = preds.groupBy(id_col).pivot("model", list(models)).agg(F.min("probs"))
    cols = [F.element_at(F.col(f"`{m}`"), i + 1).alias(f"{m}_class_{i}")
            for m in models for i in range(n_classes)]
    complete = F.lit(True)
    for m in models:
        complete = complete & F.col(f"`{m}`").isNotNull()
    return wide.where(complete).select(id_col, *cols)


def _folded(train: DataFrame, id_col: str, label: str, k: int, seed: int) -> DataFrame:
    folds = stratified_kfold(train.select(id_col, label), id_col, label, k, seed).select(id_col, "fold")
    return cut_lineage(train.join(folds, id_col))


def _compact(df: DataFrame, rows: int) -> DataFrame:
    """No more partitions than ``rows`` need: iterative fits pay for each task."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def assembled(df: DataFrame, id_col: str, label: str, features) -> DataFrame:
    """``(id_col, label, features)`` on reliable storage, for fits that share the rows."""
    return cut_lineage(_vec(df, features).select(id_col, label, "features"))


def _fit_balanced(fit: Fit, train: DataFrame, features, label: str):
    """``fit`` with balanced class weights, or without where it takes none."""
    weighted = class_weights(train, label, "balanced", "_weight")
    return fit(weighted, features, label, None if fit is fit_mlp else "_weight")


class Folds:
    """Training rows in ``k`` stratified, seeded folds: features are assembled once
    and the folded table is kept on reliable storage.  The class counts of the folds
    (classes x folds numbers) give every fold's balanced weights as literals, so a
    fit reads the table and joins nothing."""

    def __init__(self, train: DataFrame, id_col: str, label: str, features, k: int, seed: int):
        folds = stratified_kfold(train.select(id_col, label), id_col, label, k, seed).select(id_col, "fold")
        table = _vec(train.join(folds, id_col), features).select(id_col, label, "features", "fold")
        table = cut_lineage(table)
        counts = table.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect()
        self.id_col, self.label, self.k = id_col, label, k
        self.counts = {(r["fold"], r[label]): r["n"] for r in counts}
        self.table = _compact(table, sum(self.counts.values()))

    def training(self, fold: int) -> DataFrame:
        """Rows of the other folds with ``_weight``, n / (classes * n of the class)."""
        sizes: dict = {}
        for (f, y), n in self.counts.items():
            if f != fold:
                sizes[y] = sizes.get(y, 0) + n
        weight = F.lit(None).cast("double")
        for y, n in sizes.items():
            weight = F.when(F.col(self.label) == y, sum(sizes.values()) / (len(sizes) * n)).otherwise(weight)
        return self.table.where(F.col("fold") != fold).withColumn("_weight", weight)

    def held_out(self, name: str, fit: Fit, fold: int) -> DataFrame:
        """Predictions of a fold by a model of the others."""
        model = fit(self.training(fold), "features", self.label, None if fit is fit_mlp else "_weight")
        return predict(model, self.table.where(F.col("fold") == fold), "features", self.id_col, self.label, name)


def at_once(jobs: Sequence[Callable[[], object]], threads: int = FIT_THREADS) -> list:
    """Results of independent Spark jobs started from a thread pool, in order; the
    first error is raised."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def _out_of_fold(folds: Folds, fits: dict[str, Fit]) -> DataFrame:
    parts = at_once([partial(folds.held_out, name, fit, f) for name, fit in fits.items() for f in range(folds.k)])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold(train: DataFrame, id_col: str, label: str, features, fit: Fit, name: str,
                k: int = 3, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions: each fold is predicted by a model fitted on
    the other folds (stratified, seeded folds; balanced class weights)."""
    return _out_of_fold(Folds(train, id_col, label, features, k, seed), {name: fit})


def stack_cv(train: DataFrame, id_col: str, label: str, features,
             bases: dict[str, Fit], final: Fit = fit_logreg, k: int = 3, seed: int = 42):
    """Stacked generalisation: out-of-fold base predictions -> meta model.
    Returns (meta model, stacked training matrix)."""
    preds = _out_of_fold(Folds(train, id_col, label, features, k, seed), bases)
    n_classes = int(train.agg(F.max(label)).first()[0]) + 1
    mat = stack_matrix(preds, "id", list(bases), n_classes)
    mat = cut_lineage(mat.join(train.select(F.col(id_col).alias("id"), label), "id"))
    feats = [c for c in mat.columns if c not in ("id", label)]
    return final(mat, feats, label, None), mat


def select_meta_learner(train: DataFrame, id_col: str, label: str, features,
                        candidates: dict[str, Fit], classes: Sequence[int], k: int = 5,
                        seed: int = 42) -> DataFrame:
    """Held-out macro-F1 and accuracy of every candidate on each of ``k`` folds, fitted
    with balanced class weights: (model, fold, macro_f1, accuracy, mean_f1, selected),
    the model of the best mean being selected (ties: the last name)."""
    folds = Folds(train, id_col, label, features, k, seed)

    def score(name: str, fit: Fit, f: int) -> tuple:
        p = folds.held_out(name, fit, f).groupBy("y_true", "pred").agg(F.count(F.lit(1)).alias("n"))
        return (name, f, *_scores_of({(r["y_true"], r["pred"]): r["n"] for r in p.collect()}, classes))

    done = at_once([partial(score, name, fit, f) for name, fit in candidates.items() for f in range(k)])
    rows = train.sparkSession.createDataFrame(done, "model string, fold int, macro_f1 double, accuracy double")
    card = model_card(rows).select("model", "mean_f1", "selected")
    return rows.join(F.broadcast(card), "model")


def _scores_of(counts: dict, classes: Sequence[int]) -> tuple[float, float]:
    """Macro-F1 over ``classes`` and accuracy of (truth, prediction) counts."""
    f1 = []
    for c in classes:
        hit = counts.get((c, c), 0)
        said, held = (sum(n for pair, n in counts.items() if pair[at] == c) for at in (1, 0))
        f1.append(2 * hit / (said + held) if said + held else 0.0)
    total = sum(counts.values())
    return sum(f1) / len(f1), sum(n for (y, p), n in counts.items() if y == p) / total if total else 0.0


def select_resampler(train: DataFrame, id_col: str, label: str, cols: Sequence[str], cat_cols: Sequence[str] = (),
                     methods: Sequence[str] = METHODS, fit: Fit = fit_random_forest, k: int = 3, seed: int = 42) -> DataFrame:
    """Held-out macro-F1 of ``fit`` after each resampling method: (method, fold,
    held_out, macro_f1, mean_f1, selected), the best mean being selected (ties: the
    last name).

    Only the rows of the other folds are resampled and fit the scaler, so no
    synthetic row, and nothing made from a held-out row, is scored.  All methods are
    scored on the same rows."""
    coded = train.where(F.col(label).isNotNull()).select(id_col, label, *cols, *cat_cols)
    for c in cat_cols:
        coded = encode_category(coded, c)
    table = _folded(coded, id_col, label, k, seed)
    classes = sorted(r[0] for r in table.select(label).distinct().collect())
    features = [*cols, *cat_cols]

    def score(method: str, f: int) -> tuple:
        made = cut_lineage(oversample(method, table.where(F.col("fold") != f).drop("fold"), id_col, label, cols, cat_cols, seed=seed))
        n = made.count()
        scaled, (held,) = standardize(made, [table.where(F.col("fold") == f)], features)
        model = _fit_balanced(fit, _compact(_vec(scaled, features), n), "features", label)
        p = predict(model, held, features, id_col, label, method).groupBy("y_true", "pred").agg(F.count(F.lit(1)).alias("n"))
        counts = {(r["y_true"], r["pred"]): r["n"] for r in p.collect()}
        return method, f, sum(counts.values()), _scores_of(counts, classes)[0]

    done = at_once([partial(score, m, f) for m in methods for f in range(k)])
    rows = train.sparkSession.createDataFrame(done, "method string, fold int, held_out long, macro_f1 double")
    card = model_card(rows.withColumnRenamed("method", "model")).select(F.col("model").alias("method"), "mean_f1", "selected")
    return rows.join(F.broadcast(card), "method")


def calibrate_platt(oof: DataFrame, n_classes: int, k: int = 3, seed: int = 42) -> DataFrame:
    """Per-class sigmoid calibration of out-of-fold scores (``y == c`` against
    ``probs[c]``), scaled to sum 1.

    Cross-fitted: the rows of each of ``k`` stratified folds are calibrated by
    sigmoids fitted on the other folds.  The fitted numbers are literals, so a
    row is calibrated in place, without joins."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    d = _folded(oof, "id", "y_true", k, seed)
    out = F.lit(None).cast("array<double>")
    for f in range(k):
        rest, shares = d.where(F.col("fold") != f), []
        for c in range(n_classes):
            pairs = rest.select((F.col("y_true") == c).cast("double").alias("_y"),
                                array_to_vector(F.array(F.element_at("probs", c + 1))).alias("_f"))
            m = LogisticRegression(featuresCol="_f", labelCol="_y").fit(pairs)
            z = float(m.coefficients[0]) * F.element_at("probs", c + 1) + float(m.intercept)
            shares.append(1 / (1 + F.exp(-z)))
        total = sum(shares[1:], shares[0])
        out = F.when(F.col("fold") == f, F.array(*[s / total for s in shares])).otherwise(out)
    return d.select(*oof.columns, "fold", out.alias("calibrated"))


def coef_table(model, features: Sequence[str], spark) -> DataFrame:
    """Coefficients per (class, feature) of a fitted logistic regression."""
    from .evaluate import coef_table as _ct
    mat = model.coefficientMatrix.toArray().tolist()
    return _ct(mat, features, spark)


def run_params_metrics(spark, run: int, params: dict, metrics: dict) -> DataFrame:
    """Long (run, kind, key, value) rows for experiment tracking tables."""
    rows = [(run, "param", k, str(v)) for k, v in params.items()]
    rows += [(run, "metric", k, str(v)) for k, v in metrics.items()]
    return spark.createDataFrame(rows, "run int, kind string, key string, value string")


def model_card(scores: DataFrame) -> DataFrame:
    """Candidate comparison: mean/std macro-F1 per model, its scores by fold, and the
    best flagged."""
    by_fold = F.transform(F.sort_array(F.collect_list(F.struct("fold", "macro_f1"))), lambda x: x["macro_f1"])
    per = scores.groupBy("model").agg(F.avg("macro_f1").alias("mean_f1"),
                                      F.stddev_samp("macro_f1").alias("std_f1"),
                                      F.count(F.lit(1)).alias("folds"), by_fold.alias("fold_scores"))
    best = per.agg(F.max_by("model", F.struct("mean_f1", F.col("model")))).scalar()
    return per.withColumn("selected", F.col("model") == best)


def model_card_report(scores: DataFrame, prefix: str) -> DataFrame:
    """The selected model's card as (section, item, value) rows: what was selected, its
    accuracy and macro-F1 with the scores of all folds, and every candidate's mean."""
    card = model_card(scores)
    best = card.where("selected")
    accuracy = scores.groupBy("model").agg(F.avg("accuracy").alias("accuracy"))
    best = best.join(accuracy, "model")
    row = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("string").alias("value"))
    number = lambda c: F.format_string("%.4f", F.col(c))
    folds = best.select(F.posexplode("fold_scores").alias("f", "score"))
    parts = [row(best, "model", F.lit("metric_prefix"), F.lit(prefix)), row(best, "model", F.lit("selected"), F.col("model")),
             row(best, "performance", F.lit("accuracy"), number("accuracy")), row(best, "performance", F.lit("macro_f1"), number("mean_f1")),
             row(folds, "performance", F.format_string("macro_f1_fold_%d", F.col("f") + 1), number("score")),
             row(card, "candidates", F.col("model"), number("mean_f1"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def multi_seed_runs(step: Callable[[int], DataFrame], seeds: Sequence[int]) -> DataFrame:
    """Union of ``step(seed)`` over seeds with ``run``, ``status`` and ``error``
    columns.  Independent, so started from a thread pool.  A failing seed does not stop the others: it becomes one row with
    status ``failed``, the error's text and nulls.  If every seed fails the last
    error is raised, since there is no result to give a schema."""
    def run(i: int, s: int):
        try:
            return cut_lineage(step(s))  # an action: errors of the run surface here
        except Exception as e:  # noqa: BLE001 - reported in the failed run's row
            log.warning("run %d (seed %d) failed: %s", i, s, e)
            return e

    done, failed, last = [], [], None
    for i, df in enumerate(at_once([partial(run, i, s) for i, s in enumerate(seeds, start=1)]), start=1):
        if isinstance(df, Exception):
            failed.append((i, f"{type(df).__name__}: {df}"[:500]))
            last = df
        else:
            done.append(df.withColumns({"run": F.lit(i), "status": F.lit("ok"), "error": F.lit(None).cast("string")}))
    if not done:
        if last is None:
            raise ValueError("no seeds given")
        raise last
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if failed:
        rows = out.sparkSession.createDataFrame(failed, "run int, error string")
        out = out.unionByName(rows.withColumn("status", F.lit("failed")), allowMissingColumns=True)
    return out
