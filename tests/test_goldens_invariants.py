"""Published golden statistics and ML-preparation invariants.

Fixed values: exact two-sided signed-rank p-values for (W, n) pairs as
published with the reference's significance results:
W=0, n=30 -> 1.862645e-09; W=32, n=30 -> 5.144626e-06;
W=202, n=30 -> 0.54252794; W=0, n=8 -> 0.0078125.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import seq as Q
from tessera.operators import stats as ST
from tests.conftest import SF_SMALL

GOLDEN_P = [(0, 30, 1.862645e-09), (32, 30, 5.144626e-06), (202, 30, 0.54252794),
            (0, 8, 0.0078125)]


def test_exact_wilcoxon_goldens(spark):
    df = spark.createDataFrame([(w, n) for w, n, _ in GOLDEN_P], "w int, n int")
    p = F.least(F.lit(1.0), 2 * ST.exact_wilcoxon_cdf(F.col("n"), F.col("w").cast("double")))
    got = [r["p"] for r in df.select(p.alias("p")).collect()]
    for g, (_, _, want) in zip(got, GOLDEN_P):
        assert g == pytest.approx(want, rel=1e-6)


def _orders(spark):
    return spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderstatus")


def test_stratified_split_is_deterministic_and_sized(spark):
    o = _orders(spark)
    a = Q.stratified_split(o, "o_orderkey", "o_orderstatus", 0.2, seed=7)
    b = Q.stratified_split(o, "o_orderkey", "o_orderstatus", 0.2, seed=7)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == o.count() and a.select("o_orderkey").distinct().count() == o.count()
    per = {r["o_orderstatus"]: (r["n"], r["v"]) for r in a.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_val").cast("int")).alias("v")).collect()}
    for n, v in per.values():
        assert v == round(0.2 * n + 1e-12) or abs(v - 0.2 * n) <= 0.5
    c = Q.stratified_split(o, "o_orderkey", "o_orderstatus", 0.2, seed=8)
    assert sorted(a.collect()) != sorted(c.collect())


def test_kfold_partitions_each_class_evenly(spark):
    o = _orders(spark)
    f = Q.stratified_kfold(o, "o_orderkey", "o_orderstatus", k=5)
    assert f.count() == o.count()
    sizes = f.groupBy("o_orderstatus", "fold").count().groupBy("o_orderstatus").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in sizes)


def test_logreg_probabilities_sum_to_one(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    feats = [f"e{i}" for i in range(6)]
    d = e.select("vec_id", F.pmod("label", F.lit(3)).cast("int").alias("y"),
                 *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}")
                   for i in range(6)])
    m = M.fit_logreg(d, feats, "y")
    p = M.predict(m, d, feats, "vec_id", "y", "lr")
    sums = p.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert len(sums) == d.count()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)


def test_pca_equals_numpy_on_the_whole_table(spark):
    import numpy as np

    from tessera.operators import prep as P
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 1000).alias("v"))
    got = {r.vec_id: (r.pca_1, r.pca_2) for r in P.pca_2(e.repartition(5), "v").collect()}
    rows = e.orderBy("vec_id").collect()
    x = np.array([r.v for r in rows])
    c = x - x.mean(0)
    _, _, w = np.linalg.svd(c, full_matrices=False)
    w = w[:2] * np.sign([r[np.abs(r).argmax()] for r in w[:2]])[:, None]
    assert np.allclose([got[r.vec_id] for r in rows], c @ w.T, atol=1e-8)
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [3.0, 2.0]), (5, [1.0])], "vec_id long, v array<double>")
    out = {r.vec_id: r.pca_1 for r in P.pca_2(odd, "v").collect()}
    assert out == {1: -1.0, 4: 1.0, 2: None, 3: None, 5: None}
    assert P.pca_2(odd.limit(0), "v").count() == 0


def _three_classes(spark, dims=4):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    feats = [f"e{i}" for i in range(dims)]
    return feats, e.select("vec_id", F.pmod("label", F.lit(3)).cast("int").alias("y"), *[
        F.element_at("embedding", i + 1).cast("double").alias(f) for i, f in enumerate(feats)])


def test_logistic_fit_is_stationary_and_predicts_its_formula(spark):
    """The weighted likelihood's gradient is near zero, and probabilities are the softmax
    of the coefficients the table lists."""
    import numpy as np

    from tessera.operators.prep import class_weights
    feats, d = _three_classes(spark)
    d = class_weights(d, "y").cache()
    m = M.fit_logreg(d, feats, "y", "weight")
    rows = d.orderBy("vec_id").collect()
    x, y, w = (np.array([[r[f] for f in feats] for r in rows]), np.array([r.y for r in rows]), np.array([r.weight for r in rows]))
    table = {(int(str(r["class"]).split("_")[-1]), r["feature"]): r["coefficient"] for r in M.coef_table(m, feats, spark).collect()}
    coef = np.array([[table[c, f] for f in feats] for c in range(3)])
    z = x @ coef.T + m.interceptVector.toArray()
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    gradient = ((p - np.eye(3)[y]) * w[:, None]).T @ np.c_[x, np.ones(len(x))] / w.sum()
    assert np.abs(gradient).max() < 1e-4
    got = {r.id: r.probs for r in M.predict(m, d, feats, "vec_id", "y", "lr").collect()}
    assert np.allclose([got[r.vec_id] for r in rows], p, atol=1e-9)


def test_platt_sigmoids_are_fitted_on_the_other_folds(spark):
    """Each fold's calibrated values follow the sigmoids that maximise the likelihood of the rest."""
    import numpy as np
    feats, d = _three_classes(spark)
    oof = M.out_of_fold(d, "vec_id", "y", feats, M.fit_logreg, "lr").cache()
    cal = M.calibrate_platt(oof, 3).collect()
    for f in range(3):
        rest = [r for r in cal if r.fold != f]
        shares = []
        for c in range(3):
            s, t = np.array([r.probs[c] for r in rest]), np.array([r.y_true == c for r in rest], float)
            a = np.zeros(2)
            for _ in range(50):  # Newton's method
                xx = np.c_[s, np.ones(len(s))]
                q = 1 / (1 + np.exp(-xx @ a))
                a -= np.linalg.solve((xx * (q * (1 - q))[:, None]).T @ xx + 1e-12 * np.eye(2), xx.T @ (q - t))
            shares.append(lambda r, a=a, c=c: 1 / (1 + np.exp(-(a[0] * r.probs[c] + a[1]))))
        for r in cal:
            if r.fold == f:
                v = np.array([g(r) for g in shares])
                assert np.allclose(r.calibrated, v / v.sum(), atol=2e-3)


def test_clusters_are_nearest_centres_and_topics_sum_to_one(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from tessera.operators import prep as P
    from tessera.operators import text as TX
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        "vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    out, model = P.kmeans_5(e, "v")
    centres = np.array(model.clusterCenters())
    for r in out.collect():
        d = ((centres - r.v.toArray()) ** 2).sum(1)
        assert d[r.cluster] <= d.min() + 1e-12
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    counts, _ = TX.count_vectorize(docs, "text", min_df=5)
    topics, _ = TX.lda_topics(counts, "counts", k=5, max_iter=3)
    sums = topics.select("counts", sum((F.col(f"topic_{i}") for i in range(1, 6)), F.lit(0.0)).alias("s")).collect()
    assert len(sums) == docs.count()
    assert all(abs(r.s - 1) < 1e-6 or r.counts.numNonzeros() == 0 for r in sums)
