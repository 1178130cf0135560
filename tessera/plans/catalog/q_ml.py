"""ML preparation, models and stacking (2.9) on driver tables.

Model fits are rows-only checks (iterative optimisers have no SQL oracle);
scaling, weights, oversampling counts and the stacking matrix have oracles.
The classification data set is ``embeddings`` with three classes derived
from its label, split 80/20 by the seeded hash split.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ...functions._util import r6
from ...operators import models as M
from ...operators import prep as P
from ...operators.seq import pad_sequence_mask, stratified_split
from ...session import cut_lineage
from . import query
from ._common import t

_DIMS = 64
_FEATS = [f"e{i}" for i in range(_DIMS)]


def _emb(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.select("vec_id", F.pmod("label", F.lit(3)).cast("int").alias("y"),
                    *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(_DIMS)])


def _split(spark, sf):
    d = _emb(spark, sf)
    s = stratified_split(d, "vec_id", "y", 0.2, 42).select("vec_id", "is_val")
    d = d.join(s, "vec_id")
    return d.where(~F.col("is_val")), d


def _fit_query(fit, name, **kw):
    def run(spark, sf):
        train, full = _split(spark, sf)
        model = fit(train, _FEATS, "y", None, **kw)
        p = M.predict(model, full, _FEATS, "vec_id", "y", name)
        return p.select("id", "pred", r6(F.array_max("probs")).alias("p_max"))
    return run


@query("assemble_features", """
SELECT vec_id, 64 AS n_features,
       round(""" + " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(64)) + """, 6) AS total
FROM embeddings""", "ml")
def q_assemble_features(spark, sf):
    from pyspark.ml.functions import vector_to_array
    d = P.assemble_features(_emb(spark, sf), _FEATS)
    a = vector_to_array("features")
    return d.select("vec_id", F.size(a).alias("n_features"),
                    r6(F.aggregate(a, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("standardize", """
WITH tr AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'),
st AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa,
              avg(CAST(c_nationkey AS DOUBLE)) AS mn, stddev_pop(CAST(c_nationkey AS DOUBLE)) AS sn FROM tr)
SELECT c_custkey, round((c_acctbal - ma) / CASE WHEN sa IS NULL OR sa = 0 THEN 1.0 ELSE sa END, 6) AS c_acctbal_z,
       round((c_nationkey - mn) / CASE WHEN sn IS NULL OR sn = 0 THEN 1.0 ELSE sn END, 6) AS c_nationkey_z
FROM customer, st""", "ml")
def q_standardize(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    train = c.where("c_mktsegment <> 'BUILDING'")
    _, (full,) = P.standardize(train, [c], ["c_acctbal", "c_nationkey"], suffix="_z")
    return full.select("c_custkey", r6("c_acctbal_z").alias("c_acctbal_z"),
                       r6("c_nationkey_z").alias("c_nationkey_z"))


@query("standardize_sequence", """
WITH l AS (SELECT user_id, coalesce(value, 0) AS v, coalesce(CAST(nullif(regexp_extract(props, '(\\d+)', 1), '') AS DOUBLE), 0) AS k, event_type,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
u AS (SELECT user_id, sum(v) AS v, sum(k) AS k, sum(v * v) AS vv, sum(k * k) AS kk, arg_min(event_type, r) AS y
      FROM l WHERE r <= 10 GROUP BY user_id),
s AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || user_id), user_id)
                <= round(count(*) OVER (PARTITION BY y) * 0.2) AS is_val FROM u),
m AS (SELECT sum(v) / (10 * count(*)) AS mv, sum(k) / (10 * count(*)) AS mk, sum(vv) / (10 * count(*)) AS qv, sum(kk) / (10 * count(*)) AS qk
      FROM s WHERE NOT is_val)
SELECT user_id, round((v - 10 * mv) / sqrt(qv - mv * mv) + (k - 10 * mk) / sqrt(qk - mk * mk), 6) AS seq_total FROM u, m""", "ml")
def q_standardize_sequence(spark, sf):
    e = t(spark, sf, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("double"))
    seqs = pad_sequence_mask(e, "user_id", "ts", ["value", "k"], "event_type", 10, "event_id")
    # fit the scaler on the seeded stratified training split (80 %)
    split = stratified_split(seqs, "user_id", "event_type", frac=0.2)
    train = seqs.join(split.where(~F.col("is_val")).select("user_id"), "user_id", "left_semi")
    _, (full,) = P.standardize_sequence(train, [seqs], "seq")
    return full.select("user_id", r6(F.aggregate(F.flatten("seq"), F.lit(0.0),
                                                 lambda s, x: s + x)).alias("seq_total"))


@query("class_weights", """
WITH c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY 1),
s AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT l.doc_id, l.quality, round(s.n / (s.k * c.nc), 6) AS weight
FROM labels l JOIN c ON l.quality = c.quality, s""", "ml")
def q_class_weights(spark, sf):
    lb = t(spark, sf, "labels").select("doc_id", "quality")
    return P.class_weights(lb, "quality", "balanced").select("doc_id", "quality",
                                                              r6("weight").alias("weight"))


@query("oversample_random", """
WITH d AS (SELECT vec_id, CAST(label % 3 AS INTEGER) AS y FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM d),
c AS (SELECT DISTINCT y, n FROM r),
x AS (SELECT y, n, unnest(range(1, (SELECT max(n) FROM c) - n + 1)) AS copy FROM c),
k AS (SELECT y, copy, CAST('0x' || substr(md5('42:' || y || ':' || copy), 1, 12) AS BIGINT) % n + 1 AS rn FROM x)
SELECT vec_id, y, 0 AS copy FROM d
UNION ALL SELECT r.vec_id, k.y, CAST(k.copy AS INTEGER) FROM k JOIN r ON r.y = k.y AND r.rn = k.rn""", "ml")
def q_oversample_random(spark, sf):
    d = _emb(spark, sf).select("vec_id", "y")
    return P.oversample_random(d, "vec_id", "y", seed=42).select("vec_id", "y", F.col("_copy").alias("copy"))


@query("pca_2", None, "ml")
def q_pca_2(spark, sf):
    from pyspark.ml.functions import array_to_vector
    e = t(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    out = P.pca_2(e, "v")
    return out.select("vec_id", r6("pca_1").alias("pca_1"), r6("pca_2").alias("pca_2"))


@query("kmeans_5", None, "ml")
def q_kmeans_5(spark, sf):
    from pyspark.ml.functions import array_to_vector
    e = t(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    out, _ = P.kmeans_5(e, "v", 5, 42, "note_cluster")
    return out.select("vec_id", "note_cluster")


_FITS = [
    ("fit_logreg", M.fit_logreg, {}),
    ("fit_random_forest", M.fit_random_forest, {"num_trees": 200}),
    ("fit_boosted_trees", M.fit_boosted_trees, {}),
    ("fit_mlp", M.fit_mlp, {"hidden": (128, 64)}),
    ("fit_svm", M.fit_svm, {}),
    ("fit_naive_bayes", M.fit_naive_bayes, {}),
]
# All classifiers of the library, and the bases of the stacking model.
_CANDIDATES = {name.removeprefix("fit_"): partial(fit, **kw) if kw else fit for name, fit, kw in _FITS if fit is not M.fit_mlp}
_CANDIDATES["mlp"] = M.fit_mlp  # by itself: it takes no class weights
_BASES = {"logreg": M.fit_logreg, "random_forest": partial(M.fit_random_forest, num_trees=100),
          "boosted_trees": M.fit_boosted_trees}

for _name, _fit, _kw in _FITS:
    query(_name, None, "ml")(_fit_query(_fit, _name, **_kw))


@query("fit_logreg_tabular", None, "ml")
def q_fit_logreg_tabular(spark, sf):
    train, full = _split(spark, sf)
    train = train.withColumn("y", (F.col("y") == 0).cast("int"))
    full = full.withColumn("y", (F.col("y") == 0).cast("int"))
    m = M.fit_logreg_tabular(train, _FEATS, "y")
    p = M.predict(m, full, _FEATS, "vec_id", "y", "tabular_logreg")
    return p.select("id", "pred", r6(F.element_at("probs", 2)).alias("p_pos"))


def _sequences(spark, sf):
    e = t(spark, sf, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("double"))
    seqs = pad_sequence_mask(e, "user_id", "ts", ["value", "k"], "event_type", 10, "event_id")
    return seqs.withColumn("y", (F.col("event_type") == "purchase").cast("int"))


@query("fit_sequence_baseline", None, "ml")
def q_fit_sequence_baseline(spark, sf):
    from pyspark.ml.functions import array_to_vector
    s = _sequences(spark, sf)
    m = M.fit_sequence_baseline(s, "seq", "y")
    out = m.transform(s.withColumn("features", array_to_vector(F.flatten("seq"))))
    return out.select("user_id", F.col("prediction").cast("int").alias("pred"))


@query("fit_fused_baseline", None, "ml")
def q_fit_fused_baseline(spark, sf):
    from pyspark.ml.functions import array_to_vector
    from ...functions.arrays import masked_mean_pool
    s = _sequences(spark, sf)
    m = M.fit_fused_baseline(s, "seq", "seq", "mask", "y")
    feats = array_to_vector(F.concat(F.flatten("seq"), masked_mean_pool("seq", "mask")))
    return m.transform(s.withColumn("features", feats)).select(
        "user_id", F.col("prediction").cast("int").alias("pred"))


def _probe_preds(spark, sf):
    e = t(spark, sf, "embeddings")
    f = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x.cast("double"))
    m1 = e.select(F.lit("m1").alias("model"), F.col("vec_id").alias("id"), f(1, 3).alias("probs"))
    m2 = e.where("label <> 9").select(F.lit("m2").alias("model"), F.col("vec_id").alias("id"),
                                      f(4, 3).alias("probs"))
    return m1.unionByName(m2)


@query("stack_matrix", """
SELECT a.vec_id AS id,
""" + ",\n".join(f"CAST(a.embedding[{i + 1}] AS DOUBLE) AS m1_class_{i}" for i in range(3)) + ",\n"
       + ",\n".join(f"CAST(a.embedding[{i + 4}] AS DOUBLE) AS m2_class_{i}" for i in range(3)) + """
FROM embeddings a WHERE a.label <> 9""", "ml")
def q_stack_matrix(spark, sf):
    return M.stack_matrix(_probe_preds(spark, sf), "id", ["m1", "m2"], 3)


@query("stack_cv", None, "ml")
def q_stack_cv(spark, sf):
    train, _ = _split(spark, sf)
    meta, mat = M.stack_cv(train, "vec_id", "y", _FEATS, _BASES, k=3)
    feats = [c for c in mat.columns if c not in ("id", "y")]
    p = M.predict(meta, mat, feats, "id", "y", "stacker")
    return p.select("id", "pred")


@query("select_meta_learner", None, "ml")
def q_select_meta_learner(spark, sf):
    train, _ = _split(spark, sf)
    scores = M.select_meta_learner(train, "vec_id", "y", _FEATS, _CANDIDATES, [0, 1, 2], k=5)
    return scores.select("model", "fold", r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"),
                         r6("mean_f1").alias("mean_f1"), "selected")


@query("model_card", None, "ml")
def q_model_card(spark, sf):
    train, _ = _split(spark, sf)
    scores = M.select_meta_learner(train, "vec_id", "y", _FEATS, _CANDIDATES, [0, 1, 2], k=5)
    return M.model_card_report(scores, "embeddings")


@query("calibrate_platt", None, "ml")
def q_calibrate_platt(spark, sf):
    train, _ = _split(spark, sf)
    oof = M.out_of_fold(train, "vec_id", "y", _FEATS, M.fit_logreg, "logreg", k=3)
    cal = M.calibrate_platt(oof, 3)
    return cal.select("id", "fold", *[r6(F.element_at("calibrated", c + 1)).alias(f"p{c}") for c in range(3)])


@query("coef_table", None, "ml")
def q_coef_table(spark, sf):
    train, _ = _split(spark, sf)
    m = M.fit_logreg(train, _FEATS, "y")
    return M.coef_table(m, _FEATS, spark).select("class", "feature",
                                                  r6("coefficient").alias("coefficient"))


@query("run_params_metrics", None, "ml")
def q_run_params_metrics(spark, sf):
    from ...operators.evaluate import metric_accuracy
    train, full = _split(spark, sf)
    m = M.fit_logreg(train, _FEATS, "y", reg=0.01)
    acc = metric_accuracy(M.predict(m, full, _FEATS, "vec_id", "y", "logreg"), "y_true", "pred")
    return M.run_params_metrics(spark, 1, {"model": "logreg", "reg": 0.01, "seed": 42},
                                {"accuracy": acc.first()[0]})


@query("multi_seed_runs", None, "ml")
def q_multi_seed_runs(spark, sf):
    from ...operators.evaluate import metric_accuracy

    # read and assembled once for all seeds
    rows = M.assembled(_emb(spark, sf), "vec_id", "y", _FEATS)

    def step(seed: int):
        s = stratified_split(rows.select("vec_id", "y"), "vec_id", "y", 0.2, seed).select("vec_id", "is_val")
        # a fit reads its rows several times
        d = cut_lineage(rows.join(s, "vec_id"))
        m = M.fit_logreg(d.where(~F.col("is_val")), "features", "y")
        p = M.predict(m, d.where("is_val"), "features", "vec_id", "y", "logreg")
        return metric_accuracy(p, "y_true", "pred").select(r6("accuracy").alias("accuracy"),
                                                           F.lit(seed).alias("seed"))
    return M.multi_seed_runs(step, [42 + i for i in range(1, 31)])
