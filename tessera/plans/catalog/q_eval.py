"""Classification metrics (2.9 evaluation) on driver tables.

Predictions are derived from the tables: documents' language as a predicted
quality class, embeddings' first ten coordinates as class scores.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions._util import r6
from ...operators import evaluate as EV
from . import query
from ._common import t

_PRED_SQL = """preds AS (SELECT l.doc_id, l.quality AS y, CASE WHEN d.lang = 'en' THEN 1 WHEN d.lang = 'fr' THEN 2 ELSE 0 END AS pred,
                 CAST(d.n_chars AS DOUBLE) AS score
          FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _preds(spark, sf):
    lb, d = t(spark, sf, "labels"), t(spark, sf, "documents")
    return lb.join(d, "doc_id").select(
        "doc_id", F.col("quality").alias("y"),
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(0).alias("pred"),
        F.col("n_chars").cast("double").alias("score"))


_PER_CLASS_SQL = f"""
WITH {_PRED_SQL},
dom AS (SELECT * FROM (VALUES (0), (1), (2)) v(class)),
s AS (SELECT dom.class,
             count_if(p.y = dom.class AND p.pred = dom.class) AS tp,
             count_if(p.y = dom.class) AS support,
             count_if(p.pred = dom.class) AS predicted
      FROM dom LEFT JOIN preds p ON p.y = dom.class OR p.pred = dom.class GROUP BY dom.class),
m AS (SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM s),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
"""


@query("metric_per_class", _PER_CLASS_SQL + """
SELECT CAST(class AS INTEGER) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       CAST(support AS BIGINT) AS support, round(f1, 6) AS f1 FROM f""", "eval")
def q_metric_per_class(spark, sf):
    out = EV.metric_per_class(_preds(spark, sf), "y", "pred", [0, 1, 2])
    return out.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      "support", r6("f1").alias("f1"))


@query("metric_macro_f1", _PER_CLASS_SQL + """
SELECT round(avg(f1), 6) AS macro_f1, round(avg(precision), 6) AS macro_precision,
       round(avg(recall), 6) AS macro_recall FROM f""", "eval")
def q_metric_macro_f1(spark, sf):
    out = EV.metric_macro_f1(_preds(spark, sf), "y", "pred", [0, 1, 2])
    return out.select(*[r6(c).alias(c) for c in ("macro_f1", "macro_precision", "macro_recall")])


@query("metric_accuracy", f"""
WITH {_PRED_SQL} SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds""",
       "eval")
def q_metric_accuracy(spark, sf):
    return EV.metric_accuracy(_preds(spark, sf), "y", "pred").select(r6("accuracy").alias("accuracy"))


@query("confusion_matrix", f"""
WITH {_PRED_SQL},
dom AS (SELECT * FROM (VALUES (0), (1), (2)) v(c)),
cc AS (SELECT y, pred, count(*) AS n FROM preds GROUP BY 1, 2)
SELECT CAST(a.c AS INTEGER) AS y_true, CAST(b.c AS INTEGER) AS y_pred, CAST(coalesce(cc.n, 0) AS BIGINT) AS n
FROM dom a CROSS JOIN dom b LEFT JOIN cc ON cc.y = a.c AND cc.pred = b.c""", "eval")
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(_preds(spark, sf), "y", "pred", [0, 1, 2])


@query("roc_curve", f"""
WITH {_PRED_SQL},
c AS (SELECT score, CAST(count_if(y = 1) AS DOUBLE) AS pos, CAST(count_if(y <> 1) AS DOUBLE) AS neg
      FROM preds WHERE score IS NOT NULL GROUP BY score),
pts0 AS (SELECT row_number() OVER (ORDER BY score DESC) AS k, score AS threshold,
                sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
                sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps FROM c),
nb AS (SELECT *, lag(tps) OVER (ORDER BY k) AS tp0, lead(tps) OVER (ORDER BY k) AS tp2,
              lag(fps) OVER (ORDER BY k) AS fp0, lead(fps) OVER (ORDER BY k) AS fp2 FROM pts0),
kept AS (SELECT k, threshold, tps, fps FROM nb
         WHERE tp0 IS NULL OR tp2 IS NULL OR (SELECT count(*) FROM c) <= 2
            OR tp2 - 2 * tps + tp0 <> 0 OR fp2 - 2 * fps + fp0 <> 0
         UNION ALL SELECT 0, 'inf'::DOUBLE, 0.0, 0.0),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c)
SELECT 1 AS class, CAST(k AS BIGINT) AS k, threshold,
       round(CASE WHEN N > 0 THEN fps / N END, 6) AS fpr, round(CASE WHEN P > 0 THEN tps / P END, 6) AS tpr
FROM kept, tot""", "eval")
def q_roc_curve(spark, sf):
    out = EV.roc_curve(_preds(spark, sf), "y", "score", 1)
    return out.select("class", "k", "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("roc_auc", """
WITH long AS (SELECT label AS y, unnest(range(0, 10)) AS cls, unnest(embedding[1:10]) AS score FROM embeddings),
c AS (SELECT cls, CAST(score AS DOUBLE) AS score, CAST(count_if(y = cls) AS DOUBLE) AS pos,
             CAST(count_if(y <> cls) AS DOUBLE) AS neg FROM long GROUP BY 1, 2),
cb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
per AS (SELECT CAST(cls AS VARCHAR) AS average, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc
        FROM cb GROUP BY cls),
mc AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM c GROUP BY score),
mb AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
       FROM mc)
SELECT average, round(auc, 6) AS auc FROM per
UNION ALL SELECT 'macro', round(avg(auc), 6) FROM per
UNION ALL SELECT 'micro', round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) FROM mb""", "eval")
def q_roc_auc(spark, sf):
    e = t(spark, sf, "embeddings")
    s = e.select(F.col("label").alias("y"),
                 F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("probs"))
    out = EV.roc_auc(s, "y", "probs", list(range(10)))
    return out.select("average", r6("auc").alias("auc"))


@query("binary_auc", f"""
WITH {_PRED_SQL},
c AS (SELECT score, CAST(count_if(y = 1) AS DOUBLE) AS pos, CAST(count_if(y <> 1) AS DOUBLE) AS neg
      FROM preds WHERE score IS NOT NULL GROUP BY score),
cb AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM cb""", "eval")
def q_binary_auc(spark, sf):
    return EV.binary_auc(_preds(spark, sf), "y", "score", 1).select(r6("auc").alias("auc"))


_COEF = [[0.5, -0.2], [0.1, 0.3]]


@query("linear_shap", """
WITH m AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS n FROM customer),
v AS (SELECT '0' AS class, 'c_acctbal' AS feature, abs(0.5 * (c_acctbal - a)) AS v FROM customer, m
      UNION ALL SELECT '0', 'c_nationkey', abs(-0.2 * (c_nationkey - n)) FROM customer, m
      UNION ALL SELECT '1', 'c_acctbal', abs(0.1 * (c_acctbal - a)) FROM customer, m
      UNION ALL SELECT '1', 'c_nationkey', abs(0.3 * (c_nationkey - n)) FROM customer, m)
SELECT class, feature, round(avg(v), 6) AS mean_abs_shap FROM v GROUP BY 1, 2""", "eval")
def q_linear_shap(spark, sf):
    c = t(spark, sf, "customer")
    out = EV.linear_shap(c, "c_custkey", ["c_acctbal", "c_nationkey"], _COEF)
    return out.select("class", "feature", r6("mean_abs_shap").alias("mean_abs_shap"))
