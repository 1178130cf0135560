"""Paired significance tests (2.10): runs = days of ``events``, models =
event types, value = daily mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions._util import r6
from ...operators import stats as ST
from . import query
from ._common import t


def _daily(spark, sf):
    e = t(spark, sf, "events")
    return e.groupBy(F.dayofmonth("ts").cast("long").alias("run"),
                     F.col("event_type").alias("model")).agg(F.avg("value").alias("v"))


# DuckDB form of the same test: pairs, signed ranks with average ties, exact
# null distribution by a list DP (n <= 50, no ties/zeros), Holm step-down.
_WILCOXON_SQL = """
WITH daily AS (SELECT CAST(day(ts) AS BIGINT) AS run, event_type AS model, avg(value) AS v
               FROM events GROUP BY 1, 2),
pairs AS (SELECT a.model AS model_1, b.model AS model_2, a.v - b.v AS d
          FROM daily a JOIN daily b ON a.run = b.run AND a.model < b.model),
np AS (SELECT model_1, model_2, count(*) AS n_pairs FROM pairs GROUP BY 1, 2 HAVING count(*) >= 5),
nz AS (SELECT model_1, model_2, d, abs(d) AS ad FROM pairs WHERE d <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY model_1, model_2 ORDER BY ad)
                 + (count(*) OVER (PARTITION BY model_1, model_2, ad) - 1) / 2.0 AS r,
              count(*) OVER (PARTITION BY model_1, model_2, ad) AS t FROM nz),
w AS (SELECT model_1, model_2, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp,
             sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm, max(t) AS max_tie FROM rk GROUP BY 1, 2),
st AS (SELECT np.model_1, np.model_2, np.n_pairs, coalesce(w.n, 0) AS n, coalesce(w.max_tie, 1) AS max_tie,
              least(coalesce(w.wp, 0.0), coalesce(w.wm, 0.0)) AS statistic
       FROM np LEFT JOIN w ON np.model_1 = w.model_1 AND np.model_2 = w.model_2),
ex AS (SELECT *, list_reduce(range(1, CAST(n AS BIGINT) + 1),
                   lambda acc, i: list_transform(acc, lambda x, k: x + CASE WHEN k - 1 >= i THEN acc[k - i] ELSE CAST(0 AS DOUBLE) END),
                   list_transform(range(0, CAST(n * (n + 1) / 2 AS BIGINT) + 1), lambda k: CASE WHEN k = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
                 ) AS dist FROM st),
pv AS (SELECT model_1, model_2, n_pairs, statistic,
              CASE WHEN n = 0 THEN 1.0
                   ELSE least(1.0, 2 * list_sum(dist[1:CAST(floor(statistic) AS BIGINT) + 1]) / pow(2.0, n)) END AS p_value,
              n, max_tie
       FROM ex)
"""


@query("wilcoxon_unadjusted", _WILCOXON_SQL + """
SELECT model_1, model_2, n_pairs, round(statistic, 6) AS statistic, round(p_value, 12) AS p_value,
       p_value < 0.05 AS significant FROM pv""", "stats")
def q_wilcoxon_unadjusted(spark, sf):
    out = ST.wilcoxon_unadjusted(_daily(spark, sf), "run", "model", "v", 5)
    return out.select("model_1", "model_2", "n_pairs", r6("statistic").alias("statistic"),
                      F.round("p_value", 12).alias("p_value"), "significant")


@query("wilcoxon_signed_rank", _WILCOXON_SQL + """,
h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model_1, model_2) + 1) * p_value AS step FROM pv),
a AS (SELECT *, max(step) OVER (ORDER BY p_value, model_1, model_2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj
      FROM h)
SELECT model_1, model_2, n_pairs, round(statistic, 6) AS statistic, round(p_value, 12) AS p_value,
       p_value < 0.05 AS significant, round(least(1.0, adj), 12) AS p_value_adj, adj <= 0.05 AS significant_adj
FROM a""", "stats")
def q_wilcoxon_signed_rank(spark, sf):
    out = ST.wilcoxon_signed_rank(_daily(spark, sf), "run", "model", "v", 5)
    return out.select("model_1", "model_2", "n_pairs", r6("statistic").alias("statistic"),
                      F.round("p_value", 12).alias("p_value"), "significant",
                      F.round("p_value_adj", 12).alias("p_value_adj"), "significant_adj")


@query("holm_adjust", """
WITH p AS (SELECT l_returnflag AS model_1, l_linestatus AS model_2, avg(l_discount) AS p_value
           FROM lineitem GROUP BY 1, 2),
h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model_1, model_2) + 1) * p_value AS step FROM p),
a AS (SELECT *, max(step) OVER (ORDER BY p_value, model_1, model_2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj FROM h)
SELECT model_1, model_2, round(p_value, 12) AS p_value, round(least(1.0, adj), 12) AS p_value_adj,
       adj <= 0.3 AS significant_adj FROM a""", "stats")
def q_holm_adjust(spark, sf):
    li = t(spark, sf, "lineitem")
    p = li.groupBy(F.col("l_returnflag").alias("model_1"), F.col("l_linestatus").alias("model_2")).agg(
        F.avg("l_discount").alias("p_value"))
    out = ST.holm_adjust(p, "p_value", 0.3)
    return out.select("model_1", "model_2", F.round("p_value", 12).alias("p_value"),
                      F.round("p_value_adj", 12).alias("p_value_adj"), "significant_adj")


@query("p_value_matrix", _WILCOXON_SQL + """,
m AS (SELECT model_1 AS m FROM pv UNION SELECT model_2 FROM pv),
both_ AS (SELECT model_1 AS row_model, model_2 AS col_model, p_value FROM pv
          UNION ALL SELECT model_2, model_1, p_value FROM pv)
SELECT a.m AS row_model, b.m AS col_model,
       round(CASE WHEN a.m = b.m THEN 1.0 ELSE coalesce(x.p_value, 1.0) END, 12) AS p
FROM m a CROSS JOIN m b LEFT JOIN both_ x ON x.row_model = a.m AND x.col_model = b.m""", "stats")
def q_p_value_matrix(spark, sf):
    res = ST.wilcoxon_unadjusted(_daily(spark, sf), "run", "model", "v", 5)
    out = ST.p_value_matrix(res, p="p_value")
    return out.select("row_model", "col_model", F.round("p", 12).alias("p"))
