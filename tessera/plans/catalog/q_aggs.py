"""Aggregations, pivots and summaries (2.5) on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions._util import r6
from ...operators import aggs as G
from . import query
from ._common import brand_code, t

_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("agg_collect_codes", """
SELECT l.l_orderkey, string_agg(regexp_extract(p.p_brand, '#(\\d+)', 1), ',' ORDER BY regexp_extract(p.p_brand, '#(\\d+)', 1)) AS codes
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey""", "agg")
def q_agg_collect_codes(spark, sf):
    li, p = t(spark, sf, "lineitem"), t(spark, sf, "part")
    dx = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey",
                                                                      brand_code().alias("code"))
    out = G.agg_collect_codes(dx, ["l_orderkey"], "code", "codes")
    return out.select("l_orderkey", F.array_join("codes", ",").alias("codes"))


@query("agg_any_match", """
SELECT l.l_orderkey, coalesce(bool_or(starts_with(regexp_extract(p.p_brand, '#(\\d+)', 1), '1')), false) AS any_hit
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey""", "agg")
def q_agg_any_match(spark, sf):
    li, p = t(spark, sf, "lineitem"), t(spark, sf, "part")
    dx = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return G.agg_any_match(dx, ["l_orderkey"], brand_code().startswith("1"), "any_hit")


@query("agg_count_rows", """
SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey""", "agg")
def q_agg_count_rows(spark, sf):
    return G.agg_count_rows(t(spark, sf, "orders"), ["o_custkey"], "n_orders")


@query("agg_count_matching", """
SELECT l_orderkey, count_if(l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY l_orderkey""",
       "agg")
def q_agg_count_matching(spark, sf):
    li = t(spark, sf, "lineitem")
    return G.agg_count_matching(li, ["l_orderkey"], F.col("l_returnflag") == "R", "n_returned")


@query("agg_count_matching_compat", """
SELECT l_orderkey, count(*) AS n_returned FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
GROUP BY l_orderkey""", "agg")
def q_agg_count_matching_compat(spark, sf):
    li = t(spark, sf, "lineitem")
    return G.agg_count_matching(li, ["l_orderkey"], F.col("l_returnflag") == "R", "n_returned",
                                compat=True)


@query("agg_max_bool", """
SELECT o.o_custkey, coalesce(bool_or(l.l_returnflag = 'R'), false) AS ever_returned
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey""", "agg")
def q_agg_max_bool(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return G.agg_max_bool(j, ["o_custkey"], F.col("l_returnflag") == "R", "ever_returned")


@query("agg_count_distinct", """
SELECT o.o_custkey, count(DISTINCT l.l_partkey) AS n_parts
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey""", "agg")
def q_agg_count_distinct(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return G.agg_count_distinct(j, ["o_custkey"], "l_partkey", "n_parts")


@query("agg_count_nonnull", """
SELECT l.l_orderkey, count(p.p_name) AS n_named
FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size <= 10) p ON l.l_partkey = p.p_partkey
GROUP BY l.l_orderkey""", "agg")
def q_agg_count_nonnull(spark, sf):
    li, p = t(spark, sf, "lineitem"), t(spark, sf, "part").where("p_size <= 10")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return G.agg_count_nonnull(j, ["l_orderkey"], "p_name", "n_named")


@query("agg_mean", """
SELECT l_orderkey, round(avg(l_quantity), 6) AS mean_qty FROM lineitem GROUP BY l_orderkey""", "agg")
def q_agg_mean(spark, sf):
    out = G.agg_mean(t(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "mean_qty")
    return out.select("l_orderkey", r6("mean_qty").alias("mean_qty"))


_WS = ("[\\t\\n\\x{0b}\\f\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


@query("agg_notes", f"""
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(text) AS note_count,
       round(avg(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> ''))), 6) AS avg_note_length
FROM conversations GROUP BY conv_id""", "agg")
def q_agg_notes(spark, sf):
    c = t(spark, sf, "conversations")
    out = G.agg_notes(c, ["conv_id"], "text", "turn")
    return out.select("conv_id", "text", "note_count", r6("avg_note_length").alias("avg_note_length"))


@query("agg_concat_text", """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role) AS text FROM conversations GROUP BY conv_id""", "agg")
def q_agg_concat_text(spark, sf):
    return G.agg_concat_text(t(spark, sf, "conversations"), ["conv_id"], "text", ["turn", "role"])


@query("agg_max_label", """
SELECT d.source, max(l.quality) AS quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id
GROUP BY d.source""", "agg")
def q_agg_max_label(spark, sf):
    lb, d = t(spark, sf, "labels"), t(spark, sf, "documents").select("doc_id", "source")
    return G.agg_max_label(lb.join(d, "doc_id"), ["source"], "quality")


@query("agg_last_nonnull", """
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v,
                  CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS et FROM events)
SELECT user_id, arg_max(v, (ts IS NULL, ts, event_id)) FILTER (WHERE v IS NOT NULL) AS v,
       arg_max(et, (ts IS NULL, ts, event_id)) FILTER (WHERE et IS NOT NULL) AS et
FROM e GROUP BY user_id""", "agg")
def q_agg_last_nonnull(spark, sf):
    e = t(spark, sf, "events")
    s = e.select("user_id", "ts", "event_id",
                 F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("v"),
                 F.when(F.col("event_type") == "view", None).otherwise(F.col("event_type")).alias("et"))
    return G.agg_last_nonnull(s, ["user_id"], "ts", ["v", "et"], tiebreak="event_id")


_PIVOT_SQL = ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{x}'), 6) AS {x}" for x in _TYPES)


@query("pivot_mean", f"""
SELECT user_id, {_PIVOT_SQL} FROM events GROUP BY user_id""", "agg")
def q_pivot_mean(spark, sf):
    out = G.pivot_mean(t(spark, sf, "events"), ["user_id"], "event_type", "value", _TYPES)
    return out.select("user_id", *[r6(x).alias(x) for x in _TYPES])


_FIRST_SQL = ", ".join(f"arg_min(value, event_id) FILTER (WHERE event_type = '{x}') AS {x}" for x in _TYPES)


@query("pivot_first", f"""
SELECT CAST(day(ts) AS BIGINT) AS run, {_FIRST_SQL} FROM events GROUP BY 1""", "agg")
def q_pivot_first(spark, sf):
    e = t(spark, sf, "events").withColumn("run", F.dayofmonth("ts").cast("long"))
    return G.pivot_first(e, ["run"], "event_type", "value", _TYPES, order="event_id")


@query("pivot_run_model_mean", f"""
SELECT CAST(day(ts) AS BIGINT) AS run, {_PIVOT_SQL} FROM events GROUP BY 1""", "agg")
def q_pivot_run_model_mean(spark, sf):
    e = t(spark, sf, "events").withColumn("run", F.dayofmonth("ts").cast("long"))
    out = G.pivot_run_model_mean(e, "run", "event_type", "value", _TYPES)
    return out.select("run", *[r6(x).alias(x) for x in _TYPES])


@query("agg_macro_by_run", """
SELECT l_returnflag AS model, l_linestatus AS run, round(avg(l_discount), 6) AS macro_precision,
       round(avg(l_tax), 6) AS macro_recall
FROM lineitem GROUP BY 1, 2""", "agg")
def q_agg_macro_by_run(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"),
                                         F.col("l_linestatus").alias("run"), "l_discount", "l_tax")
    out = G.agg_macro_by_run(li, "model", "run", {"l_discount": "macro_precision",
                                                  "l_tax": "macro_recall"})
    return out.select("model", "run", r6("macro_precision").alias("macro_precision"),
                      r6("macro_recall").alias("macro_recall"))


_DAILY_SQL = """daily AS (SELECT CAST(day(ts) AS BIGINT) AS run, event_type AS model, avg(value) AS v
                FROM events GROUP BY 1, 2)"""


def _daily(spark, sf):
    e = t(spark, sf, "events")
    return e.groupBy(F.dayofmonth("ts").cast("long").alias("run"),
                     F.col("event_type").alias("model")).agg(F.avg("value").alias("v"))


@query("agg_mean_std", f"""
WITH {_DAILY_SQL}
SELECT model, round(avg(v), 6) AS v_mean, round(stddev_samp(v), 6) AS v_std FROM daily GROUP BY model""",
       "agg")
def q_agg_mean_std(spark, sf):
    out = G.agg_mean_std(_daily(spark, sf), ["model"], ["v"])
    return out.select("model", r6("v_mean").alias("v_mean"), r6("v_std").alias("v_std"))


@query("agg_importance_summary", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, max(value) AS max, count(value) AS count
FROM events GROUP BY event_type""", "agg")
def q_agg_importance_summary(spark, sf):
    out = G.agg_importance_summary(t(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max",
                      "count")


_TAG_SPARK = {"view": "tfidf", "click": "lstm", "error": "gru", "purchase": "tabular_rf_xgb",
              "signup": "stacker_multiclass"}
_TAG_SQL = """(CASE event_type WHEN 'view' THEN 'tfidf' WHEN 'click' THEN 'lstm' WHEN 'error' THEN 'gru'
               WHEN 'purchase' THEN 'tabular_rf_xgb' ELSE 'stacker_multiclass' END
               || '_run' || CAST(day(ts) AS VARCHAR))"""
_FAMILY_SQL = """CASE WHEN tag LIKE '%tabular_rf_xgb%' THEN 'RF+XGB' WHEN tag LIKE '%tabular_logreg%' THEN 'Logistic Regression'
  WHEN tag LIKE '%clinicalbert%' THEN 'ClinicalBERT' WHEN tag LIKE '%transformer%' THEN 'Transformer'
  WHEN tag LIKE '%gru%' THEN 'GRU' WHEN tag LIKE '%lstm%' THEN 'LSTM' WHEN tag LIKE '%tfidf%' THEN 'TF-IDF'
  WHEN tag LIKE '%stacker_multiclass%' THEN 'Meta-Learner' ELSE 'Other' END"""
_LOG_SQL = f"""log AS (SELECT event_id, lower({_TAG_SQL}) AS tag, value AS cpu_pct, value / 100 AS gpu_hrs,
                       CAST(user_id AS DOUBLE) AS disk_used_gb, value / 3600 AS elapsed_hr FROM events),
fam AS (SELECT *, {_FAMILY_SQL} AS model_type,
               coalesce(CAST(nullif(regexp_extract(tag, '(?:iter|run)(\\d+)', 1), '') AS BIGINT), 0) AS iter_num
        FROM log),
last AS (SELECT * FROM fam QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY iter_num DESC, event_id DESC) <= 30),
res AS (SELECT model_type, avg(cpu_pct) AS cpu_pct, avg(gpu_hrs) AS gpu_hrs, avg(disk_used_gb) AS disk_used_gb,
               avg(elapsed_hr) AS elapsed_hr FROM last GROUP BY model_type)"""


def _log(spark, sf):
    e = t(spark, sf, "events")
    tag = F.lower(F.concat(F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v))
                                        for k, v in _TAG_SPARK.items()]),
                           F.lit("_run"), F.dayofmonth("ts").cast("string")))
    return e.select("event_id", tag.alias("tag"), F.col("value").alias("cpu_pct"),
                    (F.col("value") / 100).alias("gpu_hrs"),
                    F.col("user_id").cast("double").alias("disk_used_gb"),
                    (F.col("value") / 3600).alias("elapsed_hr"), "value")


@query("agg_resource_by_model", f"""
WITH {_LOG_SQL}
SELECT model_type, round(cpu_pct, 6) AS cpu_pct, round(gpu_hrs, 6) AS gpu_hrs,
       round(disk_used_gb, 6) AS disk_used_gb, round(elapsed_hr, 6) AS elapsed_hr FROM res""", "agg")
def q_agg_resource_by_model(spark, sf):
    out = G.agg_resource_by_model(_log(spark, sf), 30, "tag", order="event_id")
    return out.select("model_type", *[r6(c).alias(c) for c in
                                      ("cpu_pct", "gpu_hrs", "disk_used_gb", "elapsed_hr")])


_NOTES = {"TF-IDF": "cpu only", "LSTM": "gpu", "GRU": "gpu"}


@query("benchmark_summary", f"""
WITH {_LOG_SQL},
perf AS (SELECT model_type, avg(cpu_pct) AS score_mean, stddev_samp(cpu_pct) AS score_std FROM fam
         WHERE model_type <> 'GRU' GROUP BY 1)
SELECT coalesce(p.model_type, r.model_type) AS model_type, round(p.score_mean, 6) AS score_mean,
       round(p.score_std, 6) AS score_std, round(r.cpu_pct, 6) AS cpu_pct, round(r.gpu_hrs, 6) AS gpu_hrs,
       CASE coalesce(p.model_type, r.model_type) WHEN 'TF-IDF' THEN 'cpu only' WHEN 'LSTM' THEN 'gpu'
            WHEN 'GRU' THEN 'gpu' ELSE NULL END AS notes
FROM perf p FULL OUTER JOIN res r ON p.model_type = r.model_type""", "agg")
def q_benchmark_summary(spark, sf):
    from ...functions.codes import bucket_model_tag
    log = _log(spark, sf)
    fam = log.withColumn("model_type", bucket_model_tag("tag"))
    perf = G.agg_mean_std(fam.where("model_type <> 'GRU'"), ["model_type"], ["cpu_pct"])
    perf = perf.select("model_type", F.col("cpu_pct_mean").alias("score_mean"),
                       F.col("cpu_pct_std").alias("score_std"))
    res = G.agg_resource_by_model(log, 30, "tag", metrics=("cpu_pct", "gpu_hrs"), order="event_id")
    out = G.benchmark_summary(perf, res, "model_type", _NOTES)
    return out.select("model_type", *[r6(c).alias(c) for c in
                                      ("score_mean", "score_std", "cpu_pct", "gpu_hrs")], "notes")


@query("class_distribution", """
WITH dom AS (SELECT * FROM (VALUES (-1), (0), (1), (2)) v(label)),
c AS (SELECT CAST(quality - toxic AS INTEGER) AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT dom.label, coalesce(c.n, 0) AS n FROM dom LEFT JOIN c ON dom.label = c.label
UNION ALL SELECT c.label, c.n FROM c WHERE c.label IS NULL OR c.label NOT IN (-1, 0, 1, 2)""", "agg")
def q_class_distribution(spark, sf):
    lb = t(spark, sf, "labels").select((F.col("quality") - F.col("toxic")).alias("label"))
    return G.class_distribution(lb, "label", [-1, 0, 1, 2])


@query("median_global", """
SELECT round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders""", "agg")
def q_median_global(spark, sf):
    return G.median_global(t(spark, sf, "orders"), "o_totalprice").select(r6("median").alias("median"))


@query("note_stats", """
WITH a AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2),
p AS (SELECT conv_id, count(*) AS n_adm FROM a GROUP BY 1)
SELECT round(avg(n), 6) AS mean_notes_per_admission, max(n) AS max_notes_per_admission,
       count(*) AS n_admissions, round(quantile_cont(n, 0.95), 6) AS p95_notes_per_admission,
       (SELECT round(avg(n_adm), 6) FROM p) AS mean_admissions_per_patient,
       (SELECT count(*) FROM p) AS n_patients
FROM a""", "agg")
def q_note_stats(spark, sf):
    out = G.note_stats(t(spark, sf, "conversations"), "conv_id", "role")
    return out.select(r6("mean_notes_per_admission").alias("mean_notes_per_admission"),
                      "max_notes_per_admission", "n_admissions",
                      r6("p95_notes_per_admission").alias("p95_notes_per_admission"),
                      r6("mean_admissions_per_patient").alias("mean_admissions_per_patient"),
                      "n_patients")


_CUST_TYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
               ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query("eda_overview", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{ty}' AS dtype, count({c}) AS non_null, count(*) AS \"rows\" FROM customer"
    for c, ty in _CUST_TYPES), "agg")
def q_eda_overview(spark, sf):
    return G.eda_overview(t(spark, sf, "customer").select(*[c for c, _ in _CUST_TYPES]))


@query("eda_histogram", """
WITH mm AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((o_totalprice - lo) / ((hi - lo) / 40)) + 1, 40) END
                  AS INTEGER) AS bin FROM orders, mm WHERE o_totalprice IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
dom AS (SELECT CAST(unnest(range(1, 41)) AS INTEGER) AS bin)
SELECT dom.bin, round(lo + (dom.bin - 1) * (hi - lo) / 40, 6) AS bin_lo, round(lo + dom.bin * (hi - lo) / 40, 6) AS bin_hi,
       coalesce(c.n, 0) AS n
FROM dom CROSS JOIN mm LEFT JOIN c ON dom.bin = c.bin""", "agg")
def q_eda_histogram(spark, sf):
    out = G.eda_histogram(t(spark, sf, "orders"), "o_totalprice", 40)
    return out.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n")


@query("eda_category_counts", """
SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment""", "agg")
def q_eda_category_counts(spark, sf):
    return G.eda_category_counts(t(spark, sf, "customer"), "c_mktsegment")


@query("eda_box_stats", """
SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.0), 6) AS min,
       round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
       round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(quantile_cont(o_totalprice, 1.0), 6) AS max
FROM orders GROUP BY 1""", "agg")
def q_eda_box_stats(spark, sf):
    out = G.eda_box_stats(t(spark, sf, "orders"), "o_orderstatus", "o_totalprice")
    return out.select("o_orderstatus", *[r6(c).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query("duration_totals", """
SELECT count(value) AS runs, round(sum(value), 6) AS total_sec, round(avg(value), 6) AS avg_sec FROM events""",
       "agg")
def q_duration_totals(spark, sf):
    out = G.duration_totals(t(spark, sf, "events"), "value")
    return out.select("runs", r6("total_sec").alias("total_sec"), r6("avg_sec").alias("avg_sec"))


@query("best_run", """
SELECT run, round(mean_score, 6) AS mean_score FROM (
  SELECT CAST(day(ts) AS BIGINT) AS run, avg(value) AS mean_score FROM events GROUP BY 1)
ORDER BY mean_score DESC, run ASC LIMIT 1""", "agg")
def q_best_run(spark, sf):
    e = t(spark, sf, "events").withColumn("run", F.dayofmonth("ts").cast("long"))
    out = G.best_run(e, "run", "value")
    return out.select("run", r6("mean_score").alias("mean_score"))


@query("min_p_by_pair", """
SELECT l_returnflag AS model_1, l_linestatus AS model_2, min(l_discount) AS min_p
FROM lineitem GROUP BY 1, 2""", "agg")
def q_min_p_by_pair(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model_1"),
                                         F.col("l_linestatus").alias("model_2"),
                                         F.col("l_discount").alias("p_value"))
    return G.min_p_by_pair(li)
