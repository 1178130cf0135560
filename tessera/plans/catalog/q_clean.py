"""Projections, filters, fills and contracts (2.2) on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions._util import r6
from ...operators import clean as CL
from . import query
from ._common import t


@query("filter_not_null", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_shipdate IS NOT NULL AND l_partkey IS NOT NULL""", "filter")
def q_filter_not_null(spark, sf):
    li = t(spark, sf, "lineitem")
    return CL.filter_not_null(li, ["l_shipdate", "l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("filter_in_list", """
SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'system')""", "filter")
def q_filter_in_list(spark, sf):
    c = t(spark, sf, "conversations")
    return CL.filter_in_list(c, "role", ["user", "system"]).select("conv_id", "turn", "role")


@query("filter_drop_templates", """
SELECT doc_id FROM documents
WHERE NOT coalesce(regexp_matches(lower(text), 'licensed under|all rights reserved'), false)""",
       "filter")
def q_filter_drop_templates(spark, sf):
    d = t(spark, sf, "documents")
    return CL.filter_drop_templates(d, "text", ["licensed under", "all rights reserved"]).select(
        "doc_id")


@query("filter_drop_sentinel", """
SELECT doc_id, quality - toxic AS label FROM labels WHERE (quality - toxic) IS DISTINCT FROM -1""",
       "filter")
def q_filter_drop_sentinel(spark, sf):
    lb = t(spark, sf, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("label"))
    return CL.filter_drop_sentinel(lb, "label", -1)


@query("filter_numeric_class", """
SELECT o_orderkey, CAST(TRY_CAST(substr(o_orderpriority, 1, CAST(1 + (o_orderkey % 2) AS INTEGER)) AS DOUBLE)
                      AS INTEGER) AS class
FROM orders
WHERE TRY_CAST(substr(o_orderpriority, 1, CAST(1 + (o_orderkey % 2) AS INTEGER)) AS DOUBLE) IS NOT NULL""",
       "filter")
def q_filter_numeric_class(spark, sf):
    o = t(spark, sf, "orders")
    cls = F.substring("o_orderpriority", F.lit(1), (F.pmod("o_orderkey", F.lit(2)) + 1).cast("int"))
    return CL.filter_numeric_class(o.select("o_orderkey", cls.alias("class")), "class")


@query("filter_contains_ci", """
SELECT doc_id, source FROM documents WHERE source ILIKE '%SRC1%'""", "filter")
def q_filter_contains_ci(spark, sf):
    d = t(spark, sf, "documents")
    return CL.filter_contains_ci(d, "source", "SRC1").select("doc_id", "source")


@query("filter_latest_n_runs", """
WITH r AS (SELECT event_id, CAST(nullif(regexp_extract('iter' || CAST(day(ts) AS VARCHAR), '(\\d+)', 1), '')
                                AS BIGINT) AS iter_num FROM events)
SELECT event_id, iter_num FROM r
WHERE iter_num > (SELECT max(iter_num) FROM r) - 10 AND iter_num <= (SELECT max(iter_num) FROM r)""",
       "filter")
def q_filter_latest_n_runs(spark, sf):
    e = t(spark, sf, "events")
    tagged = e.select("event_id", F.concat(F.lit("iter"), F.dayofmonth("ts").cast("string"))
                      .alias("tag"))
    return CL.filter_latest_n_runs(tagged, "tag", 10).select("event_id", "iter_num")


@query("filter_rare_classes", """
SELECT p_partkey, p_size FROM part
WHERE p_size IN (SELECT p_size FROM part GROUP BY p_size HAVING count(*) >= 45)""", "filter")
def q_filter_rare_classes(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_size")
    return CL.filter_rare_classes(p, "p_size", 45)


@query("rename_map", """
SELECT c_custkey AS subject_id, c_mktsegment AS segment, c_nationkey FROM customer""", "filter")
def q_rename_map(spark, sf):
    c = t(spark, sf, "customer")
    return CL.rename_map(CL.select_columns(c, ["c_custkey", "c_mktsegment", "c_nationkey"]),
                         {"c_custkey": "subject_id", "c_mktsegment": "segment"})


@query("normalize_column_names", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""", "filter")
def q_normalize_column_names(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                        "c_mktsegment")
    messy = c.toDF(" C_CustKey", "C Name", "C-NationKey", "c acctbal ", "C_MktSegment")
    return CL.normalize_column_names(messy)


@query("coalesce_duplicate_columns", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(p.p_name, l.l_returnflag) AS label_text
FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON l.l_partkey = p.p_partkey""",
       "filter")
def q_coalesce_duplicate_columns(spark, sf):
    li, p = t(spark, sf, "lineitem"), t(spark, sf, "part").where("p_size > 25")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "p_name", "l_returnflag")
    return CL.coalesce_duplicate_columns(j, ["p_name", "l_returnflag"], "label_text")


@query("fill_constant", """
SELECT c.c_custkey, coalesce(n.n_orders, 0) AS n_orders, coalesce(n.top_priority, 'UNKNOWN') AS top_priority
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, min(o_orderpriority) AS top_priority
                           FROM orders GROUP BY o_custkey) n ON c.c_custkey = n.o_custkey""",
       "filter")
def q_fill_constant(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                   F.min("o_orderpriority").alias("top_priority"))
    j = c.select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").drop(
        "o_custkey")
    return CL.fill_constant(j, {"n_orders": 0, "top_priority": "UNKNOWN"})


@query("fill_median", """
WITH s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS bal,
                  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_nationkey END AS nk FROM customer)
SELECT c_custkey, round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM s)), 6) AS bal,
       round(coalesce(CAST(nk AS DOUBLE), (SELECT quantile_cont(nk, 0.5) FROM s)), 6) AS nk
FROM s""", "filter")
def q_fill_median(spark, sf):
    c = t(spark, sf, "customer")
    s = c.select("c_custkey",
                 F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_acctbal"))
                 .alias("bal"),
                 F.when(F.col("c_mktsegment") == "MACHINERY", None).otherwise(F.col("c_nationkey"))
                 .alias("nk"))
    out = CL.fill_median(s, ["bal", "nk"])
    return out.select("c_custkey", r6("bal").alias("bal"), r6("nk").alias("nk"))


@query("drop_incomplete_rows", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name
FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 40) p ON l.l_partkey = p.p_partkey
WHERE p.p_name IS NOT NULL""", "filter")
def q_drop_incomplete_rows(spark, sf):
    li, p = t(spark, sf, "lineitem"), t(spark, sf, "part").where("p_size > 40")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "p_name")
    return CL.drop_incomplete_rows(j, ["p_name"])


@query("check_class_coverage", """
WITH dom AS (SELECT * FROM (VALUES (0), (1), (2)) v(quality)),
c AS (SELECT CAST(quality AS INTEGER) AS quality, count(*) AS n FROM labels GROUP BY 1)
SELECT coalesce(dom.quality, c.quality) AS quality, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       CASE WHEN dom.quality IS NULL THEN 'unexpected' WHEN c.n IS NULL THEN 'missing' ELSE 'present' END AS status
FROM dom FULL OUTER JOIN c ON dom.quality = c.quality""", "filter")
def q_check_class_coverage(spark, sf):
    lb = t(spark, sf, "labels")
    return CL.check_class_coverage(lb, "quality", [0, 1, 2])


_PRED_SQL = """
preds AS (SELECT l_orderkey AS subject_id, l_returnflag AS model, [l_discount, l_tax] AS probs FROM lineitem)"""


@query("check_model_alignment", f"""
WITH {_PRED_SQL},
nm AS (SELECT count(DISTINCT model) AS n_models FROM preds),
pi AS (SELECT subject_id, count(DISTINCT model) AS m FROM preds GROUP BY 1),
nc AS (SELECT count(*) AS n_common_ids FROM pi WHERE m = (SELECT n_models FROM nm)),
cs AS (SELECT count(DISTINCT len(probs)) AS n_class_sizes, max(len(probs)) AS n_classes FROM preds)
SELECT nm.n_models, cs.n_class_sizes, CAST(cs.n_classes AS INTEGER) AS n_classes, nc.n_common_ids,
       nm.n_models >= 2 AND cs.n_class_sizes = 1 AND nc.n_common_ids > 0 AS ok
FROM nm, cs, nc""", "filter")
def q_check_model_alignment(spark, sf):
    li = t(spark, sf, "lineitem")
    preds = li.select(F.col("l_orderkey").alias("subject_id"), F.col("l_returnflag").alias("model"),
                      F.array("l_discount", "l_tax").alias("probs"))
    return CL.check_model_alignment(preds, "subject_id", "model", "probs")


@query("check_foreign_keys", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l
WHERE l.l_orderkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus <> 'F' AND o.o_orderkey = l.l_orderkey)""",
       "filter")
def q_check_foreign_keys(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders").where("o_orderstatus <> 'F'")
    return CL.check_foreign_keys(li, o, "l_orderkey", "o_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("select_columns", """
SELECT o_orderkey, o_totalprice FROM orders""", "filter")
def q_select_columns(spark, sf):
    return CL.select_columns(t(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])


@query("detect_column", """
SELECT o_orderkey, o_totalprice AS value FROM orders""", "contract")
def q_detect_column(spark, sf):
    o = t(spark, sf, "orders")
    c = CL.detect_column(o, ["o_total", "o_totalprice", "o_price"])
    return o.select("o_orderkey", F.col(c).alias("value"))


@query("check_required_columns", """
SELECT doc_id, n_chars FROM documents""", "contract")
def q_check_required_columns(spark, sf):
    d = CL.check_required_columns(t(spark, sf, "documents"), ["doc_id", "text", "n_chars"])
    return d.select("doc_id", "n_chars")
