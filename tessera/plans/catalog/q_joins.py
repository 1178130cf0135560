"""Joins (2.4) and set operations (2.7) on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions._util import r6
from ...operators import joins as J
from ...operators import sets as S
from . import query
from ._common import t


def _adm(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"),
                                         F.col("o_orderkey").alias("hadm_id"), "o_orderpriority")


def _dx(spark, sf):
    li = t(spark, sf, "lineitem")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"),
        "l_linenumber", "l_partkey", "l_returnflag")


_DX_SQL = """dx AS (SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, l.l_linenumber, l.l_partkey,
                  l.l_returnflag FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


@query("join_left_composite", f"""
WITH {_DX_SQL},
svc AS (SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, min(l_returnflag) AS service
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT a.subject_id, a.hadm_id, a.o_orderpriority, s.service
FROM (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderpriority FROM orders) a
LEFT JOIN svc s ON a.subject_id = s.subject_id AND a.hadm_id = s.hadm_id""", "join")
def q_join_left_composite(spark, sf):
    svc = _dx(spark, sf).select("subject_id", "hadm_id", F.col("l_returnflag").alias("service"))
    return J.join_left_composite(_adm(spark, sf), svc, ["subject_id", "hadm_id"], dedup=True)


@query("join_left_composite_fanout", f"""
WITH {_DX_SQL}
SELECT a.subject_id, a.hadm_id, a.o_orderpriority, d.l_returnflag AS service
FROM (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderpriority FROM orders) a
LEFT JOIN dx d ON a.subject_id = d.subject_id AND a.hadm_id = d.hadm_id""", "join")
def q_join_left_composite_fanout(spark, sf):
    svc = _dx(spark, sf).select("subject_id", "hadm_id", F.col("l_returnflag").alias("service"))
    return J.join_left_composite(_adm(spark, sf), svc, ["subject_id", "hadm_id"], dedup=False)


@query("join_left_single", """
SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, coalesce(c.c_acctbal, 0.0) AS c_acctbal
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) c ON o.o_custkey = c.c_custkey""",
       "join")
def q_join_left_single(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf, "customer").where("c_nationkey < 20").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return J.join_left_single(o, c, "o_custkey", fill={"c_acctbal": 0.0})


@query("join_left_flag_fill", """
SELECT o.o_orderkey, coalesce(f.n_items, 0) AS n_items, coalesce(f.any_return, false) AS any_return
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, bool_or(l_returnflag = 'R') AS any_return
                         FROM lineitem GROUP BY l_orderkey) f ON o.o_orderkey = f.l_orderkey""", "join")
def q_join_left_flag_fill(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey")
    li = t(spark, sf, "lineitem")
    f = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_items"), F.bool_or(F.col("l_returnflag") == "R").alias("any_return"))
    return J.join_left_flag_fill(o, f, ["o_orderkey"], {"n_items": 0, "any_return": False})


@query("join_left_renamed", """
SELECT c.c_custkey, c.c_nationkey, n.n_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""", "join")
def q_join_left_renamed(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    return J.join_left_renamed(c, n, [("c_nationkey", "n_nationkey")])


@query("join_full_outer", """
WITH perf AS (SELECT l_returnflag AS model, round(avg(l_discount), 6) AS mean_discount FROM lineitem
              WHERE l_returnflag <> 'N' GROUP BY 1),
res AS (SELECT l_returnflag AS model, count(*) AS n_rows FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT coalesce(p.model, r.model) AS model, p.mean_discount, r.n_rows
FROM perf p FULL OUTER JOIN res r ON p.model = r.model""", "join")
def q_join_full_outer(spark, sf):
    li = t(spark, sf, "lineitem")
    perf = li.where("l_returnflag <> 'N'").groupBy(F.col("l_returnflag").alias("model")).agg(
        r6(F.avg("l_discount")).alias("mean_discount"))
    res = li.where("l_returnflag <> 'A'").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return J.join_full_outer(perf, res, "model")


_VAL_IDS = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("join_semi_split", f"""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN ({_VAL_IDS})""", "join")
def q_join_semi_split(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    ids = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey"))
    return J.join_semi_split(o, ids, "o_custkey")


@query("join_anti_split", f"""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN ({_VAL_IDS})""", "join")
def q_join_anti_split(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    ids = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey"))
    return J.join_anti_split(o, ids, "o_custkey")


@query("join_inner_align", """
SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id""", "join")
def q_join_inner_align(spark, sf):
    lb = t(spark, sf, "labels").select("doc_id", "quality")
    d = t(spark, sf, "documents").select("doc_id", "lang")
    return J.join_inner_align(lb, d, "doc_id")


@query("join_intersect_ids", """
SELECT l_orderkey FROM lineitem GROUP BY l_orderkey
HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""", "join")
def q_join_intersect_ids(spark, sf):
    li = t(spark, sf, "lineitem")
    return J.join_intersect_ids(li, "l_orderkey", "l_returnflag")


_DAILY_SQL = """daily AS (SELECT CAST(day(ts) AS BIGINT) AS run, event_type AS model, avg(value) AS v
                FROM events GROUP BY 1, 2)"""


def _daily(spark, sf):
    e = t(spark, sf, "events")
    return e.groupBy(F.dayofmonth("ts").cast("long").alias("run"),
                     F.col("event_type").alias("model")).agg(F.avg("value").alias("v"))


@query("join_pairwise_models", f"""
WITH {_DAILY_SQL}
SELECT a.run, a.model AS model_1, b.model AS model_2, round(a.v, 6) AS value_1, round(b.v, 6) AS value_2
FROM daily a JOIN daily b ON a.run = b.run AND a.model < b.model""", "join")
def q_join_pairwise_models(spark, sf):
    out = J.join_pairwise_models(_daily(spark, sf), "run", "model", "v")
    return out.select("run", "model_1", "model_2", r6("value_1").alias("value_1"),
                      r6("value_2").alias("value_2"))


@query("join_wide_features", """
SELECT c.c_custkey, o.n_orders, l.n_items
FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           GROUP BY 1) l ON c.c_custkey = l.o_custkey""", "join")
def q_join_wide_features(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey")
    o = t(spark, sf, "orders")
    li = t(spark, sf, "lineitem")
    a = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
         .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_items")))
    return J.join_wide_features([c, a, b], "c_custkey")


# -- set operations -------------------------------------------------------------------

@query("union_metrics", """
SELECT l_returnflag AS model, round(avg(l_discount), 6) AS precision, NULL::DOUBLE AS recall
FROM lineitem GROUP BY 1
UNION ALL
SELECT l_returnflag AS model, NULL::DOUBLE AS precision, round(avg(l_tax), 6) AS recall
FROM lineitem GROUP BY 1""", "set")
def q_union_metrics(spark, sf):
    li = t(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_returnflag").alias("model")).agg(r6(F.avg("l_discount")).alias("precision"))
    b = li.groupBy(F.col("l_returnflag").alias("model")).agg(r6(F.avg("l_tax")).alias("recall"))
    return S.union_metrics([a, b])


@query("set_intersect_ids", """
SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'
INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'
INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O'""", "set")
def q_set_intersect_ids(spark, sf):
    li = t(spark, sf, "lineitem")
    return S.set_intersect_ids([li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"),
                                li.where("l_linestatus = 'O'")], "l_orderkey")


@query("set_except_classes", """
SELECT quality FROM (VALUES (0), (1), (2), (3)) v(quality)
EXCEPT SELECT CAST(quality AS INTEGER) FROM labels""", "set")
def q_set_except_classes(spark, sf):
    return S.set_except_classes(t(spark, sf, "labels"), "quality", [0, 1, 2, 3])


@query("set_union_models", f"""
WITH {_DAILY_SQL},
pairs AS (SELECT a.model AS model_1, b.model AS model_2 FROM daily a JOIN daily b
          ON a.run = b.run AND a.model < b.model WHERE a.model <> 'view')
SELECT model_1 AS model FROM pairs UNION SELECT model_2 FROM pairs""", "set")
def q_set_union_models(spark, sf):
    pairs = J.join_pairwise_models(_daily(spark, sf), "run", "model", "v").where(
        "model_1 <> 'view'")
    return S.set_union_models(pairs)


@query("distinct_pairs", """
SELECT DISTINCT o.o_custkey, l.l_orderkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag = 'R'""", "set")
def q_distinct_pairs(spark, sf):
    li = t(spark, sf, "lineitem").where("l_returnflag = 'R'")
    o = t(spark, sf, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return S.distinct_pairs(j, ["o_custkey", "l_orderkey"])


@query("distinct_sample", """
SELECT DISTINCT c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')
ORDER BY c_name LIMIT 10""", "set")
def q_distinct_sample(spark, sf):
    return S.distinct_sample(t(spark, sf, "customer"), "c_name", "Customer#00000001", 10)
