"""Ordered per-entity procedures, splits and top-k (2.6) on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions._util import r6
from ...operators import seq as Q
from ...plans.ordered import ordered_scan
from . import query
from ._common import t


@query("event_sequence", """
SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_type) AS path FROM events GROUP BY user_id""",
       "seq")
def q_event_sequence(spark, sf):
    out = Q.event_sequence(t(spark, sf, "events"), ["user_id"], "ts", "event_type",
                           tiebreak="event_type", out="seq")
    return out.select("user_id", F.array_join(F.transform("seq", lambda e: e["value"]), ">")
                      .alias("path"))


@query("nested_note_sequences", """
WITH a AS (SELECT conv_id, role, string_agg(text, ' | ' ORDER BY turn) AS notes FROM conversations GROUP BY 1, 2)
SELECT conv_id, string_agg(notes, ' || ' ORDER BY role) AS notes FROM a GROUP BY conv_id""", "seq")
def q_nested_note_sequences(spark, sf):
    out = Q.nested_note_sequences(t(spark, sf, "conversations"), "conv_id", "role", "turn", "text")
    return out.select("conv_id", F.array_join(F.transform("notes", lambda a: F.array_join(a, " | ")),
                                              " || ").alias("notes"))


_WS = ("[\\t\\n\\x{0b}\\f\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


@query("merge_short_notes", f"""
WITH n AS (SELECT conv_id, turn, text, CASE WHEN length(text) >= 100 THEN 1 ELSE 0 END AS is_long FROM conversations),
g AS (SELECT *, coalesce(sum(is_long) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM n)
SELECT conv_id, CAST(2 * g + 1 AS BIGINT) AS note_order, text FROM g WHERE is_long = 1
UNION ALL
SELECT conv_id, CAST(2 * g AS BIGINT) AS note_order,
       regexp_replace(string_agg(text, ' ' ORDER BY turn), '^{_WS}+|{_WS}+$', '', 'g') AS text
FROM g WHERE is_long = 0 GROUP BY conv_id, g""", "seq")
def q_merge_short_notes(spark, sf):
    return Q.merge_short_notes(t(spark, sf, "conversations"), ["conv_id"], "turn", "text", "turn",
                               min_len=100)


@query("last_n_visits", """
SELECT user_id, event_id, visit_rank FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS visit_rank
  FROM events) WHERE visit_rank <= 10""", "seq")
def q_last_n_visits(spark, sf):
    out = Q.last_n_visits(t(spark, sf, "events"), "user_id", "ts", 10, tiebreak="event_id")
    return out.select("user_id", "event_id", F.col("visit_rank").cast("long").alias("visit_rank"))


@query("pad_sequence_mask", """
WITH l AS (SELECT user_id, value, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k, event_type,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
s AS (SELECT user_id, count(*) AS n_real, sum(value) + sum(k) AS total,
             arg_min(event_type, r) AS label, arg_min(value, r) AS last_value,
             arg_max(value, r) AS first_value FROM l WHERE r <= 60 GROUP BY user_id)
SELECT user_id, CAST(n_real AS INTEGER) AS n_real, round(total, 6) AS seq_total, label,
       round(last_value, 6) AS seq_last,
       round(CASE WHEN n_real < 60 THEN 0.0 ELSE first_value END, 6) AS seq_first,
       repeat('0', CAST(60 - n_real AS INTEGER)) || repeat('1', CAST(n_real AS INTEGER)) AS mask
FROM s""", "seq")
def q_pad_sequence_mask(spark, sf):
    e = t(spark, sf, "events").withColumn(
        "k", F.regexp_extract("props", r"(\d+)", 1).cast("double"))
    out = Q.pad_sequence_mask(e, "user_id", "ts", ["value", "k"], "event_type", n=60,
                              tiebreak="event_id")
    flat = F.flatten("seq")
    return out.select(
        "user_id",
        F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
        r6(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)).alias("seq_total"),
        F.col("event_type").alias("label"),
        r6(F.element_at(F.element_at("seq", -1), 1)).alias("seq_last"),
        r6(F.element_at(F.element_at("seq", 1), 1)).alias("seq_first"),
        F.array_join("mask", "").alias("mask"))


@query("tail_n_per_group", """
SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 5""", "seq")
def q_tail_n_per_group(spark, sf):
    out = Q.tail_n_per_group(t(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 5)
    return out.select("event_id", "event_type")


@query("dedup_first", """
SELECT user_id, event_id, ts, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""", "seq")
def q_dedup_first(spark, sf):
    out = Q.dedup_first(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", "ts", "event_type", "value", "props")


def _hash_sql(col: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || coalesce({col}::varchar, ''))"


@query("stratified_split_nulls", f"""
WITH s AS (SELECT o_orderkey + 9007199254740993 AS big_id, o_custkey AS carried,
                  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS label FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash_sql('big_id', 11)}, big_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM s)
SELECT big_id, label, rn <= round(n * 0.2) AS is_val FROM r""", "seq")
def q_stratified_split_nulls(spark, sf):
    """Null labels and ids above 2**53: every input row comes back unchanged."""
    o = t(spark, sf, "orders").select(
        (F.col("o_orderkey") + F.lit(9007199254740993)).alias("big_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("label"))
    return Q.stratified_split(o, "big_id", "label", 0.2, 11)


@query("ordered_scan_nullable", """
SELECT event_id, user_key, row_number() OVER w AS rn,
       round(sum(coalesce(value, 0)) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS running
FROM (SELECT event_id, ts, value, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id + 9007199254740993 END AS user_key
      FROM events)
WINDOW w AS (PARTITION BY user_key ORDER BY ts, event_id)""", "seq")
def q_ordered_scan_nullable(spark, sf):
    """Ranks and running sums with a null group and large integer keys."""
    e = t(spark, sf, "events").select(
        "event_id", "ts", "value",
        F.when(F.col("user_id") % 3 != 0, F.col("user_id") + F.lit(9007199254740993)).alias("user_key"))
    out = ordered_scan(e, ["ts", "event_id"], by=["user_key"], sums=["value"])
    return out.select("event_id", "user_key", F.col("_rn").alias("rn"), r6(F.col("_cum_value")).alias("running"))


@query("stratified_split", f"""
WITH h AS (SELECT o_orderkey, o_orderstatus, {_hash_sql('o_orderkey')} AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) AS rn,
             count(*) OVER (PARTITION BY o_orderstatus) AS n FROM h)
SELECT o_orderkey, o_orderstatus, rn <= round(n * 0.2) AS is_val FROM r""", "seq")
def q_stratified_split(spark, sf):
    o = t(spark, sf, "orders")
    return Q.stratified_split(o, "o_orderkey", "o_orderstatus", 0.2, 42)


@query("split_fallback", f"""
WITH s AS (SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM labels) THEN 9 ELSE quality END AS label
           FROM labels),
h AS (SELECT *, {_hash_sql('doc_id', 7)} AS h FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rn FROM h)
SELECT doc_id, label, rn <= round((SELECT count(*) FROM s) * 0.2) AS is_val FROM r""", "seq")
def q_split_fallback(spark, sf):
    lb = t(spark, sf, "labels")
    mn = lb.agg(F.min("doc_id")).scalar()
    s = lb.select("doc_id", F.when(F.col("doc_id") == mn, F.lit(9)).otherwise(F.col("quality"))
                  .alias("label"))
    return Q.split_fallback(s, "doc_id", "label", 0.2, 7)


@query("stratified_kfold", f"""
WITH h AS (SELECT o_orderkey, o_orderstatus, {_hash_sql('o_orderkey', 3)} AS h FROM orders)
SELECT o_orderkey, o_orderstatus,
       CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM h""", "seq")
def q_stratified_kfold(spark, sf):
    return Q.stratified_kfold(t(spark, sf, "orders"), "o_orderkey", "o_orderstatus", 5, 3)


@query("top_k_features", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20""",
       "seq")
def q_top_k_features(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return Q.top_k_features(p, "p_retailprice", 20, name="p_partkey")


@query("sort_by_metric", """
SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY 1 ORDER BY mean_value DESC""",
       "seq")
def q_sort_by_metric(spark, sf):
    e = t(spark, sf, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean_value"))
    return Q.sort_by_metric(e, "mean_value")


@query("head_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""", "seq")
def q_head_n(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Q.head_n(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("next_run_number", """
SELECT coalesce(max(CAST(nullif(regexp_extract('run' || CAST(day(ts) AS VARCHAR), '(?:iter|run)(\\d+)', 1), '')
                     AS BIGINT)), 0) + 1 AS next_run FROM events""", "seq")
def q_next_run_number(spark, sf):
    e = t(spark, sf, "events").select(F.concat(F.lit("run"), F.dayofmonth("ts").cast("string"))
                                      .alias("tag"))
    return Q.next_run_number(e, "tag")
