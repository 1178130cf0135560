"""Scalar functions (2.3) applied to driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import arrays as A
from ...functions import codes as C
from ...functions import dates as D
from ...functions import text as X
from ...functions._util import r6
from ...operators import encode as EN
from . import query
from ._common import brand_code, t

# -- conditional / code sets ------------------------------------------------------

_CODE_TEXT = "concat('0', regexp_extract(p_brand, '#(\\d+)', 1), '.', CAST(p_size AS VARCHAR))"


@query("normalize_code", f"""
SELECT p_partkey, {_CODE_TEXT} AS raw_code,
       regexp_replace(replace({_CODE_TEXT}, '.', ''), '^0+', '') AS code
FROM part""", "scalar")
def q_normalize_code(spark, sf):
    p = t(spark, sf, "part")
    raw = F.concat(F.lit("0"), brand_code(), F.lit("."), F.col("p_size").cast("string"))
    return p.select("p_partkey", raw.alias("raw_code"), C.normalize_code(raw).alias("code"))


@query("match_code_prefix", """
SELECT p_partkey, coalesce(regexp_matches(regexp_replace(replace(regexp_extract(p_brand, '#(\\d+)', 1), '.', ''), '^0+', ''), '^(?:1|22)'), false) AS hit
FROM part""", "scalar")
def q_match_code_prefix(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", C.match_code_prefix(brand_code(), ["1", "22"]).alias("hit"))


_CATS = {"mh_a": ["11", "12"], "mh_b": ["13", "14", "15"], "pain_a": ["21", "22"],
         "pain_b": ["23", "24", "25"]}


@query("code_category_flags", """
SELECT l.l_orderkey,
  coalesce(bool_or(regexp_matches(regexp_extract(p.p_brand, '#(\\d+)', 1), '^(?:11|12)')), false) AS mh_a,
  coalesce(bool_or(regexp_matches(regexp_extract(p.p_brand, '#(\\d+)', 1), '^(?:13|14|15)')), false) AS mh_b,
  coalesce(bool_or(regexp_matches(regexp_extract(p.p_brand, '#(\\d+)', 1), '^(?:21|22)')), false) AS pain_a,
  coalesce(bool_or(regexp_matches(regexp_extract(p.p_brand, '#(\\d+)', 1), '^(?:23|24|25)')), false) AS pain_b
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY l.l_orderkey""", "scalar")
def q_code_category_flags(spark, sf):
    li, p = t(spark, sf, "lineitem"), t(spark, sf, "part")
    dx = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", brand_code().alias("code"))
    return EN.code_category_flags(dx, ["l_orderkey"], "code", EN.prefix_table(spark, _CATS),
                                  categories=list(_CATS))


@query("label_multiclass", """
SELECT doc_id, CAST(CASE WHEN quality = 1 AND toxic = 1 THEN 2 WHEN toxic = 1 THEN 1
                    WHEN quality = 1 THEN 0 ELSE -1 END AS INTEGER) AS label
FROM labels""", "scalar")
def q_label_multiclass(spark, sf):
    lb = t(spark, sf, "labels")
    return lb.select("doc_id", C.label_multiclass(F.col("quality") == 1, F.col("toxic") == 1)
                     .alias("label"))


@query("label_binary_exclusive", """
SELECT doc_id, CAST(CASE WHEN toxic = 1 AND NOT quality = 1 THEN 1
                    WHEN quality = 1 AND NOT toxic = 1 THEN 0 ELSE -1 END AS INTEGER) AS label
FROM labels""", "scalar")
def q_label_binary_exclusive(spark, sf):
    lb = t(spark, sf, "labels")
    return lb.select("doc_id", C.label_binary_exclusive(F.col("toxic") == 1, F.col("quality") == 1)
                     .alias("label"))


@query("label_membership", """
SELECT c.c_custkey, CASE WHEN h.o_custkey IS NULL THEN 0 ELSE 1 END AS label
FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
                           AND o_totalprice > 400000) h ON c.c_custkey = h.o_custkey""", "scalar")
def q_label_membership(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    hits = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000))
    return EN.label_membership(c.select("c_custkey"), "c_custkey", hits, "o_custkey")


@query("flag_co_occurrence", """
SELECT doc_id, (quality = 1) AND (toxic = 1) AS both_flags FROM labels""", "scalar")
def q_flag_co_occurrence(spark, sf):
    lb = t(spark, sf, "labels")
    return lb.select("doc_id", C.flag_co_occurrence(F.col("quality") == 1, F.col("toxic") == 1)
                     .alias("both_flags"))


@query("flag_threshold", """
SELECT o_custkey, CAST(count(*) >= 12 AS INTEGER) AS many_orders
FROM orders GROUP BY o_custkey""", "scalar")
def q_flag_threshold(spark, sf):
    o = t(spark, sf, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", C.flag_threshold("n", 12).alias("many_orders"))


_SEG_RULES = [("Industrial", ["MACHINERY", "AUTOMOBILE", "BUILD"]), ("Home", ["HOUSE", "FURNI"])]


@query("bucket_by_substring", """
SELECT c_custkey,
  CASE WHEN upper(coalesce(c_mktsegment, 'UNKNOWN')) LIKE '%MACHINERY%'
         OR upper(coalesce(c_mktsegment, 'UNKNOWN')) LIKE '%AUTOMOBILE%'
         OR upper(coalesce(c_mktsegment, 'UNKNOWN')) LIKE '%BUILD%' THEN 'Industrial'
       WHEN upper(coalesce(c_mktsegment, 'UNKNOWN')) LIKE '%HOUSE%'
         OR upper(coalesce(c_mktsegment, 'UNKNOWN')) LIKE '%FURNI%' THEN 'Home'
       ELSE 'Other' END AS segment_group
FROM customer""", "scalar")
def q_bucket_by_substring(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", C.bucket_by_substring("c_mktsegment", _SEG_RULES, "Other")
                    .alias("segment_group"))


_TAG_RULES = [("Ring", ["ring"]), ("Widget", ["widget"]), ("Metal", ["bolt", "gear", "rod"])]


@query("bucket_model_tag", """
SELECT p_partkey,
  CASE WHEN lower(coalesce(CAST(p_name AS VARCHAR), 'nan')) LIKE '%ring%' THEN 'Ring'
       WHEN lower(coalesce(CAST(p_name AS VARCHAR), 'nan')) LIKE '%widget%' THEN 'Widget'
       WHEN lower(coalesce(CAST(p_name AS VARCHAR), 'nan')) LIKE '%bolt%'
         OR lower(coalesce(CAST(p_name AS VARCHAR), 'nan')) LIKE '%gear%'
         OR lower(coalesce(CAST(p_name AS VARCHAR), 'nan')) LIKE '%rod%' THEN 'Metal'
       ELSE 'Other' END AS family
FROM part""", "scalar")
def q_bucket_model_tag(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", C.bucket_model_tag("p_name", _TAG_RULES, "Other").alias("family"))


@query("significance_stars", """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount,
  CASE WHEN l_discount / 10 < 0.001 THEN '***' WHEN l_discount / 10 < 0.01 THEN '**'
       WHEN l_discount / 10 < 0.05 THEN '*' ELSE printf('%.2f', l_discount / 10) END AS stars
FROM lineitem""", "scalar")
def q_significance_stars(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount",
                     C.significance_stars(F.col("l_discount") / 10).alias("stars"))


# -- strings --------------------------------------------------------------------

_KW_RE = "(?:^|[^\\p{L}\\p{N}_])(?:%s)(?:[^\\p{L}\\p{N}_]|$)"


@query("match_keywords", f"""
SELECT doc_id, coalesce(regexp_matches(lower(text), '{_KW_RE % "the|und|les|que"}'), false) AS hit
FROM documents""", "scalar")
def q_match_keywords(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", X.match_keywords("text", ["the", "und", "les", "que"]).alias("hit"))


@query("match_keywords_escaped", f"""
SELECT p_partkey, coalesce(regexp_matches(lower(p_name), '{_KW_RE % "red widget|small ring|c\\\\+\\\\+"}'), false) AS hit
FROM part""", "scalar")
def q_match_keywords_escaped(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey",
                    X.match_keywords_escaped("p_name", ["red widget", "small ring", "c++"]).alias("hit"))


@query("flag_contains", """
SELECT o_orderkey,
  coalesce(regexp_matches(upper(o_orderpriority), 'URGENT|HIGH'), false) AS is_priority,
  coalesce(regexp_matches(o_orderstatus, '(?i)f'), false) AS is_final
FROM orders""", "scalar")
def q_flag_contains(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey",
                    X.flag_contains("o_orderpriority", "URGENT|HIGH", upper=True).alias("is_priority"),
                    X.flag_contains("o_orderstatus", "f", case_insensitive=True).alias("is_final"))


_WS = ("[\\t\\n\\x{0b}\\f\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
CLEAN_SQL = (f"regexp_replace(replace(replace(regexp_replace(regexp_replace(lower(__X__), "
             f"'{_WS}+', ' ', 'g'), '_+', ' ', 'g'), '[**', ''), '**]', ''), "
             f"'^{_WS}+|{_WS}+$', '', 'g')")


@query("clean_text", f"""
SELECT doc_id, {CLEAN_SQL.replace('__X__', 'text')} AS clean FROM documents""", "scalar")
def q_clean_text(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", X.clean_text("text").alias("clean"))


@query("count_words", f"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '')) AS BIGINT) AS n_words
FROM documents""", "scalar")
def q_count_words(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", X.count_words("text").alias("n_words"))


@query("truncate_text", """
SELECT doc_id, substring(text, 1, 10000) AS head FROM documents""", "scalar")
def q_truncate_text(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", X.truncate_text("text", 10000).alias("head"))


@query("extract_run_number", """
SELECT event_id,
  CAST(nullif(regexp_extract(CASE WHEN event_type IN ('view', 'click') THEN 'stacker_iter' ELSE 'run' END
       || CAST(day(ts) AS VARCHAR), '(?:iter|run)(\\d+)', 1), '') AS BIGINT) AS run_number
FROM events""", "scalar")
def q_extract_run_number(spark, sf):
    e = t(spark, sf, "events")
    tag = F.concat(F.when(F.col("event_type").isin("view", "click"), F.lit("stacker_iter"))
                   .otherwise(F.lit("run")), F.dayofmonth("ts").cast("string"))
    return e.select("event_id", C.extract_run_number(tag).alias("run_number"))


@query("normalize_model_name", """
SELECT DISTINCT event_type,
  trim(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(
      lower('stacker_' || event_type || '_multiclass'),
      'stacker_', 'stack_', 'g'), 'clinicalbert_transformer', 'Clinicalbert', 'g'), '_multiclass', '', 'g'),
      'gru', 'GRU', 'g'), 'lstm', 'LSTM', 'g'), 'tfidf', 'TF-IDF', 'g'), 'transformer', 'Transformer', 'g'),
      'tabular_xgb', 'XGBoost', 'g'), 'tabular_rf', 'Random Forest', 'g'),
    'Clinicalbert', 'ClinicalBERT '), 'stack_', 'Stacked ')) AS model
FROM events""", "scalar")
def q_normalize_model_name(spark, sf):
    e = t(spark, sf, "events")
    raw = F.concat(F.lit("stacker_"), F.col("event_type"), F.lit("_multiclass"))
    return e.select("event_type", C.normalize_model_name(raw).alias("model")).distinct()


_STATUS = {"F": "final", "O": "open"}


@query("lookup_map", """
SELECT o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE NULL END AS status_name,
  coalesce(CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE NULL END, o_orderstatus)
    AS status_or_code
FROM orders""", "scalar")
def q_lookup_map(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", C.lookup_map("o_orderstatus", _STATUS).alias("status_name"),
                    C.lookup_map("o_orderstatus", _STATUS, keep_miss=True).alias("status_or_code"))


@query("format_metric", """
SELECT l_orderkey, l_linenumber, l_partkey, printf('%.4f', l_quantity / 7.0) AS metric
FROM lineitem""", "scalar")
def q_format_metric(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     C.format_metric(F.col("l_quantity") / F.lit(7.0).cast("double")).alias("metric"))


# -- dates / numbers --------------------------------------------------------------

@query("parse_timestamp_safe", """
SELECT event_id, CAST(TRY_CAST(CASE WHEN event_type = 'error' THEN 'not a date' ELSE CAST(ts AS VARCHAR) END
                         AS TIMESTAMP) AS VARCHAR) AS parsed
FROM events""", "scalar")
def q_parse_timestamp_safe(spark, sf):
    e = t(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", F.lit("not a date")).otherwise(F.col("ts").cast("string"))
    return e.select("event_id", D.parse_timestamp_safe(raw).cast("string").alias("parsed"))


_DAYS = "floor(date_diff('microsecond', {a}, {b}) / 86400000000)"


@query("age_at_event", f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  round(CASE WHEN l.l_shipdate IS NULL OR o.o_orderdate IS NULL THEN NULL
       WHEN year(o.o_orderdate) = 2100 THEN 90.0
       WHEN {_DAYS.format(a='o.o_orderdate', b='l.l_shipdate')} / 365.25 < 0
         OR {_DAYS.format(a='o.o_orderdate', b='l.l_shipdate')} / 365.25 > 120 THEN NULL
       ELSE {_DAYS.format(a='o.o_orderdate', b='l.l_shipdate')} / 365.25 END, 6) AS age
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""", "scalar")
def q_age_at_event(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    r6(D.age_at_event("l_shipdate", "o_orderdate")).alias("age"))


@query("age_as_of", f"""
SELECT o_orderkey, CAST(floor({_DAYS.format(a='o_orderdate', b="TIMESTAMP '2025-01-01 00:00:00'")} / 365) AS BIGINT) AS age_years
FROM orders""", "scalar")
def q_age_as_of(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", D.age_as_of("o_orderdate", F.lit("2025-01-01 00:00:00")
                                              .cast("timestamp_ntz")).alias("age_years"))


@query("length_of_stay", f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  CASE WHEN {_DAYS.format(a='o.o_orderdate', b='l.l_shipdate')} < 0
         OR {_DAYS.format(a='o.o_orderdate', b='l.l_shipdate')} > 60 THEN NULL
       ELSE CAST({_DAYS.format(a='o.o_orderdate', b='l.l_shipdate')} AS BIGINT) END AS stay
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""", "scalar")
def q_length_of_stay(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    D.length_of_stay("o_orderdate", "l_shipdate", cap=60).alias("stay"))


@query("in_interval_flag", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  coalesce(o.o_orderdate <= l.l_shipdate AND l.l_shipdate <= o.o_orderdate + INTERVAL 60 DAY
           AND year(l.l_shipdate) <> 2100, false) AS shipped_in_window
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""", "scalar")
def q_in_interval_flag(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    D.in_interval_flag("l_shipdate", "o_orderdate", end).alias("shipped_in_window"))


@query("duration_days", f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  CAST({_DAYS.format(a='o.o_orderdate', b='l.l_shipdate')} AS BIGINT) AS days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""", "scalar")
def q_duration_days(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    D.duration_days("o_orderdate", "l_shipdate").alias("days"))


@query("to_number_safe", """
SELECT event_id,
  TRY_CAST(regexp_extract(props, ':\\s*([^}]*)}', 1) AS DOUBLE) AS k,
  TRY_CAST(event_type AS DOUBLE) AS type_as_number
FROM events""", "scalar")
def q_to_number_safe(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id",
                    D.to_number_safe(F.regexp_extract("props", r":\s*([^}]*)}", 1)).alias("k"),
                    D.to_number_safe("event_type").alias("type_as_number"))


@query("encode_binary", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE -1 END
  AS status_code FROM orders""", "scalar")
def q_encode_binary(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", C.encode_binary("o_orderstatus", {"F": 1, "O": 0}, -1)
                    .alias("status_code"))


@query("encode_category", """
WITH d AS (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL),
r AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM d)
SELECT c.c_custkey, c.c_mktsegment, coalesce(r.code, -1) AS segment_code
FROM customer c LEFT JOIN r ON c.c_mktsegment = r.c_mktsegment""", "scalar")
def q_encode_category(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return EN.encode_category(c, "c_mktsegment", out="segment_code")


@query("encode_labels_all", """
WITH s AS (SELECT c_custkey, c_acctbal, coalesce(c_name, 'nan') AS c_name,
                  coalesce(c_mktsegment, 'nan') AS c_mktsegment FROM customer),
n AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM s)),
m AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM s))
SELECT s.c_custkey, s.c_acctbal, CAST(n.code AS INTEGER) AS c_name, CAST(m.code AS INTEGER) AS c_mktsegment
FROM s JOIN n ON s.c_name = n.c_name JOIN m ON s.c_mktsegment = m.c_mktsegment""", "scalar")
def q_encode_labels_all(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name", "c_mktsegment")
    return EN.encode_labels_all(c, exclude=["c_custkey"])


# -- arrays / JSON ----------------------------------------------------------------

@query("sequence_to_json", """
SELECT user_id,
  '[' || string_agg('["' || event_type || '", "' || CAST(ts AS VARCHAR) || '"]', ', ' ORDER BY ts, event_type)
  || ']' AS events_json
FROM events GROUP BY user_id""", "scalar")
def q_sequence_to_json(spark, sf):
    from ...operators.seq import event_sequence
    e = t(spark, sf, "events")
    return event_sequence(e, ["user_id"], "ts", "event_type", tiebreak="event_type",
                          out="events_json", as_json=True)


@query("softmax_argmax", """
WITH l AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE) * 10, CAST(embedding[2] AS DOUBLE) * 10,
                            CAST(embedding[3] AS DOUBLE) * 10] AS logits FROM embeddings),
p AS (SELECT vec_id, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM l)
SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS cls,
       round(list_max(ex) / list_sum(ex), 6) AS p_max
FROM p""", "scalar")
def q_softmax_argmax(spark, sf):
    e = t(spark, sf, "embeddings")
    logits = F.array(*[F.element_at("embedding", i).cast("double") * 10 for i in (1, 2, 3)])
    return e.select("vec_id", A.softmax_argmax(logits).alias("cls"),
                    r6(F.array_max(A.softmax(logits))).alias("p_max"))


@query("sigmoid_threshold", """
SELECT vec_id, CAST(1.0 / (1.0 + exp(-(CAST(embedding[1] AS DOUBLE) * 10))) > 0.5 AS INTEGER) AS positive
FROM embeddings""", "scalar")
def q_sigmoid_threshold(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.select("vec_id", A.sigmoid_threshold(F.element_at("embedding", 1).cast("double") * 10)
                    .alias("positive"))


@query("positive_class_prob", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag = 'N' THEN l_discount ELSE l_tax END AS p_pos
FROM lineitem""", "scalar")
def q_positive_class_prob(spark, sf):
    li = t(spark, sf, "lineitem")
    probs = F.when(F.col("l_returnflag") == "N", F.array("l_discount")).otherwise(
        F.array("l_discount", "l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     A.positive_class_prob(probs).alias("p_pos"))


@query("masked_mean_pool", """
WITH s AS (SELECT vec_id, embedding AS e, [1, label % 2, 1] AS m FROM embeddings)
SELECT vec_id,
  round((CAST(e[1] AS DOUBLE) * m[1] + CAST(e[5] AS DOUBLE) * m[2] + CAST(e[9] AS DOUBLE) * m[3])
        / greatest(m[1] + m[2] + m[3], 1e-6), 6) AS pool_1,
  round((CAST(e[2] AS DOUBLE) * m[1] + CAST(e[6] AS DOUBLE) * m[2] + CAST(e[10] AS DOUBLE) * m[3])
        / greatest(m[1] + m[2] + m[3], 1e-6), 6) AS pool_2
FROM s""", "scalar")
def q_masked_mean_pool(spark, sf):
    e = t(spark, sf, "embeddings")
    seq = F.array(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4), F.slice("embedding", 9, 4))
    seq = F.transform(seq, lambda v: F.transform(v, lambda x: x.cast("double")))
    mask = F.array(F.lit(1), F.pmod(F.col("label"), F.lit(2)), F.lit(1))
    pooled = A.masked_mean_pool(seq, mask)
    return e.select("vec_id", r6(pooled[0]).alias("pool_1"), r6(pooled[1]).alias("pool_2"))
