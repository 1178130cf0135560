"""End-to-end pipelines over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import driver_cohort
from . import query
from ._common import t

_COHORT_SQL = r"""
WITH items AS (
  SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, l.l_returnflag, l.l_linestatus,
         l.l_shipdate, p.p_brand, p.p_name, p.p_type
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey),
dx AS (SELECT subject_id, hadm_id, regexp_extract(p_brand, '#(\d+)', 1) AS code FROM items),
diag AS (
  SELECT subject_id, hadm_id,
         string_agg(code, ',' ORDER BY code) AS codes,
         count(*) AS diagnosis_count,
         bool_or(regexp_matches(regexp_replace(replace(code, '.', ''), '^0+', ''), '^(?:11|12|13|14|15)')) AS has_mental_health,
         bool_or(regexp_matches(regexp_replace(replace(code, '.', ''), '^0+', ''), '^(?:21|22|23|24|25)')) AS has_chronic_pain
  FROM dx WHERE code IS NOT NULL GROUP BY subject_id, hadm_id),
last_ship AS (SELECT l_orderkey AS hadm_id, max(l_shipdate) AS dischtime FROM lineitem GROUP BY 1),
adm AS (
  SELECT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id, o.o_orderpriority AS insurance,
         o.o_orderstatus AS admission_type, o.o_orderdate AS admittime, s.dischtime,
         CASE WHEN floor(date_diff('microsecond', o.o_orderdate, s.dischtime) / 86400000000) < 0
                OR floor(date_diff('microsecond', o.o_orderdate, s.dischtime) / 86400000000) > 365 THEN NULL
              ELSE CAST(floor(date_diff('microsecond', o.o_orderdate, s.dischtime) / 86400000000) AS BIGINT) END
           AS length_of_stay,
         CASE WHEN upper(coalesce(o.o_orderpriority, 'UNKNOWN')) LIKE '%URGENT%' THEN 'Urgent'
              WHEN upper(coalesce(o.o_orderpriority, 'UNKNOWN')) LIKE '%HIGH%' THEN 'High'
              WHEN upper(coalesce(o.o_orderpriority, 'UNKNOWN')) LIKE '%MEDIUM%' THEN 'Medium'
              WHEN upper(coalesce(o.o_orderpriority, 'UNKNOWN')) LIKE '%LOW%' THEN 'Low'
              ELSE 'Other' END AS insurance_group
  FROM orders o LEFT JOIN last_ship s ON o.o_orderkey = s.hadm_id),
rx AS (
  SELECT subject_id, hadm_id, count(*) AS medication_count,
         bool_or(coalesce(regexp_matches(lower(p_name), '(?:^|[^\p{L}\p{N}_])(?:ring|widget|bolt|gizmo)(?:[^\p{L}\p{N}_]|$)'), false)) AS on_psych_or_pain_meds,
         count_if(coalesce(regexp_matches(lower(p_name), '(?:^|[^\p{L}\p{N}_])(?:ring|widget|bolt|gizmo)(?:[^\p{L}\p{N}_]|$)'), false)) AS psych_or_pain_rx_count
  FROM items GROUP BY subject_id, hadm_id),
tr AS (
  SELECT subject_id, hadm_id,
         bool_or(coalesce(regexp_matches(upper(l_returnflag || l_linestatus), '^R'), false)) AS was_in_icu,
         count(*) AS transfer_count,
         '[' || string_agg('["' || upper(l_returnflag || l_linestatus) || '", "' || CAST(l_shipdate AS VARCHAR) || '"]', ', '
                           ORDER BY l_shipdate, upper(l_returnflag || l_linestatus)) || ']' AS curr_careunit_sequence
  FROM items GROUP BY subject_id, hadm_id),
sv AS (SELECT subject_id, hadm_id, min(p_type) AS curr_service, bool_or(contains(upper(p_type), 'PROMO')) AS seen_by_psych
       FROM items GROUP BY subject_id, hadm_id),
pat AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CASE WHEN c_custkey % 17 = 0 THEN TIMESTAMP '2100-01-01' ELSE TIMESTAMP '1950-01-01' + to_days(CAST(c_custkey AS INTEGER)) END AS dob,
               CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1995-06-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) END AS dod,
               CAST(c_custkey % 3 = 0 AS INTEGER) AS expire_flag FROM customer)
SELECT d.subject_id, d.hadm_id, a.admittime, a.dischtime, s.curr_service, coalesce(s.seen_by_psych, false) AS seen_by_psych,
       c.gender, c.expire_flag,
       round(CASE WHEN a.admittime IS NULL OR c.dob IS NULL THEN NULL WHEN year(c.dob) = 2100 THEN 90.0
             WHEN floor(date_diff('microsecond', c.dob, a.admittime) / 86400000000) / 365.25 BETWEEN 0 AND 120
             THEN floor(date_diff('microsecond', c.dob, a.admittime) / 86400000000) / 365.25 END, 6) AS approx_age,
       coalesce(a.admittime <= c.dod AND c.dod <= a.dischtime AND year(c.dod) <> 2100, false) AS in_hospital_mortality,
       d.codes, d.diagnosis_count, d.has_mental_health, d.has_chronic_pain,
       d.has_mental_health AND d.has_chronic_pain AS co_occurrence,
       CAST(CASE WHEN d.has_mental_health AND d.has_chronic_pain THEN 2 WHEN d.has_chronic_pain THEN 1
            WHEN d.has_mental_health THEN 0 ELSE -1 END AS INTEGER) AS label,
       a.insurance, a.admission_type, a.length_of_stay, a.insurance_group,
       coalesce(r.medication_count, 0) AS medication_count,
       coalesce(r.on_psych_or_pain_meds, false) AS on_psych_or_pain_meds,
       coalesce(r.psych_or_pain_rx_count, 0) AS psych_or_pain_rx_count,
       coalesce(t.was_in_icu, false) AS was_in_icu,
       coalesce(t.transfer_count, 0) AS transfer_count,
       coalesce(t.curr_careunit_sequence, '[]') AS curr_careunit_sequence,
       c.c_mktsegment AS segment,
       CAST(coalesce(r.medication_count, 0) >= 5 AS INTEGER) AS polypharmacy_flag
FROM diag d
LEFT JOIN adm a ON d.subject_id = a.subject_id AND d.hadm_id = a.hadm_id
LEFT JOIN rx r ON d.subject_id = r.subject_id AND d.hadm_id = r.hadm_id
LEFT JOIN tr t ON d.subject_id = t.subject_id AND d.hadm_id = t.hadm_id
LEFT JOIN sv s ON d.subject_id = s.subject_id AND d.hadm_id = s.hadm_id
LEFT JOIN pat c ON d.subject_id = c.c_custkey
WHERE {label_filter}
"""

_MULTI = _COHORT_SQL.replace("{label_filter}", """
  CASE WHEN d.has_mental_health AND d.has_chronic_pain THEN 2 WHEN d.has_chronic_pain THEN 1
       WHEN d.has_mental_health THEN 0 ELSE -1 END <> -1""")

_BINARY = _MULTI.replace(
    """CAST(CASE WHEN d.has_mental_health AND d.has_chronic_pain THEN 2 WHEN d.has_chronic_pain THEN 1
            WHEN d.has_mental_health THEN 0 ELSE -1 END AS INTEGER) AS label""",
    """CAST(CASE WHEN d.has_chronic_pain AND NOT d.has_mental_health THEN 1
            WHEN d.has_mental_health AND NOT d.has_chronic_pain THEN 0 ELSE -1 END AS INTEGER) AS label""",
).replace("""
  CASE WHEN d.has_mental_health AND d.has_chronic_pain THEN 2 WHEN d.has_chronic_pain THEN 1
       WHEN d.has_mental_health THEN 0 ELSE -1 END <> -1""", """
  CASE WHEN d.has_chronic_pain AND NOT d.has_mental_health THEN 1
       WHEN d.has_mental_health AND NOT d.has_chronic_pain THEN 0 ELSE -1 END <> -1""")


@query("cohort_features", _MULTI, "pipeline")
def cohort_features(spark, sf):
    return driver_cohort(t(spark, sf, "orders"), t(spark, sf, "lineitem"), t(spark, sf, "part"),
                         t(spark, sf, "customer")).withColumn("approx_age", F.round("approx_age", 6))


@query("cohort_features_binary", _BINARY, "pipeline")
def cohort_features_binary(spark, sf):
    return driver_cohort(t(spark, sf, "orders"), t(spark, sf, "lineitem"), t(spark, sf, "part"),
                         t(spark, sf, "customer"), binary=True).withColumn("approx_age", F.round("approx_age", 6))


__all__ = ["F"]


def _patient_sql() -> str:
    from ..patient import DRIVER_MEASURES
    kw = "(?:^|[^\\p{L}\\p{N}_])(?:%s)(?:[^\\p{L}\\p{N}_]|$)"
    obs = ", ".join(
        f"avg(value) FILTER (WHERE lower(regexp_replace(event_type, '[^0-9a-zA-Z]+', '_', 'g')) = '{m}') AS {m}"
        for m in DRIVER_MEASURES)
    meds = ", ".join(f"(SELECT quantile_cont({c}, 0.5) FROM j) AS med_{c}"
                     for c in ["age", "healthcare_expenses", "healthcare_coverage", *DRIVER_MEASURES])
    fills = ", ".join(f"round(coalesce(CAST(j.{c} AS DOUBLE), m.med_{c}), 6) AS {c}"
                      for c in ["age", "healthcare_expenses", "healthcare_coverage", *DRIVER_MEASURES])
    return f"""
WITH items AS (SELECT o.o_custkey, o.o_orderdate, l.l_shipdate, l.l_partkey, p.p_name, p.p_type
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
               LEFT JOIN part p ON l.l_partkey = p.p_partkey),
cond AS (SELECT o_custkey AS patient, lower(p_name) AS description,
                CAST(floor(date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000) AS DOUBLE) AS dd
         FROM items),
cond2 AS (SELECT patient, description, coalesce(dd, (SELECT quantile_cont(dd, 0.5) FROM cond)) AS dd FROM cond),
hits AS (SELECT DISTINCT patient FROM cond
         WHERE coalesce(regexp_matches(lower(description), '{kw % "ring|bolt"}'), false)),
cf AS (SELECT patient, count(DISTINCT description) AS num_conditions, avg(dd) AS avg_condition_duration
       FROM cond2 GROUP BY 1),
mf AS (SELECT o_custkey AS patient, count(DISTINCT lower(concat_ws(' ', p_type, p_name))) AS num_unique_meds,
              count_if(coalesce(regexp_matches(lower(concat_ws(' ', p_type, p_name)), '{kw % "widget|gear"}'), false))
                AS num_pain_meds
       FROM items GROUP BY 1),
ef AS (SELECT o_custkey AS patient, count(*) AS num_encounters FROM orders GROUP BY 1),
pf AS (SELECT o_custkey AS patient, count(l_partkey) AS num_procedures,
              count(DISTINCT l_partkey) AS unique_procedures FROM items GROUP BY 1),
obs AS (SELECT user_id AS patient, {obs} FROM events GROUP BY 1),
fo AS (SELECT o_custkey AS id, min(o_orderdate) AS birthdate FROM orders GROUP BY 1),
base AS (SELECT c.c_custkey AS id, c.c_mktsegment AS race, n.n_name AS ethnicity,
                CAST(c.c_acctbal AS DOUBLE) AS healthcare_expenses,
                CASE WHEN c.c_custkey % 9 <> 0 THEN c.c_nationkey * 125.5::double END AS healthcare_coverage,
                CAST(floor(floor(date_diff('microsecond', fo.birthdate, TIMESTAMP '2025-01-01 00:00:00')
                                 / 86400000000) / 365) AS BIGINT) AS age,
                CAST(coalesce(c.c_mktsegment = 'HOUSEHOLD', false) AS INTEGER) AS is_female
         FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN fo ON c.c_custkey = fo.id),
j AS (SELECT b.*, CAST(CASE WHEN h.patient IS NULL THEN 0 ELSE 1 END AS INTEGER) AS binary_label,
             coalesce(cf.num_conditions, 0) AS num_conditions,
             coalesce(cf.avg_condition_duration, 0.0) AS avg_condition_duration,
             coalesce(mf.num_unique_meds, 0) AS num_unique_meds, coalesce(mf.num_pain_meds, 0) AS num_pain_meds,
             coalesce(ef.num_encounters, 0) AS num_encounters, coalesce(pf.num_procedures, 0) AS num_procedures,
             coalesce(pf.unique_procedures, 0) AS unique_procedures, {", ".join(f"obs.{m}" for m in DRIVER_MEASURES)}
      FROM base b LEFT JOIN hits h ON b.id = h.patient LEFT JOIN cf ON b.id = cf.patient
      LEFT JOIN mf ON b.id = mf.patient LEFT JOIN ef ON b.id = ef.patient LEFT JOIN pf ON b.id = pf.patient
      LEFT JOIN obs ON b.id = obs.patient),
rc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT coalesce(race, 'nan') AS v FROM j)),
ec AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT coalesce(ethnicity, 'nan') AS v FROM j)),
m AS (SELECT {meds})
SELECT j.id, rc.code AS race, ec.code AS ethnicity, j.is_female, j.binary_label, j.num_conditions,
       round(j.avg_condition_duration, 6) AS avg_condition_duration, j.num_unique_meds, j.num_pain_meds,
       j.num_encounters, j.num_procedures, j.unique_procedures, {fills}
FROM j JOIN rc ON coalesce(j.race, 'nan') = rc.v JOIN ec ON coalesce(j.ethnicity, 'nan') = ec.v, m"""


@query("patient_features", _patient_sql(), "pipeline")
def patient_features(spark, sf):
    from ...functions._util import r6
    from ..patient import DRIVER_MEASURES, driver_patient_features
    out = driver_patient_features(t(spark, sf, "customer"), t(spark, sf, "nation"),
                                  t(spark, sf, "orders"), t(spark, sf, "lineitem"),
                                  t(spark, sf, "part"), t(spark, sf, "events"))
    dbl = ["age", "healthcare_expenses", "healthcare_coverage", "avg_condition_duration", *DRIVER_MEASURES]
    return out.select(*[r6(c).alias(c) if c in dbl else F.col(c) for c in out.columns])
