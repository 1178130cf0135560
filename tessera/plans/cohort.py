"""Cohort feature pipelines: one wide, labelled row per admission or patient.

Each input is aggregated to one row per admission before it is joined, and
inputs that come from the same table are aggregated in one pass: the aggregates
of every input are lists of columns (``diagnosis_aggs`` ...), so a caller whose
diagnoses, prescriptions, transfers and services share a source groups it once
(``driver_cohort``).  Label rules are column expressions and Catalyst prunes
every scan to the columns the features need.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import codes as C
from ..functions import dates as D
from ..functions import text as X
from ..operators.clean import filter_drop_sentinel
from ..operators.aggs import ordered_list


@dataclass
class AdmissionSpec:
    """Column names and code sets of an admission-level cohort."""
    subject: str = "subject_id"
    admission: str = "hadm_id"
    code: str = "icd9_code"
    mh_prefixes: Sequence[str] = field(default_factory=lambda: C.all_prefixes(C.MENTAL_HEALTH_CODES))
    pain_prefixes: Sequence[str] = field(default_factory=lambda: C.all_prefixes(C.CHRONIC_PAIN_CODES))
    admit: str = "admittime"
    discharge: str = "dischtime"
    insurance: str = "insurance"
    admission_type: str = "admission_type"
    insurance_rules: Sequence = field(default_factory=lambda: C.INSURANCE_RULES)
    insurance_default: str = C.INSURANCE_DEFAULT
    drug: str = "drug"
    med_keywords: Sequence[str] = field(default_factory=lambda: X.PSYCH_MEDICATIONS + X.PAIN_MEDICATIONS)
    unit: str = "curr_careunit"
    intime: str = "intime"
    icu_pattern: str = X.ICU_UNIT_PATTERN
    polypharmacy_at: int = 5
    binary: bool = False          # label_binary_exclusive instead of multiclass
    drop_neither: bool = True     # drop label -1 rows
    compat_rx_count: bool = False  # count matching admissions, not rows
    service: str = "curr_service"
    psych_service: str = "PSY"
    gender: str = "gender"
    birth: str = "dob"
    death: str = "dod"
    expired: str = "expire_flag"


def diagnosis_aggs(s: AdmissionSpec) -> list[Column]:
    code = F.col(s.code)
    norm = C.normalize_code(s.code)
    return [F.array_join(F.array_sort(F.collect_list(code)), ",").alias("codes"),
            F.count(code).alias("diagnosis_count"),
            F.bool_or(norm.rlike(C.prefix_regex(s.mh_prefixes))).alias("has_mental_health"),
            F.bool_or(norm.rlike(C.prefix_regex(s.pain_prefixes))).alias("has_chronic_pain")]


def prescription_aggs(s: AdmissionSpec) -> list[Column]:
    match = X.match_keywords(s.drug, s.med_keywords)
    return [F.count(F.lit(1)).alias("medication_count"), F.bool_or(match).alias("on_psych_or_pain_meds"),
            (F.max(match.cast("long")) if s.compat_rx_count else F.count_if(match)).alias("psych_or_pain_rx_count")]


def transfer_aggs(s: AdmissionSpec) -> list[Column]:
    unit = F.upper(F.col(s.unit))
    item = F.struct(unit.alias("value"), F.col(s.intime).alias("ts"))
    return [F.bool_or(X.flag_contains(unit, s.icu_pattern)).alias("was_in_icu"),
            F.count(F.lit(1)).alias("transfer_count"),
            A.sequence_to_json(ordered_list(item, [F.col(s.intime), unit])).alias("curr_careunit_sequence")]


def service_aggs(s: AdmissionSpec) -> list[Column]:
    """Of several services of an admission the alphabetically first is shown; any
    of them makes the psychiatry flag true."""
    service = F.col(s.service)
    return [F.min(service).alias("curr_service"),
            F.bool_or(F.upper(service).contains(s.psych_service.upper())).alias("seen_by_psych")]


def _finish(per_admission: DataFrame, admissions: DataFrame, patients: DataFrame | None,
            s: AdmissionSpec, patient_cols: Sequence[str]) -> DataFrame:
    """Labels, stay, age and mortality of the aggregated admissions."""
    label = (C.label_binary_exclusive("has_chronic_pain", "has_mental_health") if s.binary
             else C.label_multiclass("has_mental_health", "has_chronic_pain"))
    out = per_admission.withColumns({
        "co_occurrence": C.flag_co_occurrence("has_mental_health", "has_chronic_pain"), "label": label})
    if s.drop_neither:
        out = filter_drop_sentinel(out, "label", -1)
    if admissions is not None:  # else the admission's columns are there already
        out = out.join(admissions.select(
            s.subject, s.admission, F.col(s.insurance).alias("insurance"), F.col(s.admission_type).alias("admission_type"),
            F.col(s.admit).alias("admittime"), F.col(s.discharge).alias("dischtime")), [s.subject, s.admission], "left")
    out = out.withColumns({
        "length_of_stay": D.length_of_stay("admittime", "dischtime"),
        "insurance_group": C.bucket_by_substring("insurance", s.insurance_rules, s.insurance_default)})
    if patients is not None:
        p = patients.select(s.subject, F.col(s.gender).alias("gender"), F.col(s.expired).alias("expire_flag"),
                            F.col(s.birth).alias("_dob"), F.col(s.death).alias("_dod"), *patient_cols)
        out = out.join(p, s.subject, "left").withColumns({
            "approx_age": D.age_at_event("admittime", "_dob"),
            "in_hospital_mortality": D.in_interval_flag("_dod", "admittime", "dischtime")}).drop("_dob", "_dod")
    zeros = {"medication_count": F.lit(0), "psych_or_pain_rx_count": F.lit(0), "on_psych_or_pain_meds": F.lit(False),
             "was_in_icu": F.lit(False), "transfer_count": F.lit(0), "curr_careunit_sequence": F.lit("[]"),
             "seen_by_psych": F.lit(False)}
    out = out.withColumns({c: F.coalesce(c, v) for c, v in zeros.items() if c in out.columns})
    return out.withColumn("polypharmacy_flag", C.flag_threshold("medication_count", s.polypharmacy_at))


def cohort_features(diagnoses: DataFrame, admissions: DataFrame, transfers: DataFrame,
                    prescriptions: DataFrame, patients: DataFrame | None = None,
                    spec: AdmissionSpec | None = None, patient_cols: Sequence[str] = (),
                    services: DataFrame | None = None) -> DataFrame:
    """One row per admission with a diagnosis, from one table per input.  Without
    ``services`` or ``patients`` their columns are left out."""
    s = spec or AdmissionSpec()
    K = [s.subject, s.admission]
    out = diagnoses.where(F.col(s.code).isNotNull()).groupBy(*K).agg(*diagnosis_aggs(s))
    for table, aggs in ((prescriptions, prescription_aggs), (transfers, transfer_aggs), (services, service_aggs)):
        if table is not None:
            out = out.join(table.groupBy(*K).agg(*aggs(s)), K, "left")
    return _finish(out, admissions, patients, s, patient_cols)


# -- driver-table adapter -------------------------------------------------------
# The driver tables stand in for the EHR tables: orders = admissions,
# customer = patients, lineitem x part = diagnoses / prescriptions / transfers.
# The demo code sets and keyword lists used on those tables.
DRIVER_MH_PREFIXES = ["11", "12", "13", "14", "15"]
DRIVER_PAIN_PREFIXES = ["21", "22", "23", "24", "25"]
DRIVER_MED_KEYWORDS = ["ring", "widget", "bolt", "gizmo"]
DRIVER_PRIORITY_RULES = [("Urgent", ["URGENT"]), ("High", ["HIGH"]), ("Medium", ["MEDIUM"]),
                         ("Low", ["LOW"])]
DRIVER_ICU_PATTERN = "^R"
DRIVER_PSYCH_SERVICE = "promo"


def driver_spec(binary: bool = False) -> AdmissionSpec:
    return AdmissionSpec(
        subject="subject_id", admission="hadm_id", code="code",
        mh_prefixes=DRIVER_MH_PREFIXES, pain_prefixes=DRIVER_PAIN_PREFIXES,
        admit="admittime", discharge="dischtime", insurance="insurance",
        admission_type="admission_type", insurance_rules=DRIVER_PRIORITY_RULES,
        insurance_default="Other", drug="drug", med_keywords=DRIVER_MED_KEYWORDS,
        unit="unit", intime="intime", icu_pattern=DRIVER_ICU_PATTERN, binary=binary,
        psych_service=DRIVER_PSYCH_SERVICE)


# Stand-in for the patients' dates: births fall on one day per customer, every
# 17th has the sentinel year, every third has a date of death.
_BIRTH = ("CASE WHEN c_custkey % 17 = 0 THEN timestamp_ntz'2100-01-01 00:00:00' "
          "ELSE timestamp_ntz'1950-01-01 00:00:00' + make_dt_interval(CAST(c_custkey AS INT)) END")
_DEATH = ("CASE WHEN c_custkey % 3 = 0 THEN timestamp_ntz'1995-06-01 00:00:00' + "
          "make_dt_interval(CAST(c_custkey % 2000 AS INT)) END")


def driver_cohort(orders, lineitem, part, customer, binary: bool = False) -> DataFrame:
    """Items are grouped by order, in one pass over ``lineitem``; the order gives
    the subject and the admission's columns in one more join."""
    s = driver_spec(binary)
    items = lineitem.join(part.select("p_partkey", "p_brand", "p_name", "p_type"),
                          F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_orderkey").alias("hadm_id"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("code"),
        F.col("p_name").alias("drug"), F.concat("l_returnflag", "l_linestatus").alias("unit"),
        F.col("l_shipdate").alias("intime"), F.col("p_type").alias("curr_service"))
    aggs = [*diagnosis_aggs(s), *prescription_aggs(s), *transfer_aggs(s), *service_aggs(s),
            F.max("intime").alias("dischtime")]
    grouped = items.groupBy("hadm_id").agg(*aggs).where("diagnosis_count > 0")
    adm = orders.select(F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"),
                        F.col("o_orderdate").alias("admittime"), F.col("o_orderpriority").alias("insurance"),
                        F.col("o_orderstatus").alias("admission_type"))
    pats = customer.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"),
                           F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
                           F.expr(_BIRTH).alias("dob"), F.expr(_DEATH).alias("dod"),
                           (F.col("c_custkey") % 3 == 0).cast("int").alias("expire_flag"))
    return _finish(grouped.join(adm, "hadm_id"), None, pats, s, ["segment"])
