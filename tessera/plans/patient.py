"""Patient-level cohort: one labelled row per patient.

Label = 1 when any condition description matches the pain keywords.  Every
input is aggregated to one row per patient before the joins (map-side
combined), observations are pivoted over a fixed list of measures, text
columns are label-encoded and numeric gaps are filled with exact medians.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators.aggs import pivot_mean
from ..operators.clean import fill_median
from ..operators.encode import encode_labels_all
from ..session import cut_lineage
from .quantiles import exact_quantiles_discrete

# Observation measures kept as columns (cleaned names).
OBSERVATION_MEASURES = [
    "pain_severity_0_10_verbal_numeric_rating_score_reported",
    "body_height", "body_weight", "body_mass_index",
    "body_mass_index_bmi_percentile_per_age_and_gender",
    "systolic_blood_pressure", "diastolic_blood_pressure", "heart_rate",
    "respiratory_rate", "qaly", "daly", "qols",
]


@dataclass
class PatientSpec:
    pain_keywords: Sequence[str] = field(default_factory=lambda: X.PAIN_CONDITION_KEYWORDS)
    pain_med_keywords: Sequence[str] = field(default_factory=lambda: X.PAIN_MED_KEYWORDS)
    measures: Sequence[str] = field(default_factory=lambda: OBSERVATION_MEASURES)
    as_of: str = "2025-01-01 00:00:00"
    female_value: str = "F"


def patient_features(patients: DataFrame, conditions: DataFrame, medications: DataFrame,
                     encounters: DataFrame, procedures: DataFrame, observations: DataFrame,
                     spec: PatientSpec | None = None) -> DataFrame:
    """Inputs (column names):
    patients(id, birthdate, gender, race, ethnicity, healthcare_expenses,
    healthcare_coverage),
    conditions(patient, description, start, stop), medications(patient, description),
    encounters(patient), procedures(patient, description),
    observations(patient, description, value)."""
    s = spec or PatientSpec()
    cond = conditions.select("patient", F.lower("description").alias("description"), "start", "stop")
    hits = cond.where(X.match_keywords("description", s.pain_keywords)).select(
        F.col("patient").alias("id")).distinct().withColumn("binary_label", F.lit(1))
    dur = cond.withColumn("duration_days", D.duration_days("start", "stop"))
    # whole days repeat a lot: the exact median comes from a value histogram
    med = exact_quantiles_discrete(dur, "duration_days", [0.5], names=["m"]).scalar()
    dur = dur.withColumn("duration_days", F.coalesce(F.col("duration_days").cast("double"), med))
    cond_f = dur.groupBy(F.col("patient").alias("id")).agg(
        F.count_distinct("description").alias("num_conditions"),
        F.avg("duration_days").alias("avg_condition_duration"))
    meds = medications.select("patient", F.lower("description").alias("description"))
    med_f = meds.groupBy(F.col("patient").alias("id")).agg(
        F.count_distinct("description").alias("num_unique_meds"),
        F.count_if(X.match_keywords("description", s.pain_med_keywords)).alias("num_pain_meds"))
    enc_f = encounters.groupBy(F.col("patient").alias("id")).agg(
        F.count(F.lit(1)).alias("num_encounters"))
    proc_f = procedures.groupBy(F.col("patient").alias("id")).agg(
        F.count("description").alias("num_procedures"),
        F.count_distinct("description").alias("unique_procedures"))
    obs = pivot_mean(observations, ["patient"], "description", "value", list(s.measures))
    obs = obs.withColumnRenamed("patient", "id")

    base = patients.select(
        "id", "race", "ethnicity", F.col("healthcare_expenses").cast("double"),
        F.col("healthcare_coverage").cast("double"),
        D.age_as_of("birthdate", F.lit(s.as_of).cast("timestamp_ntz")).alias("age"),
        (F.col("gender") == F.lit(s.female_value)).cast("int").alias("is_female"))
    out = (base.join(hits, "id", "left").join(cond_f, "id", "left").join(med_f, "id", "left")
           .join(enc_f, "id", "left").join(proc_f, "id", "left").join(obs, "id", "left"))
    zeros = {"binary_label": 0, "num_conditions": 0, "avg_condition_duration": 0.0,
             "num_unique_meds": 0, "num_pain_meds": 0, "num_encounters": 0,
             "num_procedures": 0, "unique_procedures": 0}
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in zeros.items()})
    # One row per patient from here on: far smaller than the event inputs and
    # read by several passes (codes per text column, exact medians), so the
    # joins run once and the result is kept in the checkpoint folder.
    out = cut_lineage(out)
    out = encode_labels_all(out, exclude=["id"])
    return fill_median(out, ["age", "healthcare_expenses", "healthcare_coverage", *s.measures])


# -- driver-table adapter ----------------------------------------------------------
# Demo keyword lists and measures on the driver tables.
DRIVER_PAIN_KEYWORDS = ["ring", "bolt"]
DRIVER_PAIN_MED_KEYWORDS = ["widget", "gear"]
DRIVER_MEASURES = ["click", "error", "purchase", "signup", "view"]


def driver_patient_features(customer, nation, orders, lineitem, part, events) -> DataFrame:
    items = (lineitem.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"),
                           F.col("l_orderkey") == F.col("o_orderkey"))
             .join(part.select("p_partkey", "p_name", "p_type"),
                   F.col("l_partkey") == F.col("p_partkey"), "left"))
    first_order = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("o_orderdate").alias("birthdate"))
    patients = (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                .select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("race"),
                        F.col("n_name").alias("ethnicity"),
                        F.col("c_acctbal").alias("healthcare_expenses"),
                        F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey") * 125.5)
                        .alias("healthcare_coverage"),
                        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "F").otherwise("M")
                        .alias("gender"))
                .join(first_order, "id", "left"))
    conditions = items.select(F.col("o_custkey").alias("patient"), F.col("p_name").alias("description"),
                              F.col("o_orderdate").alias("start"), F.col("l_shipdate").alias("stop"))
    medications = items.select(F.col("o_custkey").alias("patient"),
                               F.concat_ws(" ", "p_type", "p_name").alias("description"))
    encounters = orders.select(F.col("o_custkey").alias("patient"))
    procedures = items.select(F.col("o_custkey").alias("patient"),
                              F.col("l_partkey").cast("string").alias("description"))
    observations = events.select(F.col("user_id").alias("patient"),
                                 F.col("event_type").alias("description"), "value")
    spec = PatientSpec(pain_keywords=DRIVER_PAIN_KEYWORDS, pain_med_keywords=DRIVER_PAIN_MED_KEYWORDS,
                       measures=DRIVER_MEASURES, female_value="F")
    return patient_features(patients, conditions, medications, encounters, procedures,
                            observations, spec)
