"""The cohort from separate inputs equals the one-pass plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import cohort as CO
from tests.conftest import SF_SMALL


def test_separate_inputs_and_one_pass_agree(spark):
    o, li, p, c = (spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in ("orders", "lineitem", "part", "customer"))
    items = (li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
             .join(o, F.col("l_orderkey") == F.col("o_orderkey")))
    K = [F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id")]
    last = li.groupBy(F.col("l_orderkey").alias("hadm_id")).agg(F.max("l_shipdate").alias("dischtime"))
    adm = o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                   F.col("o_orderdate").alias("admittime"), F.col("o_orderpriority").alias("insurance"),
                   F.col("o_orderstatus").alias("admission_type")).join(last, "hadm_id", "left")
    pats = c.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"),
                    F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
                    F.expr(CO._BIRTH).alias("dob"), F.expr(CO._DEATH).alias("dod"),
                    (F.col("c_custkey") % 3 == 0).cast("int").alias("expire_flag"))
    got = CO.cohort_features(
        items.select(*K, F.regexp_extract("p_brand", r"#(\d+)", 1).alias("code")), adm,
        items.select(*K, F.concat("l_returnflag", "l_linestatus").alias("unit"), F.col("l_shipdate").alias("intime")),
        items.select(*K, F.col("p_name").alias("drug")), pats, CO.driver_spec(), ["segment"],
        services=items.select(*K, F.col("p_type").alias("curr_service")))
    want = CO.driver_cohort(o, li, p, c)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
