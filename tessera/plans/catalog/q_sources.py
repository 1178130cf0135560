"""Scans, sources and sinks (2.1) on driver tables.

Each sink entry writes data derived from the driver tables below the shared
checkpoint folder (``scratch_path``), reads it back through the matching
source, and returns the round-tripped rows; the oracle is the SQL of the data
that was written.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ...functions._util import r6
from ...session import scratch_path
from ...sources import io as IO
from . import REGISTRY, q_pipelines, q_seq, query  # noqa: F401  (entries reused below)
from ._common import t


@query("scan_parquet", """
SELECT l_orderkey, l_linenumber, l_discount FROM lineitem
WHERE l_returnflag = 'R' AND l_discount >= 0.05""", "source")
def q_scan_parquet(spark, sf):
    li = IO.scan_parquet(spark, sf, "lineitem")
    return li.where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05)).select(
        "l_orderkey", "l_linenumber", "l_discount")


@query("scan_csv", """
SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer""", "source")
def q_scan_csv(spark, sf):
    path = scratch_path(spark, "customer-csv")
    cu = t(spark, sf, "customer")
    # upper-case header on disk; the scan lower-cases it
    cu.toDF(*[c.upper() for c in cu.columns]).write.option("header", True).csv(path)
    got = IO.scan_csv(spark, path, cols=["C_CUSTKEY", "c_name", "c_acctbal"])
    return got.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                      r6("c_acctbal").alias("c_acctbal"))


@query("scan_csv_quoted", """
SELECT doc_id, text, lang FROM documents""", "source")
def q_scan_csv_quoted(spark, sf):
    """Line breaks, commas and quotes inside fields come back as written."""
    path = scratch_path(spark, "documents-csv")
    d = t(spark, sf, "documents").select("doc_id", "text", "lang")
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return IO.scan_csv(spark, path, "doc_id bigint, text string, lang string")


@query("scan_csv_tolerant", """
SELECT n_nationkey, n_name, n_regionkey FROM nation
UNION ALL SELECT NULL, r_name, r_regionkey FROM region
UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region""", "source")
def q_scan_csv_tolerant(spark, sf):
    path = scratch_path(spark, "nation-csv")
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    line = lambda k, df, *c: df.select(F.lit(k).alias("k"), F.concat_ws(",", *c).alias("value"))
    lines = (line(1, n, "n_nationkey", "n_name", "n_regionkey")
             .unionByName(line(1, r, F.concat(F.lit("x"), "r_name"), "r_name", "r_regionkey"))  # no number: null
             .unionByName(line(1, r, F.col("r_regionkey") + 100, "r_name"))  # a field short
             .unionByName(line(1, r, "r_regionkey", "r_name", "r_regionkey", "r_name")))  # a field too many
    header = spark.createDataFrame([(0, "\ufeffN_NATIONKEY,N_NAME,N_REGIONKEY")], "k int, value string")
    header.unionByName(lines).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return IO.scan_csv_tolerant(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("ingest_csv_tables", """
SELECT c.c_custkey, n.n_name, r.r_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""", "source")
def q_ingest_csv_tables(spark, sf):
    src, dst = scratch_path(spark, "ingest-src"), scratch_path(spark, "ingest-dst")
    order = ["region", "nation", "customer"]
    schemas = {}
    for name in order:
        df = t(spark, sf, name)
        schemas[name] = df.schema
        df.write.option("header", True).csv(f"{src}/{name}.csv")
    paths = IO.ingest_csv_tables(spark, src, dst, schemas, order)
    c, n, r = (spark.read.parquet(paths[k]) for k in ("customer", "nation", "region"))
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select("c_custkey", "n_name", "r_name"))


@query("scan_metric_files", """
SELECT l_returnflag AS model, CAST(l_linenumber AS INTEGER) AS run, l_linestatus AS class,
       count(*) AS n, round(avg(l_discount), 6) AS mean_discount
FROM lineitem GROUP BY l_returnflag, l_linenumber, l_linestatus""", "source")
def q_scan_metric_files(spark, sf):
    path = scratch_path(spark, "metric-files")
    li = t(spark, sf, "lineitem")
    metrics = li.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("run"),
                         F.col("l_linestatus").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("l_discount")).alias("mean_discount"))
    # one folder of CSV files per (model, run), as a benchmark run leaves them
    metrics.write.partitionBy("model", "run").option("header", True).csv(path)
    got = IO.scan_metric_files(spark, f"{path}/*/*/*.csv", r"model=([^/]+)/run=(\d+)/",
                               schema="class string, n bigint, mean_discount double")
    return got.select("model", F.col("run").cast("int").alias("run"), "class", "n",
                      "mean_discount")


@query("read_note_sequences", """
SELECT conv_id, string_agg(text, ' ' ORDER BY role, turn) AS text
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""", "source")
def q_read_note_sequences(spark, sf):
    path = scratch_path(spark, "note-seq")
    c = t(spark, sf, "conversations").where(F.col("text").isNotNull())
    # nested notes: per conversation, one inner list per role, ordered by turn
    inner = c.groupBy("conv_id", "role").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                    lambda s: s["text"]).alias("texts"))
    nested = inner.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("role", "texts"))),
                    lambda s: s["texts"]).alias("notes"))
    nested.write.parquet(path)
    return IO.read_note_sequences(spark, path, ["conv_id"])


@query("write_features", REGISTRY["cohort_features"].sql, "sink")
def q_write_features(spark, sf):
    path = scratch_path(spark, "features")
    feats = REGISTRY["cohort_features"].fn(spark, sf)
    IO.write_features(feats, path, feats.columns)
    return spark.read.parquet(path)


@query("write_run_summary", """
SELECT 'n_rows' AS key, count(*) AS value FROM labels
UNION ALL
SELECT 'class_' || coalesce(CAST(quality AS VARCHAR), 'null') AS key, count(*) AS value
FROM labels GROUP BY quality""", "sink")
def q_write_run_summary(spark, sf):
    path = scratch_path(spark, "run-summary")
    lb = t(spark, sf, "labels").withColumn(
        "label", F.concat(F.lit("class_"), F.coalesce(F.col("quality").cast("string"),
                                                        F.lit("null"))))
    IO.write_run_summary(lb, path, "label")
    js = spark.read.schema("n_rows bigint, class_counts map<string,bigint>").json(path)
    return (js.select(F.lit("n_rows").alias("key"), F.col("n_rows").alias("value"))
            .unionByName(js.select(F.explode("class_counts").alias("key", "value"))))


@query("write_sequences", REGISTRY["pad_sequence_mask"].sql, "sink")
def q_write_sequences(spark, sf):
    path = scratch_path(spark, "sequences")
    seqs = REGISTRY["pad_sequence_mask"].fn(spark, sf)
    IO.write_sequences(seqs, path, ["value", "k"], {"max_len": 60})
    data, meta = IO.read_sequences(spark, path)
    assert meta["features"] == ["value", "k"]
    return data


@query("write_predictions", """
SELECT o_orderkey AS subject_id, round(o_totalprice / (o_totalprice + 100000.0), 6) AS prob,
       1 AS run, 'price' AS model FROM orders
UNION ALL
SELECT o_orderkey, round(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 5.0, 6), 1,
       'priority' FROM orders""", "sink")
def q_write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    o = t(spark, sf, "orders")
    price = o.select(F.col("o_orderkey").alias("subject_id"),
                     r6(F.col("o_totalprice") / (F.col("o_totalprice") + 100000.0)).alias("prob"))
    prio = o.select(F.col("o_orderkey").alias("subject_id"),
                    r6(F.substring("o_orderpriority", 1, 1).try_cast("double") / 5.0).alias("prob"))
    IO.write_predictions(price, path, 1, "price")
    IO.write_predictions(prio, path, 1, "priority")
    return spark.read.parquet(path).select(
        "subject_id", "prob", F.col("run").cast("int").alias("run"), "model")


@query("write_predictions_flat", """
SELECT o_orderkey AS subject_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y_true,
       CAST(o_totalprice > 150000 AS INTEGER) AS y_pred FROM orders""", "sink")
def q_write_predictions_flat(spark, sf):
    path = scratch_path(spark, "pred-flat")
    o = t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("subject_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        (F.col("o_totalprice") > 150000).cast("int").alias("y_pred"))
    IO.write_predictions_flat(o, path)
    return IO.scan_csv(spark, path, "subject_id bigint, y_true int, y_pred int")


@query("append_run_log", """
SELECT 'nations' AS stage, n_regionkey AS key, count(*) AS n FROM nation GROUP BY n_regionkey
UNION ALL
SELECT 'customers', n.n_regionkey, count(*) FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_regionkey""", "sink")
def q_append_run_log(spark, sf):
    path = scratch_path(spark, "run-log")
    n = t(spark, sf, "nation")
    c = t(spark, sf, "customer")
    IO.append_run_log(n.groupBy(F.col("n_regionkey").alias("key")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("nations").alias("stage"), "key", "n"), path)
    IO.append_run_log(c.join(n, c.c_nationkey == n.n_nationkey)
                      .groupBy(F.col("n_regionkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
                      .select(F.lit("customers").alias("stage"), "key", "n"), path)
    return IO.scan_csv(spark, path, "stage string, key int, n bigint")


@query("save_model", """
SELECT c_custkey,
       round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS acctbal_z
FROM customer""", "sink")
def q_save_model(spark, sf):
    path = scratch_path(spark, "scaler")
    cu = t(spark, sf, "customer")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["c_acctbal"], outputCol="v"),
                            StandardScaler(inputCol="v", outputCol="z", withMean=True,
                                           withStd=True)])
    IO.save_model(pipe.fit(cu), path)
    model = PipelineModel.load(path)
    return model.transform(cu).select(
        "c_custkey", r6(vector_to_array("z")[0]).alias("acctbal_z"))


@query("skip_if_done", """
SELECT c_nationkey, count(*) AS n_customers, round(sum(c_acctbal), 6) AS total_acctbal
FROM customer GROUP BY c_nationkey""", "sink")
def q_skip_if_done(spark, sf):
    path = scratch_path(spark, "stage")
    built = []

    def build():
        built.append(1)
        return t(spark, sf, "customer").groupBy("c_nationkey").agg(
            F.count(F.lit(1)).alias("n_customers"), r6(F.sum("c_acctbal")).alias("total_acctbal"))

    IO.skip_if_done(spark, path, build)
    out = IO.skip_if_done(spark, path, build)  # second call reuses the stored stage
    assert len(built) == 1
    return out
