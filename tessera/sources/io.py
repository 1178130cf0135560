"""Scans, sources and sinks.

Everything here is a thin, declarative use of ``spark.read`` / ``df.write``:
schemas are given up front (no inference pass over the data), projections are
applied right after the scan so the CSV/Parquet readers prune columns, and all
intermediate and output paths are plain (shared) filesystem paths chosen by the
caller -- on a cluster these live below ``spark.checkpoint.dir`` or a table
location, never a machine-local folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"

# ---------------------------------------------------------------------------
# Column lists and types of the eleven Synthea CSV tables, in the
# order the files carry them, and the dependency order used to load them
# (parents before children).  Dates are ISO dates, money and coordinates are
# doubles, everything else is text.
# ---------------------------------------------------------------------------
SYNTHEA_DDL = {
    "patients": "id string, birthdate date, deathdate date, ssn string, drivers string, "
                "passport string, prefix string, first string, last string, suffix string, "
                "maiden string, marital string, race string, ethnicity string, gender string, "
                "birthplace string, address string, city string, state string, county string, "
                "zip string, lat double, lon double, healthcare_expenses double, "
                "healthcare_coverage double",
    "organizations": "id string, name string, address string, city string, state string, "
                     "zip string, lat double, lon double, phone string, revenue double, "
                     "utilization double",
    "providers": "id string, organization_id string, name string, gender string, "
                 "specialty string, address string, city string, state string, zip string, "
                 "lat double, lon double, utilization double",
    "encounters": "id string, start date, stop date, patient string, organization string, "
                  "provider string, payer string, encounterclass string, code string, "
                  "description string, base_encounter_cost double, total_claim_cost double, "
                  "payer_coverage double, reasoncode string, reasondescription string",
    "conditions": "start date, stop date, patient string, encounter string, code string, "
                  "description string",
    "procedures": "date date, patient string, encounter string, code string, "
                  "description string, base_cost double, reasoncode string, "
                  "reasondescription string",
    "medications": "start date, stop date, patient string, payer string, encounter string, "
                   "code string, description string, base_cost double, payer_coverage double, "
                   "dispenses double, totalcost double, reasoncode string, "
                   "reasondescription string",
    "immunizations": "date date, patient string, encounter string, code string, "
                     "description string, base_cost double",
    "observations": "date date, patient string, encounter string, code string, "
                    "description string, value string, units string, type string",
    "careplans": "id string, start date, stop date, patient string, encounter string, "
                 "code string, description string, reasoncode string, reasondescription string",
    "allergies": "start date, stop date, patient string, encounter string, code string, "
                 "description string",
}
SYNTHEA_LOAD_ORDER = ["patients", "organizations", "providers", "encounters", "conditions",
                      "procedures", "medications", "immunizations", "observations",
                      "careplans", "allergies"]
# Foreign keys (child table, column) -> (parent table, column).
SYNTHEA_FOREIGN_KEYS = {
    ("providers", "organization_id"): ("organizations", "id"),
    ("encounters", "patient"): ("patients", "id"),
    ("encounters", "organization"): ("organizations", "id"),
    ("encounters", "provider"): ("providers", "id"),
    ("conditions", "patient"): ("patients", "id"),
    ("conditions", "encounter"): ("encounters", "id"),
    ("procedures", "patient"): ("patients", "id"),
    ("procedures", "encounter"): ("encounters", "id"),
    ("medications", "patient"): ("patients", "id"),
    ("medications", "encounter"): ("encounters", "id"),
    ("immunizations", "patient"): ("patients", "id"),
    ("immunizations", "encounter"): ("encounters", "id"),
    ("observations", "patient"): ("patients", "id"),
    ("observations", "encounter"): ("encounters", "id"),
    ("careplans", "patient"): ("patients", "id"),
    ("careplans", "encounter"): ("encounters", "id"),
    ("allergies", "patient"): ("patients", "id"),
    ("allergies", "encounter"): ("encounters", "id"),
}


_TYPES = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType()}


def table_schemas() -> dict[str, T.StructType]:
    """The Synthea schemas as ``StructType`` constants, keyed by table."""
    out = {}
    for name, ddl in SYNTHEA_DDL.items():
        pairs = [f.split() for f in ddl.split(",")]
        out[name] = T.StructType([T.StructField(c, _TYPES[ty]) for c, ty in pairs])
    return out


def _lower_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip(BOM).strip().lower() for c in df.columns])


def _csv_reader(spark: SparkSession, multi_line: bool):
    """Quotes inside quoted fields are doubled (RFC 4180)."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             cols: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header row; names lower-cased, optional column subset.

    Quoted fields may hold line breaks and doubled quotes.  Files without line
    breaks inside fields can be read with ``multi_line=False``, which lets Spark
    split a large file over many tasks.

    With a ``schema`` there is no inference pass; its names must be the header's
    (in any case, in order), else the read fails.  The ``select`` after the scan
    is pushed into the reader, so unneeded CSV columns are never converted.
    """
    r = _csv_reader(spark, multi_line)
    if schema is not None:
        df = r.option("enforceSchema", False).schema(schema).csv(path)
    else:
        df = r.option("inferSchema", False).csv(path)
    df = _lower_header(df)
    return df.select(*[c.lower() for c in cols]) if cols else df


def scan_csv_tolerant(spark: SparkSession, path: str,
                      schema: T.StructType | str | None = None) -> DataFrame:
    """Like :func:`scan_csv`, but lines with too many fields are skipped and a
    UTF-8 byte-order mark on the header is removed.

    Shorter lines are filled with nulls and values that do not parse become
    null.  Which lines are skipped does not depend on the columns selected
    afterwards: every line is read as text, judged by its field count, and only
    then cast.  (A surplus field that is empty cannot be told from a line end.)
    """
    r = _csv_reader(spark, False).option("columnPruning", False).option("mode", "PERMISSIVE")
    if schema is None:
        names = _lower_header(_csv_reader(spark, False).csv(path)).columns
        types = {n: T.StringType() for n in names}
    else:
        parsed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        types = {f.name.lower(): f.dataType for f in parsed.fields}
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*types, "_line"]])
    df = r.schema(text).option("columnNameOfCorruptRecord", "_line").csv(path)
    wider = ", ".join(f"f{i} string" for i in range(len(types) + 1))
    surplus = F.from_csv("_line", wider, {"quote": '"', "escape": '"'})[f"f{len(types)}"]
    # Spark refuses queries that read the raw line alone (a count), so the
    # condition also reads the first column
    first = F.length(F.coalesce(F.col(next(iter(types))), F.lit(""))) >= 0
    kept = df.where((F.col("_line").isNull() | surplus.isNull()) & first)
    return kept.select(*[F.col(n).try_cast(k).alias(n) for n, k in types.items()])


def scan_parquet(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def scan_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              props: Mapping[str, str] | None = None, part_col: str | None = None,
              n: int | None = None, lower: int | None = None, upper: int | None = None,
              cols: Sequence[str] | None = None, predicate: str | None = None) -> DataFrame:
    """A database table (or query) through JDBC.

    With ``part_col``/``n``/``lower``/``upper`` the read is split into ``n``
    range queries run by as many tasks; column lists and simple predicates
    given with ``select``/``where`` afterwards are pushed into the SQL.
    """
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    if query is not None:
        r = r.option("query", query)
    else:
        r = r.option("dbtable", table)
    if part_col is not None:
        r = (r.option("partitionColumn", part_col).option("numPartitions", int(n or 1))
             .option("lowerBound", int(lower)).option("upperBound", int(upper)))
    df = r.load()
    if predicate:
        df = df.where(predicate)
    return df.select(*cols) if cols else df


def ingest_csv_tables(spark: SparkSession, src: str, dst: str,
                      schemas: Mapping[str, T.StructType | str],
                      order: Sequence[str] | None = None, multi_line: bool = True) -> dict[str, str]:
    """Load ``{src}/{table}.csv`` with explicit schemas and store each table as
    Parquet under ``{dst}/{table}``, parents first; returns table -> path."""
    out = {}
    for name in (order or list(schemas)):
        df = scan_csv(spark, f"{src.rstrip('/')}/{name}.csv", schemas[name], multi_line=multi_line)
        p = f"{dst.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(p)
        out[name] = p
    return out


def scan_metric_files(spark: SparkSession, glob: str, pattern: str,
                      names: Sequence[str] = ("model", "run"),
                      schema: T.StructType | str | None = None) -> DataFrame:
    """Read many CSV files at once and derive columns from each file's path.

    ``pattern`` is a regular expression over the full file path with one group
    per entry of ``names`` (e.g. ``r'model=([^/]+)/run=(\\d+)/'``).  The file
    name comes from the hidden ``_metadata`` column, so no driver-side listing
    or per-file loop is needed.
    """
    df = scan_csv(spark, glob, schema)
    path = F.col("_metadata.file_path")
    derived = {n: F.regexp_extract(path, pattern, i + 1) for i, n in enumerate(names)}
    return df.select("*", *[v.alias(k) for k, v in derived.items()])


def read_note_sequences(spark: SparkSession, path: str, keys: Sequence[str],
                        notes: str = "notes", sep: str = " ", out: str = "text") -> DataFrame:
    """Nested notes (array of arrays of text per key) flattened to one text."""
    df = spark.read.parquet(path)
    return df.select(*keys, F.array_join(F.flatten(F.col(notes)), sep).alias(out))


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------

def write_features(df: DataFrame, path: str, cols: Sequence[str], fmt: str = "parquet",
                   mode: str = "overwrite") -> str:
    """Write a fixed, ordered column list (the feature contract)."""
    w = df.select(*cols).write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def run_summary(df: DataFrame, label: str) -> DataFrame:
    """One row: ``n_rows`` and a ``class_counts`` map, computed in one pass; rows
    without a label are counted as class ``null``."""
    per = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return per.agg(F.sum("v").alias("n_rows"),
                   F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))
                   .alias("class_counts"))


def write_run_summary(df: DataFrame, path: str, label: str) -> str:
    """Row count and class counts as one JSON document."""
    run_summary(df, label).coalesce(1).write.mode("overwrite").json(path)
    return path


def write_sequences(df: DataFrame, path: str, features: Sequence[str],
                    meta: Mapping[str, object] | None = None) -> str:
    """Store padded sequences (array columns, masks, ids) as Parquet plus a
    one-row metadata table holding the feature list."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    info = {"features": list(features), **(meta or {})}
    spark.createDataFrame([(json.dumps(info),)], "meta string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/meta")
    return path


def read_sequences(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    return spark.read.parquet(f"{path}/data"), meta


def write_predictions(df: DataFrame, path: str, run: int | str, model: str) -> str:
    """Append one model's predictions to the long prediction table,
    partitioned by run and model so later reads prune to what they need."""
    (df.withColumn("run", F.lit(str(run))).withColumn("model", F.lit(model))
     .write.mode("append").partitionBy("run", "model").parquet(path))
    return path


def write_predictions_flat(df: DataFrame, path: str, cols: Sequence[str] = ("subject_id", "y_true",
                                                                            "y_pred")) -> str:
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
    return path


def append_run_log(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Append rows to a log; every CSV part carries its own header, so the
    log reads back with ``header=True`` no matter how many appends."""
    w = df.write.mode("append")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def save_model(model, path: str) -> str:
    """Persist a fitted ``pyspark.ml`` model or pipeline (overwrite)."""
    model.write().overwrite().save(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on its (possibly remote) filesystem."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def skip_if_done(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                 marker: str = "_SUCCESS") -> DataFrame:
    """Build and write a stage only when its output is not complete yet.

    Spark's committer writes ``_SUCCESS`` last, so its presence means the
    earlier run finished; a half-written folder is rebuilt.  Either way the
    stage's result is read back from ``path``.
    """
    if not path_exists(spark, f"{path.rstrip('/')}/{marker}"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


__all__ = [n for n in dir() if not n.startswith("_")]
