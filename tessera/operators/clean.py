"""Projections, filters, fills and data contracts (DataFrame -> DataFrame)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOTE_TEMPLATE_PHRASES, drop_templates
from ..plans.quantiles import exact_quantiles
from ..session import broadcast_if_small


def filter_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def filter_in_list(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def filter_drop_templates(df: DataFrame, col: str,
                          phrases: Sequence[str] = NOTE_TEMPLATE_PHRASES) -> DataFrame:
    """Drop rows whose text contains any template phrase (case-insensitive);
    rows with null text are kept."""
    return df.where(drop_templates(col, phrases))


def filter_drop_sentinel(df: DataFrame, col: str, value=-1) -> DataFrame:
    """Drop rows equal to the sentinel; null labels are kept (pandas ``!=``)."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def filter_numeric_class(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose class text parses as a number; cast it to int."""
    num = F.col(col).cast("string").try_cast("double")
    return df.where(num.isNotNull()).withColumn(col, num.cast("int"))


def filter_contains_ci(df: DataFrame, col: str, text: str) -> DataFrame:
    return df.where(F.coalesce(F.col(col).ilike(f"%{text}%"), F.lit(False)))


def filter_latest_n_runs(df: DataFrame, col: str, n: int = 30, out: str = "iter_num") -> DataFrame:
    """Run number = first digits in ``col``; keep runs in ``(max - n, max]``."""
    s = F.regexp_extract(F.col(col).cast("string"), r"(\d+)", 1)
    with_n = df.withColumn(out, F.when(s == "", None).otherwise(s).cast("long"))
    mx = with_n.agg(F.max(out)).scalar()  # scalar subquery, computed once
    return with_n.where((F.col(out) > mx - n) & (F.col(out) <= mx))


def filter_rare_classes(df: DataFrame, label: str, min_count: int = 5) -> DataFrame:
    """Keep rows of classes with at least ``min_count`` rows (semi join)."""
    keep = df.groupBy(label).count().where(F.col("count") >= min_count).select(label)
    return df.join(broadcast_if_small(keep), label, "left_semi")


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def clean_name(name: str) -> str:
    n = name.strip().lower()
    return re.sub(r"[^0-9a-z]+", "_", n)


def normalize_column_names(df: DataFrame) -> DataFrame:
    """strip + lower + non-alphanumerics to ``_``; later duplicates dropped."""
    seen, cols = set(), []
    for c in df.columns:
        n = clean_name(c)
        if n in seen:
            continue
        seen.add(n)
        cols.append(F.col(f"`{c}`").alias(n))
    return df.select(*cols)


def detect_column(df: DataFrame, candidates: Sequence[str]) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def coalesce_duplicate_columns(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Row-wise first non-null of ``cols`` into ``out``; the inputs are dropped."""
    merged = F.coalesce(*[F.col(c) for c in cols])
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, merged.alias(out))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def numeric_columns(df: DataFrame) -> list[str]:
    num = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return [c for c, t in df.dtypes if t in num or t.startswith("decimal")]


def fill_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null -> exact (interpolated) column median; all numeric columns by default.
    Filled columns become double, as a numeric column with gaps does in pandas,
    so a median between two integers is kept exactly.

    All medians come from one job: the columns are unpivoted to
    ``(column, value)`` rows and the exact quantile is grouped by column name
    (a group count bounded by the schema, so its statistics are broadcast).
    """
    cols = list(cols) if cols else numeric_columns(df)
    if not cols:
        return df
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v"))
                             for c in cols])).alias("_kv")
    long = df.select(kv).select("_kv.*")
    meds = exact_quantiles(long, "_v", [0.5], by=["_col"], names=["m"], few_groups=True)
    medmap = meds.agg(F.map_from_entries(F.collect_list(F.struct("_col", "m")))).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), medmap[F.lit(c)]) for c in cols})


def drop_incomplete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def check_required_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def check_class_coverage(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """Rows per class with status ``present`` / ``missing`` / ``unexpected``."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(int(c),) for c in classes], f"{label} int")
    counts = df.groupBy(F.col(label).cast("int").alias(label)).agg(F.count(F.lit(1)).alias("n"))
    out = dom.withColumn("_expected", F.lit(True)).join(counts, label, "full_outer")
    return out.select(
        label,
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.when(F.col("_expected").isNull(), "unexpected")
         .when(F.col("n").isNull(), "missing").otherwise("present").alias("status"))


def check_model_alignment(preds: DataFrame, id_col: str = "subject_id", model: str = "model",
                          probs: str = "probs") -> DataFrame:
    """One row: models, distinct class counts, ids common to all models, ok flag."""
    n_models = preds.agg(F.count_distinct(model)).scalar()
    per_id = preds.groupBy(id_col).agg(F.count_distinct(model).alias("_m"))
    n_common = per_id.where(F.col("_m") == n_models).agg(F.count(F.lit(1))).scalar()
    out = preds.agg(F.count_distinct(F.size(probs)).alias("n_class_sizes"),
                    F.max(F.size(probs)).alias("n_classes"))
    out = out.select(n_models.alias("n_models"), "n_class_sizes", "n_classes",
                     n_common.alias("n_common_ids"))
    return out.withColumn("ok", (F.col("n_models") >= 2) & (F.col("n_class_sizes") == 1)
                          & (F.col("n_common_ids") > 0))


def check_foreign_keys(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent row."""
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return (child.where(F.col(fk).isNotNull())
            .join(p, F.col(fk) == F.col("_pk"), "left_anti"))
