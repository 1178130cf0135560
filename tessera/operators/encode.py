"""Code-category flags, membership labels and categorical encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import normalize_code
from ..plans.ordered import ordered_scan
from ..session import SMALL_SIDE_MAX, broadcast_if_small, cut_lineage


def prefix_table(spark, codes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(category, prefix) rows from a category -> prefixes mapping."""
    rows = [(cat, p) for cat, ps in codes.items() for p in ps]
    return spark.createDataFrame(rows, "category string, prefix string")


def code_category_flags(df: DataFrame, keys: Sequence[str], code: str,
                        prefixes: DataFrame, categories: Sequence[str] | None = None,
                        max_prefix_len: int | None = None) -> DataFrame:
    """One boolean column per category: any code of the entity starts with
    one of the category's prefixes.

    Only the *distinct* codes are expanded into their own prefixes (``1``,
    ``12``, ``123`` ... up to the longest listed prefix) and equi-joined to the
    prefix table, never matched in a nested loop.  The resulting code table, one
    row of flags per distinct code, is joined back to the rows (broadcast when an
    exact count shows it small), and one ``groupBy``, combined map-side, ORs the
    flags per entity.  Entities without any match get their all-false row.
    """
    keys = list(keys)
    if categories is None:
        categories = [r[0] for r in prefixes.select("category").distinct()
                      .orderBy("category").collect()]
    if max_prefix_len is None:
        max_prefix_len = prefixes.agg(F.max(F.length("prefix"))).collect()[0][0] or 1
    rows = df.select(*keys, normalize_code(code).alias("_c"))
    n_chars = F.least(F.length("_c"), F.lit(max_prefix_len))
    own_prefixes = F.transform(F.sequence(F.lit(1), n_chars), lambda i: F.substring("_c", 1, i))
    codes = rows.select("_c").where(F.length("_c") > 0).distinct()
    hits = codes.select("_c", F.explode(own_prefixes).alias("prefix")).join(
        prefixes.select("prefix", "category"), "prefix")
    flag = lambda c: F.bool_or(F.col("category") == F.lit(c)).alias(f"_f{categories.index(c)}")
    table = cut_lineage(hits.groupBy("_c").agg(*[flag(c) for c in categories]))
    return rows.join(broadcast_if_small(table), "_c", "left").groupBy(*keys).agg(*[
        F.coalesce(F.bool_or(f"_f{i}"), F.lit(False)).alias(c) for i, c in enumerate(categories)])


def label_membership(df: DataFrame, id_col: str, hits: DataFrame, hit_id: str,
                     out: str = "label") -> DataFrame:
    """1 if the entity appears in the hit table, else 0 (semi-join style)."""
    h = hits.select(F.col(hit_id).alias(id_col)).distinct().withColumn("_hit", F.lit(1))
    return df.join(h, id_col, "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def category_codes(df: DataFrame, col: str, null_token: str | None = None,
                   code: str = "code", broadcast_max: int = SMALL_SIDE_MAX) -> DataFrame:
    """Distinct values of ``col`` with their 0-based sorted position.

    The distinct values are ranked by the ordered scan, so even a
    high-cardinality column never sorts in one task.  The table is marked for
    broadcast when it holds at most ``broadcast_max`` values.
    """
    v = F.col(col) if null_token is None else F.coalesce(F.col(col).cast("string"),
                                                         F.lit(null_token))
    distinct = df.select(v.alias("_v")).where(F.col("_v").isNotNull()).distinct()
    ranked = cut_lineage(ordered_scan(distinct, ["_v"]))
    codes = ranked.select(F.col("_v").alias(col), (F.col("_rn") - 1).cast("int").alias(code))
    return broadcast_if_small(codes, broadcast_max)


def encode_category(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Replace a category by its sorted code; null -> -1 (pandas cat.codes)."""
    codes = category_codes(df, col, code="_code")
    return (df.join(codes, col, "left")
            .withColumn(out or col, F.coalesce(F.col("_code"), F.lit(-1))).drop("_code"))


def encode_labels_all(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Label-encode every non-numeric column as text (null -> ``'nan'``) by
    alphabetical order of its values."""
    num = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean")
    cols = [c for c, t in df.dtypes if c not in exclude and t not in num
            and not t.startswith("decimal")]
    out = df
    for c in cols:
        codes = category_codes(df, c, null_token="nan", code="_code")
        out = (out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("nan")))
               .join(codes, c, "left").drop(c).withColumnRenamed("_code", c))
    return out.select(*df.columns)
