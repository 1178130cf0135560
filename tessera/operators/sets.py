"""Set operations over result and id tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_metrics(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate tables whose columns differ; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def set_intersect_ids(dfs: Sequence[DataFrame], id_col: str) -> DataFrame:
    out = dfs[0].select(id_col)
    for d in dfs[1:]:
        out = out.intersect(d.select(id_col))
    return out


def set_except_classes(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """Expected classes that do not occur in ``df``."""
    dom = df.sparkSession.createDataFrame([(int(c),) for c in classes], f"{label} int")
    present = df.select(F.col(label).cast("int").alias(label))
    return dom.subtract(present)


def set_union_models(df: DataFrame, a: str = "model_1", b: str = "model_2",
                     out: str = "model") -> DataFrame:
    return df.select(F.col(a).alias(out)).union(df.select(F.col(b).alias(out))).distinct()


def distinct_pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).dropDuplicates()


def distinct_sample(df: DataFrame, col: str, prefix: str, n: int = 10) -> DataFrame:
    """The first ``n`` distinct values starting with ``prefix`` (a preview)."""
    return (df.select(col).where(F.col(col).startswith(prefix)).distinct()
            .orderBy(col).limit(n))
