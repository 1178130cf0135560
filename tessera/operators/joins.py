"""Joins between entity tables.

No operator here adds a ``broadcast`` hint on data-derived tables: AQE turns a
sort-merge join into a broadcast join at run time only after it has measured
the materialised size of the smaller side (``autoBroadcastJoinThreshold``), so
the size check is done by the engine on real statistics.  Keys are given as
lists, joins are always equi-joins, and ``null`` keys never match (Spark SQL
semantics; pandas would match NaN to NaN).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def dedup_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the smallest value of every other column.

    Partial aggregation combines duplicates map-side, so a hot key costs no
    more shuffle than a cold one.
    """
    keys = _keys(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest])


def join_left_composite(left: DataFrame, right: DataFrame, keys, dedup: bool = True) -> DataFrame:
    """Left join on several keys; ``dedup=False`` keeps the fan-out of a
    one-to-many right side (the original behaviour)."""
    keys = _keys(keys)
    r = dedup_by_key(right, keys) if dedup else right
    return left.join(r, keys, "left")


def join_left_single(left: DataFrame, right: DataFrame, key: str,
                     fill: Mapping[str, object] | None = None) -> DataFrame:
    out = left.join(right, _keys(key), "left")
    if fill:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    return out


def join_left_flag_fill(left: DataFrame, right: DataFrame, keys,
                        defaults: Mapping[str, object]) -> DataFrame:
    """Left join pre-aggregated flags/counts; missing -> defaults (False/0)."""
    out = left.join(right, _keys(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def join_left_renamed(left: DataFrame, right: DataFrame,
                      pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Left join where key names differ ((left, right) pairs); right keys dropped."""
    r = right.withColumnsRenamed({rk: lk for lk, rk in pairs if rk != lk})
    return left.join(r, [lk for lk, _ in pairs], "left")


def join_full_outer(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right, _keys(keys), "full_outer")


def join_semi_split(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids`` (e.g. the validation split)."""
    return df.join(ids.select(key), key, "left_semi")


def join_anti_split(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids`` (e.g. the training split)."""
    return df.join(ids.select(key), key, "left_anti")


def join_inner_align(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return left.join(right, _keys(key), "inner")


def join_intersect_ids(preds: DataFrame, id_col: str, model: str) -> DataFrame:
    """Ids that appear for every model."""
    n_models = preds.agg(F.count_distinct(model)).scalar()
    per_id = preds.groupBy(id_col).agg(F.count_distinct(model).alias("_m"))
    return per_id.where(F.col("_m") == n_models).select(id_col)


def join_pairwise_models(df: DataFrame, run: str, model: str, value: str,
                         models: Sequence[str] | None = None) -> DataFrame:
    """Paired values of every unordered model pair, matched by run.

    An equi-join on ``run`` of the (run, model) table with itself: each
    (run, model) is reduced to one value first (the smallest, if it repeats), so
    the join is as wide as its output.
    Output: run, model_1, model_2, value_1, value_2 (both values present).
    """
    one = df.where(F.col(model).isNotNull() & F.col(value).isNotNull())
    if models is not None:
        one = one.where(F.col(model).isin(list(models)))
    one = one.groupBy(run, model).agg(F.min(F.col(value).cast("double")).alias("_v"))
    a = one.select(run, F.col(model).alias("model_1"), F.col("_v").alias("value_1"))
    b = one.select(run, F.col(model).alias("model_2"), F.col("_v").alias("value_2"))
    return a.join(b, run).where(F.col("model_1") < F.col("model_2")).select(
        run, "model_1", "model_2", "value_1", "value_2")


def join_wide_features(dfs: Sequence[DataFrame], keys, how: str = "left") -> DataFrame:
    """Column-wise concat of feature blocks by entity key (never by position)."""
    keys = _keys(keys)
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, keys, how)
    return out
