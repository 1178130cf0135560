"""Joins on keys that many rows may share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 5_000
HOT_KEYS = 20_000


def join_counted(rows: DataFrame, table: DataFrame, on: Sequence[str], total: int,
                 hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined (inner) with ``table``, which has one row a key and says in
    ``weight`` how many rows may have it; the weights sum to at most ``total``.

    Keys above ``max(hot_rows, total / hot_keys)`` rows, of which there can be at
    most ``hot_keys``, are broadcast, so no task takes all rows of a hot key; the
    others are joined by shuffle."""
    on = list(on)
    limit = max(hot_rows, total // hot_keys)
    hot = table.where(F.col("weight") > limit).drop("weight").withColumn("_hot", F.lit(True))
    cold = table.where(F.col("weight") <= limit).drop("weight")
    tagged = rows.join(F.broadcast(hot), on, "left")
    columns = rows.columns + [c for c in cold.columns if c not in on]
    return (tagged.where("_hot").select(columns)
            .unionByName(tagged.where("_hot is null").select(rows.columns).join(cold, on).select(columns)))
