"""Skew-proof ordered scans: exact row positions and running sums per group.

Spark's window functions put every row of a window partition into one task.
When one key may hold a third of all rows (a class label, a hot patient, a
global ordering with no partition key at all) that task becomes the whole job.

``ordered_scan`` computes the same values as::

    row_number() OVER (PARTITION BY by ORDER BY order)
    sum(c)       OVER (PARTITION BY by ORDER BY order ROWS UNBOUNDED PRECEDING)

but spreads a hot group over many tasks:

1. range-partition on ``(by, order)`` (Spark samples the key distribution, so a
   hot group is split across consecutive partitions) and tag each row with its
   partition; checkpoint it so that all later passes see the same tags;
2. an ordinary window numbers and sums the rows of each (partition, group);
3. groups that span partitions get carry-in offsets: at most two rows per
   partition, summed over the partitions before and broadcast to the rows.

All of it is Spark expressions: keys and carried columns keep their types and
values, and a null group key is a group like any other.

The order must be total (callers add tie-breaking columns) so that the result
is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions

OrderSpec = Sequence[str | tuple[str, bool]]

_PART = "_ordered_part"


def _sort_columns(order: OrderSpec) -> list:
    pairs = [(o, True) if isinstance(o, str) else (o[0], bool(o[1])) for o in order]
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in pairs]


def ordered_scan(df: DataFrame, order: OrderSpec, by: Sequence[str] = (),
                 sums: Sequence[str] = (), rn: str = "_rn",
                 cum_prefix: str = "_cum_", num_partitions: int | None = None) -> DataFrame:
    """Add ``rn`` (1-based position within ``by`` by ``order``) and inclusive
    running sums ``{cum_prefix}{c}`` for each ``c`` in ``sums`` (nulls count 0).
    """
    by, sums = list(by), list(sums)
    columns = df.columns
    n_parts = num_partitions or shuffle_partitions(df.sparkSession)
    in_order = _sort_columns(order)
    dealt = df.repartitionByRange(n_parts, *[F.col(c).asc_nulls_first() for c in by], *in_order)
    dealt = cut_lineage(dealt.withColumn(_PART, F.spark_partition_id()))
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in sums}

    local = Window.partitionBy(_PART, *by).orderBy(*in_order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = dealt.withColumns({rn: F.row_number().over(local).cast("long"),
                                 **{f"{cum_prefix}{c}": F.sum(value[c]).over(running) for c in sums}})

    totals = dealt.groupBy(_PART, *by).agg(F.count(F.lit(1)).alias("_k"),
                                           *[F.sum(value[c]).alias(f"_s{i}") for i, c in enumerate(sums)])
    spans = totals.groupBy(*by).agg(F.min(_PART).alias("_from"), F.max(_PART).alias("_to")).where("_from < _to")
    if by:
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by])
        spanning = totals.alias("a").join(spans.alias("s"), same, "left_semi")
    else:
        spanning = totals
    # a group that spans partitions is alone in all of them but its first and
    # last, so these are at most two rows per partition
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = spanning.select(F.col(_PART).alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
                            F.sum("_k").over(before).alias("_k"),
                            *[F.sum(f"_s{i}").over(before).alias(f"_s{i}") for i in range(len(sums))])
    here = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)],
                  F.col(_PART) == F.col("_p"))
    joined = scanned.join(F.broadcast(carry), here, "left")
    add = lambda c, k, zero: (F.col(c) + F.coalesce(F.col(k), F.lit(zero))).alias(c)
    return joined.select(*columns, add(rn, "_k", 0),
                         *[add(f"{cum_prefix}{c}", f"_s{i}", 0.0) for i, c in enumerate(sums)])
