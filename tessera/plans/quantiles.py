"""Exact, interpolated quantiles without holding a whole group in one task.

``percentile``/``median`` keep a value->count map per group; for a continuous
column that map grows with the data and the final merge of a single global
group runs in one task.  We instead

1. run one distributed pass with ``count`` and ``approx_percentile`` (a
   mergeable GK sketch whose rank error is at most ``n / accuracy``) to get, for
   every requested probability, a bracket ``[lo, hi]`` that must contain the
   exact order statistics;
2. count the rows below each bracket (a second distributed aggregate);
3. count the rows inside the brackets by value (map-side, so a value held by
   most rows is one row): about ``8 n / accuracy`` distinct values per group and
   probability at most;
4. while a bracket may hold more than ``MAX_VALUES`` distinct values, narrow it:
   cut points from a mergeable sketch divide it into ``CELLS`` cells, a histogram
   counts them (``CELLS`` numbers a bracket), and only the cells that hold the two
   order statistics are kept.  What is left is a sorted array of bounded size, in
   which the statistics at ``(n - 1) * p`` are found and interpolated linearly
   (the rule used by pandas, NumPy and DuckDB's ``quantile_cont``).

Groups whose sketch bracket would not hold (never, given the sketch's error
bound; kept as a guard) fall back to their min/max range, which is still exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .ordered import ordered_scan

DEFAULT_ACCURACY = 100_000
# Distinct values of a bracket that are gathered into one array, and the cells into
# which a larger bracket is divided at a time.
MAX_VALUES = 20_000
CELLS = 256


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None,
                    accuracy: int = DEFAULT_ACCURACY, few_groups: bool = False) -> DataFrame:
    """One row per ``by`` group with one double column per probability.

    The per-group statistics are kept in the checkpoint folder and broadcast to
    the rows when an exact count shows them small (``few_groups=True`` says so
    without counting), so a group holding most of the rows never lands in one
    task; with more groups the planner joins them.
    """
    def bc(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if few_groups else broadcast_if_small(small)

    by = list(by)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]
    margin = 4.0 / accuracy
    lo_p = [max(p - margin, 0.0) for p in probs]
    hi_p = [min(p + margin, 1.0) for p in probs]
    x = F.col(col).cast("double")
    base = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))

    # pass 1: counts + sketch brackets
    stats = base.groupBy(*by).agg(
        F.count("_x").alias("_n"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        F.percentile_approx("_x", lo_p, accuracy).alias("_lo"),
        F.percentile_approx("_x", hi_p, accuracy).alias("_hi"),
    )
    j = list(range(len(probs)))
    stat_cols = ["_n", "_min", "_max", "_lo", "_hi"]
    if by:
        stats = cut_lineage(stats)
        joined = base.join(bc(stats), by, "inner")
    else:  # one global row, attached as a scalar subquery (no join at all)
        one = stats.select(F.struct(*stat_cols).alias("_s")).scalar()
        joined = base.withColumn("_s", one).select("_x", *[F.col(f"_s.{c}").alias(c) for c in stat_cols])

    # pass 2: rows below each bracket and rows inside it
    st = joined.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in stat_cols],
        *[F.count_if(F.col("_x") < F.element_at("_lo", i + 1)).alias(f"_b{i}") for i in j],
        *[F.count_if((F.col("_x") >= F.element_at("_lo", i + 1))
                     & (F.col("_x") <= F.element_at("_hi", i + 1))).alias(f"_c{i}") for i in j],
    )
    # ranks (0-based) of the two order statistics around (n-1)p
    rows = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        r0 = F.floor(h)
        r1 = F.least(r0 + 1, F.col("_n") - 1)
        ok = (F.col(f"_b{i}") <= r0) & (F.col(f"_b{i}") + F.col(f"_c{i}") > r1)
        lo = F.when(ok, F.element_at("_lo", i + 1)).otherwise(F.col("_min"))
        hi = F.when(ok, F.element_at("_hi", i + 1)).otherwise(F.col("_max"))
        b = F.when(ok, F.col(f"_b{i}")).otherwise(F.lit(0))
        rows.append(F.struct(F.lit(i).alias("j"), lo.alias("lo"), hi.alias("hi"),
                             b.cast("long").alias("b"), r0.cast("long").alias("r0"),
                             r1.cast("long").alias("r1"), (h - r0).alias("frac"),
                             F.when(ok, F.col(f"_c{i}")).otherwise(F.col("_n")).alias("rows")))
    brackets = st.select(*by, F.array(*rows).alias("_br"))

    # pass 3: keep only rows inside a bracket (one bracket array per group)
    brackets = cut_lineage(brackets)
    if by:
        tagged = base.join(bc(brackets), by, "inner")
    else:
        tagged = base.withColumn("_br", brackets.select("_br").scalar())
    inside = (tagged.select(*by, "_x", F.explode(F.filter(
        "_br", lambda r: (F.col("_x") >= r["lo"]) & (F.col("_x") <= r["hi"]))).alias("_b"))
        .select(*by, "_x", "_b.*"))
    values = inside.groupBy(*by, "j", "_x").agg(
        F.count(F.lit(1)).alias("_w"), *[F.first(c).alias(c) for c in ("b", "r0", "r1", "frac")])
    most = brackets.agg(F.max(F.array_max(F.transform("_br", lambda r: r["rows"])))).first()[0] or 0
    while most > MAX_VALUES:
        values = _narrowed(cut_lineage(values), by)
        most = values.groupBy(*by, "j").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    one = F.first(F.struct("b", "r0", "r1", "frac")).alias("_at")
    arrays = values.groupBy(*by, "j").agg(F.sort_array(F.collect_list(F.struct("_x", "_w"))).alias("_vs"), one)
    picked = arrays.select(*by, "j", _value_at("_vs", F.col("_at.b"), F.col("_at.r0")).alias("v0"),
                           _value_at("_vs", F.col("_at.b"), F.col("_at.r1")).alias("v1"), F.col("_at.frac").alias("frac"))
    val = (F.col("v0") + F.col("frac") * (F.col("v1") - F.col("v0"))).alias("v")
    long = picked.select(*by, "j", val)
    wide = long.groupBy(*by).agg(*[F.max(F.when(F.col("j") == i, F.col("v"))).alias(names[i])
                                   for i in j])
    if by:
        return stats.select(*by).join(wide, by, "left")
    # a global aggregate always yields one row (null quantiles for empty input)
    return wide.select(*names)


def _value_at(values: str, before: Column, rank: Column) -> Column:
    """Value of the 0-based ``rank`` in a sorted array of (value, count) structs that
    ``before`` rows precede."""
    start = F.struct(before.cast("long").alias("seen"), F.lit(None).cast("double").alias("x"))
    step = lambda s, v: F.struct((s["seen"] + v["_w"]).alias("seen"),
                                 F.when(s["x"].isNull() & (s["seen"] + v["_w"] > rank), v["_x"]).otherwise(s["x"]).alias("x"))
    return F.aggregate(values, start, step)["x"]


def _narrowed(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values of each bracket whose cell holds one of its two order statistics."""
    key = [*by, "j"]
    cuts = values.groupBy(*key).agg(F.array_distinct(F.percentile_approx(
        "_x", [(i + 1) / CELLS for i in range(CELLS - 1)], 50 * CELLS)).alias("_cuts"))
    cell = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    cut = cut_lineage(_beside(values, cuts, key).withColumn("_cell", cell).drop("_cuts"))
    cells = cut.groupBy(*key, "_cell").agg(F.sum("_w").alias("_w"), F.first(F.struct("b", "r0", "r1")).alias("_at"))
    # at most CELLS rows a bracket
    sums = cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("_cell").cast("double").alias("_x"), "_w"))).alias("_vs"),
                                   F.first("_at").alias("_at"))
    sums = sums.withColumns({f"_cell{i}": _value_at("_vs", F.col("_at.b"), F.col(f"_at.r{i}")) for i in (0, 1)})
    skipped = F.aggregate(F.filter("_vs", lambda v: v["_x"] < F.col("_cell0")), F.lit(0).cast("long"), lambda s, v: s + v["_w"])
    sums = sums.select(*key, "_cell0", "_cell1", skipped.alias("_skipped"))
    kept = _beside(cut, sums, key).where(F.col("_cell").between(F.col("_cell0"), F.col("_cell1")))
    return kept.withColumn("b", F.col("b") + F.col("_skipped")).select(*values.columns)


def _beside(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key; null keys are equal)."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    right = table.withColumnsRenamed(names)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(right, same).drop(*names.values())


def exact_median(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "median",
                 accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    return exact_quantiles(df, col, [0.5], by, [name], accuracy)


def exact_quantiles_discrete(df: DataFrame, col: str, probs: Sequence[float],
                             by: Sequence[str] = (),
                             names: Sequence[str] | None = None) -> DataFrame:
    """Exact interpolated quantiles for a column with repeated values (whole
    days, counts, codes), from a value histogram.

    The input is read once: ``(by, value) -> count`` is aggregated map-side
    (a hot value or group is combined before the shuffle) and kept in the
    checkpoint folder.  Running counts over the sorted distinct values come
    from the ordered scan, so no group is sorted in one task, and each order
    statistic is the smallest value whose running count passes its rank.
    Same results as :func:`exact_quantiles`, which suits continuous columns.
    """
    by = list(by)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]
    x = F.col(col).cast("double")
    base = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    hist = cut_lineage(base.groupBy(*by, "_x").agg(F.count(F.lit(1)).cast("double").alias("_w")))
    scanned = ordered_scan(hist, ["_x"], by=by, sums=["_w"])
    totals = hist.groupBy(*by).agg(F.sum("_w").alias("_n"))
    if by:
        joined = scanned.join(totals, by, "inner")
    else:
        joined = scanned.withColumn("_n", totals.select("_n").scalar())
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        r0 = F.floor(h)
        r1 = F.least(r0 + 1, F.col("_n") - 1)
        aggs += [F.min(F.when(F.col("_cum__w") > r0, F.col("_x"))).alias(f"_v0_{i}"),
                 F.min(F.when(F.col("_cum__w") > r1, F.col("_x"))).alias(f"_v1_{i}"),
                 F.first(h - r0).alias(f"_f_{i}")]
    picked = joined.groupBy(*by).agg(*aggs)
    vals = [(F.col(f"_v0_{i}") + F.col(f"_f_{i}") * (F.col(f"_v1_{i}") - F.col(f"_v0_{i}")))
            .alias(names[i]) for i in range(len(probs))]
    if by:
        return picked.select(*by, *vals)
    # a global aggregate always yields one row (null quantiles for empty input)
    return picked.select(*vals)
