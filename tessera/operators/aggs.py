"""Group aggregations, pivots and summary tables.

All aggregates here are algebraic or mergeable, so Spark runs them as a
partial (map-side) aggregate followed by one shuffle on the group key; a hot
key contributes one partial row per map task, not all its rows.  The few
list-valued aggregates (codes or notes per entity) are marked: their output is
one value per entity by definition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import col_of
from ..functions.codes import bucket_model_tag, extract_run_number
from ..functions.text import count_words
from ..plans.quantiles import exact_quantiles


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def agg_collect_codes(df: DataFrame, keys, code: str, out: str | None = None) -> DataFrame:
    """Sorted list of codes per entity (list size = codes of that entity)."""
    return df.groupBy(*_k(keys)).agg(F.array_sort(F.collect_list(code)).alias(out or code))


def agg_any_match(df: DataFrame, keys, cond: Column, out: str) -> DataFrame:
    return df.groupBy(*_k(keys)).agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias(out))


def agg_count_rows(df: DataFrame, keys, out: str = "count") -> DataFrame:
    return df.groupBy(*_k(keys)).agg(F.count(F.lit(1)).alias(out))


def agg_count_matching(df: DataFrame, keys, cond: Column, out: str,
                       compat: bool = False) -> DataFrame:
    """Matching rows per group.  ``compat=True`` counts after de-duplicating
    the keys, i.e. 1 if any row matches (the original quirk)."""
    keys = _k(keys)
    if compat:
        return (df.where(cond).select(*keys).distinct()
                .groupBy(*keys).agg(F.count(F.lit(1)).alias(out)))
    return df.groupBy(*keys).agg(F.count_if(cond).alias(out))


def agg_max_bool(df: DataFrame, keys, c, out: str) -> DataFrame:
    return df.groupBy(*_k(keys)).agg(F.coalesce(F.bool_or(col_of(c)), F.lit(False)).alias(out))


def agg_count_distinct(df: DataFrame, keys, c: str, out: str) -> DataFrame:
    return df.groupBy(*_k(keys)).agg(F.count_distinct(c).alias(out))


def agg_count_nonnull(df: DataFrame, keys, c: str, out: str) -> DataFrame:
    return df.groupBy(*_k(keys)).agg(F.count(c).alias(out))


def agg_mean(df: DataFrame, keys, c: str, out: str) -> DataFrame:
    return df.groupBy(*_k(keys)).agg(F.avg(c).alias(out))


def ordered_list(value: Column, order: Sequence[Column]) -> Column:
    """Aggregate: values sorted by ``order`` (each order column ascending,
    nulls last) -- sorting a per-group array, never the whole table."""
    keyed = F.struct(*[F.struct(o.isNull().alias("n"), o.alias("v")) for o in order],
                     value.alias("_v"))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda e: e["_v"])


def agg_notes(df: DataFrame, keys, text: str, ts: str, tiebreak: str | None = None,
              out_text: str = "text") -> DataFrame:
    """Text joined in time order, note count and mean words per note."""
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    return df.groupBy(*_k(keys)).agg(
        F.array_join(ordered_list(F.col(text), order), " ").alias(out_text),
        F.count(text).alias("note_count"),
        F.avg(count_words(text)).alias("avg_note_length"))


def agg_concat_text(df: DataFrame, keys, text: str, order: Sequence[str],
                    out: str = "text", sep: str = " ") -> DataFrame:
    return df.groupBy(*_k(keys)).agg(
        F.array_join(ordered_list(F.col(text), [F.col(o) for o in order]), sep).alias(out))


def agg_max_label(df: DataFrame, keys, label: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*_k(keys)).agg(F.max(label).alias(out or label))


def agg_last_nonnull(df: DataFrame, keys, ts: str, cols: Sequence[str],
                     tiebreak: str | None = None) -> DataFrame:
    """Per column, the last non-null value by time; undated rows count as the
    latest (null times sort last, as in pandas)."""
    order = F.struct(F.col(ts).isNull().alias("undated"), F.col(ts).alias("ts"),
                     *([F.col(tiebreak).alias("tb")] if tiebreak else []))
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
    return df.groupBy(*_k(keys)).agg(*aggs)


def pivot_mean(df: DataFrame, keys, name: str, value: str, names: Sequence[str],
               clean: bool = True) -> DataFrame:
    """One column per listed name with the mean value; text values are parsed
    to numbers first (non-numbers ignored).  A fixed name list keeps the
    schema stable and avoids a distinct-values job."""
    from .clean import clean_name
    v = F.col(value).cast("string").try_cast("double") if dict(df.dtypes)[value] == "string" \
        else F.col(value).cast("double")
    src = df.select(*_k(keys), F.col(name).alias("_name"), v.alias("_v"))
    if clean:
        src = src.withColumn("_name", F.lower(F.regexp_replace("_name", "[^0-9a-zA-Z]+", "_")))
    out = src.groupBy(*_k(keys)).pivot("_name", list(names)).agg(F.avg("_v"))
    return out


def pivot_first(df: DataFrame, keys, name: str, value: str, names: Sequence[str],
                order: str | None = None) -> DataFrame:
    """First value per (keys, name); ``order`` makes "first" explicit."""
    if order:
        agg = F.min_by(F.col(value), F.col(order))
    else:
        agg = F.first(F.col(value), ignorenulls=True)
    return df.groupBy(*_k(keys)).pivot(name, list(names)).agg(agg)


def pivot_run_model_mean(df: DataFrame, run: str, model: str, value: str,
                         models: Sequence[str]) -> DataFrame:
    return df.groupBy(run).pivot(model, list(models)).agg(F.avg(value))


def agg_macro_by_run(df: DataFrame, model: str, run: str,
                     metrics: Mapping[str, str]) -> DataFrame:
    """Mean over classes per (model, run); ``metrics`` maps input -> output."""
    return df.groupBy(model, run).agg(*[F.avg(i).alias(o) for i, o in metrics.items()])


def agg_mean_std(df: DataFrame, keys, metrics: Sequence[str]) -> DataFrame:
    """``{m}_mean`` and sample ``{m}_std`` per group."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*_k(keys)).agg(*aggs)


def agg_importance_summary(df: DataFrame, keys, value: str) -> DataFrame:
    return df.groupBy(*_k(keys)).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("count"))


def agg_resource_by_model(log: DataFrame, n: int = 30, tag: str = "tag",
                          metrics: Sequence[str] = ("cpu_pct", "gpu_hrs", "disk_used_gb",
                                                    "elapsed_hr"),
                          order: str | None = None) -> DataFrame:
    """Mean resources per model family over the family's last ``n`` runs.

    The run number is read after either ``run`` or ``iter`` (0 when absent).
    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so each map task forwards at most ``n`` rows per family.
    """
    fam = bucket_model_tag(F.col(tag))
    runno = extract_run_number(F.col(tag), default=0)
    src = log.select(fam.alias("model_type"), runno.alias("iter_num"), *metrics,
                     *([order] if order else [tag]))
    w = Window.partitionBy("model_type").orderBy(
        F.col("iter_num").desc(), F.col(order or tag).desc())
    last = src.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return last.groupBy("model_type").agg(*[F.avg(m).alias(m) for m in metrics])


def benchmark_summary(perf: DataFrame, resources: DataFrame, key: str = "model",
                      notes: Mapping[str, str] | None = None) -> DataFrame:
    """Performance table full-outer-joined with resource use, plus notes."""
    out = perf.join(resources, key, "full_outer")
    if notes:
        from ..functions.codes import lookup_map
        out = out.withColumn("notes", lookup_map(F.col(key), notes))
    return out


def class_distribution(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """Rows per class including zero-count classes and a null-label row."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(int(c),) for c in classes], f"{label} int")
    counts = df.groupBy(F.col(label).cast("int").alias(label)).agg(F.count(F.lit(1)).alias("n"))
    known = dom.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    other = counts.join(dom, label, "left_anti")
    return known.unionByName(other)


def median_global(df: DataFrame, c: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, c, [0.5], names=[out])


def note_stats(notes: DataFrame, subject: str, admission: str) -> DataFrame:
    """Mean / p95 / max notes per admission and mean admissions per patient."""
    per_adm = notes.groupBy(subject, admission).agg(F.count(F.lit(1)).alias("n_notes"))
    q = exact_quantiles(per_adm, "n_notes", [0.95], names=["p95_notes_per_admission"])
    per_pat = per_adm.groupBy(subject).agg(F.count(F.lit(1)).alias("n_adm"))
    base = per_adm.agg(F.avg("n_notes").alias("mean_notes_per_admission"),
                       F.max("n_notes").alias("max_notes_per_admission"),
                       F.count(F.lit(1)).alias("n_admissions"))
    return base.select(
        "*",
        q.scalar().alias("p95_notes_per_admission"),
        per_pat.agg(F.avg("n_adm")).scalar().alias("mean_admissions_per_patient"),
        per_pat.agg(F.count(F.lit(1))).scalar().alias("n_patients"))


def eda_overview(df: DataFrame) -> DataFrame:
    """Long table: column, type, non-null count and total rows (one pass)."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                     F.col(f"_nn{i}").alias("non_null"), F.col("_rows").alias("rows"))
            for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def eda_histogram(df: DataFrame, c: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin holds the maximum;
    empty bins are listed with 0."""
    x = F.col(c).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    s = mm.select(F.struct("lo", "hi")).scalar()
    lo, hi = s["lo"], s["hi"]
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.floor((x - lo) / width) + 1, F.lit(bins))).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dom = mm.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", "hi")
    dom = dom.select("bin", (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins)
                     .alias("bin_lo"),
                     (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_hi"))
    return dom.join(counts, "bin", "left").select("bin", "bin_lo", "bin_hi",
                                                  F.coalesce("n", F.lit(0)).alias("n"))


def eda_category_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(c))


def eda_box_stats(df: DataFrame, by: str, c: str) -> DataFrame:
    return exact_quantiles(df, c, [0.0, 0.25, 0.5, 0.75, 1.0], by=[by],
                           names=["min", "q1", "median", "q3", "max"])


def duration_totals(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count(c).alias("runs"), F.sum(c).alias("total_sec"),
                  F.avg(c).alias("avg_sec"))


def best_run(df: DataFrame, run: str, score: str) -> DataFrame:
    """The run with the highest mean score (ties -> the smaller run id)."""
    per = df.groupBy(run).agg(F.avg(score).alias("mean_score"))
    return per.agg(F.max_by(F.col(run), F.struct(F.col("mean_score"), -F.col(run))).alias(run),
                   F.max("mean_score").alias("mean_score"))


def min_p_by_pair(df: DataFrame, a: str = "model_1", b: str = "model_2",
                  p: str = "p_value") -> DataFrame:
    return df.groupBy(a, b).agg(F.min(p).alias("min_p"))
