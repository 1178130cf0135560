"""Synthetic oversampling: SMOTE, ADASYN, borderline SMOTE and SMOTE-NC.

Every class below the target (default: the largest class) grows to it.  A synthetic
row lies between a base row and one of its ``k`` nearest neighbours in its class:
``base + step * (neighbour - base)``.  What is drawn is a function of the seed, the
class and the draw's number (md5), so results do not depend on partitioning and any
SQL engine can repeat them.

* ``oversample_smote``: base and neighbour uniformly among all (row, neighbour).
* ``oversample_adasyn``: each row's share follows the number of its ``k`` nearest rows of
  all classes that belong to others; shares are made whole by largest remainder.
* ``oversample_borderline``: only bases in danger: at least half, but not all, of
  their ``m`` nearest rows of all classes belong to other classes.
* ``oversample_smotenc``: unequal categories add the median standard deviation of the
  class's numeric columns to the distance; a synthetic row takes the category that
  most of the base's neighbours have (ties: the smallest).

The output has ``id_col``, ``label``, the feature columns (numeric ones as doubles) and
``_copy`` (0 for original rows, else the draw's number in its class), ``_base``,
``_neighbor`` and ``_step``; a synthetic row has no id.

Neighbours come from :func:`knn_graph` (exact, at most ``k`` rows each).  The classes
are taken one by one, labels being few; rows are only counted per class on the
driver.

Defined cases: rows without a label, or with a null or NaN in a numeric column, are
kept and never drawn from.  A class of ``n <= k`` usable rows has ``n - 1``
neighbours a row; a class of one repeats that row.  A class without rows to draw
from (no majority neighbour for ADASYN, none in danger for borderline) stays as it
is.  Extra columns are dropped.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ordered_scan
from ..session import cut_lineage
from .encode import encode_category
from .neighbors import knn_graph

METHODS = ("smote", "adasyn", "borderline", "smotenc")


def draw(seed: int, *parts: Column) -> Column:
    """A whole number below 2**48, by md5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def draw_step(seed: int, *parts: Column) -> Column:
    """A number in [0, 1), independent of :func:`draw`."""
    return draw(seed, F.lit("step"), *parts) / float(1 << 48)


class _Classes:
    """The usable rows ``(id, y, v)`` and the classes that are to grow."""

    def __init__(self, train: DataFrame, id_col: str, label: str, cols: Sequence[str], target: int | None, extra: Sequence[str] = ()):
        numbers = [F.col(c).cast("double") for c in cols]
        usable = F.col(label).isNotNull() & F.col(id_col).isNotNull()
        for x in numbers:
            usable = usable & x.isNotNull() & ~F.isnan(x)
        rows = train.where(usable).select(F.col(id_col).alias("id"), F.col(label).alias("y"), F.array(*numbers).alias("v"), *extra)
        self.rows = cut_lineage(rows)
        self.kind = dict(train.dtypes)[label]
        every = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
        sizes = {r["y"]: r["n"] for r in self.rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        goal = target if target is not None else max((r["n"] for r in every), default=0)
        # class: (usable rows, rows to make)
        self.grow = {r[label]: (sizes[r[label]], goal - r["n"]) for r in sorted(every, key=lambda r: str(r[label]))
                     if goal > r["n"] and sizes.get(r[label])}

    def of(self, y) -> DataFrame:
        return self.rows.where(F.col("y") == F.lit(y))

    def value(self, table: dict) -> Column:
        """A number by class."""
        out = F.lit(None).cast("long")
        for y, n in table.items():
            out = F.when(F.col("y") == F.lit(y), F.lit(n).cast("long")).otherwise(out)
        return out

    def in_class(self, k: int, queries: Column | None = None, weights: dict | None = None, n_cat: int = 0) -> DataFrame:
        """(id, near): each row's neighbours in its class, nearest first."""
        out = self.rows.select("id", F.array("id").alias("near")).limit(0)
        for y in self.grow:
            g = knn_graph(self.of(y), "id", "v", k, "euclidean", queries, n_cat, (weights or {}).get(y, 0.0))
            out = out.unionByName(g.groupBy("id").agg(F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "neighbor"))), lambda x: x["neighbor"]).alias("near")))
        return out

    def other_neighbors(self, k: int) -> DataFrame:
        """(id, y, found, others): of the ``k`` nearest rows of all classes, how many
        there are and how many belong to other classes; rows of growing classes."""
        growing = F.col("y").isin(list(self.grow)) if self.grow else F.lit(False)
        g = knn_graph(self.rows, "id", "v", k, "euclidean", growing)
        mine = self.rows.where(growing).select("id", "y")
        theirs = self.rows.select(F.col("id").alias("neighbor"), F.col("y").alias("their"))
        met = g.select("id", "neighbor").join(theirs, "neighbor").join(mine, "id")
        counts = met.groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("their") != F.col("y")).alias("others"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return mine.join(counts, "id", "left").select("id", "y", zero("found"), zero("others"))


def _numbered_draws(c: _Classes, seed: int, bases: DataFrame, sizes: dict, near: DataFrame) -> DataFrame:
    """Uniform draws among the (base, neighbour) pairs of each class: ``bases`` is (id, y)
    with ``sizes`` rows a class; (y, copy, id, neighbor, step)."""
    needs = {y: need for y, (_, need) in c.grow.items() if sizes.get(y)}
    at, stretches = 0, []
    for y, need in needs.items():
        stretches.append((y, at, at + need))
        at += need
    which, first = F.lit(None).cast(c.kind), F.lit(0)
    for y, lo, hi in stretches:
        inside = (F.col("id") >= lo) & (F.col("id") < hi)
        which, first = F.when(inside, F.lit(y).cast(c.kind)).otherwise(which), F.when(inside, F.lit(lo)).otherwise(first)
    draws = bases.sparkSession.range(at).select(which.alias("y"), (F.col("id") - first + 1).alias("copy"))
    # rows of a class all have as many neighbours
    pairs = ordered_scan(bases, ["id"], by=["y"], rn="at").join(near, "id", "left").withColumn("k", F.coalesce(F.size("near"), F.lit(0)))
    pairs = pairs.withColumn("k", F.greatest(F.lit(1), "k"))
    pick = F.pmod(draw(seed, F.col("y"), F.col("copy")), c.value(sizes) * F.col("width"))
    widths = {r["y"]: r["k"] for r in pairs.groupBy("y").agg(F.max("k").alias("k")).collect()}
    draws = draws.withColumn("width", c.value(widths)).withColumn("pick", pick)
    draws = draws.select("y", "copy", (F.floor(F.col("pick") / F.col("width")) + 1).alias("at"), (F.col("pick") % F.col("width")).cast("int").alias("nth"),
                         draw_step(seed, F.col("y"), F.col("copy")).alias("step"))
    met = draws.join(pairs, ["y", "at"])
    return met.select("y", "copy", "id", F.coalesce(F.get("near", F.col("nth")), F.col("id")).alias("neighbor"), "step")


def _with_originals(train: DataFrame, id_col: str, label: str, cols: Sequence[str], c: _Classes, drawn: DataFrame,
                    cats: DataFrame | None = None, cat_cols: Sequence[str] = ()) -> DataFrame:
    """The input's rows and a row per draw ``(y, copy, id, neighbor, step)``."""
    kind = dict(train.dtypes)[id_col]
    names = [*cols, *cat_cols]
    empty = lambda t: F.lit(None).cast(t)
    originals = train.select(id_col, label, *(F.col(x).cast("double").alias(x) for x in cols), *cat_cols, F.lit(0).cast("long").alias("_copy"),
                             empty(kind).alias("_base"), empty(kind).alias("_neighbor"), empty("double").alias("_step"))
    vectors = c.rows.select("id", "v")
    met = drawn.join(vectors, "id").join(vectors.select(F.col("id").alias("neighbor"), F.col("v").alias("w")), "neighbor")
    mixed = F.zip_with("v", "w", lambda a, b: a + F.col("step") * (b - a))
    made = met.withColumn("x", mixed)
    if cats is not None:
        made = made.join(cats, "id")
    made = made.select(empty(kind).alias(id_col), F.col("y").alias(label), *(F.col("x")[j].alias(x) for j, x in enumerate(cols)), *cat_cols,
                       F.col("copy").alias("_copy"), F.col("id").alias("_base"), F.col("neighbor").alias("_neighbor"), F.col("step").alias("_step"))
    return originals.select(id_col, label, *names, "_copy", "_base", "_neighbor", "_step").unionByName(made)


def oversample_smote(train: DataFrame, id_col: str, label: str, cols: Sequence[str], k: int = 5,
                     target: int | None = None, seed: int = 42) -> DataFrame:
    c = _Classes(train, id_col, label, cols, target)
    bases = c.rows.where(F.col("y").isin(list(c.grow))).select("id", "y") if c.grow else c.rows.select("id", "y").limit(0)
    near = cut_lineage(c.in_class(k))
    drawn = _numbered_draws(c, seed, bases, {y: n for y, (n, _) in c.grow.items()}, near)
    return _with_originals(train, id_col, label, cols, c, drawn)


def _quotas(c: _Classes, k: int) -> DataFrame:
    found = cut_lineage(c.other_neighbors(k))
    sums = {r["y"]: r["m"] for r in found.groupBy("y").agg(F.sum("others").alias("m")).collect()}
    need = {y: (n if sums.get(y) else 0) for y, (_, n) in c.grow.items()}
    total = F.greatest(F.lit(1), c.value(sums))
    share = F.col("others") * c.value(need)
    rows = found.select("id", "y", "others", F.floor(share / total).cast("long").alias("low"), F.pmod(share, total).alias("rest"))
    # floor() of a quotient of doubles may be off by one; the remainder is exact
    rows = rows.withColumn("low", ((share - F.col("rest")) / total).cast("long"))
    rows = cut_lineage(rows)
    given = {r["y"]: r["s"] for r in rows.groupBy("y").agg(F.sum("low").alias("s")).collect()}
    missing = {y: n - given.get(y, 0) for y, n in need.items()}
    ranked = ordered_scan(rows, [("rest", False), "id"], by=["y"], rn="place")
    more = (F.col("place") <= c.value(missing)).cast("long")
    return ranked.select("id", "y", "others", (F.col("low") + more).alias("quota"))


def adasyn_quotas(train: DataFrame, id_col: str, label: str, cols: Sequence[str], k: int = 5, target: int | None = None) -> DataFrame:
    """(id, label, majority_neighbors, quota): how many synthetic rows each row of a growing
    class is the base of; a class's quotas sum to what it lacks."""
    q = _quotas(_Classes(train, id_col, label, cols, target), k)
    return q.select(F.col("id").alias(id_col), F.col("y").alias(label), F.col("others").alias("majority_neighbors"), "quota")


def oversample_adasyn(train: DataFrame, id_col: str, label: str, cols: Sequence[str], k: int = 5,
                      target: int | None = None, seed: int = 42) -> DataFrame:
    c = _Classes(train, id_col, label, cols, target)
    quotas = _quotas(c, k).where("quota > 0")
    # draws of a class are numbered in the order of the bases
    numbered = ordered_scan(quotas, ["id"], by=["y"], sums=["quota"])
    each = numbered.select("id", "y", (F.col("_cum_quota").cast("long") - F.col("quota")).alias("before"),
                           F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("nth"))
    each = each.select("id", "y", (F.col("before") + F.col("nth")).alias("copy"))
    near = cut_lineage(c.in_class(k))
    met = each.join(near, "id", "left").withColumn("k", F.greatest(F.lit(1), F.coalesce(F.size("near"), F.lit(0))))
    nth = F.pmod(draw(seed, F.col("y"), F.col("copy")), F.col("k")).cast("int")
    drawn = met.select("y", "copy", "id", F.coalesce(F.get("near", nth), F.col("id")).alias("neighbor"),
                       draw_step(seed, F.col("y"), F.col("copy")).alias("step"))
    return _with_originals(train, id_col, label, cols, c, drawn)


def _dangers(c: _Classes, m: int) -> DataFrame:
    kind = (F.when((F.col("found") > 0) & (F.col("others") == F.col("found")), "noise")
            .when((F.col("found") > 0) & (2 * F.col("others") >= F.col("found")), "danger").otherwise("safe"))
    return c.other_neighbors(m).withColumn("kind", kind)


def borderline_classes(train: DataFrame, id_col: str, label: str, cols: Sequence[str], m: int = 10, target: int | None = None) -> DataFrame:
    """(id, label, majority_neighbors, kind): ``noise``, ``danger`` or ``safe`` for each
    row of a growing class."""
    d = _dangers(_Classes(train, id_col, label, cols, target), m)
    return d.select(F.col("id").alias(id_col), F.col("y").alias(label), F.col("others").alias("majority_neighbors"), "kind")


def oversample_borderline(train: DataFrame, id_col: str, label: str, cols: Sequence[str], k: int = 5, m: int = 10,
                          target: int | None = None, seed: int = 42) -> DataFrame:
    c = _Classes(train, id_col, label, cols, target)
    bases = cut_lineage(_dangers(c, m).where("kind = 'danger'").select("id", "y"))
    sizes = {r["y"]: r["n"] for r in bases.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    c.rows = cut_lineage(c.rows.join(bases.select("id", F.lit(True).alias("danger")), "id", "left"))
    near = cut_lineage(c.in_class(k, F.col("danger")))
    return _with_originals(train, id_col, label, cols, c, _numbered_draws(c, seed, bases, sizes, near))


def oversample_smotenc(train: DataFrame, id_col: str, label: str, cols: Sequence[str], cat_cols: Sequence[str], k: int = 5,
                       target: int | None = None, seed: int = 42) -> DataFrame:
    coded = train
    for j, x in enumerate(cat_cols):
        coded = encode_category(coded, x, f"_code{j}")
    codes = [f"_code{j}" for j in range(len(cat_cols))]
    c = _Classes(coded, id_col, label, cols, target, [*codes, *(F.col(x).alias(f"_cat{j}") for j, x in enumerate(cat_cols))])
    spread = c.rows.groupBy("y").agg(F.array(*(F.stddev_pop(F.col("v")[j]) for j in range(len(cols)))).alias("s")).collect()
    weights = {r["y"]: _median(r["s"]) for r in spread}
    plain = c.rows
    c.rows = plain.withColumn("v", F.concat("v", F.array(*(F.col(x).cast("double") for x in codes))))
    near = cut_lineage(c.in_class(k, weights=weights, n_cat=len(cat_cols)))
    c.rows = plain
    growing = plain.where(F.col("y").isin(list(c.grow))) if c.grow else plain.limit(0)
    drawn = _numbered_draws(c, seed, growing.select("id", "y"), {y: n for y, (n, _) in c.grow.items()}, near)
    own = F.struct(*(F.col(f"_cat{j}").alias(x) for j, x in enumerate(cat_cols)))
    values = plain.select(F.col("id").alias("neighbor"), own.alias("cats"))
    of = growing.select("id").join(near, "id", "left").select("id", F.explode(
        F.when(F.size("near") > 0, F.col("near")).otherwise(F.array("id"))).alias("neighbor"))
    modes = of.join(values, "neighbor").groupBy("id").agg(F.collect_list("cats").alias("all"))
    cats = modes.select("id", *(_mode(F.col("all")[x]).alias(x) for x in cat_cols))
    return _with_originals(train, id_col, label, cols, c, drawn, cats, cat_cols)


def _median(xs: Sequence[float]) -> float:
    s = sorted(xs)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if s else 0.0


def _mode(values: Column) -> Column:
    """The most frequent element, the smallest of several."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(
        (-F.size(F.filter(values, lambda x: x.eqNullSafe(v)))).alias("n"), v.alias("v")))
    return F.get(F.sort_array(counted), F.lit(0))["v"]


def oversample(method: str, train: DataFrame, id_col: str, label: str, cols: Sequence[str], cat_cols: Sequence[str] = (),
               target: int | None = None, seed: int = 42) -> DataFrame:
    """One of ``METHODS`` by name; all but SMOTE-NC take the categories, which must be
    coded, as numbers."""
    if method == "smotenc":
        return oversample_smotenc(train, id_col, label, cols, cat_cols, target=target, seed=seed)
    one = {"smote": oversample_smote, "adasyn": oversample_adasyn, "borderline": oversample_borderline}[method]
    return one(train, id_col, label, [*cols, *cat_cols], target=target, seed=seed)
