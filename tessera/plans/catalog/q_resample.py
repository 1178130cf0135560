"""Neighbour graph and synthetic oversampling (2.9) on driver tables.

Every draw is an md5 of the seed, the class and the draw's number, so the SQL texts
repeat the whole result: graph, quotas, bases, neighbours and the rows made.
``embeddings`` has three classes of unequal size here; ``part`` has two numeric and
two categorical columns, and the parts of one kind as the smaller class.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions._util import r6
from ...operators import models as M
from ...operators import resample as R
from ...operators.neighbors import knn_graph
from . import query
from ._common import t

_DIMS = 64
_FEATS = [f"e{i}" for i in range(_DIMS)]


def _classes(spark, sf):
    y = F.when(F.col("label") == 0, 2).when(F.col("label") < 4, 1).otherwise(0)
    return t(spark, sf, "embeddings").select("vec_id", y.alias("y"), *[
        F.element_at("embedding", i + 1).cast("double").alias(f) for i, f in enumerate(_FEATS)])


# rows, class sizes, what each class lacks, and neighbours in the class and overall
_ROWS = """
r AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN 2 WHEN label < 4 THEN 1 ELSE 0 END AS y, embedding::double[] AS v FROM embeddings),
"""
_CLASSES = """
n AS (SELECT y, count(*) AS n FROM r GROUP BY y),
g AS (SELECT y, n, (SELECT max(n) FROM n) - n AS need, least(5, n - 1) AS k FROM n WHERE n < (SELECT max(n) FROM n)),
"""
_IN_CLASS = """
near AS (SELECT id, nid, nth FROM (
  SELECT a.id, b.id AS nid, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) - 1 AS nth
  FROM r a JOIN g ON g.y = a.y JOIN r b ON b.y = a.y AND b.id <> a.id) WHERE nth < 5),
"""
_DRAW = "CAST('0x' || substr(md5('42:' || y || ':' || copy), 1, 12) AS BIGINT)"
_STEP = "CAST('0x' || substr(md5('42:step:' || y || ':' || copy), 1, 12) AS BIGINT) / 281474976710656.0"
_MADE = f"""
made AS (SELECT NULL::bigint AS vec_id, d.y, d.copy, d.id AS base, near.nid AS neighbor, d.step,
                list_transform(list_zip(a.v, b.v), lambda z: z[1] + d.step * (z[2] - z[1])) AS x
         FROM d JOIN near ON near.id = d.id AND near.nth = d.nth JOIN r a ON a.id = d.id JOIN r b ON b.id = near.nid)
SELECT id AS vec_id, y, 0::bigint AS copy, NULL::bigint AS base, NULL::bigint AS neighbor, NULL::double AS step,
       round(v[1], 6) AS e0, round(v[{_DIMS}], 6) AS e{_DIMS - 1}, round(list_sum(v), 6) AS total FROM r
UNION ALL SELECT vec_id, y, copy, base, neighbor, round(step, 6), round(x[1], 6), round(x[{_DIMS}], 6), round(list_sum(x), 6) FROM made"""
# uniform draws over (base, neighbour) of the bases b (y, id, at from 0, size of the class's bases)
_UNIFORM = f"""
c AS (SELECT y, k, unnest(range(1, need + 1)) AS copy FROM g WHERE y IN (SELECT y FROM b)),
p AS (SELECT c.y, copy, k, {_DRAW.replace("y ||", "c.y ||")} % ((SELECT any_value(size) FROM b WHERE b.y = c.y) * k) AS pick FROM c),
d AS (SELECT p.y, copy, b.id, pick % k AS nth, {_STEP.replace("y ||", "p.y ||")} AS step FROM p JOIN b ON b.y = p.y AND b.at = pick // k),
"""


def _others(k: int) -> str:
    return f"""
o AS (SELECT id, y, count(*) AS found, count(*) FILTER (WHERE ny <> y) AS others FROM (
  SELECT a.id, a.y, b.y AS ny, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS nth
  FROM r a JOIN g ON g.y = a.y JOIN r b ON b.id <> a.id) WHERE nth <= {k} GROUP BY id, y),
"""


_QUOTAS = """
s AS (SELECT o.id, o.y, others, others * need AS share, sum(others) OVER (PARTITION BY o.y) AS total, need FROM o JOIN g ON g.y = o.y),
l AS (SELECT *, share // total AS low, row_number() OVER (PARTITION BY y ORDER BY share % total DESC, id) AS place FROM s),
q AS (SELECT id, y, others, (low + CASE WHEN place <= need - sum(low) OVER (PARTITION BY y) THEN 1 ELSE 0 END)::bigint AS quota FROM l)
"""


def _shown(out):
    total = sum((F.col(f) for f in _FEATS[1:]), F.col(_FEATS[0]))
    return out.select("vec_id", "y", F.col("_copy").alias("copy"), F.col("_base").alias("base"), F.col("_neighbor").alias("neighbor"),
                      r6("_step").alias("step"), r6("e0").alias("e0"), r6(f"e{_DIMS - 1}").alias(f"e{_DIMS - 1}"), r6(total).alias("total"))


@query("knn_graph", """
SELECT vec_id, neighbor, rank::integer AS rank, round(d, 6) AS distance FROM (
  SELECT a.vec_id, b.vec_id AS neighbor, 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS d,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 15""", "ml")
def q_knn_graph(spark, sf):
    g = knn_graph(t(spark, sf, "embeddings"), "vec_id", "embedding", 15, "cosine")
    return g.select("vec_id", "neighbor", "rank", r6("distance").alias("distance"))


@query("oversample_smote", f"""
WITH {_ROWS} {_CLASSES} {_IN_CLASS}
b AS (SELECT r.y, id, row_number() OVER (PARTITION BY r.y ORDER BY id) - 1 AS at, n AS size FROM r JOIN g ON g.y = r.y),
{_UNIFORM} {_MADE}""", "ml")
def q_oversample_smote(spark, sf):
    return _shown(R.oversample_smote(_classes(spark, sf), "vec_id", "y", _FEATS))


@query("adasyn_quotas", f"WITH {_ROWS} {_CLASSES} {_others(5)} {_QUOTAS} SELECT id AS vec_id, y, others AS majority_neighbors, quota FROM q", "ml")
def q_adasyn_quotas(spark, sf):
    return R.adasyn_quotas(_classes(spark, sf), "vec_id", "y", _FEATS)


@query("oversample_adasyn", f"""
WITH {_ROWS} {_CLASSES} {_IN_CLASS} {_others(5)} {_QUOTAS},
f AS (SELECT *, sum(quota) OVER (PARTITION BY y ORDER BY id) - quota AS before FROM q WHERE quota > 0),
e AS (SELECT id, y, (before + unnest(range(1, quota + 1)))::bigint AS copy FROM f),
d AS (SELECT id, e.y, copy, {_DRAW.replace("y ||", "e.y ||")} % k AS nth, {_STEP.replace("y ||", "e.y ||")} AS step FROM e JOIN g ON g.y = e.y),
{_MADE}""", "ml")
def q_oversample_adasyn(spark, sf):
    return _shown(R.oversample_adasyn(_classes(spark, sf), "vec_id", "y", _FEATS))


_KINDS = """
z AS (SELECT id, y, others, CASE WHEN others = found THEN 'noise' WHEN 2 * others >= found THEN 'danger' ELSE 'safe' END AS kind FROM o)
"""


@query("borderline_classes", f"WITH {_ROWS} {_CLASSES} {_others(10)} {_KINDS} SELECT id AS vec_id, y, others AS majority_neighbors, kind FROM z", "ml")
def q_borderline_classes(spark, sf):
    return R.borderline_classes(_classes(spark, sf), "vec_id", "y", _FEATS)


@query("oversample_borderline", f"""
WITH {_ROWS} {_CLASSES} {_IN_CLASS} {_others(10)} {_KINDS},
b AS (SELECT y, id, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS at, count(*) OVER (PARTITION BY y) AS size FROM z WHERE kind = 'danger'),
{_UNIFORM} {_MADE}""", "ml")
def q_oversample_borderline(spark, sf):
    return _shown(R.oversample_borderline(_classes(spark, sf), "vec_id", "y", _FEATS))


def _parts(spark, sf):
    return t(spark, sf, "part").select("p_partkey", (F.substring_index("p_name", " ", -1) == "gizmo").cast("int").alias("y"),
                                       "p_size", "p_retailprice", "p_brand", "p_type")


@query("oversample_smotenc", f"""
WITH r AS (SELECT p_partkey AS id, (p_name LIKE '% gizmo')::int AS y, p_size::double AS s, p_retailprice AS p, p_brand AS b, p_type AS t FROM part),
{_CLASSES}
w AS (SELECT y, (stddev_pop(s) + stddev_pop(p)) / 2 AS w FROM r GROUP BY y),
near AS (SELECT * FROM (
  SELECT x.id, z.id AS nid, z.b, z.t, row_number() OVER (PARTITION BY x.id ORDER BY
    (x.s - z.s) * (x.s - z.s) + (x.p - z.p) * (x.p - z.p) + w * w * ((x.b <> z.b)::int + (x.t <> z.t)::int), z.id) - 1 AS nth
  FROM r x JOIN g ON g.y = x.y JOIN w ON w.y = x.y JOIN r z ON z.y = x.y AND z.id <> x.id) WHERE nth < 5),
mb AS (SELECT id, arg_min(b, (-c, b)) AS b FROM (SELECT id, b, count(*) AS c FROM near GROUP BY id, b) GROUP BY id),
mt AS (SELECT id, arg_min(t, (-c, t)) AS t FROM (SELECT id, t, count(*) AS c FROM near GROUP BY id, t) GROUP BY id),
b AS (SELECT r.y, id, row_number() OVER (PARTITION BY r.y ORDER BY id) - 1 AS at, n AS size FROM r JOIN g ON g.y = r.y),
{_UNIFORM.rstrip().rstrip(",")}
SELECT id AS p_partkey, y, 0::bigint AS copy, NULL::bigint AS base, NULL::bigint AS neighbor, round(s, 6) AS p_size, round(p, 6) AS p_retailprice,
       b AS p_brand, t AS p_type FROM r
UNION ALL
SELECT NULL, d.y, copy, d.id, nid, round(x.s + step * (z.s - x.s), 6), round(x.p + step * (z.p - x.p), 6), mb.b, mt.t
FROM d JOIN near ON near.id = d.id AND near.nth = d.nth JOIN r x ON x.id = d.id JOIN r z ON z.id = nid JOIN mb ON mb.id = d.id JOIN mt ON mt.id = d.id""", "ml")
def q_oversample_smotenc(spark, sf):
    out = R.oversample_smotenc(_parts(spark, sf), "p_partkey", "y", ["p_size", "p_retailprice"], ["p_brand", "p_type"])
    return out.select("p_partkey", "y", F.col("_copy").alias("copy"), F.col("_base").alias("base"), F.col("_neighbor").alias("neighbor"),
                      r6("p_size").alias("p_size"), r6("p_retailprice").alias("p_retailprice"), "p_brand", "p_type")


@query("select_resampler", None, "ml")
def q_select_resampler(spark, sf):
    scores = M.select_resampler(_parts(spark, sf), "p_partkey", "y", ["p_size", "p_retailprice"], ["p_brand", "p_type"])
    return scores.select("method", "fold", "held_out", r6("macro_f1").alias("macro_f1"), r6("mean_f1").alias("mean_f1"), "selected")
