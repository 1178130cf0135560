"""Array functions: JSON sequences, softmax/argmax, sigmoid, pooling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of


def _json_str(x: Column) -> Column:
    esc = F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', '\\\\"')
    return F.concat(F.lit('"'), esc, F.lit('"'))


def sequence_to_json(arr, fields: tuple[str, str] = ("value", "ts")) -> Column:
    """``array<struct<value, ts>>`` -> ``[["MICU", "2101-10-20 19:10:11"], ...]``
    (Python ``json.dumps`` spacing); null or missing -> ``[]``."""
    a, b = fields
    items = F.transform(
        F.coalesce(col_of(arr), F.array()),
        lambda e: F.concat(F.lit("["), F.coalesce(_json_str(e[a].cast("string")), F.lit("null")),
                           F.lit(", "), F.coalesce(_json_str(e[b].cast("string")), F.lit("null")),
                           F.lit("]")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def softmax(logits) -> Column:
    x = col_of(logits)
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / s)


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    x = col_of(arr)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def softmax_argmax(logits) -> Column:
    return argmax(col_of(logits))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(x)))


def sigmoid_threshold(x, t: float = 0.5) -> Column:
    return (sigmoid(x) > F.lit(t)).cast("int")


def positive_class_prob(probs) -> Column:
    """Last entry of a 2+-class probability vector; the value of a 1-vector."""
    p = col_of(probs)
    return F.when(F.size(p) >= 2, F.element_at(p, -1)).otherwise(F.element_at(p, 1))


def masked_mean_pool(seq, mask, floor: float = 1e-6) -> Column:
    """Mean of the visit vectors whose mask is 1 (``seq``: T x D, ``mask``: T).
    The denominator is ``max(sum(mask), floor)``."""
    s, m = col_of(seq), col_of(mask)
    dim = F.size(F.element_at(s, 1))
    denom = F.greatest(F.aggregate(m, F.lit(0.0).cast("double"),
                                   lambda acc, v: acc + v.cast("double")), F.lit(floor))
    return F.transform(
        F.sequence(F.lit(1), dim),
        lambda d: F.aggregate(F.zip_with(s, m, lambda v, k: F.element_at(v, d) * k.cast("double")),
                              F.lit(0.0).cast("double"), lambda acc, v: acc + v) / denom)
