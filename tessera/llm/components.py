"""Connected components of candidate groups without listing all pairs of a group.

``link_components`` takes memberships ``(bucket, v)`` and a verifier of pairs.
Two vertices are linked when they share a bucket and the verifier accepts the
pair; the result is the component of each vertex under these links, exactly as
if every pair of every bucket had been verified.

* Small buckets (at most ``SMALL`` members) have all their pairs verified: at
  most ``(SMALL - 1) / 2`` pairs per membership.
* In larger buckets ``PIVOTS`` members, those with the smallest seeded hashes,
  are verified against all others: ``PIVOTS`` pairs per membership at most, and
  fewer where the same copies share many buckets.  This joins nearly all of a
  group of copies.
* Buckets that still hold several components are finished exactly: pairs of
  members of different components are verified, as the caller's index lists them.

Vertices are ``binary`` or ``long`` values of any kind that sorts.  Components
come from alternating large-star and small-star steps over checkpointed edge
tables, so nothing of the graph reaches the driver but emptiness tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

SMALL = 8
PIVOTS = 3

Verify = Callable[[DataFrame], DataFrame]


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is itself a u."""
    return (edges.groupBy("u").count().where("count > 1").isEmpty()
            and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(v, c)``: each vertex of an edge and the smallest
    vertex of its component.  Self loops are harmless; nulls are not allowed.

    Large-star links the larger neighbours of a vertex to the smallest vertex
    around it, small-star the smaller ones; the two are repeated until the edges
    form stars.  Only aggregates and equi-joins are used."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u != v").distinct(), "components")
    while not _is_star_forest(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        e = stored(small, "components")
    return (e.select(F.col("u").alias("v"), F.col("v").alias("c"))
            .unionByName(e.select("v", F.col("v").alias("c")).distinct()))


def link_components(members: DataFrame, verify: Verify, finish: Verify | None = None, small: int = SMALL,
                    pivots: int = PIVOTS) -> DataFrame:
    """``members`` (bucket, v), distinct; ``verify`` takes distinct pairs ``(a, b)``
    with a < b and returns those that are linked.  Returns (v, c) for every vertex
    that has a link; c is the smallest vertex of its component.

    ``finish`` takes the memberships ``(bucket, v, c)`` of open buckets with the
    components so far and lists pairs ``(a, b)`` that hold every link between two
    components; without it they are the bucket's own pairs."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    m = stored(members.join(sizes, "bucket"), "components")
    few = m.where(F.col("n") <= small).select("bucket", "v")
    many = m.where(F.col("n") > small).select("bucket", "v")
    hashes = [F.xxhash64("v", F.lit(r)) for r in range(pivots)]
    chosen = many.groupBy("bucket").agg(F.array_distinct(F.array(*(F.min_by("v", h) for h in hashes))).alias("p"))
    stars = many.join(chosen, "bucket").select("v", F.explode("p").alias("p")).where("v != p")
    pairs = (few.withColumnRenamed("v", "a").join(few.withColumnRenamed("v", "b"), "bucket").where("a < b").select("a", "b")
             .unionByName(stars.select(F.least("v", "p").alias("a"), F.greatest("v", "p").alias("b"))))
    comp = stored(connected_components(verify(pairs.distinct())), "components")
    own = many.join(comp, "v", "left").select("bucket", "v", F.coalesce("c", "v").alias("c"))
    split = own.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    open_ = stored(own.join(split, "bucket"), "components")
    if open_.isEmpty():
        return comp
    if finish is not None:
        left = finish(open_)
    else:
        x, y = (open_.select("bucket", F.col("v").alias(p), F.col("c").alias(f"{p}c")) for p in "ab")
        left = x.join(y, "bucket").where("a < b and ac != bc").select("a", "b")
    stars = comp.where("v != c").select(F.col("v").alias("a"), F.col("c").alias("b"))
    return stored(connected_components(stars.unionByName(verify(left.distinct()).select("a", "b"))), "components")
