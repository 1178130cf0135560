"""Packing (operator 6): optimal length buckets and token-budget batches.

The length of a document is its number of words (runs of non-white-space), or
any integer column named by the caller.

* *Histogram.*  One aggregate counts all documents by length.  It has one row
  per distinct length, at most ``sqrt(2 * total words)`` rows, and is the only
  thing the driver reads.
* *Buckets.*  Dynamic programming over the histogram picks at most ``BUCKETS``
  bucket limits that minimise the total padding when each document is padded to
  its bucket's limit.  Padding cost is a Monge array, so each step is solved by
  divide and conquer: ``BUCKETS * H * log H`` for ``H`` lengths.  Of equal
  solutions the one with the smallest split points is taken.
* *Batches.*  Inside a bucket of limit ``L``, batches hold
  ``max(1, budget // L)`` documents in the order of ``md5(doc_id)``.  The order
  is global but no task sorts a bucket: documents are dealt by bucket and md5
  prefix, the prefix being long enough for at most about ``CHUNK_ROWS`` rows
  each, and ranked there on top of the prefix's offset.

Defined cases: null and empty texts have length 0 and share the bucket of the
shortest limit.  A document longer than the budget is a batch of its own.  A null
``doc_id`` sorts as the empty text; repeated rows are batched as separate rows,
in any order among themselves.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import cut_lineage

BUCKETS = 8
TOKEN_BUDGET = 16_384
CHUNK_ROWS = 20_000


def word_count(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")).cast("long")


def optimal_limits(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Bucket limits (ascending, the last is the largest length) that minimise
    ``sum(counts * (limit - length))``; ``lengths`` ascending and distinct."""
    h = len(lengths)
    if not h:
        return []
    x = np.asarray(lengths, np.int64)
    n = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    s = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64) * x)])
    buckets = min(buckets, h)
    # best[j]: least padding of the first j lengths in the buckets used so far
    best = np.concatenate([[0], x * n[1:] - s[1:]])
    splits = []
    for k in range(2, buckets + 1):
        new, at = np.full(h + 1, np.iinfo(np.int64).max // 4), np.zeros(h + 1, np.int64)
        todo = [(k, h, k - 1, h - 1)]
        while todo:
            lo, hi, opt_lo, opt_hi = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(opt_lo, min(j - 1, opt_hi) + 1)
            cost = best[i] + x[j - 1] * (n[j] - n[i]) - (s[j] - s[i])
            p = int(np.argmin(cost))
            new[j], at[j] = cost[p], i[p]
            todo += [(lo, j - 1, opt_lo, int(i[p])), (j + 1, hi, int(i[p]), opt_hi)]
        best = new
        splits.append(at)
    limits, j = [], h
    for at in reversed(splits):
        limits.append(int(x[j - 1]))
        j = int(at[j])
    limits.append(int(x[j - 1]))
    return limits[::-1]


def histogram(sized: DataFrame) -> list[tuple[int, int]]:
    rows = sized.groupBy("n_tokens").agg(F.count("*").alias("k")).collect()
    return sorted((r["n_tokens"], r["k"]) for r in rows)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS,
         token_budget: int = TOKEN_BUDGET, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per row: doc_id, n_tokens, bucket_limit, padding, batch (0-based within the
    bucket), slot (0-based within the batch)."""
    length = word_count(F.col("text")) if length is None else length.cast("long")
    sized = cut_lineage(docs.select("doc_id", length.alias("n_tokens")))  # the text is read once
    hist = histogram(sized)
    limits = optimal_limits([x for x, _ in hist], [k for _, k in hist], buckets)
    bucket = F.lit(None).cast("long")
    for limit in reversed(limits):
        bucket = F.when(F.col("n_tokens") <= limit, F.lit(limit).cast("long")).otherwise(bucket)
    total = sum(k for _, k in hist)
    digits = 0
    while total > chunk_rows * 16 ** digits:
        digits += 1
    keyed = sized.select("doc_id", "n_tokens", bucket.alias("bucket_limit"),
                         F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"))
    keyed = keyed.withColumn("_chunk", F.substring("_order", 1, digits))
    # at most buckets * 16**digits rows, each standing for about chunk_rows documents
    sizes = keyed.groupBy("bucket_limit", "_chunk").agg(F.count("*").alias("_k"))
    before = Window.partitionBy("bucket_limit").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_limit", "_chunk", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("bucket_limit", "_chunk").orderBy("_order", "doc_id")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["bucket_limit", "_chunk"])
    rank = F.col("_base") + F.col("_rank") - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), "bucket_limit"))).cast("long")
    return ranked.select("doc_id", "n_tokens", "bucket_limit", (F.col("bucket_limit") - F.col("n_tokens")).alias("padding"),
                         F.floor(rank / per).cast("long").alias("batch"), (rank % per).cast("long").alias("slot"))


def oracle_sql(buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, table: str = "documents") -> str:
    """DuckDB: the dynamic program as one step per bucket over all split points."""
    steps = ["p1 AS (SELECT j, x * n - s AS cost, [j] AS ends FROM h)"]
    for k in range(2, buckets + 1):
        steps.append(f"""p{k} AS (SELECT h.j AS j, min({{'c': p.cost + h.x * (h.n - i.n) - (h.s - i.s), 'i': i.j, 'e': list_append(p.ends, h.j)}}) AS b
  FROM h JOIN h i ON i.j < h.j AND i.j >= {k - 1} JOIN p{k - 1}x p ON p.j = i.j GROUP BY h.j)""")
        steps.append(f"p{k}x AS (SELECT j, b.c AS cost, b.e AS ends FROM p{k})")
    steps.insert(1, "p1x AS (SELECT * FROM p1)")
    finals = " UNION ALL ".join(f"SELECT {k} AS k, ends FROM p{k}x WHERE j = (SELECT max(j) FROM h)" for k in range(1, buckets + 1))
    return rf"""
WITH sized AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS n_tokens FROM {table}),
g AS (SELECT n_tokens AS x, count(*)::bigint AS k FROM sized GROUP BY 1),
h AS (SELECT row_number() OVER (ORDER BY x) AS j, x, (sum(k) OVER (ORDER BY x))::bigint AS n, (sum(k * x) OVER (ORDER BY x))::bigint AS s FROM g),
{', '.join(steps)},
best AS (SELECT ends FROM ({finals}) ORDER BY k DESC LIMIT 1),
limits AS (SELECT h.x AS bucket_limit FROM best, h WHERE list_contains(best.ends, h.j)),
b AS (SELECT doc_id, n_tokens, (SELECT min(bucket_limit) FROM limits WHERE bucket_limit >= n_tokens) AS bucket_limit FROM sized),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket_limit ORDER BY md5(coalesce(doc_id::varchar, '')), doc_id) - 1 AS rank,
      greatest(1, {token_budget} // greatest(1, bucket_limit)) AS per FROM b)
SELECT doc_id, n_tokens, bucket_limit, bucket_limit - n_tokens AS padding, (rank // per)::bigint AS batch, (rank % per)::bigint AS slot FROM r"""
