import itertools
import random

from pyspark.sql import functions as F

from tessera.llm import packing
from tests.llm import helpers as H


def _padding(lengths, counts, limits):
    return sum(k * (min(y for y in limits if y >= x) - x) for x, k in zip(lengths, counts))


def test_limits_are_optimal():
    rng = random.Random(3)
    for _ in range(300):
        h = rng.randrange(1, 10)
        x, c, k = sorted(rng.sample(range(40), h)), [rng.randrange(1, 6) for _ in range(h)], rng.randrange(1, 5)
        got = packing.optimal_limits(x, c, k)
        best = min(_padding(x, c, (*q, x[-1])) for q in itertools.combinations(x[:-1], min(k, h) - 1))
        assert len(got) == min(k, h) and got[-1] == x[-1] and _padding(x, c, got) == best


def test_batches_are_full_and_in_order(spark):
    docs = spark.createDataFrame([(i, i % 7 * 10) for i in range(3000)], "doc_id long, n long")
    out = packing.pack(docs, F.col("n"), buckets=3, token_budget=300, chunk_rows=40).collect()
    assert len(out) == 3000
    for limit, rows in itertools.groupby(sorted(out, key=lambda r: (r.bucket_limit, r.batch, r.slot)), lambda r: r.bucket_limit):
        rows, per = list(rows), max(1, 300 // max(1, limit))
        assert [(r.batch, r.slot) for r in rows] == [(k // per, k % per) for k in range(len(rows))]
        assert all(r.padding == limit - r.n_tokens >= 0 for r in rows)
    one = packing.pack(docs, F.col("n"), buckets=3, token_budget=300, chunk_rows=10**6).collect()
    assert sorted(out) == sorted(one)  # chunks do not change the order


def test_edges(spark):
    docs = H.with_clashing_columns(H.edge_documents(spark))
    out = packing.pack(docs, token_budget=100).collect()
    assert len(out) == docs.count()
    assert {r.n_tokens for r in out if r.doc_id in (2, 3, 4)} == {0}
    assert [r.slot for r in out if r.doc_id == 5] == [0]  # longer than the budget: a batch of its own
    assert packing.pack(H.documents(spark, [])).count() == 0
