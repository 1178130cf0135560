"""The k-nearest-neighbour graph against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.neighbors import knn_graph
from tests.conftest import SF_SMALL


def _brute(rows, k, metric="euclidean", n_cat=0, weight=0.0, queries=None):
    out = {}
    for i, v in rows:
        if queries is not None and i not in queries:
            continue
        near = []
        for j, w in rows:
            if j == i:
                continue
            a, b = np.array(v, float), np.array(w, float)
            if metric == "cosine":
                a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
                d = round(float(((a - b) ** 2).sum()) / 2, 9)
            else:
                at = len(a) - n_cat
                d = round(float(np.sqrt(((a[:at] - b[:at]) ** 2).sum() + weight ** 2 * (a[at:] != b[at:]).sum())), 9)
            near.append((d, j))
        out[i] = sorted(near)[:k]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((round(r.distance, 9), r.neighbor))
        assert r.rank == len(out[r.id])
    return out


def _frame(spark, rows, kind="long"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"id {kind}, v array<double>")


def test_whole_embeddings(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = [(r.id, r.v) for r in e.collect()]
    got = _got(knn_graph(e, "id", "v", 15, "cosine", block_rows=64))
    want = _brute(rows, 15, "cosine")
    assert got.keys() == want.keys()
    for i in want:  # distances are float sums of another order
        assert [j for _, j in got[i]] == [j for _, j in want[i]]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], atol=1e-8)


@pytest.mark.parametrize("block_rows", [5, 4096])
def test_clusters_copies_and_ties(spark, block_rows):
    """Grid points (many ties), far clusters (cells that can be skipped) and a group
    of copies that holds a third of all rows; queries are a part of the rows."""
    rng = np.random.default_rng(3)
    rows = [(int(i), tuple(rng.integers(0, 4, 3) + 100 * (i % 4))) for i in range(200)]
    rows += [(1000 + i, (7, 7, 7)) for i in range(100)]
    got = _got(knn_graph(_frame(spark, rows), "id", "v", 6, "euclidean", F.col("id") % 3 == 0, block_rows=block_rows))
    assert got == _brute(rows, 6, queries={i for i, _ in rows if i % 3 == 0})


def test_categories(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{i:03d}", (*rng.normal(size=2).round(2), rng.integers(3), rng.integers(2))) for i in range(120)]
    got = _got(knn_graph(_frame(spark, rows, "string"), "id", "v", 5, "euclidean", n_cat=2, cat_weight=0.7, block_rows=20))
    assert got == _brute(rows, 5, n_cat=2, weight=0.7)


def test_unusable_vectors_and_few_points(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [0.0, 2.0]), (None, [1.0, 1.0]), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("near", F.lit("x")).withColumn("weight", F.lit(1))
    assert _got(knn_graph(df, "id", "v", 3)) == {1: [(1.0, 6)], 6: [(1.0, 1)]}
    assert _got(knn_graph(df.where("id < 2"), "id", "v", 3)) == {} and _got(knn_graph(df.limit(0), "id", "v", 3)) == {}


def test_a_block_is_sent_once_to_a_group_of_visitors(spark, monkeypatch):
    """Vectors without structure, so every block visits all others: what is sent grows
    with the number of groups, not with the number of blocks."""
    from tessera.operators import neighbors as N
    kept, keep = [], N.cut_lineage

    def recorded(df):
        kept.append(keep(df))
        return kept[-1]
    monkeypatch.setattr(N, "cut_lineage", recorded)
    rng = np.random.default_rng(5)
    rows = [(i, tuple(rng.normal(size=12).round(3))) for i in range(400)]
    assert _got(knn_graph(_frame(spark, rows), "id", "v", 4, "euclidean", block_rows=2)) == _brute(rows, 4)
    sent, blocks = ([d for d in kept if c in d.columns][-1].count() for c in ("visitor", "m"))
    groups = max(24, 2 * spark.sparkContext.defaultParallelism)
    assert blocks > 4 * groups, (blocks, groups)
    # some of the places counted for the groups are empty blocks
    assert sent <= 1.2 * (groups + 1) * blocks, (sent, blocks, groups)
