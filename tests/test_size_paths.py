"""Operators with a size-checked fast path give the same rows on both paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encode as EN
from tessera.operators import text as TX
from tests.conftest import SF_SMALL


def test_category_codes_small_and_large_domain_agree(spark):
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet").withColumn(
        "seg", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_mktsegment")))
    small = EN.category_codes(c, "seg", null_token="nan").collect()
    large = EN.category_codes(c, "seg", null_token="nan", broadcast_max=0).collect()
    assert sorted(small) == sorted(large)
    assert sorted(r["code"] for r in small) == list(range(len(small)))


def test_lexicon_scores_do_not_depend_on_other_rows_or_words(spark):
    lex = spark.createDataFrame([("good", 0.8), ("BAD", -0.6), ("odd", None), (None, 1.0), ("good", 0.4)],
                                "word string, polarity double")
    d = spark.createDataFrame([(1, "good good bad"), (1, "odd"), (2, None), (2, "Good")], "k long, text string")
    want = [(1, 0.0), (1, (0.6 + 0.6 - 0.6) / 3), (2, 0.0), (2, 0.6)]
    more = lex.unionByName(spark.createDataFrame([(f"unused{i}", 0.5) for i in range(200)], lex.schema))
    for words in (lex, more):
        got = sorted((r["k"], round(r["sentiment"], 9)) for r in
                     TX.lexicon_sentiment(d, ["k"], "text", words).collect())
        assert got == [(k, round(v, 9)) for k, v in want]


def test_quantiles_with_one_value_on_most_rows(spark):
    """Ties are one weighted value: no window sees the rows that hold them."""
    from tessera.plans import quantiles as QT
    rows = [(i % 3, 7.0 if i % 10 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, x double")
    import numpy as np
    got = {r["g"]: (r["q25"], r["q50"], r["q95"]) for r in QT.exact_quantiles(df, "x", [0.25, 0.5, 0.95], by=["g"]).collect()}
    for g in range(3):
        v = [x for k, x in rows if k == g]
        assert got[g] == tuple(float(np.quantile(v, q)) for q in (0.25, 0.5, 0.95))
    plan = QT.exact_quantiles(df, "x", [0.5], by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_wide_quantile_brackets_are_narrowed(spark, monkeypatch):
    """A coarse sketch and a small bound: several rounds of cells, with hot values."""
    import numpy as np

    from tessera.plans import quantiles as QT
    monkeypatch.setattr(QT, "MAX_VALUES", 12)
    monkeypatch.setattr(QT, "CELLS", 8)
    rng = np.random.default_rng(2)
    rows = [(i % 3 if i % 7 else None, 5.0 if i % 4 == 0 else float(x)) for i, x in enumerate(rng.lognormal(0, 9, 4000))]
    df = spark.createDataFrame(rows, "g long, x double")
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    for r in QT.exact_quantiles(df, "x", probs, by=["g"], names=list("abcde"), accuracy=20).collect():
        if r["g"] is not None:
            want = np.quantile([x for g, x in rows if g == r["g"]], probs)
            assert np.allclose([r[c] for c in "abcde"], want, rtol=1e-12)
    r = QT.exact_quantiles(df, "x", probs, names=list("abcde"), accuracy=20).first()
    assert np.allclose(list(r), np.quantile([x for _, x in rows], probs), rtol=1e-12)


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    import pytest

    from tessera import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session)


def test_vector_queries_read_only_stored_entries(spark, monkeypatch, tmp_path):
    """A row costs its own terms: nothing is widened to the vocabulary's size."""
    import pyspark.ml.functions as MF
    from pyspark.ml.linalg import Vectors

    from tessera.plans.catalog import load_all

    rows = [(0, Vectors.sparse(2_000_000_000, [3, 7, 1_999_999_999], [2.0, 0.0, 5.0])), (1, Vectors.dense([0.0, 4.0])),
            (2, Vectors.sparse(2_000_000_000, [], [])), (3, Vectors.dense([]))]
    got = spark.createDataFrame(rows, ["k", "v"]).select("k", TX.vector_entries("v").alias("e")).collect()
    assert {r["k"]: [(e["x"], e["i"]) for e in r["e"]] for r in got} == {0: [(2.0, 3), (5.0, 1_999_999_999)], 1: [(4.0, 1)], 2: [], 3: []}

    def widened(*_):
        raise AssertionError("a vector was made dense")
    monkeypatch.setattr(MF, "vector_to_array", widened)
    docs = [(i, "apple pear apple" if i % 2 else "pear plum" if i < 20 else None) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = load_all()
    counts = {r["doc_id"]: (r["n_terms"], r["total"], r["weighted"]) for r in queries["count_vectorize"].fn(spark, str(tmp_path)).collect()}
    # apple 24, pear 22 and plum 10 times
    assert counts[1] == (2, 3, 4) and counts[0] == (2, 2, 5) and counts[22] == (0, 0, 0)
    grams = {r["doc_id"]: (r["n_terms"], r["norm"]) for r in queries["tfidf_ngrams"].fn(spark, str(tmp_path)).collect()}
    assert grams[1] == (4, 1.0) and grams[0] == (3, 1.0) and grams[22] == (0, 0.0)
