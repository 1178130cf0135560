"""Every catalogued query against its DuckDB oracle on the sf0.001 tables.

This is the same comparison the driver makes (sorted column names, rows
compared as multisets, doubles rounded to 6 places), run on the smallest
scale so the whole suite stays quick.
"""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()

CLASSIFIERS = ["fit_logreg", "fit_random_forest", "fit_boosted_trees", "fit_mlp", "fit_svm", "fit_naive_bayes"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (bool, int)):
        return v
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_is_registered_with_a_callable():
    assert len(QUERIES) >= 150
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows, scols = df.collect(), df.columns
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _canon(scols, srows) == _canon(dcols, drows)


def _rows(spark, name):
    return QUERIES[name](spark, SF_SMALL).collect()


def _n(spark, table):
    return spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()


@pytest.mark.parametrize("name", CLASSIFIERS)
def test_classifiers_give_probabilities(spark, name):
    rows = _rows(spark, name)
    assert len({r["id"] for r in rows}) == len(rows) == _n(spark, "embeddings")
    assert all(r["pred"] in (0, 1, 2) and 1 / 3 - 1e-6 <= r["p_max"] <= 1 for r in rows)


def test_calibrated_probabilities_sum_to_one(spark):
    rows = _rows(spark, "calibrate_platt")
    assert {r["fold"] for r in rows} == {0, 1, 2}
    assert all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-5 and min(r["p0"], r["p1"], r["p2"]) >= 0 for r in rows)


def test_meta_learner_scores_are_complete(spark):
    rows = _rows(spark, "select_meta_learner")
    models = ("boosted_trees", "logreg", "mlp", "naive_bayes", "random_forest", "svm")
    assert sorted((r["model"], r["fold"]) for r in rows) == [(m, f) for m in models for f in range(5)]
    mean = {m: sum(r["macro_f1"] for r in rows if r["model"] == m) / 5 for m in models}
    assert all(abs(r["mean_f1"] - mean[r["model"]]) < 1e-5 for r in rows)
    assert {r["model"] for r in rows if r["selected"]} == {max(mean, key=lambda m: (mean[m], m))}


def test_projections_and_clusters(spark):
    rows = _rows(spark, "pca_2")
    v1, v2 = (sum(r[c] ** 2 for r in rows) for c in ("pca_1", "pca_2"))
    cross = sum(r["pca_1"] * r["pca_2"] for r in rows)
    assert len(rows) == _n(spark, "embeddings") and v1 >= v2 > 0 and abs(cross) < 1e-3 * v1
    clusters = _rows(spark, "kmeans_5")
    assert {r["note_cluster"] for r in clusters} == set(range(5))


def test_model_card_lists_all_candidates(spark):
    rows = [tuple(r) for r in _rows(spark, "model_card")]
    means = {item: float(v) for section, item, v in rows if section == "candidates"}
    assert len(means) == 6 and {s for s, *_ in rows} == {"model", "performance", "candidates"}
    card = {item: v for section, item, v in rows if section != "candidates"}
    assert card["macro_f1"] == f"{max(means.values()):.4f}" and means[card["selected"]] == max(means.values())
    folds = [float(v) for item, v in card.items() if item.startswith("macro_f1_fold_")]
    assert len(folds) == 5 and abs(sum(folds) / 5 - float(card["macro_f1"])) < 2e-4


def test_failed_seeds_are_reported(spark):
    from tessera.operators import models as M

    def step(seed):
        if seed == 2:
            raise ValueError("no luck")
        return spark.createDataFrame([(seed, 0.5)], "seed int, accuracy double")

    rows = M.multi_seed_runs(step, [1, 2, 3]).orderBy("run").collect()
    assert [(r["run"], r["status"], r["seed"]) for r in rows] == [(1, "ok", 1), (2, "failed", None), (3, "ok", 3)]
    assert "no luck" in rows[1]["error"]
    with pytest.raises(ValueError):
        M.multi_seed_runs(step, [2])


@pytest.mark.parametrize("name", ["batch_embed", "lda_topics",
                                  "coef_table", "run_params_metrics", "stack_cv", "select_resampler", "fit_logreg_tabular"])
def test_other_rows_only_queries(spark, name):
    rows = _rows(spark, name)
    assert rows and len(set(map(str, rows))) == len(rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_seeds_run_at_once(spark):
    """Every run waits until another one has started."""
    from threading import Barrier

    from tessera.operators import models as M
    both = Barrier(2, timeout=60)

    def step(seed):
        both.wait()
        return spark.createDataFrame([(seed,)], "seed int")
    rows = M.multi_seed_runs(step, [5, 6, 7, 8]).orderBy("run").collect()
    assert [(r["run"], r["seed"], r["status"], r["error"]) for r in rows] == [(i, 4 + i, "ok", None) for i in range(1, 5)]
