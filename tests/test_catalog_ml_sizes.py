"""The registered model queries run over the whole of their jobs."""

import pytest

from tessera.operators import models as M
from tessera.operators import text as TX
from tessera.plans.catalog import load_all, q_ml
from tests.conftest import SF_SMALL


class Called(Exception):
    pass


def _arguments(monkeypatch, spark, module, operator, name):
    """Arguments with which the query calls its operator, which is not run."""
    def stop(*args, **kw):
        raise Called(args, kw)
    monkeypatch.setattr(module, operator, stop)
    with pytest.raises(Called) as e:
        load_all()[name].fn(spark, SF_SMALL)
    return e.value.args


def test_candidates_bases_and_seeds(spark, monkeypatch):
    args, _ = _arguments(monkeypatch, spark, M, "select_meta_learner", "model_card")
    assert set(args[4]) == {"logreg", "random_forest", "boosted_trees", "mlp", "svm", "naive_bayes"}
    args, _ = _arguments(monkeypatch, spark, M, "select_meta_learner", "select_meta_learner")
    assert len(args[4]) == 6
    args, _ = _arguments(monkeypatch, spark, M, "stack_cv", "stack_cv")
    assert set(args[4]) == {"logreg", "random_forest", "boosted_trees"}
    args, _ = _arguments(monkeypatch, spark, M, "multi_seed_runs", "multi_seed_runs")
    assert len(set(args[1])) == 30


def test_iterations_are_the_operators_own(spark, monkeypatch):
    assert all("max_iter" not in kw for _, _, kw in q_ml._FITS)
    _, kw = _arguments(monkeypatch, spark, TX, "lda_topics", "lda_topics")
    assert "max_iter" not in kw
