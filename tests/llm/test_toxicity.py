"""Likelihood of the toxicity models: every word counts, with or without evidence."""

import math

from tessera.llm import toxicity
from tests.llm import helpers as H
from tests.llm.test_pages_and_models import _brute_models, _small_corpus


def _tables(spark):
    rows, labels = _small_corpus()
    return rows, labels, H.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_likelihood_of_every_word_by_brute_force(spark):
    rows, labels, docs, table = _tables(spark)
    _, q, _, _, total = _brute_models(rows, labels)
    model, hashes = toxicity.fit_counts(docs, table), toxicity.WordHashes()
    backed_off = 0
    for _, t in rows:
        ws = toxicity.words(t)
        pairs = list(zip([None, *ws], ws))
        backed_off += sum(not total[1][u] for u, _ in pairs)
        want = sum(math.log(q(1, u, w) / q(0, u, w)) for u, w in pairs) / max(1, len(ws))
        assert abs(model.likelihood(toxicity.word_hashes(t, hashes)) - want) < 1e-5
    assert backed_off  # contexts and words that a class does not hold


def test_words_without_evidence_count(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EVIDENCE", 1e9)
    rows, labels, docs, table = _tables(spark)
    toxic = {i: y for i, _, y in labels}
    out = toxicity.score_toxicity(docs, table).where("held_out").collect()
    score = [[r.score for r in out if toxic.get(r.doc_id) == y] for y in (0, 1)]
    over = sum(a < b for a in score[0] for b in score[1])
    assert len({r.score for r in out}) > 2 and over > 0.9 * len(score[0]) * len(score[1])
