"""Statistics and evaluation operators against brute force on small fixtures."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from tessera.operators import evaluate as EV
from tessera.operators import stats as ST
from tessera.plans.ordered import ordered_scan
from tessera.plans.quantiles import exact_quantiles


def _exact_p(diffs):
    """Two-sided exact p of the signed-rank statistic by full enumeration."""
    n = len(diffs)
    ranks = np.argsort(np.argsort(np.abs(diffs))) + 1
    w_plus = ranks[np.array(diffs) > 0].sum()
    w_minus = ranks[np.array(diffs) < 0].sum()
    w = min(w_plus, w_minus)
    le = sum(1 for signs in itertools.product((0, 1), repeat=n)
             if sum(r for r, s in zip(range(1, n + 1), signs) if s) <= w)
    return w, min(1.0, 2 * le / 2 ** n)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_wilcoxon_exact_matches_enumeration(spark, seed):
    rng = random.Random(seed)
    n = 9
    rows = []
    for run in range(n):
        a = rng.random()
        rows.append((run, "a", a))
        rows.append((run, "b", a + (rng.random() - 0.45) * (run + 1) / 10.0))
    df = spark.createDataFrame(rows, "run int, model string, f1 double")
    got = ST.wilcoxon_unadjusted(df, "run", "model", "f1").collect()
    assert len(got) == 1
    diffs = [a - b for (_, _, a), (_, _, b) in zip(rows[0::2], rows[1::2])]
    w, p = _exact_p(diffs)
    assert got[0]["statistic"] == pytest.approx(w)
    assert got[0]["p_value"] == pytest.approx(p, abs=1e-12)


def test_holm_matches_definition(spark):
    ps = [0.01, 0.04, 0.03, 0.2, 0.005]
    df = spark.createDataFrame([(f"m{i}", "z", p) for i, p in enumerate(ps)],
                               "model_1 string, model_2 string, p_value double")
    got = {r["model_1"]: r["p_value_adj"] for r in ST.holm_adjust(df).collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    m, run, want = len(ps), 0.0, {}
    for j, i in enumerate(order):
        run = max(run, (m - j) * ps[i])
        want[f"m{i}"] = min(1.0, run)
    assert got == pytest.approx(want)


def test_roc_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(7)
    n, k = 300, 3
    y = rng.integers(0, k, n)
    raw = rng.random((n, k)) + np.eye(k)[y] * 0.3
    raw = np.round(raw, 1)  # force ties
    probs = raw / raw.sum(1, keepdims=True)
    probs = np.round(probs, 2)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(y, probs)],
                               "y int, probs array<double>")
    got = {r["average"]: r["auc"] for r in EV.roc_auc(df, "y", "probs", list(range(k))).collect()}

    def auc(lbl, s):
        pos, neg = s[lbl], s[~lbl]
        gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        return gt / (len(pos) * len(neg))

    per = [auc(y == c, probs[:, c]) for c in range(k)]
    for c in range(k):
        assert got[str(c)] == pytest.approx(per[c])
    assert got["macro"] == pytest.approx(np.mean(per))
    onehot = np.eye(k)[y].ravel().astype(bool)
    assert got["micro"] == pytest.approx(auc(onehot, probs.ravel()))


def test_ordered_scan_running_sum(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "k": rng.permutation(500),
                        "v": rng.integers(0, 10, 500).astype(float)})
    df = spark.createDataFrame(pdf)
    out = ordered_scan(df, ["k"], by=["g"], sums=["v"]).toPandas()
    ref = pdf.sort_values(["g", "k"]).copy()
    ref["_rn"] = ref.groupby("g").cumcount() + 1
    ref["_cum_v"] = ref.groupby("g")["v"].cumsum()
    m = out.merge(ref, on=["g", "k"], suffixes=("", "_ref"))
    assert len(m) == 500
    assert (m["_rn"] == m["_rn_ref"]).all()
    assert np.allclose(m["_cum_v"], m["_cum_v_ref"])


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 4000), "x": rng.normal(size=4000)})
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, "x", [0.25, 0.5, 0.9], by=["g"], accuracy=50).toPandas()
    for _, r in got.iterrows():
        xs = pdf.loc[pdf.g == r["g"], "x"].to_numpy()
        assert r["q25"] == pytest.approx(np.quantile(xs, 0.25))
        assert r["q50"] == pytest.approx(np.quantile(xs, 0.5))
        assert r["q90"] == pytest.approx(np.quantile(xs, 0.9))


def test_metric_per_class_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    got = {r["class"]: r for r in EV.metric_per_class(df, "y", "p", [0, 1, 2]).collect()}
    assert got[2]["precision"] == 0.0 and got[2]["recall"] == 0.0 and got[2]["f1"] == 0.0
    assert got[0]["precision"] == 1.0 and got[0]["recall"] == 0.5


def test_discrete_quantiles_match_numpy(spark):
    from tessera.plans.quantiles import exact_quantiles_discrete

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "x": rng.integers(0, 40, 3000)})
    pdf.loc[pdf.index % 11 == 0, "x"] = None
    df = spark.createDataFrame(pdf.astype({"x": "float"}))
    got = exact_quantiles_discrete(df, "x", [0.1, 0.5, 0.75], by=["g"]).toPandas()
    for _, r in got.iterrows():
        xs = pdf.loc[pdf.g == r["g"], "x"].dropna().to_numpy()
        for p, c in ((0.1, "q10"), (0.5, "q50"), (0.75, "q75")):
            assert r[c] == pytest.approx(np.quantile(xs, p))
    one = exact_quantiles_discrete(df, "x", [0.5], names=["m"]).collect()[0]["m"]
    assert one == pytest.approx(np.quantile(pdf["x"].dropna().to_numpy(), 0.5))
