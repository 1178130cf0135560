"""Synthetic oversampling against its formulas and brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import resample as R

COLS = ["a", "b"]
DDL = "id long, y string, a double, b double, c string, d int"


def _rows(n=90, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = "big" if i % 9 > 2 else "mid" if i % 9 else "small"
        at = {"big": 0.0, "mid": 1.0, "small": 0.8}[y]
        a, b = (at + rng.normal(size=2)).round(3)
        out.append((i, y, float(a), float(b), rng.choice(["u", "v", None]), int(rng.integers(3))))
    return out


def _draw(*parts):
    return int(hashlib.md5(":".join(map(str, ("42", *parts))).encode()).hexdigest()[:12], 16)


def _near(rows, of, among, k, dist):
    return {r[0]: [j for _, j in sorted((dist(r, s), s[0]) for s in among(r) if s[0] != r[0])[:k]] for r in of}


def _plain(r, s):
    return round((r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2, 12)


def _check_made(rows, out, near, cats=()):
    """Every synthetic row is its formula; counts are exact."""
    by = {r[0]: r for r in rows}
    originals = [r for r in out if r._copy == 0]
    assert sorted((r.id, r.y, r.a, r.b) for r in originals) == sorted(r[:4] for r in rows)
    seen = Counter()
    for r in out:
        if r._copy == 0:
            continue
        seen[r.y] += 1
        assert r.id is None and by[r._base][1] == r.y and r._neighbor in near[r._base]
        assert r._step == pytest.approx(_draw("step", r.y, r._copy) / 2 ** 48)
        for at, x in ((2, r.a), (3, r.b)):
            assert x == pytest.approx(by[r._base][at] + r._step * (by[r._neighbor][at] - by[r._base][at]))
    return seen


def test_smote(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, DDL)
    out = R.oversample_smote(df, "id", "y", COLS).collect()
    near = _near(rows, rows, lambda r: [s for s in rows if s[1] == r[1]], 5, _plain)
    assert _check_made(rows, out, near) == {"mid": 60 - 20, "small": 60 - 10}
    members = {y: sorted(r[0] for r in rows if r[1] == y) for y in ("mid", "small")}
    for r in out:
        if r._copy:
            pick = _draw(r.y, r._copy) % (len(members[r.y]) * 5)
            assert (r._base, r._neighbor) == (members[r.y][pick // 5], near[members[r.y][pick // 5]][pick % 5])
    again = R.oversample_smote(df.repartition(7), "id", "y", COLS).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_adasyn_quotas_sum_to_what_is_missing(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, DDL)
    near = _near(rows, rows, lambda r: rows, 5, _plain)
    label = {r[0]: r[1] for r in rows}
    others = {i: sum(label[j] != label[i] for j in js) for i, js in near.items()}
    got = {r.id: (r.majority_neighbors, r.quota) for r in R.adasyn_quotas(df, "id", "y", COLS).collect()}
    for y, need in (("mid", 40), ("small", 50)):
        ids = [i for i in label if label[i] == y]
        total = sum(others[i] for i in ids)
        low = {i: others[i] * need // total for i in ids}
        order = sorted(ids, key=lambda i: (-(others[i] * need % total), i))
        for i in order[:need - sum(low.values())]:
            low[i] += 1
        assert {i: got[i] for i in ids} == {i: (others[i], low[i]) for i in ids} and sum(low.values()) == need
    out = R.oversample_adasyn(df, "id", "y", COLS).collect()
    inside = _near(rows, rows, lambda r: [s for s in rows if s[1] == r[1]], 5, _plain)
    assert _check_made(rows, out, inside) == {"mid": 40, "small": 50}
    assert Counter(r._base for r in out if r._copy) == {i: q for i, (_, q) in got.items() if q}


def test_borderline_draws_from_rows_in_danger(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, DDL)
    near = _near(rows, rows, lambda r: rows, 10, _plain)
    label = {r[0]: r[1] for r in rows}
    others = {i: sum(label[j] != label[i] for j in js) for i, js in near.items()}
    kind = {i: "noise" if n == 10 else "danger" if n >= 5 else "safe" for i, n in others.items() if label[i] != "big"}
    got = {r.id: r.kind for r in R.borderline_classes(df, "id", "y", COLS).collect()}
    assert got == kind and len(set(kind.values())) > 1
    out = R.oversample_borderline(df, "id", "y", COLS).collect()
    inside = _near(rows, rows, lambda r: [s for s in rows if s[1] == r[1]], 5, _plain)
    assert _check_made(rows, out, inside) == {"mid": 40, "small": 50}
    assert {r._base for r in out if r._copy} <= {i for i, x in kind.items() if x == "danger"}


def test_smotenc_with_two_categories(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, DDL)
    weight = {}
    for y in ("mid", "small"):
        spread = [np.std([r[at] for r in rows if r[1] == y]) for at in (2, 3)]
        weight[y] = float(np.median(spread))

    def mixed(r, s):
        return round((r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2 + weight[r[1]] ** 2 * ((r[4] != s[4]) + (r[5] != s[5])), 12)

    grown = [r for r in rows if r[1] != "big"]
    near = _near(rows, grown, lambda r: [s for s in rows if s[1] == r[1]], 5, mixed)
    out = R.oversample_smotenc(df, "id", "y", COLS, ["c", "d"]).collect()
    assert _check_made(rows, out, near) == {"mid": 40, "small": 50}
    by = {r[0]: r for r in rows}
    for r in out:
        if r._copy:
            for at, x in ((4, r.c), (5, r.d)):
                counts = Counter(by[j][at] for j in near[r._base])
                assert x == min((v for v in counts if counts[v] == max(counts.values())), key=lambda v: (v is not None, v))


def test_small_classes_nulls_and_ties(spark):
    """A class of one, a class of two equal rows, rows without label or value."""
    rows = [(i, "big", float(i), 0.0, "u", 1) for i in range(6)]
    rows += [(10, "one", 1.0, 1.0, "u", 1), (20, "two", 2.0, 2.0, "u", 1), (21, "two", 2.0, 2.0, "v", 1),
             (30, None, 1.0, 1.0, "u", 1), (31, "two", None, 1.0, "u", 1), (32, "two", float("nan"), 1.0, "u", 1)]
    df = spark.createDataFrame(rows, DDL).withColumn("v", F.lit(1)).withColumn("near", F.lit("x"))
    for method in R.METHODS:
        out = R.oversample(method, df, "id", "y", COLS, ["c", "d"] if method == "smotenc" else ["d"]).collect()
        made = Counter(r.y for r in out if r._copy)
        assert sum(r._copy == 0 for r in out) == len(rows)
        assert set(made.items()) <= {("one", 5), ("two", 2)} and (method != "smote" or len(made) == 2)
        assert all((r.a, r.b) == (1.0, 1.0) for r in out if r._copy and r.y == "one")
    assert R.oversample_smote(df.limit(0), "id", "y", COLS).count() == 0
    assert R.oversample_adasyn(df.limit(0), "id", "y", COLS).count() == 0


def test_resampler_is_chosen_on_original_rows(spark, monkeypatch):
    """Each method resamples the training folds only and is scored on every row once."""
    rows = [(r[0], int(r[1] != "big"), *r[2:]) for r in _rows()]
    df = spark.createDataFrame(rows, DDL.replace("y string", "y int"))
    given = []

    def spy(method, train, *args, **kw):
        given.append((method, frozenset(r.id for r in train.select("id").collect())))
        return R.oversample(method, train, *args, **kw)

    monkeypatch.setattr(M, "oversample", spy)
    out = M.select_resampler(df, "id", "y", COLS, ["c", "d"], fit=M.fit_naive_bayes).collect()
    assert len(out) == 12 and {r.method for r in out} == set(R.METHODS)
    ids = {r[0] for r in rows}
    for m in R.METHODS:
        assert sum(r.held_out for r in out if r.method == m) == len(rows)
        parts = [ids - s for name, s in given if name == m]
        assert set().union(*parts) == ids and sum(map(len, parts)) == len(ids)
    best = {r.method for r in out if r.selected}
    assert best == {max((r.mean_f1, r.method) for r in out)[1]}
