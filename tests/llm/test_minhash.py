import random

from tessera.llm import minhash
from tessera.llm.components import connected_components, link_components
from tests.llm import helpers as H


def _result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_matches_brute_force_on_the_whole_table(spark):
    docs = H.table(spark, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, sets = H.near_duplicate_components(texts)
    assert _result(minhash.near_duplicates(docs)) == sorted(
        (i, len(sets[i]), c, i == c) for i, c in want.items())


def test_large_group_of_near_copies_equals_all_pairs(spark):
    """Copies drift apart step by step, so most pairs of the group are not linked."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        rows.append((100 + i, " ".join(copy)))
    want, _ = H.near_duplicate_components(dict(rows))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(H.documents(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 1


def test_threshold_is_inclusive(spark):
    a = [f"w{k}" for k in range(11)]  # 7 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:10])), (3, " ".join(a[:9]))]  # 6/7, 5/7 and 5/6
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(H.documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(H.documents(spark, [rows[0], rows[2]])).collect()}
    assert got == {1: 1, 3: 3}


def test_short_blank_null_and_repeated_rows(spark):
    rows = [(9, "Hello  World"), (3, "hello\tworld"), (4, "hello"), (5, ""), (6, None), (7, " \n"), (9, "Hello  World")]
    assert _result(minhash.near_duplicates(H.documents(spark, rows))) == [
        (3, 1, 3, True), (4, 1, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
        (9, 1, 3, False), (9, 1, 3, False)]


def test_edge_rows_and_stage(spark):
    docs = H.with_clashing_columns(H.edge_documents(spark))
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    assert {(r.doc_id, r.component_id) for r in out} >= {(None, 1), (None, None), (5, 5), (6, 1)}
    stay = minhash.one_of_each_group(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == [1, 1, 2, 3, 4, 5]


def test_empty_table(spark):
    empty = H.documents(spark, [])
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.one_of_each_group(empty).count() == 0


def test_connected_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    groups = H.Groups(range(300))
    for a, b in edges:
        groups.link(a, b)
    got = {r.v: r.c for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: groups.find(v) for e in edges if e[0] != e[1] for v in e} or all(
        groups.find(v) == c for v, c in got.items())
    assert set(got) == {v for a, b in edges if a != b for v in (a, b)}


def test_buckets_are_finished_exactly(spark):
    """Links v ~ v + 7 only: no pivot sees all of its bucket."""
    members = spark.createDataFrame([(b, v) for b in (1, 2) for v in range(b * 100, b * 100 + 40)], "bucket long, v long")
    comp = link_components(members, lambda p: p.where("b - a = 7"), pivots=1)
    got = {r.v: r.c for r in comp.collect()}
    assert got == {v: b * 100 + (v - b * 100) % 7 for b in (1, 2) for v in range(b * 100, b * 100 + 40)}
