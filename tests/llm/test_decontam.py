import random

from tessera.llm import decontam
from tests.llm import helpers as H


def test_myers_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(1500):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 13)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        want = H.substring_distance(item, text)
        assert decontam.best_match(item, text, 99) == want
        assert decontam.best_match(item, text, want[0] - 1) is None


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_matches_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(18))) for k in range(12)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(40)]
        leak = list(rng.choice(items)[1])
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(leak))
            leak[at:at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
        body.insert(20, "".join(leak).upper() if i % 3 else "".join(leak).replace(" ", ",\n"))
        docs.append((i, " ".join(body)))
    got = {(r.doc_id, r.item_id): (r.distance, r.end_at)
           for r in decontam.matches(H.documents(spark, docs), _items(spark, items)).collect()}
    want = {}
    for i, t in docs:
        for k, item in items:
            n = decontam.normalise(item)
            d = H.substring_distance(n, decontam.normalise(t))
            if d[0] <= decontam.budget(len(n), decontam.BUDGET_PERCENT):
                want[(i, k)] = d
    assert got == want and 20 < len(want) < 60
    blocks = decontam.matches(H.documents(spark, docs), _items(spark, items), block_chars=400)
    assert {(r.doc_id, r.item_id): (r.distance, r.end_at) for r in blocks.collect()} == want


def test_planted_passages_of_the_tables(spark):
    docs, items = H.table(spark, "documents"), H.table(spark, "benchmark")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if r.text in t}
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()}
    assert want and got == want
    left = {r.doc_id for r in decontam.uncontaminated(docs, items).collect()}
    assert left == set(texts) - {i for i, _ in want}


def test_edges(spark):
    docs = H.with_clashing_columns(H.edge_documents(spark))
    items = _items(spark, [(1, None), (2, ""), (3, "the cat"), (4, "the cat of the house and the dog"), (4, "the dog is in a garden that was"), (None, "of the day 29999 no no")])
    out = decontam.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(i, k) for i in (1, None, 6) for k in (3, 4)} and len(out) == 8
    stay = decontam.uncontaminated(docs, items)
    assert stay.columns == docs.columns and sorted(str(r.doc_id) for r in stay.collect()) == ["2", "3", "4", "5", "None"]
    none = items.limit(0)
    assert decontam.matches(docs, none).count() == 0 and decontam.uncontaminated(docs, none).count() == docs.count()
    empty = H.documents(spark, [])
    assert decontam.matches(empty, items).count() == 0 and decontam.uncontaminated(empty, items).count() == 0


def test_short_items_are_exact_runs_of_words(spark):
    texts = ["The cat's tale", "concatenate", "a cat", "cat", "bobcat cat-", "category", "x y", "x  Y!", "xx yy"]
    items = [(1, "cat"), (2, "x y"), (3, "!?"), (4, "cat tales")]
    want = set()
    for i, t in enumerate(texts):
        for k, item in items:
            n = decontam.normalise(item)
            if n and f" {n} " in f" {decontam.normalise(t)} ":
                want.add((i, k))
    out = decontam.matches(H.documents(spark, list(enumerate(texts))), _items(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want and {r.distance for r in out} == {0} and len(want) == 6
    for r in out:
        doc = decontam.normalise(texts[r.doc_id])
        assert doc[r.end_at - r.item_chars:r.end_at] == decontam.normalise(dict(items)[r.item_id])
