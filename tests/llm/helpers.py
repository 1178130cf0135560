"""Brute-force versions and edge-case tables shared by the operator tests."""

from __future__ import annotations

from collections import defaultdict

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def edge_documents(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows."""
    prose = "the cat of the house and the dog is in a garden that was for the bird on it " * 3
    long = " ".join(f"word{i % 997} of the day {i}" for i in range(30_000))
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, None, "en", "a", None), (None, prose, None, None, None),
            (3, "", "de", "b", 0), (4, " \t\n ", "fr", "b", 4), (5, long, "en", "c", len(long)), (None, None, None, None, None),
            (6, prose + "end", "xx", "d", 9)]
    return spark.createDataFrame(rows, DOCS)


def with_clashing_columns(df):
    """Extra columns named like the operators' own ones."""
    from pyspark.sql import functions as F
    for name in ("key", "v", "bucket", "_t", "_words", "_all", "_gone", "n_words", "kept", "n_tokens", "line", "line_no",
                 "_order", "component_id", "score", "spans", "payload", "host", "rule", "c", "a", "b"):
        df = df.withColumn(name, F.lit("x"))
    return df


class Groups:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))


def near_duplicate_components(texts):
    """doc_id -> smallest linked doc_id, by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    groups, done = Groups(sets), set()
    for ids in index.values():
        for p, i in enumerate(ids):
            for j in ids[p + 1:]:
                if (i, j) not in done:
                    done.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        groups.link(i, j)
    return {i: groups.find(i) for i in sets}, sets


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return prev[-1]


def substring_distance(item, text):
    """(distance, first end) of the nearest substring of ``text``."""
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev), prev.index(min(prev))
