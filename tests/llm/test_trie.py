import hashlib
import random
import zlib

from tessera.llm import trie
from tests.llm import helpers as H

CONV = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _brute(rows):
    """rows: (conv_id, turn, role, text), turns without ties."""
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    members = {}
    rebuilt = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(convs.get(c - c % 100, [])[:h] + convs[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(rebuilt[c][:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node, ids in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(ids) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(rebuilt[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _random_rows(rng, n, words="ab"):
    rows = []
    for c in rng.sample(range(450), n):
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(rng.randrange(1, 9))]
    return rows


def test_whole_table(spark):
    convs = H.table(spark, "conversations", "/root/testdata/sf0.01")
    assert _got(trie.prefix_trie(convs)) == _brute([tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()])


def test_many_shared_prefixes_and_hot_keys(spark):
    """Two texts only; one conversation holds a third of all rows; conversations that
    are prefixes of one another; absent bases; keys above the limit are broadcast."""
    rng = random.Random(4)
    rows = [r for r in _random_rows(rng, 150) if not 200 <= r[0] < 230]
    rows += [(700, t, "user", "x") for t in range(len(rows) // 2)]
    rows += [(c, t, "user", "x") for c in range(701, 740) for t in range(c - 690)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, CONV)
    want = _brute(rows)
    assert max(r[3] for r in want) > 50 and max(r[1] for r in want) > 150
    assert _got(trie.prefix_trie(df, hot_rows=5)) == want
    assert _got(trie.prefix_trie(df)) == want


def test_colliding_fingerprints_are_found(spark):
    """Weak lanes, weak turn hashes: both are noticed, and another fingerprint is taken."""
    rows = _random_rows(random.Random(9), 60, "abcdefgh")
    df, weak = spark.createDataFrame(rows, CONV), trie.Fingerprint(1, (3, 2), 5)
    blind = trie.Fingerprint(2, hash_bits=2)
    for fp in (weak, blind):
        texts = trie.store_turns(df, fp)
        members = trie.members(trie.prefix_products(texts, fp), fp)
        assert not trie.all_equal(trie.group_nodes(members), members, texts)
    assert _got(trie.prefix_trie(df, [weak, blind, trie.Fingerprint()])) == _brute(rows)


def test_edge_rows(spark):
    long = "long text " * 50_000
    rows = [(100, None, "user", None), (100, 0, None, "a"), (101, 0, "user", long), (101, 1, "user", ""), (102, 0, "user", ""),
            (205, 0, "user", "alone"), (206, 0, "user", "alone"), (100, 1, "user", "dup"), (100, 1, "user", "dup")]
    df = H.with_clashing_columns(spark.createDataFrame([*rows, (None, 0, "user", "nobody")], CONV))
    got = _got(trie.prefix_trie(df))
    assert got == _brute(rows) and {r[0] for r in got} <= {100, 101, 102, 205, 206}
    assert trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
