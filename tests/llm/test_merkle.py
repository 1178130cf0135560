import hashlib
import zlib

import pytest

from tessera.llm import merkle
from tests.llm import helpers as H


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(r, text):
    parts = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return _h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in parts))


def _fold(digests):
    """Last node, and of each leaf the (before, after) of every level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(at):
            run = digests[i // 8 * 8:i // 8 * 8 + 8]
            paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            at[k] = i // 8
        digests = [_h("".join(digests[i:i + 8])) for i in range(0, len(digests), 8)]
    return digests[0], paths


def _brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    folded = {}
    for lang in order:
        langs[lang].sort(key=lambda x: x[:3])
        folded[lang] = _fold([x[2] for x in langs[lang]])
    root, above = _fold([folded[x][0] for x in order])
    out = []
    for lang, up in zip(order, above):
        for (_, _, leaf, r), path in zip(langs[lang], folded[lang][1]):
            path = path + up
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if r.text is not None else None
            d = _leaf(r, low) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else leaf
            for b, a in path:
                d = _h(b + d + a)
            out.append((str(r.doc_id), leaf, folded[lang][0], root, _h("".join(b + a for b, a in path)), d, d == root))
    return sorted(out)


def _got(docs):
    out = merkle.manifest(docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_whole_table(spark):
    docs = H.table(spark, "documents", "/root/testdata/sf0.01")
    got = _got(docs)
    assert got == _brute(docs.collect())
    assert {r[-1] for r in got} == {True, False}


def test_edge_rows(spark):
    docs = H.edge_documents(spark)
    assert _got(H.with_clashing_columns(docs)) == _brute(docs.collect())
    assert merkle.manifest(H.documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_last_runs_and_lone_nodes(spark, n):
    """One language, runs of every length, and as many languages."""
    one = H.documents(spark, [(i, f"Text {i}") for i in range(n)])
    many = H.documents(spark, [(i, f"Text {i}", f"l{i:02d}") for i in range(n)])
    assert _got(one) == _brute(one.collect()) and _got(many) == _brute(many.collect())


def test_two_children(spark):
    """Binary trees: the shift is the index XOR 1, and every untampered row folds to the root."""
    docs = H.documents(spark, [(i, "lower case") for i in range(13)])
    out = merkle.manifest(docs, arity=2).collect()
    assert len(out) == 13 and all(r.verified for r in out) and len({r.proof_sha256 for r in out}) == 13
