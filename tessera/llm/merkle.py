"""Merkle dataset manifest (operator 11): sibling-shift self-joins.

Every row is a leaf, the SHA-256 of its fields, each as its UTF-8 length, a colon
and its value.  Leaves are numbered per language by ``doc_id``; every ``ARITY``
consecutive nodes of a level are hashed to one node of the next until one is left,
the language's subroot.  The subroots, ordered by language, are the leaves of a
second tree of the same kind, whose last node is the root.

* *Numbering* comes from ``ordered_scan``, so that no language is sorted in one
  task; only digests and ids are moved, the texts are read once.
* *Levels.*  Each node asks for the nodes of its run by shifting its slot by ``0 ..
  ARITY - 1`` (for two children the shift by one is the index XOR 1) and finds them
  by an equijoin on (language, index).  What a node found, in slot order, is its
  part of every proof through it; the rows of slot zero emit the parents.
* *Proofs* are handed down, from the root to the leaves: a node's proof is what its
  siblings say at its own level, then its parent's proof.  At each step at most
  ``ARITY`` rows meet one parent, so no node near the root is a hot key.

Levels are written tables; their number grows with the logarithm of the rows, and
only that number and the root reach the driver.  ``verified`` is a real check: the
leaf is hashed anew (from the tampered text, if any) and folded with the proof.

Defined cases: null fields are hashed as ``-``.  A null ``doc_id`` sorts first;
rows repeated under one ``doc_id`` are separate leaves, ordered by digest.  A null
language is a language of its own and first.  A language with one leaf has that
leaf as its subroot; a single subroot is the root.  Rows without siblings anywhere
have the digest of the empty proof.  Extra columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordered import ordered_scan
from tessera.session import broadcast_if_small

from .stored import stored

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before:binary,after:binary>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields, each ``-`` or length, colon, value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def is_tampered(doc_id: Column) -> Column:
    """Whether the CRC-32 of the decimal id is a multiple of three (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _joined(siblings: Column) -> Column:
    """The digests of ``(at, digest)`` structs, one after the other."""
    return F.aggregate(siblings, F.lit(b""), lambda s, x: F.concat(s, x["digest"]))


def _with_runs(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes ``(tree, idx, n, digest)`` with the digests of their run that stand
    before and after them: one equijoin with the shifted slots."""
    slot = F.col("idx") % arity
    shifted = F.col("idx") - slot + (slot + F.col("shift")) % arity
    asked = (nodes.select("tree", "idx", "n", F.explode(F.sequence(F.lit(0), F.lit(arity - 1))).alias("shift"))
             .select("tree", "idx", "n", shifted.alias("at")).where("at < n"))
    found = asked.join(nodes.select("tree", F.col("idx").alias("at"), "digest"), ["tree", "at"])
    run = found.groupBy("tree", "idx", "n").agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"))
    here = F.col("idx")
    side = lambda keep: _joined(F.filter("run", keep))
    return run.select("tree", "idx", "n", side(lambda x: x["at"] < here).alias("before"),
                      side(lambda x: x["at"] == here).alias("digest"), side(lambda x: x["at"] > here).alias("after"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    first = level.where(F.col("idx") % arity == 0)
    digest = F.unhex(F.sha2(_hex(F.concat("digest", "after")).cast("binary"), 256))
    return first.select("tree", (F.col("idx") / arity).cast("long").alias("idx"),
                        F.ceil(F.col("n") / arity).cast("long").alias("n"), digest.alias("digest"))


def fold_trees(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """``leaves`` (tree, idx from 0, n leaves of the tree, digest) to the levels of
    all trees with more than one node there, (tree, idx, n, before, digest, after),
    and the last node of each tree, (tree, height, digest)."""
    levels, tops = [], []
    nodes, height = leaves, 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.lit(height).alias("height"), "digest"))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            break
        levels.append(stored(_with_runs(nodes, arity), f"merkle-level{height}"))
        height += 1
        # the next level reads an arity-th of this one
        nodes = stored(_parents(levels[-1], arity), f"merkle-nodes{height}")
    last = tops[0]
    for t in tops[1:]:
        last = last.unionByName(t)
    return levels, last


def leaf_proofs(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """(tree, idx, path, subroot) of the leaves; ``tops`` (tree, height, digest, path)
    carries the proof above each tree's last node."""
    def of_tops(height: int) -> DataFrame:
        return tops.where(F.col("height") == height).select(
            "tree", F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"))

    proofs = of_tops(len(levels))
    for height in range(len(levels) - 1, -1, -1):
        own = levels[height].select("tree", "idx", (F.col("idx") / arity).cast("long").alias("up"),
                                    F.array(F.struct("before", "after")).alias("own"))
        above = proofs.select("tree", F.col("idx").alias("up"), "path", "subroot")
        mine = own.join(above, ["tree", "up"]).select("tree", "idx", F.concat("own", "path").alias("path"), "subroot")
        proofs = mine.unionByName(of_tops(height))
    return proofs


def fold_proof(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its path give; the path lists, level by level,
    the digests before and after."""
    step = lambda d, level: F.sha2(F.concat(_hex(level["before"]), d, _hex(level["after"])).cast("binary"), 256)
    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    every = F.aggregate(path, F.lit(b""), lambda s, level: F.concat(s, level["before"], level["after"]))
    return F.sha2(_hex(every).cast("binary"), 256)


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    fields = {f: F.col(f) for f in FIELDS}
    changed = F.when(is_tampered(F.col("doc_id")), leaf_digest(
        [lower_ascii(c) if f == "text" else c for f, c in fields.items()]))
    # a null language sorts before all others and is no string that could occur
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = stored(docs.select("doc_id", tree.alias("tree"), F.unhex(leaf_digest(list(fields.values()))).alias("digest"),
                                F.unhex(changed).alias("changed")), "merkle-leaves")
    sizes = broadcast_if_small(leaves.groupBy("tree").agg(F.count("*").alias("n")))
    ranked = ordered_scan(leaves, ["doc_id", "digest"], by=["tree"], rn="rank")
    numbered = stored(ranked.join(sizes, "tree").withColumn("idx", F.col("rank") - 1).drop("rank"), "merkle-numbered")
    levels, subroots = fold_trees(numbered.select("tree", "idx", "n", "digest"), arity)

    subroots = stored(subroots, "merkle-subroots")
    ordered = ordered_scan(subroots, ["tree"], rn="rank")
    over = ordered.crossJoin(F.broadcast(subroots.agg(F.count("*").alias("n"))))  # one row
    above = stored(over.select(F.lit("").alias("tree"), (F.col("rank") - 1).alias("idx"), "n", "digest",
                               F.col("tree").alias("name")), "merkle-above")
    upper, root_node = fold_trees(above.select("tree", "idx", "n", "digest"), arity)
    root_row = root_node.first()
    root = F.lit(bytes(root_row["digest"]) if root_row else None).cast("binary")
    empty = F.array().cast(_PATH)
    upper_proofs = leaf_proofs(upper, root_node.withColumn("path", empty), arity)
    named = above.select("idx", F.col("name").alias("tree")).join(upper_proofs.select("idx", "path"), "idx")
    tops = subroots.join(named.select("tree", "path"), "tree")

    proofs = leaf_proofs(levels, tops, arity)
    out = numbered.join(proofs, ["tree", "idx"])
    folded = fold_proof(_hex(F.coalesce("changed", "digest")), F.col("path"))
    out = out.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
                     _hex(root).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(arity: int = ARITY, table: str = "documents", levels: int = 9, upper: int = 4) -> str:
    """DuckDB: ``levels`` and ``upper`` rounds of hashing, enough for
    ``arity ** levels`` rows a language and ``arity ** upper`` languages."""
    def part(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(part(text if f == "text" else f) for f in FIELDS) + ")"

    low = "list_aggregate(list_transform(string_split(text, ''), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' AND strlen(x) = 1 THEN lower(x) ELSE x END), 'string_agg', '')"
    # CRC-32 of a decimal, bit by bit: a byte is mixed in, 256 stands for one shift
    ops = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ord(x), 256, 256, 256, 256, 256, 256, 256, 256]))"
    crc = f"""xor(list_reduce(list_prepend(4294967295::bigint, {ops}::bigint[]), lambda c, x:
      CASE WHEN x < 256 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END), 4294967295::bigint)"""

    def tree(name: str, start: str, rounds: int) -> str:
        """Levels name0.. of (tree, idx, n, d) and what stands around each node."""
        out = [f"{name}0 AS ({start})"]
        for k in range(rounds):
            out.append(f"""{name}{k + 1} AS (SELECT tree, idx // {arity} AS idx, (max(n) + {arity - 1}) // {arity} AS n,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE max(d) END AS d FROM {name}{k} GROUP BY tree, idx // {arity})""")
            out.append(f"""{name}s{k} AS (SELECT tree, idx, n,
  coalesce(string_agg(d, '' ORDER BY idx) OVER (PARTITION BY tree, idx // {arity} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(d, '' ORDER BY idx) OVER (PARTITION BY tree, idx // {arity} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM {name}{k})""")
        return ",\n".join(out)

    joins = "".join(f"\n JOIN ls{k} ON ls{k}.tree = f.tree AND ls{k}.idx = f.idx // {arity ** k}" for k in range(levels))
    joins += f"\n JOIN top ON top.name = f.tree JOIN l{levels} sub ON sub.tree = f.tree JOIN u{upper} r ON true"
    joins += "".join(f"\n JOIN us{k} ON us{k}.idx = top.idx // {arity ** k}" for k in range(upper))
    every = [f"ls{k}" for k in range(levels)] + [f"us{k}" for k in range(upper)]
    proof = " || ".join(f"{x}.b || {x}.a" for x in every)
    folded = "[" + ", ".join(f"{{'n': {x}.n, 'b': {x}.b, 'a': {x}.a}}" for x in every) + "]"
    return f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS idx,
                  count(*) OVER (PARTITION BY tree) AS n
           FROM (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS d,
                        CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} END AS t FROM {table})),
{tree('l', 'SELECT tree, idx, n, d FROM f', levels)},
top AS (SELECT tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM l{levels}),
{tree('u', "SELECT '' AS tree, idx, n, d FROM top", upper)},
p AS (SELECT f.doc_id, f.d AS leaf, sub.d AS subroot, r.d AS root, sha256({proof}) AS proof_sha256,
             coalesce(f.t, f.d) AS start, {folded} AS path FROM f {joins}),
q AS (SELECT *, list_reduce(list_prepend({{'n': 0::bigint, 'b': start, 'a': ''}}, path),
         lambda s, x: {{'n': x.n, 'b': CASE WHEN x.n > 1 THEN sha256(x.b || s.b || x.a) ELSE s.b END, 'a': ''}}).b AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM q"""
