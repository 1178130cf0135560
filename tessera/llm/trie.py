"""Conversation prefix trie (operator 13) over composable monoid fingerprints.

Conversation ``c`` is rebuilt from the first ``h`` turns of ``c - c % BLOCK`` and its
own turns after its first ``h`` (``h = crc32(c) % HEADS``).  A node is a distinct
sequence of first turns of rebuilt conversations, a member one that starts with it.

* *Fingerprints.*  A sequence of turns has the pair (length, sum of ``t[i] * B**i``
  mod a prime), in two lanes.  Joining sequences is an associative product: lengths
  add, and the second sum is multiplied by ``B`` to the first's length.  One scan
  numbers the turns and takes the product of every prefix of the *original*
  conversations; it runs on range partitions, and conversations that span several
  take the product of the partitions before as a carry-in.  The prefix of a rebuilt
  conversation is (head of the base) x (own prefix without its first ``h`` turns),
  worked out from those numbers alone: no rebuilt text is ever made.
* *Groups.*  Equal (depth, fingerprint) is one node.  It is verified through the
  turn references its members store: all have the same parent, and where they
  refer to different stored turns, the least and the greatest (role, text) behind
  the references are equal.  By induction over the depth the sequences are then
  equal.  If any group fails, everything is done again with other bases.
* *Subtrees.*  A node belongs to its smallest member, so every conversation owns one
  path, from some depth down to its end, that hangs on a node of another.  Sums
  over whole paths are added up the tree of conversations by pointer doubling (as
  many rounds as the logarithm of that tree's depth), then one scan along the paths
  gives every node the sum of its subtree.
* *Ends.*  Ids are dealt by range and joined to long pieces in order, which one
  streaming SHA-256 a node reads.

Keys that many rows share (a long conversation, a common first turn, the root) are
counted first; those above ``HOT_ROWS`` rows, of which there can be at most
``HOT_KEYS``, are joined by broadcast and the others by shuffle.

Defined cases: a null role or text is empty, a null turn comes first, rows of one
turn are ordered by role and a hash of the text; repeated rows are repeated turns.
Rows without ``conv_id`` belong to no conversation and are ignored.  A rebuilt
conversation may be empty: it is a member of the root and ends there.  Extra columns
are ignored.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.ordered import ordered_scan

from .stored import stored

BLOCK = 100
HEADS = 6
PRIME = (1 << 31) - 1
HOT_ROWS = 5_000
HOT_KEYS = 20_000
PIECE_CHARS = 1 << 18


@dataclass(frozen=True)
class Fingerprint:
    """Bases of the two lanes, and the seed of the turns' hashes."""
    seed: int = 0
    bases: tuple[int, int] = (1_103_515_245, 1_540_483_477)
    prime: int = PRIME
    hash_bits: int = 64

    def turn_hash(self, role: Column, text: Column) -> Column:
        h = F.xxhash64(F.lit(self.seed), role, text)
        return h if self.hash_bits == 64 else h.bitwiseAND(F.lit((1 << self.hash_bits) - 1))

    def element(self, h: Column, lane: int) -> Column:
        half = h.bitwiseAND(F.lit((1 << 31) - 1)) if lane else F.shiftrightunsigned(h, 33)
        return half % self.prime + 1

    def power(self, exponent: Column, lane: int) -> Column:
        """The base to a power below 2**31, bit by bit."""
        out, b = F.lit(1).cast("long"), self.bases[lane] % self.prime
        for k in range(31):
            out = out * F.when(exponent.bitwiseAND(F.lit(1 << k)) != 0, F.lit(b)).otherwise(F.lit(1)) % self.prime
            b = b * b % self.prime
        return out

    def inverse(self, exponent: Column, lane: int) -> Column:
        """The base to a power of 0 .. ``-(HEADS - 1)``, given as a positive number."""
        powers = [pow(self.bases[lane], -k, self.prime) for k in range(HEADS)]
        return F.element_at(F.array(*(F.lit(x).cast("long") for x in powers)), exponent.cast("int") + 1)


def fingerprints() -> Iterator[Fingerprint]:
    """Independent fingerprints, tried in turn until every node is verified."""
    for k in itertools.count():
        yield Fingerprint(k, tuple((b + 2 * k * 1_000_003) % PRIME for b in Fingerprint.bases))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from its block's base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % BLOCK


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], total: int,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key, and ``weight``, how many rows
    may have the key; weights sum to at most ``total``).  Keys above the limit, at
    most ``HOT_KEYS``, are broadcast, so that no task takes all rows of a hot key."""
    limit = max(hot_rows, total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col("weight") > limit).drop("weight").withColumn("_hot", F.lit(True)))
    cold = table.where(F.col("weight") <= limit).drop("weight")
    tagged = rows.join(hot, on, "left")
    columns = rows.columns + [c for c in cold.columns if c not in on]
    return (tagged.where("_hot").select(columns)
            .unionByName(tagged.where("_hot is null").select(rows.columns).join(cold, on).select(columns)))


def store_turns(conversations: DataFrame, fp: Fingerprint) -> DataFrame:
    """The stored turns: ref (ascending by conversation and turn; the partition in
    the upper bits), conv_id, role, text, h, chars."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        fp.turn_hash(role, text).alias("h"))
    order = ["conv_id", "turn", "role", "h"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.select(F.monotonically_increasing_id().alias("ref"), "conv_id", "role", "text", "h",
                               F.length("text").cast("long").alias("chars")), "trie-texts")


def prefix_products(texts: DataFrame, fp: Fingerprint) -> DataFrame:
    """Per turn: ref, conv_id, idx (1-based), h, chars, and per lane the product of
    the prefix with (w) and without (q) the turn."""
    p, lanes = fp.prime, (0, 1)
    here = Window.partitionBy("part", "conv_id").orderBy("ref")
    rows = texts.select("ref", F.shiftright("ref", 33).alias("part"), "conv_id", "h", "chars")
    rows = rows.withColumn("r", F.row_number().over(here).cast("long"))
    rows = rows.withColumns({f"e{k}": fp.element(F.col("h"), k) * fp.power(F.col("r"), k) % p for k in lanes})
    rows = stored(rows.withColumns({f"w{k}": F.sum(f"e{k}").over(here.rowsBetween(Window.unboundedPreceding, 0)) % p
                                    for k in lanes}), "trie-local")
    # (length, product) of each part of a conversation that spans several: at most
    # two rows a partition
    parts = rows.groupBy("conv_id", "part").agg(F.max("r").alias("n"), *(F.max_by(f"w{k}", "r").alias(f"w{k}") for k in lanes))
    spans = parts.groupBy("conv_id").agg(F.count("*").alias("c")).where("c > 1").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.join(spans, "conv_id", "left_semi").withColumn("length", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carry = carry.withColumns({f"m{k}": fp.power(F.col("length"), k) for k in lanes})
    carry = carry.select("conv_id", "part", "length", *(f"m{k}" for k in lanes), *(
        (F.coalesce(F.sum(F.col(f"m{k}") * F.col(f"w{k}") % p).over(before), F.lit(0)) % p).alias(f"c{k}") for k in lanes))
    rows = rows.join(F.broadcast(carry), ["conv_id", "part"], "left")
    first = lambda k: F.coalesce(F.col(f"c{k}"), F.lit(0))
    times = lambda k: F.coalesce(F.col(f"m{k}"), F.lit(1))
    return stored(rows.select(
        "ref", "conv_id", (F.col("r") + F.coalesce("length", F.lit(0))).alias("idx"), "h", "chars",
        *(((first(k) + times(k) * F.col(f"w{k}")) % p).alias(f"w{k}") for k in lanes),
        *(((first(k) + times(k) * ((F.col(f"w{k}") - F.col(f"e{k}") + p) % p)) % p).alias(f"q{k}") for k in lanes)), "trie-turns")


def _key(w0: Column, w1: Column) -> Column:
    return F.shiftleft(w0, 31).bitwiseOR(w1)


def members(turns: DataFrame, fp: Fingerprint, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per rebuilt conversation and depth: conv_id, depth, key (fingerprint),
    up (the parent's), h, chars and ref of the last turn, ends."""
    p, lanes = fp.prime, (0, 1)
    h = borrowed(F.col("conv_id"))
    own = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), *(F.coalesce(F.max(F.when(F.col("idx") == h, F.col(f"w{k}"))), F.lit(0)).alias(f"o{k}") for k in lanes))
    entry = F.struct("idx", "w0", "w1", "q0", "q1", "h", "chars", "ref")
    heads = (turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("idx") < HEADS))
             .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(entry)).alias("head")))
    convs = own.withColumns({"base": base_of(F.col("conv_id")), "skip": h}).join(heads, "base", "left")
    convs = convs.withColumn("head", F.coalesce(F.slice("head", 1, F.col("skip").cast("int")), F.array()))
    convs = convs.withColumn("taken", F.size("head").cast("long"))
    convs = convs.withColumns({f"f{k}": fp.inverse(F.col("skip") - F.col("taken"), k) for k in lanes})
    # what the head adds, less the own turns it replaces
    last = lambda k: F.coalesce(F.get("head", F.size("head") - 1)[f"w{k}"], F.lit(0))
    convs = convs.withColumns({f"a{k}": (last(k) + p - F.col(f"o{k}") * F.col(f"f{k}") % p) % p for k in lanes})
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("skip"))), "trie-convs")

    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("key"), zero.alias("up"), zero.alias("h"),
                        zero.alias("chars"), F.lit(-1).cast("long").alias("ref"), (F.col("length") == 0).alias("ends"))
    head = convs.select("conv_id", "length", F.inline("head")).select(
        "conv_id", F.col("idx").alias("depth"), _key(F.col("w0"), F.col("w1")).alias("key"),
        _key(F.col("q0"), F.col("q1")).alias("up"), "h", "chars", "ref", (F.col("idx") == F.col("length")).alias("ends"))
    total = turns.count()
    table = convs.select("conv_id", "taken", "skip", "length", "f0", "f1", "a0", "a1", F.col("n").alias("weight"))
    rest = join_counted(turns.where(F.col("idx") > h), table, ["conv_id"], total, hot_rows)
    moved = lambda c, k: (F.col(f"a{k}") + F.col(f"{c}{k}") * F.col(f"f{k}")) % p
    depth = F.col("taken") + F.col("idx") - F.col("skip")
    rest = rest.select("conv_id", depth.alias("depth"), _key(moved("w", 0), moved("w", 1)).alias("key"),
                       _key(moved("q", 0), moved("q", 1)).alias("up"), "h", "chars", "ref", (depth == F.col("length")).alias("ends"))
    return stored(root.unionByName(head).unionByName(rest), "trie-members")


def group_nodes(rows: DataFrame) -> DataFrame:
    ended = F.when(F.col("ends"), F.col("conv_id"))
    return stored(rows.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.min("up").alias("up"), F.max("up").alias("up_most"), F.min("h").alias("h"), F.max("h").alias("h_most"),
        F.min("ref").alias("ref"), F.max("ref").alias("ref_most"), F.min(ended).alias("first_end")), "trie-nodes")


def all_equal(nodes: DataFrame, rows: DataFrame, texts: DataFrame, hot_rows: int = HOT_ROWS) -> bool:
    """Whether the members of each node have the same parent and last turn."""
    if not nodes.where("up != up_most or h != h_most").isEmpty():
        return False
    several = nodes.where("ref != ref_most").select("depth", "key", F.col("n_convs").alias("weight"))
    used = join_counted(rows.select("depth", "key", "ref"), several, ["depth", "key"], rows.count(), hot_rows).distinct()
    # a table of its own: where it is small, the planner moves no text
    said = stored(used, "trie-refs").join(texts.select("ref", "role", "text"), "ref")
    turn = F.struct("role", "text")
    return said.groupBy("depth", "key").agg((F.min(turn) != F.max(turn)).alias("differ")).where("differ").isEmpty()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted (depth, key, conv_id) to (depth, key, first id, comma-joined ids)."""
    at, first, ids, size = None, None, [], 0
    for b in batches:
        for depth, key, conv in zip(*(c.to_pylist() for c in b.columns)):
            if ids and (at != (depth, key) or size >= PIECE_CHARS):
                yield *at, first, ",".join(ids)
                ids, size = [], 0
            if not ids:
                at, first = (depth, key), conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield *at, first, ",".join(ids)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    at, digest = None, None
    for b in batches:
        for depth, key, ids in zip(*(c.to_pylist() for c in b.columns)):
            if at != (depth, key):
                if at is not None:
                    yield *at, digest.hexdigest()
                at, digest = (depth, key), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if at is not None:
        yield *at, digest.hexdigest()


def _in_batches(rows: Iterator[tuple], fields: list[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(fields)
    while held := list(itertools.islice(rows, 1024)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of the nodes at which a member ends."""
    long, text = pa.int64(), pa.string()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(_pieces(batches), [("depth", long), ("key", long), ("first", long), ("ids", text)])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(_hashes(batches), [("depth", long), ("key", long), ("ends_sha256", text)])

    order = ["depth", "key", "conv_id"]
    ends = rows.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = ends.mapInArrow(pieces, "depth bigint, key bigint, first bigint, ids string")
    by_node = joined.repartition("depth", "key").sortWithinPartitions("depth", "key", "first")
    return by_node.select("depth", "key", "ids").mapInArrow(hashes, "depth bigint, key bigint, ends_sha256 string")


VALUES = ("leaves", "saved")


def tree_sums(tree: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(conv_id, up, leaves, saved)``, up null for the root, to (conv_id, leaves,
    saved) summed over the subtree: in round k every row adds what the rows 2**k
    below it have, whose pointers then move up as far again."""
    total, k = tree.count(), 0
    tree = stored(tree, "trie-sums0")
    while not tree.where("up is not null").isEmpty():
        k += 1
        below = tree.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(
            *(F.sum(v).alias(f"more_{v}") for v in VALUES), F.count("*").alias("weight"))
        below = below.join(tree.select("conv_id", F.col("up").alias("next")), "conv_id")
        below = stored(below, f"trie-below{k}")
        added = tree.join(below.drop("next", "weight"), "conv_id", "left").select(
            "conv_id", "up", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in VALUES))
        jump = below.select(F.col("conv_id").alias("up"), "next", "weight")
        moved = join_counted(added.where("up is not null"), jump, ["up"], total, hot_rows)
        tree = stored(moved.select("conv_id", F.col("next").alias("up"), *VALUES)
                      .unionByName(added.where("up is null")), f"trie-sums{k}")
    return tree.select("conv_id", *VALUES)


def prefix_trie(conversations: DataFrame, attempts: Iterable[Fingerprint] | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    for fp in attempts or fingerprints():
        texts = store_turns(conversations, fp)
        rows = members(prefix_products(texts, fp), fp, hot_rows)
        nodes = group_nodes(rows)
        if all_equal(nodes, rows, texts, hot_rows):
            break
    else:
        raise RuntimeError("no fingerprint told all prefixes apart")
    # where each conversation's own path starts, and the node it hangs on
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"), F.min_by("up", "depth").alias("key"))
    tops = tops.select(F.col("conv_id").alias("child"), (F.col("depth") - 1).alias("depth"), "key").where("depth >= 0")
    owner = nodes.select("depth", "key", F.col("conv_id").alias("up"), F.col("n_convs").alias("weight"))
    hung = stored(join_counted(tops, owner, ["depth", "key"], rows.count(), hot_rows).select("child", "up", "depth"), "trie-hung")

    goes_on = (~F.col("first_end").eqNullSafe(F.col("conv_id"))).cast("long")
    branches = hung.groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count("*").alias("branches"))
    above = hung.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("up").alias("other"))
    paths = nodes.join(branches, ["conv_id", "depth"], "left").join(above, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "key", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        (goes_on + F.coalesce("branches", F.lit(0))).alias("n_children"),
        F.when(F.col("depth") > 0, F.coalesce("other", "conv_id")).alias("parent_conv_id"))
    paths = stored(paths.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "trie-paths")

    whole = paths.groupBy("conv_id").agg(*(F.sum(v).alias(v) for v in VALUES))
    tree = whole.join(hung.select(F.col("child").alias("conv_id"), "up"), "conv_id", "left")
    sums = tree_sums(tree.select("conv_id", "up", *VALUES), hot_rows)
    hanging = hung.join(sums.withColumnRenamed("conv_id", "child"), "child").groupBy(
        F.col("up").alias("conv_id"), "depth").agg(*(F.sum(v).alias(f"hung_{v}") for v in VALUES))
    valued = paths.join(hanging, ["conv_id", "depth"], "left").join(end_digests(rows), ["depth", "key"], "left")
    valued = valued.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        *((F.col(v) + F.coalesce(f"hung_{v}", F.lit(0))).alias(v) for v in VALUES),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    out = ordered_scan(valued, [("depth", False)], by=["conv_id"], sums=VALUES)
    long = lambda c: F.col(c).cast("long")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", long("_cum_leaves").alias("n_leaves"),
                      long("_cum_saved").alias("saved_tokens"), "ends_sha256")


def oracle_sql(table: str = "conversations") -> str:
    """DuckDB: rebuilt conversations with the digests of their turns strung together."""
    ops = "flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ord(x), 256, 256, 256, 256, 256, 256, 256, 256]))"
    crc = f"""xor(list_reduce(list_prepend(4294967295::bigint, {ops}::bigint[]), lambda c, x:
      CASE WHEN x < 256 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END), 4294967295::bigint)"""
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS idx,
                  sha256(coalesce(role, '') || chr(10) || coalesce(text, '')) AS d, length(coalesce(text, '')) AS chars
           FROM {table} WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.idx, t.d, t.chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {BLOCK} AND t.idx <= c.h
      UNION ALL SELECT c.conv_id, 1, t.idx, t.d, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.idx > c.h),
m AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS k, chars,
             row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, idx ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM m GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, substr(k, 1, 64 * (depth - 1)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, k)),
u AS (SELECT substr(k, 1, 64 * a) AS k, sum((n_children = 0)::bigint) AS n_leaves, sum((n_convs - 1) * chars) AS saved
      FROM (SELECT *, unnest(generate_series(0, depth)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth::bigint AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children::bigint AS n_children,
       u.n_leaves::bigint AS n_leaves, u.saved::bigint AS saved_tokens, v.ends_sha256
FROM v JOIN u ON u.k = v.k LEFT JOIN v p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.k = substr(v.k, 1, 64 * (v.depth - 1))"""
