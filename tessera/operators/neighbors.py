"""Exact k-nearest-neighbour graph: pivots, triangle bounds, blocks.

1. Equal vectors are one point (its smallest id stands for it), so a group of
   copies of any size costs one point.
2. At most ``MAX_PIVOTS`` pivots, points with the smallest id hashes, divide the
   points into cells (nearest pivot).  A cell is dealt into blocks of about
   ``block_rows`` points, each packed into one row; a hot cell is many blocks.
3. A block searches itself first.  That gives each of its points an upper bound
   ``t`` of the distance to its k-th neighbour, and a cell with pivot ``p`` and radii
   ``[low, high]`` needs a visit only if ``d(x, p) - high <= t`` and
   ``low - d(x, p) <= t`` for some point ``x`` of the block.
4. Visiting blocks are taken in groups, ``GROUPS`` or two a core, and a block is sent
   once to each group that holds a visitor of it.  There the blocks are read one at a
   time, sorted behind the visitors; each point keeps its ``k`` best.  So a point is
   shuffled about once a group, until a group reaches ``GROUP_BYTES`` of points; beyond,
   groups grow in number.  Never more than a group and one block are in
   memory, and no pair of points leaves a task but the ``k`` kept.

The result is exact whatever the data; the pivots only decide how much can be
skipped (on vectors without structure nothing can, and the work is that of all
distances, in matrix products).  Distances of candidates are recomputed pair by
pair, so they do not depend on the blocks; ties go to the smaller id.

Defined cases: ids are unique, integers or strings.  Rows whose vector is null, holds a
null or NaN, is not of the longest length, or (cosine) is all zero have no neighbours
and are none.  With fewer than ``k`` other points all of them are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.skew import join_counted
from ..session import cut_lineage

MAX_PIVOTS = 1024
BLOCK_ROWS = 4096
CHUNK_ROWS = 512
GROUPS = 24
GROUP_BYTES = 128 << 20


class Metric:
    """Distances between rows of matrices.  With ``n_cat`` the last columns are category
    codes, and each that differs adds ``cat_weight ** 2`` to the squared distance."""

    def __init__(self, name: str = "euclidean", n_cat: int = 0, cat_weight: float = 0.0):
        if name not in ("cosine", "euclidean"):
            raise ValueError(f"unknown metric {name}")
        self.cosine, self.n_cat, self.cat_weight = name == "cosine", n_cat, float(cat_weight)

    def prepared(self, m: np.ndarray) -> np.ndarray:
        """Cosine works on unit vectors."""
        return m / np.linalg.norm(m, axis=1, keepdims=True) if self.cosine else m

    def _split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = m.shape[1] - self.n_cat
        return m[:, :at], m[:, at:]

    def squared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared Euclidean distances of all rows, up to ``slack``."""
        (x, xc), (y, yc) = self._split(a), self._split(b)
        out = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
        for j in range(self.n_cat):
            out += self.cat_weight ** 2 * (xc[:, j, None] != yc[None, :, j])
        return np.maximum(out, 0)

    def slack(self, a: np.ndarray, b: np.ndarray) -> float:
        (x, _), (y, _) = self._split(a), self._split(b)
        return 1e-11 * (1 + float((x * x).sum(1).max(initial=0)) + float((y * y).sum(1).max(initial=0)))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared Euclidean distance of each row of ``a`` to the same row of ``b``."""
        (x, xc), (y, yc) = self._split(a), self._split(b)
        return ((x - y) ** 2).sum(1) + self.cat_weight ** 2 * (xc != yc).sum(1)

    def reported(self, squared: np.ndarray) -> np.ndarray:
        """Cosine distance, or Euclidean distance, of a squared Euclidean one."""
        return np.round(squared / 2, 12) if self.cosine else np.sqrt(squared)


class Best:
    """The ``k`` nearest so far of each of ``n`` points."""

    def __init__(self, n: int, k: int):
        self.k, self.row = k, np.empty(0, np.int64)
        self.sq, self.id = np.empty(0), None
        self.bound = np.full(n, np.inf)

    def offer(self, metric: Metric, mine: np.ndarray, ids: np.ndarray, other: np.ndarray, others: np.ndarray) -> None:
        slack = metric.slack(mine, other)
        for at in range(0, len(mine), CHUNK_ROWS):
            chunk = mine[at:at + CHUNK_ROWS]
            near = metric.squared(chunk, other)
            limit = self.bound[at:at + CHUNK_ROWS]
            if np.isinf(limit).any() and near.shape[1] > self.k + 1:
                # one more than k, as the point itself may be among them
                limit = np.minimum(limit, np.partition(near, self.k, axis=1)[:, self.k])
            rows, cols = np.nonzero(near <= limit[:, None] + 2 * slack)
            rows += at
            apart = others[cols] != ids[rows]
            rows, cols = rows[apart], cols[apart]
            self._keep(rows, metric.pairs(mine[rows], other[cols]), others[cols], at, at + len(chunk))

    def _keep(self, rows: np.ndarray, sq: np.ndarray, ids: np.ndarray, lo: int, hi: int) -> None:
        same = (self.row >= lo) & (self.row < hi)
        rest = ~same
        row = np.concatenate([self.row[same], rows])
        sq = np.round(np.concatenate([self.sq[same], sq]), 14)
        ids = np.concatenate([self.id[same], ids]) if self.id is not None else ids
        order = np.lexsort((ids, sq, row))
        row, sq, ids = row[order], sq[order], ids[order]
        first = np.searchsorted(row, row)  # where each point's candidates start
        rank = np.arange(len(row)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        self.bound[row[last]] = sq[last]
        self.row = np.concatenate([self.row[rest], row[keep]])
        self.sq = np.concatenate([self.sq[rest], sq[keep]])
        self.id = np.concatenate([self.id[rest], ids[keep]]) if self.id is not None else ids[keep]


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1)


def _ids(column: pa.Array) -> np.ndarray:
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _usable(vec: Column, dim: int, metric: Metric) -> Column:
    ok = vec.isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    return ok & F.exists(vec, lambda x: x != 0) if metric.cosine else ok


def _search(points: DataFrame, k: int, metric: Metric, block_rows: int, kind: str, dim: int) -> DataFrame:
    """Distinct points ``(vid, v, wanted)`` to ``(vid, near array<struct<d, nid>>)`` of
    those wanted."""
    n = points.count()
    count = max(1, min(MAX_PIVOTS, n // block_rows))
    if count < 4 <= n:
        count = 4
    chosen = points.orderBy(F.xxhash64("vid"), "vid").limit(count).select("v").collect()
    empty = points.select("vid", F.array().cast(f"array<struct<d:double,nid:{kind}>>").alias("near")).limit(0)
    if not chosen:
        return empty
    pivots = metric.prepared(np.array([r["v"] for r in chosen], np.float64))
    id_type = _ARROW[kind]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = metric.prepared(_vectors(b.column("v")))
            cell = metric.squared(m, pivots).argmin(1)
            radius = np.sqrt(metric.pairs(m, pivots[cell]))
            rows = [x.tobytes() for x in m]
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("wanted"), pa.array(cell, pa.int64()), pa.array(radius),
                                              pa.array(rows, pa.binary())], names=["vid", "wanted", "cell", "radius", "m"])

    placed = cut_lineage(points.select("vid", "v", "wanted").mapInArrow(
        assign, f"vid {kind}, wanted boolean, cell bigint, radius double, m binary"))
    # one row a pivot
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()
    parts = {r["cell"]: -(-r["n"] // block_rows) for r in cells}
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in cells:
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]

    n_parts = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in sorted(parts.items()) for x in kv)), F.col("cell"))
    block = F.shiftleft(F.col("cell"), 32) + F.pmod(F.xxhash64("vid"), n_parts)
    dealt = placed.withColumn("block", block).repartition("block").sortWithinPartitions("block", "vid")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(at: int, held: list) -> pa.RecordBatch:
            ids = pa.array([[x for p in held for x in p[0]]], pa.list_(id_type))
            wanted = pa.array([[x for p in held for x in p[1]]], pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), ids, wanted, pa.array([b"".join(x for p in held for x in p[2])], pa.binary())],
                                              names=["block", "ids", "wanted", "m"])

        at, held = None, []
        for b in batches:
            blocks = b.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if held and at != blocks[lo]:
                    yield row(at, held)
                    held = []
                at = int(blocks[lo])
                held.append(tuple(b.column(c).slice(lo, hi - lo).to_pylist() for c in ("vid", "wanted", "m")))
        if held:
            yield row(at, held)

    blocks = cut_lineage(dealt.select("block", "vid", "wanted", "m").mapInArrow(
        pack, f"block bigint, ids array<{kind}>, wanted array<boolean>, m binary"))

    # places of the blocks, cell by cell, and the groups cut from them
    place, at = {}, 0
    for c in sorted(parts):
        place[c], at = at, at + parts[c]
    most = max(GROUPS, 2 * points.sparkSession.sparkContext.defaultParallelism)
    a_group = max(1, min(-(-at // most), GROUP_BYTES // (8 * dim * block_rows)))
    groups = -(-at // a_group)

    def group_of(block: int) -> int:
        return (place[block >> 32] + (block & 0xFFFFFFFF)) // a_group

    def unpacked(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = _ids(b.column("ids")[i].values)
        m = np.frombuffer(b.column("m")[i].as_py(), np.float64).reshape(len(ids), dim)
        return ids, b.column("wanted")[i].values.to_numpy(zero_copy_only=False), m

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, wanted, m = unpacked(b, i)
                if not wanted.any():
                    continue
                mine, own = m[wanted], b.column("block")[i].as_py()
                best = Best(len(mine), k)
                best.offer(metric, mine, ids[wanted], m, ids)
                to_pivot = np.sqrt(np.stack([metric.pairs(mine, np.broadcast_to(p, mine.shape)) for p in pivots], 1))
                # rounding may not rule a cell out
                reach = (np.sqrt(best.bound) * (1 + 1e-9) + 1e-9)[:, None]
                reach = reach + 1e-9 * to_pivot
                cells = ((to_pivot - high <= reach) & (low - to_pivot <= reach)).any(0)
                to = [(c << 32) + p for c in np.flatnonzero(cells).tolist() for p in range(parts.get(c, 0))]
                to = [x for x in to if x != own]
                # the block itself comes first in its group
                yield pa.RecordBatch.from_arrays([pa.array([group_of(own)] * (len(to) + 1), pa.int64()), pa.array([own] + to, pa.int64()),
                                                  pa.array([own] * (len(to) + 1), pa.int64())], names=["visitor", "block", "reader"])

    met = blocks.mapInArrow(visits, "visitor bigint, block bigint, reader bigint")
    itself = F.col("reader") == F.col("block")
    # at most a group's blocks read a block
    wanted = cut_lineage(met.groupBy("visitor", "block", itself.cast("int").alias("turn")).agg(F.collect_set("reader").alias("readers")))
    seen = blocks.join(wanted, "block").select("visitor", (1 - F.col("turn")).alias("turn"), "readers", *blocks.columns)
    # the visitors come first, then the blocks they visit, one at a time
    queue = seen.repartition(groups, "visitor").sortWithinPartitions("visitor", "turn", "block")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(ids: np.ndarray, best: Best) -> pa.RecordBatch:
            order = np.argsort(best.row, kind="stable")
            row, d = best.row[order], metric.reported(best.sq[order])
            near = best.id[order] if best.id is not None else np.empty(0, ids.dtype)
            ends = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(near.tolist(), id_type)], names=["d", "nid"])
            return pa.RecordBatch.from_arrays([pa.array(ids.tolist(), id_type), pa.ListArray.from_arrays(pa.array(ends), values)], names=["vid", "near"])

        at, held = None, {}
        for b in batches:
            for i in range(b.num_rows):
                ids, want, m = unpacked(b, i)
                visitor = b.column("visitor")[i].as_py()
                if visitor != at:
                    yield from (result(own, best) for _, own, best in held.values())
                    at, held = visitor, {}
                if not b.column("turn")[i].as_py():
                    held[b.column("block")[i].as_py()] = m[want], ids[want], Best(int(want.sum()), k)
                for reader in sorted(b.column("readers")[i].as_py()):
                    mine, own, best = held[reader]
                    best.offer(metric, mine, own, m, ids)
        yield from (result(own, best) for _, own, best in held.values())

    return queue.mapInArrow(nearest, f"vid {kind}, near array<struct<d:double,nid:{kind}>>")


def knn_graph(df: DataFrame, id_col: str, vec: str, k: int = 15, metric: str = "cosine", queries: Column | None = None,
              n_cat: int = 0, cat_weight: float = 0.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id_col, neighbor, rank, distance)``: the ``k`` nearest other rows of every row
    (of every row that ``queries`` holds for).  ``metric`` is ``cosine`` or
    ``euclidean``; see :class:`Metric` for ``n_cat``."""
    kind, m = dict(df.dtypes)[id_col], Metric(metric, n_cat, cat_weight)
    numbers = F.transform(F.col(vec), lambda x: x.cast("double"))
    wanted = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    rows = df.select(F.col(id_col).alias("id"), numbers.alias("v"), wanted.alias("wanted")).where(F.col("id").isNotNull())
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.where(_usable(F.col("v"), dim, m))
    points = cut_lineage(rows.groupBy("v").agg(F.min("id").alias("vid"), F.count("*").alias("weight"), F.max("wanted").alias("wanted")))
    found = _search(points, k, m, block_rows, kind, dim)
    copies = points.where("weight > 1")
    if copies.isEmpty():
        flat = found.select(F.col("vid").alias("id"), F.posexplode("near").alias("at", "x"))
        return flat.select(F.col("id").alias(id_col), F.col("x.nid").alias("neighbor"), (F.col("at") + 1).alias("rank"), F.col("x.d").alias("distance"))

    # equal vectors: only their k + 1 smallest ids can be among anybody's nearest
    found = cut_lineage(found)
    total = rows.count()
    members = cut_lineage(join_counted(rows.select("id", "v", "wanted"), copies.select("v", "vid", "weight"), ["v"], total)
                          .select("id", "vid", "wanted"))
    smallest = Window.partitionBy("vid").orderBy("id")
    few = (members.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
           .groupBy("vid").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    itself = F.struct(F.lit(0.0).alias("d"), F.col("vid").alias("nid"))
    weights = points.select("vid", "weight")
    entry = found.join(weights, "vid").select("vid", "weight", F.when(F.col("weight") > 1, F.array_insert("near", 1, itself))
                                              .otherwise(F.col("near")).alias("near"))
    lists = entry.select("vid", "weight", F.explode("near").alias("x")).select("vid", "weight", "x.d", "x.nid")
    lists = lists.join(few.withColumnRenamed("vid", "nid"), "nid", "left")
    lists = lists.select("vid", "weight", "d", F.explode(F.coalesce("ids", F.array("nid"))).alias("nid"))
    best = Window.partitionBy("vid").orderBy("d", "nid")
    lists = (lists.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
             .groupBy("vid").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("d", "nid"))).alias("near")))
    lists = cut_lineage(lists)
    single = lists.where("weight = 1").select(F.col("vid").alias("id"), "near")
    many = join_counted(members.where("wanted").select("id", "vid"), lists.where("weight > 1"), ["vid"], total, hot_keys=2_000).select("id", "near")
    every = single.unionByName(many).select("id", F.slice(F.filter("near", lambda x: x["nid"] != F.col("id")), 1, k).alias("near"))
    flat = every.select("id", F.posexplode("near").alias("at", "x"))
    return flat.select(F.col("id").alias(id_col), F.col("x.nid").alias("neighbor"), (F.col("at") + 1).alias("rank"), F.col("x.d").alias("distance"))
