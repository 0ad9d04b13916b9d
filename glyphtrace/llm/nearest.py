"""Approximate nearest neighbours: stable random projections to few dimensions, kd-trees, and a chi-square stopping test.

Vectors are projected to `dims` dimensions by a Gaussian (2-stable) matrix, so that for two vectors at distance d the
squared projected distance over d squared follows a chi-square distribution of `dims` degrees. A coarse kd-tree, fitted
to a bounded sample, deals all vectors into blocks; each block gets a kd-tree over its projections. A query first
searches the block that it falls into, then every block whose box can still hold a near enough projection. In a block it
visits leaves by growing projected distance and verifies their vectors at full dimension; it stops when a vector nearer
than its k-th best would have shown up before with probability `confidence`.

Blocks and queries meet by a shuffle on the block: a task holds one block and streams the queries through it, so neither
the driver nor a broadcast holds queries. Broadcast are the cuts and boxes of at most MOST_BLOCKS blocks. A block that
many equal vectors overfill is searched in parts. Vectors that are null, zero or hold null or non-finite components take
no part; vectors of other dimensions than the query's are no candidates for it. Ties go to the smaller id. An id is
asked once and answered once: of rows that repeat it, the smallest vector asks and the nearest answers; no row answers
its own id, and rows without an id take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphtrace.llm.common import Workspace, table
from glyphtrace.llm.vectors import by_dimension, usable

LEAF = 48
MOST_BLOCKS = 1 << 15
#: Projected vectors to which the coarse trees are fitted.
SAMPLE = 1 << 17
ROW = "dim int, block int, part int, asks boolean, id long, v array<double>, reach double"


def chi_square_quantile(dims: int, p: float) -> float:
    """The value that a chi-square variable of an even number of degrees stays below with probability p."""
    half = dims // 2
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class KdTree:
    """Leaves of a kd-tree by median cuts of the widest axis: rows in order, leaf bounds and leaf boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.rows, self.cuts, low, high = np.arange(len(points)), [], [], []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            part = points[self.rows[a:b]]
            lo, hi = part.min(0), part.max(0)
            if b - a <= leaf or (lo == hi).all():
                self.cuts.append((a, b))
                low.append(lo)
                high.append(hi)
                continue
            axis, mid = int(np.argmax(hi - lo)), (b - a) // 2
            self.rows[a:b] = self.rows[a:b][np.argpartition(part[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.low, self.high = np.array(low), np.array(high)

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves and their squared distances to a point, nearest first."""
        d = box_distances(self.low, self.high, q)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def box_distances(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(low - q, 0) + np.maximum(q - high, 0)
    return np.einsum("ij,ij->i", gap, gap)


class Cuts:
    """A coarse kd-tree: planes that deal any point to one of `count` blocks."""

    def __init__(self, points: np.ndarray, count: int):
        self.axis, self.at, self.below, self.above = [], [], [], []
        self.count = 0
        self._grow(points, count)

    def _grow(self, points: np.ndarray, count: int) -> int:
        """The node's number; blocks have the numbers -1, -2, …"""
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(1)
        if count < 2 or len(points) < 2 or not spread.max() > 0:
            self.count += 1
            return -self.count
        node, axis = len(self.axis), int(np.argmax(spread))
        at = float(np.median(points[:, axis]))
        if not (points[:, axis] < at).any():
            at = float(points[points[:, axis] > at, axis].min())
        for grown, x in ((self.axis, axis), (self.at, at), (self.below, 0), (self.above, 0)):
            grown.append(x)
        low = points[:, axis] < at
        self.below[node] = self._grow(points[low], count // 2)
        self.above[node] = self._grow(points[~low], count - count // 2)
        return node

    def blocks(self, points: np.ndarray) -> np.ndarray:
        if not self.axis:
            return np.zeros(len(points), np.int32)
        axis, at, below, above = (np.array(x) for x in (self.axis, self.at, self.below, self.above))
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(rows):
            n = node[rows]
            node[rows] = np.where(points[rows, axis[n]] < at[n], below[n], above[n])
            rows = rows[node[rows] >= 0]
        return (-1 - node).astype(np.int32)


def _nearest_of_each(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct ids, nearest first, ties to the smaller id."""
    order = np.lexsort((ids, d))
    ids, d = ids[order], d[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], d[first[:k]]


def _search(tree: KdTree, ids, vectors, query_id, query, query_low, k: int, bound: float, reach: float):
    """The k best of a block for one query, as far as they are not beyond `reach`: (ids, distances)."""
    best_id, best = np.zeros(0, np.int64), np.zeros(0)
    order, floors = tree.order(query_low)
    at = 0
    while at < len(order):
        if floors[at] > bound * min(reach, best[-1] if len(best) == k else reach) ** 2:
            break
        take = order[at : at + 4]
        at += len(take)
        rows = np.concatenate([tree.rows[a:b] for a, b in (tree.cuts[i] for i in take)])
        rows = rows[ids[rows] != query_id]
        d = vectors[rows] - query
        d = np.sqrt(np.einsum("ij,ij->i", d, d))
        near = d <= reach
        best_id, best = _nearest_of_each(np.concatenate([best_id, ids[rows[near]]]), np.concatenate([best, d[near]]), k)
    return best_id, best


def nearest_neighbours(df: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, dims: int = 8, confidence: float = 0.97, block_rows: int = 4096, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: of every id for which `queries` holds, its k nearest other ids by Euclidean distance."""
    spark = df.sparkSession
    ws = Workspace(spark)
    rows = usable(df, id_col, vector_col, asked=F.coalesce(queries, F.lit(False))).filter("id is not null")
    bound = chi_square_quantile(dims, confidence)

    def project(m: np.ndarray) -> np.ndarray:
        return m @ np.random.Generator(np.random.PCG64(seed)).standard_normal((m.shape[1], dims))

    def lows(batches):
        for b in batches:
            for _, m in by_dimension(b) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), m.shape[1], np.int32)), pa.array(list(project(m)), pa.list_(pa.float64()))], names=["dim", "low"])

    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").mapInArrow(lows, "dim int, low array<double>").toArrow()  # SAMPLE rows, give or take
    of, low = np.asarray(sample["dim"].combine_chunks()), np.asarray(sample["low"].combine_chunks().flatten()).reshape(-1, dims)
    blocks = min(MOST_BLOCKS, -(-n // block_rows))
    cuts = spark.sparkContext.broadcast({int(d): Cuts(low[of == d], max(1, round(blocks * (of == d).mean()))) for d in np.unique(of)})

    def deal(batches):
        for b in batches:
            for r, m in by_dimension(b) if b.num_rows else ():
                low, d = project(m), m.shape[1]
                block = cuts.value[d].blocks(low) if d in cuts.value else np.zeros(len(m), np.int32)
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, np.int32)), pa.array(block), b["id"].take(at), b["asked"].take(at), b["v"].take(at), pa.array(list(low), pa.list_(pa.float64()))], names=["dim", "block", "id", "asked", "v", "low"])

    dealt = ws.keep(rows.mapInArrow(deal, "dim int, block int, id long, asked boolean, v array<double>, low array<double>"))
    edge = [f(F.col("low")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    boxes = dealt.groupBy("dim", "block").agg(F.count("*").alias("rows"), *edge).orderBy("dim", "block").toArrow()  # MOST_BLOCKS rows, give or take one for each dimension
    of, block = (np.asarray(boxes[c].combine_chunks()) for c in ("dim", "block"))
    parts = -(-np.asarray(boxes["rows"].combine_chunks()) // (4 * block_rows))
    low, high = (np.stack([np.asarray(boxes[f"{name}{i}"].combine_chunks()) for i in range(dims)], 1) for name in ("lo", "hi"))
    known = spark.sparkContext.broadcast({int(d): (block[of == d], parts[of == d].astype(np.int32), low[of == d], high[of == d]) for d in np.unique(of)})
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    sizes = spark.createDataFrame(pa.table({"dim": of, "block": block, "parts": parts.astype(np.int32)}).to_pandas() if len(of) else [], "dim int, block int, parts int")
    none = F.lit(None).cast("double").alias("reach")
    held = dealt.join(F.broadcast(sizes), ["dim", "block"])  # MOST_BLOCKS rows
    stock = held.select("dim", "block", part, F.lit(False).alias("asks"), "id", "v", none)
    asked = ws.keep(dealt.filter("asked").groupBy("dim", "id").agg(F.min(F.struct("v", "low", "block")).alias("x")).groupBy("id").agg(F.min(F.struct("dim", "x")).alias("y")).select("id", "y.dim", "y.x.*"))

    def search(batches):
        """One block at a time: its vectors come first, then the queries stream by."""
        at = tree = None
        mine: list = []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b[c]) for c in ("dim", "block", "part")], 1)
            asks = np.asarray(b["asks"].cast(pa.int8()))
            turn = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1) | (asks[1:] != asks[:-1])]))
            for x, y in zip(turn, np.append(turn[1:], len(asks)), strict=True):
                some, here = b.slice(x, y - x), tuple(key[x].tolist())
                ids, m = np.asarray(some["id"]), next(by_dimension(some))[1]
                if here != at:
                    at, tree, mine = here, None, []
                if not asks[x]:
                    mine.append((ids, m))
                    continue
                if not mine:
                    continue
                if tree is None:
                    own, vectors = (np.concatenate(c) for c in zip(*mine, strict=True))
                    tree = KdTree(project(vectors))
                reach, q_low = np.asarray(some["reach"].fill_null(math.inf)), project(m)
                out = [_search(tree, own, vectors, ids[i], m[i], q_low[i], k, bound, reach[i]) for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(o[0]) for o in out])), pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], names=["query_id", "vec_id", "score"])

    def searched(asking: DataFrame) -> DataFrame:
        both = stock.unionAll(asking.select("dim", "block", "part", F.lit(True).alias("asks"), "id", "v", "reach"))
        return ws.keep(both.repartition("dim", "block", "part").sortWithinPartitions("dim", "block", "part", "asks").mapInArrow(search, "query_id long, vec_id long, score double"))

    first = searched(asked.join(F.broadcast(sizes), ["dim", "block"]).select("dim", "block", part, "id", "v", none))
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("reach"))

    def further(batches):
        """The other blocks, or parts of blocks, in which a query's stop test does not hold yet."""
        for b in batches:
            for r, m in by_dimension(b) if b.num_rows else ():
                block, parts, low, high = known.value[m.shape[1]]
                q_low, reach, home, own = project(m), np.asarray(b["reach"].fill_null(math.inf))[r], np.asarray(b["block"])[r], np.asarray(b["part"])[r]
                for i in range(len(m)):
                    near = np.flatnonzero(box_distances(low, high, q_low[i]) <= bound * reach[i] ** 2)
                    to = np.repeat(block[near], parts[near])
                    p = np.concatenate([np.arange(parts[j]) for j in near]) if len(near) else np.zeros(0, np.int64)
                    new = np.flatnonzero((to != home[i]) | (p != own[i]))
                    row = pa.array(np.full(len(new), r[i]))
                    yield pa.RecordBatch.from_arrays([b["dim"].take(row), pa.array(to[new].astype(np.int32)), pa.array(p[new].astype(np.int32)), pa.array(np.ones(len(new), bool)), b["id"].take(row), b["v"].take(row), b["reach"].take(row)], names=["dim", "block", "part", "asks", "id", "v", "reach"])

    again = asked.join(F.broadcast(sizes), ["dim", "block"]).join(reached, "id", "left").select("dim", "block", part, "id", "v", "reach")
    second = searched(again.mapInArrow(further, ROW))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = first.unionAll(second).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return ws.result(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
