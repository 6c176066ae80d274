"""Exact top-k by inner product with KD-trees per shard.

Vectors are dealt into shards of bounded size. A shard builds a KD-tree: median splits of the widest side, tight boxes around
what a node really holds, and the smallest id below each node. A query walks a tree best-first: a box's bound is the largest
inner product that any point of the box could have, and a walk ends when no open box can beat the k-th score found so far (nor
tie with it under a smaller id). Each query starts in its own shard; its k-th score and id then travel with it to all other
shards and cut their walks short from the start. The best of all shards are merged at the end.

Components are turned into floor(scale * x). Cases: vectors that are null, empty or hold a null or non-finite component take no
part, nor do rows without id; vectors meet only vectors of their own length; a row never matches rows with its own id; of rows that
share an id and are queries, one is asked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Vectors in a shard, points in a leaf, and shards whose queries visit a tree in one task.
SHARD_ROWS, LEAF, GROUP = 16384, 64, 64


class Tree:
    """A KD-tree over integer points; ``ids`` break ties."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        spans, children = [], []
        stack = [(0, len(ids), -1)]
        while stack:
            begin, end, parent = stack.pop()
            node = len(spans)
            spans.append((begin, end))
            children.append([])
            if parent >= 0:
                children[parent].append(node)
            if end - begin > leaf:
                part = points[order[begin:end]]
                side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                half = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(part[:, side], half)]
                stack += [(begin, begin + half, node), (begin + half, end, node)]
        self.points, self.ids = points[order], ids[order]
        self.spans, self.children = spans, children
        self.low = np.stack([self.points[b:e].min(axis=0) for b, e in spans])
        self.high = np.stack([self.points[b:e].max(axis=0) for b, e in spans])
        self.least_id = [int(self.ids[b:e].min()) for b, e in spans]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product a point of each node's box could have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, worst: tuple[int, int]) -> list[tuple[int, int]]:
        """The best (score, -id) pairs that are better than ``worst``, best first."""
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if (-top, -self.least_id[node]) <= worst:
                if -top < worst[0]:
                    break
                continue
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= worst[0]:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            begin, end = self.spans[node]
            scores, ids = self.points[begin:end] @ query, self.ids[begin:end]
            for i in np.flatnonzero((scores >= worst[0]) & (ids != own)):
                pair = (int(scores[i]), -int(ids[i]))
                if pair > worst:
                    heapq.heappush(best, pair)
                    if len(best) > k:
                        heapq.heappop(best)
                    if len(best) == k:
                        worst = max(worst, best[0])
        return sorted(best, reverse=True)


NOTHING = (-(1 << 62), -(1 << 62))
_FOUND = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("query_id", pa.int64()), ("vector", pa.binary()),
                    ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
_FOUND_SQL = "dim int, shard int, query_id bigint, vector binary, ids array<bigint>, scores array<bigint>"


def _number(points: np.ndarray, queries: np.ndarray) -> type:
    """Doubles where they hold every product exactly, else 64-bit integers."""
    reach = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, points.shape[1])
    return np.float64 if reach < 2**52 else np.int64


def _points(table: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=np.int64).reshape(-1, dim)


def _ask(tree_points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, worst: list[tuple]) -> list:
    kind = _number(tree_points, queries)
    tree = Tree(tree_points.astype(kind), ids)
    queries = queries.astype(kind)
    out = []
    for at in range(0, len(queries), 1024):
        bound = tree.bounds(queries[at:at + 1024])
        for i in range(len(bound)):
            out.append(tree.search(queries[at + i], int(query_ids[at + i]), bound[i], k, worst[at + i]))
    return out


def _rows(table: pa.Table, query_ids, vectors, results) -> pa.Table:
    n = len(query_ids)
    return pa.Table.from_arrays([
        pa.array([table["dim"][0].as_py()] * n, pa.int32()), pa.array([table["shard"][0].as_py()] * n, pa.int32()),
        pa.array(query_ids, pa.int64()), pa.array(vectors, pa.binary()),
        pa.array([[-i for _, i in r] for r in results], pa.list_(pa.int64())),
        pa.array([[s for s, _ in r] for r in results], pa.list_(pa.int64()))], schema=_FOUND)


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim, vector (packed 64-bit integers) of the rows that take part."""
    def run(batches):
        for batch in batches:
            values = batch.column("embedding")
            packed = [np.floor(scale * np.asarray(v.values, dtype=np.float64)).astype(np.int64).tobytes() for v in values]
            yield pa.record_batch([batch.column("vec_id"), pa.array([len(p) // 8 for p in packed], pa.int32()),
                                   pa.array(packed, pa.binary())], names=["vec_id", "dim", "vector"])
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(whole, F.lit(False))).mapInArrow(
        run, "vec_id bigint, dim int, vector binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for each row that ``is_query`` (a condition on vec_id) holds for."""
    points = integer_vectors(vectors, scale)
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    points = materialize(points.withColumn("asked", F.coalesce(is_query, F.lit(False))).withColumn(
        "shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")))

    def at_home(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        every, ids, asked = _points(table, dim), np.asarray(table["vec_id"]), np.flatnonzero(np.asarray(table["asked"]))
        asked = asked[np.unique(ids[asked], return_index=True)[1]] if len(asked) else asked
        results = _ask(every, ids, every[asked], ids[asked], k, [NOTHING] * len(asked)) if len(asked) else []
        return _rows(table, ids[asked], [every[i].tobytes() for i in asked], results)
    home = materialize(points.groupBy("dim", "shard").applyInArrow(at_home, _FOUND_SQL))
    found = home.select("query_id", "ids", "scores")
    if shards > 1:
        groups = math.ceil(shards / GROUP)
        # what a query brings along: itself and the k-th pair of its own shard
        full = F.size("ids") == k
        asking = home.select(
            "dim", F.col("shard").alias("origin"), F.pmod(F.col("shard"), F.lit(groups)).alias("group"), "query_id", "vector",
            F.when(full, F.element_at("scores", -1)).alias("score"), F.when(full, F.element_at("ids", -1)).alias("kth"),
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).filter("origin <> shard")
        trees = points.select("dim", "shard", "vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

        def away(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows == 0 or right.num_rows == 0:
                return _FOUND.empty_table()
            dim = left["dim"][0].as_py()
            worst = [NOTHING if s is None else (s, -i) for s, i in zip(right["score"].to_pylist(), right["kth"].to_pylist())]
            ids = np.asarray(right["query_id"])
            queries = _points(right, dim)
            results = _ask(_points(left, dim), np.asarray(left["vec_id"]), queries, ids, k, worst)
            return _rows(left, ids, [b""] * len(ids), results)
        key = ["dim", "shard", "group"]
        rest = trees.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(away, _FOUND_SQL)
        found = found.unionByName(rest.select("query_id", "ids", "scores"))
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select(
        "query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
