"""Exact Lloyd rounds over integer vectors, with a heap of bound gaps for each cluster.

A vector's gap is the distance to the second nearest centroid less the distance to its own. A centroid that moves by m lowers the
gaps of its vectors by at most m, and what the other centroids move by at most the furthest of these moves. So every cluster has one
running drift, the sum of both over the rounds, and a vector goes into its cluster's heap once, under its gap plus the drift
so far. In the next rounds a vector is untouched as long as its entry stays above the drift; only entries at the heap's top that the
drift has reached are popped, and these vectors are compared with all centroids again, in integers. An entry is lowered by what
its rounding might hide, so a vector whose two nearest centroids are equally far is always looked at.

The vectors are written once, in packs, as a table bucketed by pack. A pack has its own heaps; between rounds only these travel (12 bytes
a vector), and the vectors are joined to them where they lie. A round returns sums and counts of what changed its cluster:
clusters times components numbers, which is all that the driver sees, beside the centroids.

Cases: a vector that is null, has another number of components than asked for, or holds a null or non-finite component takes no
part, nor does one with a component beyond 2**27 after scaling, whose squared distances could leave 64 bits. Vectors of one id are rows of
their own; rows without id take part, but start a centroid only where ids run out. With fewer vectors than clusters every vector
starts one. An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, scratch_root

#: Vectors in a pack, and in a bucket of packs.
PACK_ROWS, BUCKET_ROWS = 4096, 1 << 18
LIMIT = 2.0**27
_ROUNDING = 1e-12
STATE = "pack bigint, sizes array<int>, members binary, entries binary, changes array<bigint>"
_STATE = pa.schema([("pack", pa.int64()), ("sizes", pa.list_(pa.int32())), ("members", pa.binary()), ("entries", pa.binary()),
                    ("changes", pa.list_(pa.int64()))])


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and the integer components floor(scale * x) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= LIMIT))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("embedding")).filter(
        (F.size("embedding") == dim) & F.coalesce(fits, F.lit(False))).select(
        "vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("int")).alias("vector"))


def start_centroids(points: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The vectors with the ``k`` smallest sha256 of prefix and id, in that order (k rows on the driver)."""
    digest = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = points.select(digest.alias("digest"), "vector").orderBy(F.asc_nulls_last("digest"), "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    part, no = TaskContext.get().partitionId(), 0
    ids, held, count = [], [], 0

    def flush():
        return pa.record_batch([pa.array([part << 32 | no], pa.int64()), pa.array([[i for x in ids for i in x]], pa.list_(pa.int64())),
                                pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["pack", "ids", "vectors"])
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = min(rows - count, batch.num_rows - at)
            piece = batch.slice(at, step)
            ids.append(piece.column("vec_id").to_pylist())
            held.append(np.asarray(piece.column("vector").flatten(), dtype=np.int32))
            count += step
            at += step
            if count == rows:
                yield flush()
                ids, held, count, no = [], [], 0, no + 1
    if count:
        yield flush()


class Packs:
    """The vectors in packs, as a table bucketed by pack in the shared folder."""

    def __init__(self, points: DataFrame, rows: int, pack_rows: int):
        self.spark: SparkSession = points.sparkSession
        buckets = max(1, -(-rows // BUCKET_ROWS), min(self.spark.sparkContext.defaultParallelism, -(-rows // pack_rows)))
        self.name = f"packs_{uuid.uuid4().hex}"
        self.path = f"{scratch_root(self.spark).rstrip('/')}/promptmill/{self.name}"
        packs = points.mapInArrow(lambda batches: _packed(batches, pack_rows), "pack bigint, ids array<bigint>, vectors binary")
        (packs.repartition(buckets, "pack").write.bucketBy(buckets, "pack").option("path", self.path)
         .option("parquet.block.size", 16 << 20).saveAsTable(self.name))
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, in doubles where these hold every intermediate value."""
    reach = int(max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * reach * reach < 2**52 else np.int64
    x, c = points.astype(kind), centroids.astype(kind)
    if kind is np.int64:
        return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)


@dataclass
class Round:
    """What a round needs: centroids and the drift that each cluster has gathered."""
    centroids: np.ndarray
    drift: np.ndarray

    def entries(self, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cluster (the first of equal ones) and heap entry of vectors with these squared distances."""
        own = squared.argmin(axis=1)
        every = np.sqrt(squared.astype(np.float64))
        upper = every[np.arange(len(own)), own]
        every[np.arange(len(own)), own] = np.inf
        lower = every.min(axis=1)
        drift = self.drift[own]
        entry = lower - upper + drift - _ROUNDING * (np.where(np.isinf(lower), 0, lower) + upper + drift)
        return own, entry


def _state(pack: int, heaps: list[list[tuple[float, int]]], changes: np.ndarray | None) -> list:
    flat = [e for h in heaps for e in h]
    return [pack, [len(h) for h in heaps], np.array([i for _, i in flat], dtype=np.int32).tobytes(),
            np.array([g for g, _ in flat], dtype=np.float64).tobytes(), None if changes is None else changes.ravel().tolist()]


def _gained(now: Round, cluster: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rows of the count and the summed components that these vectors bring to each cluster."""
    k, dim = now.centroids.shape
    out = np.zeros((k, dim + 1), np.int64)
    np.add.at(out[:, 0], cluster, 1)
    np.add.at(out[:, 1:], cluster, points)
    return out


def first_round(pack: int, points: np.ndarray, now: Round) -> list:
    own, entry = now.entries(squared_distances(points, now.centroids))
    heaps: list[list[tuple[float, int]]] = [[] for _ in now.centroids]
    for i, (cluster, gap) in enumerate(zip(own.tolist(), entry.tolist())):
        heaps[cluster].append((gap, i))
    for h in heaps:
        heapq.heapify(h)
    return _state(pack, heaps, _gained(now, own, points))


def next_round(pack: int, points: np.ndarray, sizes: list[int], members: np.ndarray, gaps: np.ndarray, now: Round) -> list:
    """Pop the entries that the drift has reached, compare their vectors with all centroids, and push them again."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    heaps = [list(zip(gaps[a:b].tolist(), members[a:b].tolist())) for a, b in zip(bounds, bounds[1:])]
    popped, was = [], []
    for cluster, heap in enumerate(heaps):
        drift = now.drift[cluster]
        while heap and heap[0][0] <= drift:
            popped.append(heapq.heappop(heap)[1])
            was.append(cluster)
    if not popped:
        return _state(pack, heaps, None)
    old, chosen = np.array(was), points[np.array(popped)]
    own, entry = now.entries(squared_distances(chosen, now.centroids))
    for i, cluster, gap in zip(popped, own.tolist(), entry.tolist()):
        heapq.heappush(heaps[cluster], (gap, i))
    changed = own != old
    if not changed.any():
        return _state(pack, heaps, None)
    return _state(pack, heaps, _gained(now, own[changed], chosen[changed]) - _gained(now, old[changed], chosen[changed]))


def _vectors(column, row: int, dim: int) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), dtype=np.int32).reshape(-1, dim).astype(np.int64)


def _round(packs: DataFrame, state: DataFrame | None, now: Round) -> DataFrame:
    dim, first = now.centroids.shape[1], state is None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pack, points = batch.column("pack")[row].as_py(), _vectors(batch.column("vectors"), row, dim)
                if first:
                    out = first_round(pack, points, now)
                else:
                    out = next_round(pack, points, batch.column("sizes")[row].as_py(),
                                     np.frombuffer(batch.column("members")[row].as_buffer(), dtype=np.int32),
                                     np.frombuffer(batch.column("entries")[row].as_buffer(), dtype=np.float64), now)
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip(out, _STATE)], schema=_STATE)
    if state is None:
        return packs.select("pack", "vectors").mapInArrow(work, STATE)
    return packs.select("pack", "vectors").join(state.select("pack", "sizes", "members", "entries"), "pack").mapInArrow(work, STATE)


def _changes(state: DataFrame, k: int, dim: int) -> list[list[int]]:
    """Rows of the count and the sums that each cluster gained in a round, over all packs."""
    out = [[0] * (dim + 1) for _ in range(k)]
    for r in (state.filter("changes IS NOT NULL").select(F.posexplode("changes").alias("at", "value")).groupBy("at")
              .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()):
        out[r["at"] // (dim + 1)][r["at"] % (dim + 1)] = int(r["value"])
    return out


def _assigned(packs: DataFrame, state: DataFrame, centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                points = _vectors(batch.column("vectors"), row, dim)
                members = np.frombuffer(batch.column("members")[row].as_buffer(), dtype=np.int32)
                own = np.empty(len(points), dtype=np.int32)
                own[members] = np.repeat(np.arange(len(centroids), dtype=np.int32), batch.column("sizes")[row].as_py())
                distance = squared_distances(points, centroids)[np.arange(len(own)), own]
                yield pa.record_batch([batch.column("ids")[row].values, pa.array(own), pa.array(distance)],
                                      names=["vec_id", "cluster", "distance"])
    joined = packs.join(state.select("pack", "sizes", "members"), "pack")
    return joined.mapInArrow(work, "vec_id bigint, cluster int, distance bigint")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, prefix: str = "3:",
                    pack_rows: int = PACK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster and squared distance of each vector; the final centroids). ``rounds`` times every vector goes to its
    nearest centroid and each non-empty centroid to the floor of its vectors' mean; then the vectors are assigned once
    more. Rounds end early where no centroid moves, as nothing would change."""
    points = integer_vectors(vectors, dim, scale)
    centroids = start_centroids(points, k, prefix)
    if not len(centroids):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), centroids
    k = len(centroids)
    packs = Packs(points, vectors.count(), pack_rows)
    now, state = Round(centroids, np.zeros(k)), None
    held = [[0] * (dim + 1) for _ in range(k)]
    for step in range(rounds + 1):
        after = _write(_round(packs.table, state, now))
        if state is not None:
            discard(state)
        state = after
        if step == rounds:
            break
        held = [[a + b for a, b in zip(*rows)] for rows in zip(held, _changes(state, k, dim))]
        new = np.array([[s // n for s in sums] if n else now.centroids[j].tolist() for j, (n, *sums) in enumerate(held)], dtype=np.int64)
        moves = np.sqrt(((new - now.centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + _ROUNDING)
        if not moves.any():
            break
        others = np.array([np.delete(moves, j).max(initial=0) for j in range(k)])
        now = Round(new, now.drift + moves + others)
    result = materialize(_assigned(packs.table, state, now.centroids))
    packs.drop()
    discard(state)
    return result, now.centroids


def _write(state: DataFrame) -> DataFrame:
    return materialize(state, **{"parquet.block.size": 16 << 20})


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the summed distances of each cluster and of all (null beyond 64 bits), and a digest of each centroid. The driver sees one
    sum per cluster, a number fixed by a parameter, and so has the joined table."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    of_cluster = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}

    def long(n: int) -> int | None:
        return n if n < 2**63 else None
    rows = [(j, long(n), long(sum(of_cluster.values())),
             hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in of_cluster.items()]
    clusters = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
