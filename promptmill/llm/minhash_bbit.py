"""Near-duplicate components by b-bit MinHash.

Each document becomes a set of word shingles and, from its minima under many hash functions, band keys and a packed signature of
the lowest bits of each minimum. Documents with equal sets are one node (named after their smallest id), so copies cost nothing
further. Nodes that share a band key, directly or through others, form a family; families are found from one edge per member and
key, never from pairs. Inside a family, signatures are compared by bit counts, corrected for bits that agree by chance, and
what may reach the threshold is confirmed on the full sets:

1. every member against the family's first node;
2. the members that this did not link to it, against the whole family.

Members linked in step 1 are in one component already and need no comparison among themselves. Both steps run in blocks: a
family of any size is dealt out over tasks, each of which holds two blocks of bounded size. A task joins what is linked as it
goes and returns one link per joining, so its result has at most as many rows as it holds nodes, not pairs.

With 48 bands of 5 rows a pair of similarity 0.8 misses all bands with probability 5e-9. The signature filter stands 5 standard
deviations under the threshold.

Cases: a text without words is empty, has 0 shingles and is linked with nothing; with fewer words than a shingle, the whole
sequence is one shingle. A null text is empty. Rows without id get no component and are not kept. Rows that share an id are
one document to the links; identical rows give a row each. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components
from .sequences import buffer_of, lower_ascii, mix, prefix_hashes, run_hashes, slices, window_hashes, word_hashes, words_of

BANDS, ROWS, BITS = 48, 5, 4
HASHES = BANDS * ROWS
#: Bytes of sets in a block of a family.
SET_BYTES = 2 << 20
_FACTORS = np.random.default_rng(4).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = np.uint64(0x1111111111111111)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as ordered hashes."""
    data, offsets = buffer_of(texts)
    data = lower_ascii(data)
    starts, ends, first = words_of(data, offsets)
    prefix = prefix_hashes(word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64))
    grams = mix(window_hashes(prefix, size) + np.uint64(size))
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            out.append(mix(run_hashes(prefix, np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[at:at + 4096, None] * _FACTORS).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key ^ rows[:, k])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of each minimum, sixteen minima to a word."""
    bits = mix(low) & np.uint64(2**BITS - 1)
    lanes = bits.reshape(-1, 64 // BITS) << np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(lanes, axis=1)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to many, corrected for minima whose low bits agree by chance."""
    x = many ^ one
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    share = 1 - np.bitwise_count(x & _LANE).sum(axis=1) / HASHES
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def margin(percent: int) -> float:
    """Five standard deviations of the estimate at the threshold."""
    j, chance = percent / 100, 2.0**-BITS
    p = j + (1 - j) * chance
    return 5 * math.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and packed signature of each row (null for empty sets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), size)
                low = [minima(s) if len(s) else None for s in sets]
                yield pa.record_batch([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if m is None else band_keys(m) for m in low], pa.list_(pa.int64())),
                    pa.array([None if m is None else packed(m).tobytes() for m in low], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "bands", "signature"])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, signature binary")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, shingles (packed hashes), their size in bytes and signature of the documents named by ``nodes``. The named
    documents grow with the corpus, so the join shuffles at every size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), size)
                yield pa.record_batch([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()),
                                       pa.array([s.nbytes for s in sets], pa.int64()),
                                       pa.array([packed(minima(s)).tobytes() for s in sets], pa.binary())],
                                      names=["node", "shingles", "size", "signature"])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    wanted = rows.join(nodes.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    found = wanted.mapInArrow(run, "node bigint, shingles binary, size bigint, signature binary")
    return found.filter("size > 0")


def _links_of_blocks(percent: int):
    """Links that join the left and the right nodes of a block pair into components. Right nodes that are known to belong
    together are one component from the start."""
    least = percent / 100 - margin(percent)

    def run(table: pa.Table) -> pa.Table:
        side, known = np.asarray(table["side"]), np.asarray(table["known"])
        node = np.asarray(table["node"])
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].to_pylist()]
        signs = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint64).reshape(len(sets), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = []
        if len(left) and len(right):
            size = np.array([len(sets[i]) for i in right])
            every = np.concatenate([sets[i] for i in right])
            value, place = np.unique(every, return_inverse=True)
            starts = np.cumsum(size) - size
            label = np.where(known[right], -1, np.arange(len(right)))
            for i in left:
                near = np.flatnonzero(estimate(signs[i], signs[right]) >= least)
                near = near[node[right[near]] != node[i]]
                if len(near) == 0:
                    continue
                mark = np.zeros(len(value) + 1, dtype=np.int64)
                at = np.searchsorted(value, sets[i])
                at = at[(at < len(value)) & (value[np.minimum(at, len(value) - 1)] == sets[i])]
                mark[at] = 1
                common = np.add.reduceat(mark[place], starts)[near]
                union = size[near] + len(sets[i]) - common
                near = near[100 * common >= percent * union]
                # one link to each component that it touches; these are one component from now on
                touched, first = np.unique(label[near], return_index=True)
                links += [(node[i], node[right[k]]) for k in near[first]]
                if len(touched) > 1:
                    label[np.isin(label, touched)] = touched[0]
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])
    return run


def block_links(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join ``left`` nodes (columns family, node) to ``right`` nodes of the same family (also ``known``: whether they
    are in the component of the family's first node). Each side of a family is dealt into blocks of about ``SET_BYTES``; a task
    holds one block of each. Blocks are planned on narrow rows; a set is shuffled once to its place."""
    sizes = sets.select("node", "size")

    def planned(side: DataFrame, count: str) -> tuple[DataFrame, DataFrame]:
        full = side.join(sizes, "node")
        return full, full.groupBy("family").agg(F.ceil((F.sum("size") + 1) / SET_BYTES).cast("int").alias(count))
    (l_side, l_count), (r_side, r_count) = planned(left.withColumn("known", F.lit(False)), "l_blocks"), planned(right, "r_blocks")
    counts = materialize(l_count.join(r_count, "family"))

    def dealt(side: DataFrame, number: int, own: str, other: str) -> DataFrame:
        return side.join(counts, "family").select(
            "family", F.lit(number).alias("side"), "known", "node", F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
    placed = dealt(l_side, 0, "l_blocks", "r_blocks").unionByName(dealt(r_side, 1, "r_blocks", "l_blocks"))
    return (placed.join(sets.drop("size"), "node").groupBy("family", "l_blocks", "r_blocks")
            .applyInArrow(_links_of_blocks(percent), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links of at least ``percent`` per cent) and kept."""
    sketch = materialize(sketches(docs, size))
    nodes = (sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest")
             .agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")))
    keyed = materialize(nodes.select("node", F.explode("bands").alias("key")))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    edges = materialize(keyed.join(shared.select("key", "first"), "key").filter("node <> first").select("node", "first").distinct())
    # A node under many keys is tied to the least of their first nodes, and these to each other: the same components from about
    # one edge per node.
    nearest = materialize(edges.groupBy("node").agg(F.min("first").alias("b")))
    ties = edges.join(nearest, "node").filter("first <> b").select(F.col("first").alias("a"), "b").distinct()
    families = components(nearest.select(F.col("node").alias("a"), "b").union(ties)).select("node", F.col("label").alias("family"))
    sets = materialize(full_sets(docs, families, size))
    heads = families.filter("node = family")
    first = materialize(block_links(heads, families.withColumn("known", F.lit(False)), sets, percent))
    linked = first.select(F.col("b").alias("node")).distinct().withColumn("linked", F.lit(True))
    judged = materialize(families.join(linked, "node", "left").withColumn(
        "known", F.coalesce("linked", F.col("node") == F.col("family"))).drop("linked"))
    second = block_links(judged.filter("NOT known").drop("known"), judged, sets, percent)
    labels = components(first.union(second))
    named = materialize(nodes.select("digest", "node").join(labels, "node", "left").select(
        "digest", F.coalesce("label", "node").alias("component")))
    found = sketch.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
