"""Removal of long byte strings that an earlier document holds, by a sharded suffix sort.

A byte of a document goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id. Steps:

1. Every string of that length chooses an anchor, its least short gram in a pseudo-random order, so equal strings choose equal
   anchors. Blocks of documents tell the buckets which anchors they hold, each once, and learn which ones another
   document holds (``blocks``). A string whose anchor no other document holds occurs nowhere else.
2. For the shared anchors, blocks send the text around them, each different piece once with the smallest id that has it.
3. A bucket holds all pieces with its anchors and sorts the suffixes that start there, a portion of its anchors at a time: eight bytes
   after the other, where prefix polynomial hashes do not say that all suffixes that are still together are equal; a sort runs on all
   groups side by side. Suffixes start in the order of their anchor and distance to it. Neighbours that agree over the whole
   length by their hashes are compared byte by byte before they count as equal.
4. The smallest id of each string goes back to the blocks, which take the strings out.

Cases: a null text is empty; texts shorter than ``length`` lose nothing; rows that share an id never remove from each other (no
smaller id), and identical rows give a row each; a null id counts as larger than every other; an empty table gives no rows; other
columns are ignored. Bytes that are left may not be valid UTF-8, so they are returned as binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from .sequences import (buffer_of, byte_values, first_of_groups, mix, prefix_hashes, ragged, run_hashes, valid_runs,
                        window_anchors, window_hashes)

LENGTH = 50
#: Bytes in a gram; a string of ``LENGTH`` bytes has LENGTH - GRAM + 1 of them.
GRAM = 24
SHARED, PIECES, LEAST = 0, 1, 2
#: Bytes of pieces that a bucket sorts at once; blocks that make as many buckets, and the most blocks that share one.
PORTION_BYTES, MANY, WIDE = 2 << 20, 64, 8


class SuffixSort:
    """Suffixes of one byte array, compared over at most ``depth`` bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, depth: int, prefix: np.ndarray | None = None):
        self.data, self.starts, self.depth = data, starts, depth
        self.prefix = prefix_hashes(byte_values(data)) if prefix is None else prefix

    def order(self, begin: np.ndarray) -> np.ndarray:
        """Indices of the suffixes sorted inside each group; groups lie side by side and ``begin`` says where. All groups are sorted at
        once, by eight bytes after the other; what these leave together is sorted by the next eight, but for suffixes whose whole
        depth is equal by its hash, which keep their places."""
        n = len(self.starts)
        order = np.arange(n)
        size = np.diff(np.append(begin, n))
        whole = run_hashes(self.prefix, self.starts, self.starts + self.depth)
        slot, rank = order, np.repeat(np.arange(len(size)), size)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, dtype=">u8", buffer=padded, strides=(1,))
        for at in range(0, self.depth, 8):
            first = first_of_groups(rank)
            hash_of = whole[order[slot]]
            apart = np.zeros(len(slot), dtype=bool)
            apart[1:] = (hash_of[1:] != hash_of[:-1]) & (rank[1:] == rank[:-1])
            mixed = np.logical_or.reduceat(apart, first) if len(first) else apart
            left = np.repeat(mixed, np.diff(np.append(first, len(slot))))
            slot, rank = slot[left], rank[left]
            if not len(slot):
                break
            key = eight[self.starts[order[slot]] + at].astype(np.uint64) >> np.uint64(8 * max(0, at + 8 - self.depth))
            moved = np.lexsort((key, rank))
            order[slot], key = order[slot[moved]], key[moved]
            new = np.ones(len(slot), dtype=bool)
            new[1:] = (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])
            rank = np.cumsum(new)
        return order

    def classes(self, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where a new class of equal suffixes begins in the order. Equal hashes are confirmed byte by byte."""
        a, b = self.starts[order[:-1]], self.starts[order[1:]]
        equal = run_hashes(self.prefix, a, a + self.depth) == run_hashes(self.prefix, b, b + self.depth)
        equal[begin[1:] - 1] = False
        span = np.arange(self.depth)
        near = np.flatnonzero(equal)
        for at in range(0, len(near), 1 << 16):
            part = near[at:at + (1 << 16)]
            equal[part] = (self.data[a[part][:, None] + span] == self.data[b[part][:, None] + span]).all(axis=1)
        return np.concatenate(([0], np.flatnonzero(~equal) + 1))


def equal_pieces(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, strings: np.ndarray, distance: np.ndarray, length: int) -> np.ndarray:
    """For each piece (its place, number of strings, and distance from its start to its anchor) one that is equal, the same for all equal
    ones. Equal hashes are confirmed byte by byte; what differs stands for itself."""
    size = strings + length - 1
    content = mix(run_hashes(prefix, at, at + size) + strings.astype(np.uint64) * np.uint64(1 << 20) + distance.astype(np.uint64))
    order = np.argsort(content, kind="stable")
    head = np.zeros(len(order), dtype=bool)
    head[first_of_groups(content[order])] = True
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
    same = np.ones(len(order), dtype=bool)
    check = np.flatnonzero(~head)
    for begin in range(0, len(check), 1 << 12):
        part = check[begin:begin + (1 << 12)]
        a, b = order[part], leader[part]
        alike = (size[a] == size[b]) & (distance[a] == distance[b])
        a, b = a[alike], b[alike]
        n = size[a]
        if len(a):
            equal = data[ragged(at[a], n)] == data[ragged(at[b], n)]
            alike[alike] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        same[part] = alike
    leader[~same] = order[~same]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = leader
    return out


def least_of_equal(unique: np.ndarray, ids: np.ndarray) -> np.ndarray:
    least = np.full(len(unique), np.iinfo(np.int64).max)
    np.minimum.at(least, unique, ids)
    return least


class Strings:
    """The strings of ``length`` bytes in a block and their anchors."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.ids = bl.doc_ids(table)
        self.data, self.offsets = buffer_of(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))
        self.length = length
        self.prefix = prefix_hashes(byte_values(self.data))
        grams = window_hashes(self.prefix, gram)
        self.anchor = window_anchors(grams, length - gram + 1)
        self.valid = valid_runs(self.offsets, length, len(self.data))
        chosen = np.zeros(len(self.data), dtype=bool)
        chosen[self.anchor[self.valid]] = True
        self.places = np.flatnonzero(chosen)
        self.hash = mix(grams[self.places])
        self.doc = np.searchsorted(self.offsets, self.places, side="right") - 1

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        return self.hash % np.uint64(buckets), (self.hash >> np.uint64(33)).astype(np.uint32)

    def pieces(self, shared: list[tuple], buckets: int) -> None:
        """Finds the pieces of text around shared anchors: ``at`` and ``strings`` (start and number of strings) and ``point``
        (anchor) of each, and ``unique``, the piece that stands for it."""
        known = [np.frombuffer(r[2], np.uint32).astype(np.uint64) | np.uint64(r[0] << 31) for r in shared if r[1] == SHARED]
        known = np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64)
        bucket, key = self.keys(buckets)
        own = (bucket << np.uint64(31)) | key.astype(np.uint64)
        found = np.searchsorted(known, own)
        hit = found < len(known)
        hit[hit] = known[found[hit]] == own[hit]
        marked = np.zeros(len(self.data) + 1, dtype=bool)
        marked[self.places[hit]] = True
        string = np.flatnonzero(self.valid & marked[self.anchor])
        anchor = self.anchor[string]
        new = np.ones(len(string), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1] + 1)
        first = np.flatnonzero(new)
        self.at, self.strings = string[first], np.diff(np.append(first, len(string)))
        self.point = anchor[first]
        self.piece_doc = np.searchsorted(self.offsets, self.at, side="right") - 1
        self.unique = equal_pieces(self.data, self.prefix, self.at, self.strings, self.point - self.at, self.length)
        self.leaders = np.flatnonzero(self.unique == np.arange(len(self.unique)))
        self.least = least_of_equal(self.unique, self.ids[self.piece_doc])
        self.piece_hash = self.hash[np.searchsorted(self.places, self.point)]


def _anchors(length: int, gram: int, buckets: int):
    def run(block: int, table: pa.Table) -> pa.Table:
        s = Strings(table, length, gram)
        if not len(s.hash):  # no text of the block is long enough
            return bl.rows_table([])
        order = np.argsort(s.hash, kind="stable")
        first = first_of_groups(s.hash[order])
        last = np.append(first[1:], len(order)) - 1
        twice = s.ids[s.doc[order[first]]] != s.ids[s.doc[order[last]]]
        # documents of a block are in the order of their ids, so the first and last tell whether ids differ
        bucket, key = s.keys(buckets)
        keys = (key[order[first]] << np.uint32(1)) | twice
        home = bucket[order[first]]
        return bl.rows_table([bl.pack(block, k, SHARED, np.sort(keys[i])) for k, i in bl.deal(home, buckets)])
    return run


def _shared(bucket: int, rows: list[tuple]) -> list[tuple]:
    return [bl.pack(r[0], bucket, SHARED, keys) for r, keys in zip(rows, bl.shared_keys(rows)) if len(keys)]


def _pieces(length: int, gram: int, buckets: int):
    def run(block: int, table: pa.Table, answers: list[tuple]) -> pa.Table:
        s = Strings(table, length, gram)
        s.pieces(answers, buckets)
        rows = []
        for k, i in bl.deal(s.piece_hash[s.leaders], buckets):
            p = s.leaders[i]
            size = s.strings[p] + length - 1
            shape = np.stack([s.point[p] - s.at[p], s.strings[p]], axis=1).astype(np.uint16)
            rows.append(bl.pack(block, k, PIECES, s.piece_hash[p], shape, s.least[p], s.data[ragged(s.at[p], size)]))
        return bl.rows_table(rows)
    return run


def _least(length: int, buckets: int):
    def smallest(anchor: np.ndarray, shape: np.ndarray, ids: np.ndarray, data: np.ndarray) -> np.ndarray:
        # equal pieces of several blocks are sorted once, under the least id of all
        every = shape[:, 1]
        size = every + length - 1
        prefix = prefix_hashes(byte_values(data))
        unique = equal_pieces(data, prefix, np.cumsum(size) - size, every, shape[:, 0], length)
        leaders = np.flatnonzero(unique == np.arange(len(unique)))
        ids = least_of_equal(unique, ids)[leaders]
        strings = every[leaders]
        starts = ragged((np.cumsum(size) - size)[leaders], strings)
        distance = ragged(np.zeros(len(strings), np.int64), strings)
        distance = np.repeat(shape[leaders, 0], strings) - distance
        group = np.repeat(anchor[leaders], strings) + distance.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        arranged = np.argsort(group, kind="stable")
        begin = first_of_groups(group[arranged])
        sorter = SuffixSort(data, starts[arranged], length, prefix)
        order = sorter.order(begin)
        klass = sorter.classes(order, begin)
        least = np.minimum.reduceat(np.repeat(ids, strings)[arranged[order]], klass)
        found = np.empty(len(starts), dtype=np.int64)
        found[arranged[order]] = np.repeat(least, np.diff(np.append(klass, len(starts))))
        where = np.zeros(len(unique), dtype=np.int64)
        where[leaders] = np.cumsum(strings) - strings
        return found[ragged(where[unique], every)]

    def run(bucket: int, rows: list[tuple]) -> list[tuple]:
        """The smallest id of each string of each piece. A bucket is worked on in portions of its anchors."""
        anchor = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        shape = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows]).reshape(-1, 2).astype(np.int64)
        ids = np.concatenate([np.frombuffer(r[4], np.int64) for r in rows])
        data = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows])
        size = shape[:, 1] + length - 1
        place, first = np.cumsum(size) - size, np.cumsum(shape[:, 1]) - shape[:, 1]
        out = np.empty(int(shape[:, 1].sum()), dtype=np.int64)
        for _, i in bl.deal(anchor // np.uint64(buckets), max(1, -(-len(data) // PORTION_BYTES))):
            out[ragged(first[i], shape[i, 1])] = smallest(anchor[i], shape[i], ids[i], data[ragged(place[i], size[i])])
        answers, at = [], 0
        for r in rows:
            n = int(np.frombuffer(r[3], np.uint16)[1::2].sum())
            # neighbouring strings often have one smallest id: runs of equal ones
            begin = first_of_groups(out[at:at + n])
            answers.append(bl.pack(r[0], bucket, LEAST, out[at + begin], np.diff(np.append(begin, n)).astype(np.uint32)))
            at += n
        return answers
    return run


def _remove(length: int, gram: int, buckets: int):
    def run(block: int, table: pa.Table, answers: list[tuple]) -> pa.Table:
        s = Strings(table, length, gram)
        s.pieces(answers, buckets)
        least = {r[0]: np.repeat(np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.uint32)) for r in answers if r[1] == LEAST}
        # where the answers of each leader's strings lie
        where = np.zeros(len(s.at), dtype=np.int64)
        parts, at = [], 0
        for k, i in bl.deal(s.piece_hash[s.leaders], buckets):
            p = s.leaders[i]
            where[p] = at + np.cumsum(s.strings[p]) - s.strings[p]
            parts.append(least[k])
            at += len(least[k])
        smallest = np.concatenate(parts) if parts else np.empty(0, np.int64)
        string = ragged(s.at, s.strings)
        smallest = smallest[ragged(where[s.unique], s.strings)]
        gone = string[smallest < np.repeat(s.ids[s.piece_doc], s.strings)]
        mark = np.bincount(gone, minlength=len(s.data) + 1) - np.bincount(gone + length, minlength=len(s.data) + 1)
        removed = np.cumsum(mark[:-1]) > 0
        edge = np.diff(np.concatenate(([False], removed, [False])).astype(np.int8))
        if len(removed):  # a removed run ends with its document
            inner = s.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(removed))]
            inner = np.unique(inner)
            split = inner[removed[inner] & removed[inner - 1]]
        else:
            split = np.empty(0, np.int64)
        begins = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
        ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), split]))
        owner = np.searchsorted(s.offsets, begins, side="right") - 1
        base = s.offsets[owner]
        spans = pa.StructArray.from_arrays([pa.array(begins - base, pa.int64()), pa.array(ends - base, pa.int64())], ["begin", "end"])
        span_offsets = np.searchsorted(owner, np.arange(len(s.ids) + 1)).astype(np.int32)
        kept = np.concatenate(([0], np.cumsum(~removed)))[s.offsets]
        left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s.ids), [
            None, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(s.data[~removed].tobytes())])
        return pa.table([table["doc_id"].combine_chunks() if table.num_rows else table["doc_id"],
                         pa.array(np.diff(s.offsets), pa.int64()),
                         pa.ListArray.from_arrays(pa.array(span_offsets), spans), left.cast(pa.binary())],
                        names=["doc_id", "n_bytes", "spans", "kept"])
    return run


def remove_earlier_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (array of begin and end of each removed run of bytes) and kept (the remaining bytes)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocked, count = bl.blocked(rows, block_bytes)
    # blocks times buckets make the packed rows: from MANY blocks on a bucket has the anchors of up to WIDE blocks
    buckets = bl.buckets_for(count, min(WIDE, max(1, count // MANY)))
    shared = bl.per_bucket(bl.per_block(blocked, _anchors(length, gram, buckets)), _shared)
    pieces = bl.back_to_blocks(blocked, shared, _pieces(length, gram, buckets))
    least = bl.per_bucket(pieces, _least(length, buckets))
    return bl.back_to_blocks(blocked, shared.unionByName(least), _remove(length, gram, buckets),
                             "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
