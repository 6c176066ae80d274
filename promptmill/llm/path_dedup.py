"""Removal of long word spans that occur more than once, by compaction of a De Bruijn graph.

The edges of the graph are windows of ``length`` words, its nodes the runs of length - 1 words between neighbouring windows. A
word goes if a window covers it whose words also start somewhere else, in the same document or another. Steps:

1. Every window chooses an anchor, its least short gram in a pseudo-random order. Blocks tell the buckets which anchors they
   hold and learn which ones occur again (``blocks``); a window whose anchor occurs once occurs once.
2. For the other windows, each block sends every different edge once with what stands before and after it. A bucket
   sees all of an edge: whether it is repeated, and whether its paths part before or after it (the end of a document
   counts as a way of its own).
3. The answers meet the documents in a join by block. Repeated edges that follow each other without a branch between them are
   compacted into a path. All occurrences of an edge are cut at the same places, so a path has the same edges
   wherever it stands.
4. A digest of all words of each path, read at its source coordinates, goes to the buckets, each different one of a block once,
   and the answers come back in a second join by block. Only what two coordinates agree on in full is taken out, so equal hashes of
   edges remove nothing by themselves.

Cases: a null or empty text has no words; texts shorter than a window lose nothing; identical rows are removed from each other
as any repeated text; a null id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import blocks as bl
from .sequences import (buffer_of, copy_runs, fill_runs, first_of_groups, mix, prefix_hashes, valid_runs,
                        window_anchors, window_hashes, word_hashes, words_of)

LENGTH = 35
#: Words in a gram; a window has LENGTH - GRAM + 1 of them.
GRAM = 12
SHARED, EDGES, PATHS = 0, 1, 2
BEGIN, END, MANY = np.uint64(0), np.uint64(1), np.uint64(2)
REPEATED, PARTS_BEFORE, PARTS_AFTER = 1, 2, 4


class Windows:
    """The windows of a block's documents, their edges and anchors."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.table, self.length = table, length
        self.data, self.offsets = buffer_of(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))
        self.starts, self.ends, self.first = words_of(self.data, self.offsets)
        words = word_hashes(self.data, self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)
        prefix = prefix_hashes(words)
        grams = window_hashes(prefix, gram)
        self.anchor = window_anchors(grams, length - gram + 1)
        self.valid = valid_runs(self.first, length, len(words))
        self.places, self.times = np.unique(self.anchor[self.valid], return_counts=True)
        self.hash = mix(grams[self.places])
        del grams, words
        # 0, 1 and 2 are marks
        self.edge = np.maximum(mix(window_hashes(prefix, length)), np.uint64(3))

    def candidates(self, answers: list[tuple], buckets: int) -> np.ndarray:
        """Windows whose anchor occurs more than once."""
        known = [np.frombuffer(r[2], np.uint32).astype(np.uint64) | np.uint64(r[0] << 31) for r in answers if r[1] == SHARED]
        known = np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64)
        own = ((self.hash % np.uint64(buckets)) << np.uint64(31)) | (self.hash >> np.uint64(33))
        at = np.searchsorted(known, own)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == own[hit]
        marked = np.zeros(len(self.starts) + 1, dtype=bool)
        marked[self.places[hit]] = True
        return np.flatnonzero(self.valid & marked[self.anchor])

    def edges(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different edges of the windows in order, the index among them of each window, and the order of the windows."""
        edge = self.edge[window]
        order = np.argsort(edge, kind="stable")
        first = first_of_groups(edge[order])
        index = np.empty(len(window), dtype=np.int64)
        index[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        return edge[order[first]], index, order

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kept words of each document joined by one blank: bytes, offset of each document, and of each kept word."""
        starts, size = self.starts[keep], (self.ends - self.starts)[keep]
        first = np.concatenate(([0], np.cumsum(keep)))[self.first]
        # a blank before each word that is not its document's first
        blank = np.ones(len(starts), dtype=np.int64)
        blank[first[:-1][np.diff(first) > 0]] = 0
        to = np.cumsum(size + blank) - size
        out = np.full(int((size + blank).sum()), 32, dtype=np.uint8)
        copy_runs(out, to, self.data, starts, size)
        stops = np.concatenate(([0], np.cumsum(size + blank)))
        return out, stops[first], to


def _anchors(length: int, gram: int, buckets: int):
    def run(block: int, table: pa.Table) -> pa.Table:
        w = Windows(table, length, gram)
        order = np.argsort(w.hash, kind="stable")
        first = first_of_groups(w.hash[order])
        twice = np.diff(np.append(first, len(order))) > 1
        hashes = w.hash[order[first]]
        keys = ((hashes >> np.uint64(33)).astype(np.uint32) << np.uint32(1)) | twice
        return bl.rows_table([bl.pack(block, k, SHARED, np.sort(keys[i])) for k, i in bl.deal(hashes % np.uint64(buckets), buckets)])
    return run


def _shared(bucket: int, rows: list[tuple]) -> list[tuple]:
    return [bl.pack(r[0], bucket, SHARED, keys) for r, keys in zip(rows, bl.shared_keys(rows)) if len(keys)]


def _one_or_many(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value that a whole group has, or MANY."""
    low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return np.where(low == high, low, MANY)


def _edges(length: int, gram: int, buckets: int):
    def run(block: int, table: pa.Table, answers: list[tuple]) -> pa.Table:
        w = Windows(table, length, gram)
        window = w.candidates(answers, buckets)
        if len(window) == 0:
            return bl.rows_table([])
        doc = np.searchsorted(w.first, window, side="right") - 1
        before = np.where(window > w.first[doc], w.edge[np.maximum(window - 1, 0)], BEGIN)
        last = w.first[doc + 1] - length
        after = np.where(window < last, w.edge[np.minimum(window + 1, len(w.edge) - 1)], END)
        edges, _, order = w.edges(window)
        first = first_of_groups(w.edge[window][order])
        before, after = _one_or_many(before[order], first), _one_or_many(after[order], first)
        twice = (np.diff(np.append(first, len(order))) > 1).astype(np.uint8)
        return bl.rows_table([bl.pack(block, k, EDGES, edges[i], before[i], after[i], twice[i])
                              for k, i in bl.deal(edges, buckets)])
    return run


def _branches(bucket: int, rows: list[tuple]) -> list[tuple]:
    edge, before, after = (np.concatenate([np.frombuffer(r[k], np.uint64) for r in rows]) for k in (2, 3, 4))
    twice = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows])
    order = np.argsort(edge, kind="stable")
    first = first_of_groups(edge[order])
    count = np.diff(np.append(first, len(order)))
    repeated = (count > 1) | (np.maximum.reduceat(twice[order], first) > 0)
    answer = (REPEATED * repeated + PARTS_BEFORE * (_one_or_many(before[order], first) == MANY)
              + PARTS_AFTER * (_one_or_many(after[order], first) == MANY)).astype(np.uint8)
    out = np.empty(len(edge), dtype=np.uint8)
    out[order] = np.repeat(answer, count)
    answers, at = [], 0
    for r in rows:
        n = len(r[5])
        answers.append(bl.pack(r[0], bucket, EDGES, out[at:at + n]))
        at += n
    return answers


class Paths:
    """The compacted paths of a block: first window and number of windows of each, its digest, and the different digests."""

    def __init__(self, w: Windows, answers: list[tuple], buckets: int):
        window = w.candidates(answers, buckets)
        edges, index, _ = w.edges(window)
        told = {r[0]: np.frombuffer(r[2], np.uint8) for r in answers if r[1] == EDGES}
        flag = np.zeros(len(edges), dtype=np.uint8)
        for k, i in bl.deal(edges, buckets):
            flag[i] = told[k]
        flags = flag[index]
        found = (flags & REPEATED) > 0
        window, flags = window[found], flags[found]
        doc = np.searchsorted(w.first, window, side="right") - 1
        new = np.ones(len(window), dtype=bool)
        new[1:] = ((window[1:] != window[:-1] + 1) | (doc[1:] != doc[:-1]) | ((flags[1:] & PARTS_BEFORE) > 0)
                   | ((flags[:-1] & PARTS_AFTER) > 0))
        begin = np.flatnonzero(new)
        self.count, self.at = np.diff(np.append(begin, len(window))), window[begin]
        # only the words of paths are joined: paths of one document may share words, so each run of them is joined once
        stop = self.at + self.count + w.length - 1
        used = np.zeros(len(w.starts) + 1, dtype=np.int32)
        np.add.at(used, self.at, 1)
        np.add.at(used, stop, -1)
        used = np.cumsum(used[:-1]) > 0
        text, _, to = w.joined(used)
        place = np.cumsum(used) - 1
        size, text = (w.ends - w.starts)[used], memoryview(text)
        digest = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest()
                          for a, b in zip(to[place[self.at]], (to + size)[place[stop - 1]])) if len(self.at) else b""
        digest = np.frombuffer(digest, dtype=np.uint64).reshape(-1, 2)
        order = np.lexsort((digest[:, 1], digest[:, 0]))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (digest[order][1:] != digest[order][:-1]).any(axis=1)
        first = np.flatnonzero(head)
        self.digest, self.times = digest[order[first]], np.diff(np.append(first, len(order)))
        self.index = np.empty(len(order), dtype=np.int64)
        self.index[order] = np.cumsum(head) - 1


def _paths(length: int, gram: int, buckets: int):
    def run(block: int, table: pa.Table, answers: list[tuple]) -> pa.Table:
        paths = Paths(Windows(table, length, gram), answers, buckets)
        twice = (paths.times > 1).astype(np.uint8)
        return bl.rows_table([bl.pack(block, k, PATHS, paths.digest[i], twice[i]) for k, i in bl.deal(paths.digest[:, 0], buckets)])
    return run


def _confirmed(bucket: int, rows: list[tuple]) -> list[tuple]:
    """Which digests occur more than once."""
    digest = np.concatenate([np.frombuffer(r[2], np.uint64).reshape(-1, 2) for r in rows])
    twice = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (digest[order][1:] != digest[order][:-1]).any(axis=1)
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(order)))
    out = np.empty(len(order), dtype=np.uint8)
    out[order] = np.repeat((count > 1) | (np.maximum.reduceat(twice[order], first) > 0), count)
    answers, at = [], 0
    for r in rows:
        n = len(r[3])
        answers.append(bl.pack(r[0], bucket, PATHS, out[at:at + n]))
        at += n
    return answers


def _cut(length: int, gram: int, buckets: int, forms: tuple[str, ...], carry: tuple[str, ...]):
    def run(block: int, table: pa.Table, answers: list[tuple]) -> pa.Table:
        w = Windows(table, length, gram)
        paths = Paths(w, answers, buckets)
        told = {r[0]: np.frombuffer(r[2], np.uint8) for r in answers if r[1] == PATHS}
        agreed = np.zeros(len(paths.digest), dtype=bool)
        for k, i in bl.deal(paths.digest[:, 0], buckets):
            agreed[i] = told[k] > 0
        gone_paths = agreed[paths.index]
        at, count = paths.at[gone_paths], paths.count[gone_paths]
        mark = np.zeros(len(w.starts) + 1, dtype=np.int32)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + count + length - 1, -1)
        gone = np.cumsum(mark[:-1]) > 0
        gone_before = np.concatenate(([0], np.cumsum(gone)))[w.first]
        texts = {"kept": lambda: _texts(*w.joined(~gone)[:2]), "rest": lambda: _texts(*_rest(w, gone))}
        return pa.table([table["doc_id"].combine_chunks(), pa.array(np.diff(w.first), pa.int64()),
                         pa.array(np.diff(gone_before), pa.int64()), *[texts[f]() for f in forms], *[table[c] for c in carry]],
                        names=["doc_id", "n_words", "n_removed", *forms, *carry])
    return run


def _rest(w: Windows, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as they stand, without the removed words and the white space after each."""
    edge = np.concatenate((w.starts, [len(w.data)])).astype(np.int64)
    upto = edge[1:].copy()
    owner = np.searchsorted(w.first, np.arange(len(w.starts)), side="right") - 1
    upto = np.minimum(upto, w.offsets[owner + 1]) if len(upto) else upto
    stay = np.ones(len(w.data), dtype=bool)
    fill_runs(stay, w.starts[gone], (upto - w.starts)[gone], False)
    return w.data[stay], np.concatenate(([0], np.cumsum(stay)))[w.offsets]


CUT = "doc_id bigint, n_words bigint, n_removed bigint"


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    array = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return array.cast(pa.string())


def remove_repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = bl.BLOCK_BYTES,
                          carry: tuple[str, ...] = (), forms: tuple[str, ...] = ("kept", "rest")) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, one blank between), rest (the text left, with its white space), and the
    columns named by ``carry`` as they are. ``forms``: which of kept and rest are made."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    blocked, count = bl.blocked(rows, block_bytes, carry)
    schema = StructType([*StructType.fromDDL(CUT + "".join(f", {f} string" for f in forms)).fields, *[rows.schema[c] for c in carry]])
    buckets = bl.buckets_for(count)
    shared = bl.per_bucket(bl.per_block(blocked, _anchors(length, gram, buckets)), _shared)
    edges = bl.back_to_blocks(blocked, shared, _edges(length, gram, buckets))
    branches = bl.per_bucket(edges, _branches)
    told = shared.unionByName(branches)
    confirmed = bl.per_bucket(bl.back_to_blocks(blocked, told, _paths(length, gram, buckets)), _confirmed)
    return bl.back_to_blocks(blocked, told.unionByName(confirmed), _cut(length, gram, buckets, forms, carry), schema)


def digests(cut: DataFrame) -> DataFrame:
    """The query's columns, from cuts with ``kept``."""
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
