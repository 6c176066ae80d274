"""Runs of words: maximal periodic stretches of a document, found with string synchronising sets.

A run has a smallest period q, is at least ``max(min_length, 3 * q)`` words long, and no neighbouring word extends it. Periods up
to ``DIRECT`` come from comparing the words with themselves that many places on. Longer ones are proposed at the scales
t = 4, 8, 16, ...; scale t answers for periods above 1.5 t and up to 3 t:

* A place is highly periodic if the t words from there have a period of at most t / 3. These places lie in runs of much smaller
  periods, which are known by then.
* Every other place has a hash of its t words. Place i belongs to the synchronising set if the least hash of the places i to i + t
  stands at i or at i + t. Membership depends on the 2 t words from i alone, so it repeats with the period inside a run.
* Any run of a period that the scale answers for holds a member whose 2 t words stand again one period later, within the run: the
  least hash is found within t places unless these are highly periodic, and then the place where the small period breaks lies
  within p + t / 3 words of the run's start, since two periods cannot go on together for longer than their sum.
* Equal contexts of members are more than t / 3 apart (nearer ones would be highly periodic), so a member meets at most nine
  equal ones within 3 t. All these pairs propose their distance.

A proposed period is extended to both sides by binary search over prefix hashes, and every stretch that is long enough is compared
word by word. Work and memory are n log n in the words of a document; documents are independent, so nothing is shuffled.

Words are ``[^\\x20\\x09-\\x0D]+``. Cases: a null or empty text and one without words has no runs and an empty rest; identical rows give a
row each; a null ``doc_id`` is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import (buffer_of, first_of_groups, mix, prefix_hashes, ragged, run_hashes, slices, window_hashes, word_hashes,
                        words_of)

MIN_LENGTH, DIRECT, SLICE = 24, 8, 2 << 20
#: Proposals that are extended at a time.
BLOCK = 1 << 18
_NONE = np.uint64(2**64 - 1)

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_of_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours: suffix minima of one block of that width meet prefix minima of the next."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, _NONE)
    padded[:len(x)] = x
    padded = padded.reshape(blocks, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


class Text:
    """Words of documents in a row: a number per word (equal for equal words) and the offset of each document."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        self.words, self.offsets = words, offsets
        self.prefix = prefix_hashes(mix(words))
        self.begin = np.repeat(offsets[:-1], np.diff(offsets))
        self.end = np.repeat(offsets[1:], np.diff(offsets))

    def direct(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Maximal stretches with period p of at least 3 p words."""
        n = len(self.words)
        same = np.zeros(max(0, n - p) + 1, dtype=bool)
        same[:-1] = (self.words[:n - p] == self.words[p:]) & (self.begin[:n - p] == self.begin[p:]) if n > p else False
        edge = np.diff(same.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p
        keep = end - start >= 3 * p
        return start[keep], end[keep]

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a equal those from b, for a < b in one document."""
        low, high = np.zeros(len(a), np.int64), self.end[b] - b
        while len(a) and (low < high).any():
            middle = (low + high + 1) >> 1
            equal = run_hashes(self.prefix, a, a + middle) == run_hashes(self.prefix, b, b + middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b."""
        low, high = np.zeros(len(a), np.int64), a - self.begin[a]
        while len(a) and (low < high).any():
            middle = (low + high + 1) >> 1
            equal = run_hashes(self.prefix, a - middle, a) == run_hashes(self.prefix, b - middle, b)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def synchronising(self, t: int, used: int, runs: np.ndarray) -> np.ndarray:
        """Members of the synchronising set at scale t among the first ``used`` words."""
        rank = mix(window_hashes(self.prefix[:used + 1], t) + np.uint64(t))
        rank[rank == _NONE] -= np.uint64(1)
        inside = runs[(runs[:, 2] <= t // 3) & (runs[:, 1] - runs[:, 0] >= t) & (runs[:, 1] <= used)]
        if len(inside):
            mark = np.zeros(len(rank) + 1, dtype=np.int32)
            np.add.at(mark, inside[:, 0], 1)
            np.add.at(mark, inside[:, 1] - t + 1, -1)
            rank[np.cumsum(mark)[:-1] > 0] = _NONE
        least = least_of_windows(rank, t + 1)
        chosen = (least != _NONE) & ((rank[:len(least)] == least) | (rank[t:t + len(least)] == least))
        at = np.flatnonzero(chosen)
        return at[at + 2 * t <= self.end[at]]

    def proposals(self, t: int, used: int, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, periods) that equal contexts of members propose."""
        at = self.synchronising(t, used, runs)
        context = run_hashes(self.prefix, at, at + 2 * t)
        order = np.lexsort((at, context, self.begin[at]))
        at, context = at[order], context[order]
        first = self.begin[at]
        for step in range(1, 10):
            gap = at[step:] - at[:-step]
            pair = (context[step:] == context[:-step]) & (first[step:] == first[:-step]) & (2 * gap > 3 * t) & (gap <= 3 * t)
            hit = np.flatnonzero(pair)
            for k in range(0, len(hit), BLOCK):
                yield at[hit[k:k + BLOCK]], gap[hit[k:k + BLOCK]]

    def extended(self, s: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Rows (start, end, period) of the maximal stretches around the pairs (s, s + p), of at least three periods."""
        start = s - self.common_before(s, s + p)
        end = s + p + self.common_after(s, s + p)
        keep = end - start >= 3 * p
        rows, one = np.unique(np.stack([start[keep], end[keep], p[keep]], axis=1), axis=0, return_index=True)
        return self.verified(rows, s[keep][one])

    def verified(self, rows: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The stretches word by word: where equal hashes hid a difference, only what lies around the pair seen remains."""
        length = rows[:, 1] - rows[:, 0] - rows[:, 2]
        at = ragged(rows[:, 0], length)
        unequal = self.words[at] != self.words[at + np.repeat(rows[:, 2], length)]
        if not unequal.any():
            return rows
        row = np.repeat(np.arange(len(rows)), length)[unequal]
        out = rows.copy()
        for r, place in zip(row, at[unequal]):
            if place < seen[r]:
                out[r, 0] = max(out[r, 0], place + 1)
            else:
                out[r, 1] = min(out[r, 1], place + out[r, 2])
        return out[out[:, 1] - out[:, 0] >= 3 * out[:, 2]]

    def runs(self) -> np.ndarray:
        """Rows (start, end, smallest period), each of at least three periods, by start and period. The documents must come
        longest first, so that those long enough for a scale are the first ones."""
        found = [np.empty((0, 3), np.int64)]
        for p in range(1, DIRECT + 1):
            start, end = self.direct(p)
            found.append(np.stack([start, end, np.full(len(start), p)], axis=1))
        known = smallest(np.concatenate(found))
        lengths = np.diff(self.offsets)
        t = 4
        while True:
            long = int(np.count_nonzero(2 * lengths > 9 * t))
            if not long:
                return known
            used = int(self.offsets[long])
            found = [known, *[self.extended(s, p) for s, p in self.proposals(t, used, known)]]
            known = smallest(np.concatenate(found))
            t *= 2


def smallest(rows: np.ndarray) -> np.ndarray:
    """One row a stretch, with its smallest period, ordered by start and period. A stretch of at least three of a multiple of its
    period cannot be extended by the multiple alone, so equal stretches have equal ends."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    new = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def strongest(rows: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) of the greatest length / period, the first of equal ones."""
    best = None
    for row in rows:
        if best is None or row[1] * best[2] > best[1] * row[2]:
            best = row
    return best


def _equal_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    length = ends[a] - starts[a]
    return bool((length == ends[b] - starts[b]).all()) and bool(
        (data[ragged(starts[a], length)] == data[ragged(starts[b], length)]).all())


def _runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of documents that come longest first; words are compared by hash, and the words of all runs byte by byte."""
    rows = Text(hashes, offsets).runs()
    length = rows[:, 1] - rows[:, 0] - rows[:, 2]
    at = ragged(rows[:, 0], length)
    if _equal_bytes(data, starts, ends, at, at + np.repeat(rows[:, 2], length)):
        return rows
    numbers: dict[bytes, int] = {}
    exact = [numbers.setdefault(data[s:e].tobytes(), len(numbers)) for s, e in zip(starts, ends)]
    return Text(np.array(exact, dtype=np.uint64), offsets).runs()


def _collapsed(data, starts, ends, offsets, rows: np.ndarray) -> pa.Array:
    """Texts without the words that a run repeats, one blank between words."""
    n = len(starts)
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, rows[:, 0] + rows[:, 2], 1)
    np.add.at(mark, rows[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(mark)[:-1] == 0)
    of_doc = np.diff(np.searchsorted(kept, offsets))
    length = ends[kept] - starts[kept]
    last = np.cumsum(of_doc)[of_doc > 0] - 1
    room = length + 1
    room[last] -= 1
    target = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, dtype=np.uint8)
    out[ragged(target, length)] = data[ragged(starts[kept], length)]
    bounds = np.concatenate(([0], np.cumsum(room)))[np.concatenate(([0], np.cumsum(of_doc)))]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                 [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def runs_of_batch(batch: pa.RecordBatch, min_length: int = MIN_LENGTH) -> pa.RecordBatch:
    data, byte_offsets = buffer_of(batch.column("text"))
    starts, ends, offsets = words_of(data, byte_offsets)
    order = np.argsort(-np.diff(offsets), kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    # the words of the documents, longest document first
    lengths = np.diff(offsets)[order]
    word = ragged(offsets[:-1][order], lengths)
    hashes = word_hashes(data, starts, ends)[word]
    starts, ends, offsets = starts[word], ends[word], np.concatenate(([0], np.cumsum(lengths)))
    rows = _runs_of(data, starts, ends, hashes, offsets)
    rows = rows[rows[:, 1] - rows[:, 0] >= min_length]
    text = _collapsed(data, starts, ends, offsets, rows).take(pa.array(back))
    doc = np.searchsorted(offsets, rows[:, 0], side="right") - 1
    per_doc: dict[int, list[tuple[int, int, int]]] = {}
    for d, (start, end, period) in zip(doc.tolist(), rows.tolist()):
        per_doc.setdefault(d, []).append((start - int(offsets[d]), end - start, period))
    found = [per_doc.get(d, []) for d in back.tolist()]

    def struct(row):
        return dict(zip(("start", "length", "period"), row)) if row else None
    return pa.record_batch([
        batch.column("doc_id"), pa.array(lengths[back], pa.int64()),
        pa.array([[struct(r) for r in f] for f in found], pa.list_(_RUN)),
        pa.array([struct(strongest(f)) for f in found], _RUN), text],
        names=["doc_id", "n_words", "runs", "strongest", "collapsed"])


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start and period), strongest run (greatest length / period; null without runs) and ``collapsed``:
    the words without those that a run holds after its first period, joined by one blank. A run has at least ``min_length``
    words and three periods."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=SLICE):
                yield runs_of_batch(part, min_length)
    return rows.mapInArrow(run, SCHEMA)
