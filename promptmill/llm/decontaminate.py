"""Benchmark decontamination with spaced seeds.

A spaced seed is a fixed mask over a span of words: the hash covers the words under the ones and ignores the others, so a seed
still hits where a word under a zero was replaced. Every position of the benchmark and of the documents is hashed under each
mask; where hashes meet, document and item are laid side by side at that shift and their words compared around the hit.

An overlap is reported if at least ``MIN_WORDS`` words (or the whole item, if shorter, but not under ``LEAST_WORDS``) stand
side by side of which at least ``SIMILARITY`` agree, beginning and ending with an agreeing word. Words are ASCII
lower-cased and stripped of punctuation at their ends. The masks miss no such overlap (nor with a larger ``min_words`` or
``similarity``); the tests go through all placements of replaced words.
An item under ``LEAST_WORDS`` words is reported where it stands word for word in a document of at most twice its words; inside
longer documents such items are not looked for, as they are words that any text may hold.

Cases: a null or empty text or item has no words and no overlap; items that say the same are reported each; identical documents
are reported each; a null id is kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import _IS_WORD, buffer_of, byte_values, lower_ascii, mix, prefix_hashes, ragged, run_hashes, slices, words_of

#: Masks with 6 ones for items of at least ``MIN_WORDS`` words. Wherever a fifth of 13 to 25 words is replaced, one of them hits;
#: a longer run of which a fifth is replaced holds such a window, as it can be cut into windows of 13 to 25 words.
MASKS = ("1111011", "1110100011", "11000011011", "1110111")
#: For items of ``LEAST_WORDS`` to ``MIN_WORDS`` - 1 words, which count as a whole: the same for the words between their ends.
SHORT_MASKS = ("1111011", "11001111", "1101000111", "10111101", "1110100011")
MIN_WORDS = 13
LEAST_WORDS = 8
SIMILARITY = 0.8
#: Benchmark words compared in one pass over the documents; a larger benchmark takes several passes.
PASS_WORDS = 2_000_000
_STRIP = np.zeros(256, dtype=bool)
_STRIP[[ord(c) for c in "\"'()[]{}.,;:!?`*_-"]] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word without punctuation at its ends, and the first word of each document. Words of
    punctuation alone are left out."""
    data = lower_ascii(data)
    starts, ends, first = words_of(data, offsets)
    if len(starts):
        body = np.concatenate(([0], np.cumsum(~_STRIP[data] & _IS_WORD[data])))
        # the first and last byte that is not punctuation, by their rank among such bytes
        places = np.flatnonzero(np.diff(body))
        kept = body[ends] > body[starts]
        owner = np.searchsorted(np.flatnonzero(kept), first)
        low, high = body[starts[kept]], body[ends[kept]] - 1
        starts, ends, first = places[low], places[high] + 1, owner
    hashes = run_hashes(prefix_hashes(byte_values(data)), starts, ends) if len(starts) else np.empty(0, np.uint64)
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends, first


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the ones of the mask, at each position that has the whole span."""
    m = len(words) - len(mask) + 1
    out = np.zeros(max(0, m), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1" and m > 0:
            out += words[k:k + m] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & (2**64 - 1) | 1)
    return mix(out + np.uint64(len(mask)))


class Items:
    """A part of the benchmark: its words, and its seed hashes in order with their places."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, first: np.ndarray, masks: tuple[str, ...]):
        self.ids, self.words, self.first = ids, words, first
        self.masks = (*masks, *SHORT_MASKS)
        self.seeds = []
        size = np.diff(first)
        for k, mask in enumerate(self.masks):
            hashes = seeds(words, mask)
            owner = np.searchsorted(first, np.arange(len(hashes)), side="right") - 1
            whole = np.arange(len(hashes)) + len(mask) <= first[owner + 1] if len(hashes) else np.empty(0, bool)
            whole &= (size[owner] < MIN_WORDS) == (k >= len(masks))
            whole &= size[owner] >= LEAST_WORDS
            places = np.flatnonzero(whole)
            order = np.argsort(hashes[places], kind="stable")
            seen = np.zeros(1 << 18, dtype=bool)
            seen[(hashes[places] >> np.uint64(46)).astype(np.int64)] = True
            self.seeds.append((hashes[places][order], places[order], seen))
        #: items under ``LEAST_WORDS`` words: by their number of words, hashes in order and their items
        self.short = {}
        for n in range(1, LEAST_WORDS):
            which = np.flatnonzero(size == n)
            if len(which):
                hashes = seeds(words, "1" * n)[first[which]]
                order = np.argsort(hashes, kind="stable")
                self.short[n] = hashes[order], which[order]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the documents and in the benchmark whose seeds are equal."""
        left, right = [], []
        for mask, (known, places, seen) in zip(self.masks, self.seeds):
            if len(known) == 0:
                continue
            hashes = seeds(words, mask)
            at = np.flatnonzero(seen[(hashes >> np.uint64(46)).astype(np.int64)])
            low = np.searchsorted(known, hashes[at], side="left")
            count = np.searchsorted(known, hashes[at], side="right") - low
            left.append(np.repeat(at, count))
            right.append(places[ragged(low, count)])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])


def short_overlaps(words: np.ndarray, first: np.ndarray, items: Items) -> list[tuple]:
    """Items under ``LEAST_WORDS`` words that stand word for word in a document of at most twice their words."""
    size, found = np.diff(first), []
    for n, (known, which) in items.short.items():
        docs = np.flatnonzero((size >= n) & (size <= 2 * n))
        if len(docs) == 0:
            continue
        at = ragged(first[docs], size[docs] - n + 1)
        hashes = seeds(words, "1" * n)[at]
        low = np.searchsorted(known, hashes, side="left")
        count = np.searchsorted(known, hashes, side="right") - low
        doc = np.repeat(np.searchsorted(first, at, side="right") - 1, count)
        item, place = which[ragged(low, count)], np.repeat(at, count)
        found += [(int(d), int(i), int(p - first[d]), n, n) for d, i, p in zip(doc, item, place)]
    return found


def best_overlap(agree: np.ndarray, similarity: float) -> tuple[int, int]:
    """Longest run [begin, end) of which at least ``similarity`` agrees and whose first and last words agree."""
    places = np.flatnonzero(agree)
    if len(places) == 0:
        return 0, 0
    # agreement minus the share asked for, summed up: a run qualifies if the sum does not fall over it
    gain = np.concatenate(([0.0], np.cumsum(agree - similarity)))
    begin, end = places, places + 1
    best = (0, 0)
    for b in begin:
        fit = end[(end > b) & (gain[end] - gain[b] >= -1e-9)]
        if len(fit) and fit[-1] - b > best[1] - best[0]:
            best = (int(b), int(fit[-1]))
    return best


def overlaps(words: np.ndarray, first: np.ndarray, items: Items, min_words: int, similarity: float) -> list[tuple]:
    """(document, item, first word in the document, words, agreeing words) of each overlap that is long enough."""
    if len(words) == 0 or len(items.words) == 0:
        return []
    left, right = items.hits(words)
    doc = np.searchsorted(first, left, side="right") - 1
    item = np.searchsorted(items.first, right, side="right") - 1
    found = {}
    shifts = np.unique(np.stack([doc, item, left - right], axis=1), axis=0) if len(left) else []
    for d, i, shift in shifts:
        low = max(items.first[i], first[d] - shift)
        high = min(items.first[i + 1], first[d + 1] - shift)
        agree = words[low + shift:high + shift] == items.words[low:high]
        need = max(LEAST_WORDS, min(min_words, items.first[i + 1] - items.first[i]))
        if agree.sum() < similarity * need - 1e-9:
            continue
        b, e = best_overlap(agree, similarity)
        if e - b >= need:
            row = (int(d), int(i), int(low + shift + b - first[d]), e - b, int(agree[b:e].sum()))
            found.setdefault((int(d), int(i), row[2]), row)
    return sorted([*found.values(), *short_overlaps(words, first, items)])


def benchmark_parts(benchmark: DataFrame, masks: tuple[str, ...], pass_words: int) -> Iterator[tuple[Items, list]]:
    """The benchmark in parts of at most about ``pass_words`` words, each with the ids of its items. Only one part is on the
    driver at a time, and each is sent to all tasks, so what is sent is bounded whatever the benchmark's size."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("text").isNotNull())
    # a word takes a byte at least and a blank, so half the bytes bound the number of words
    total = items.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(total // (2 * pass_words)) + 1
    for part in range(parts):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        table = chosen.toArrow()
        data, offsets = buffer_of(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))
        words, _, _, first = plain_words(data, offsets)
        ids = table["item_id"].to_pylist()
        yield Items(np.arange(len(ids)), words, first, masks), ids


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS,
                  similarity: float = SIMILARITY, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row for each overlap: doc_id, item_id, first_word, last_word (of the document, from 0), n_words, n_agree, and the
    bytes of the text that it covers (begin_byte, end_byte). The documents are not shuffled."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = ("doc_id bigint, item_id bigint, first_word int, last_word int, n_words int, n_agree int, begin_byte int, "
              "end_byte int")
    out = None
    for items, ids in benchmark_parts(benchmark, masks, pass_words):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    data, offsets = buffer_of(piece.column("text"))
                    words, starts, ends, first = plain_words(data, offsets)
                    rows = overlaps(words, first, sent.value, min_words, similarity)
                    doc = pa.array([r[0] for r in rows], pa.int64())
                    at = np.array([first[r[0]] + r[2] for r in rows], dtype=np.int64)
                    size = np.array([r[3] for r in rows], dtype=np.int64)
                    base = np.array([offsets[r[0]] for r in rows], dtype=np.int64)
                    ints = [[r[2] for r in rows], [r[2] + r[3] - 1 for r in rows], [r[3] for r in rows], [r[4] for r in rows],
                            starts[at] - base if len(rows) else [], ends[at + size - 1] - base if len(rows) else []]
                    yield pa.record_batch([piece.column("doc_id").take(doc), pa.array([ids[r[1]] for r in rows], pa.int64()),
                                           *[pa.array(x, pa.int32()) for x in ints]],
                                          names=["doc_id", "item_id", "first_word", "last_word", "n_words", "n_agree",
                                                 "begin_byte", "end_byte"])
        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS,
                     similarity: float = SIMILARITY, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no overlap with any item."""
    for items, _ in benchmark_parts(benchmark, masks, pass_words):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    words, _, _, first = plain_words(*buffer_of(piece.column("text")))
                    clean = np.ones(piece.num_rows, dtype=bool)
                    clean[[r[0] for r in overlaps(words, first, sent.value, min_words, similarity)]] = False
                    yield piece.filter(pa.array(clean))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contaminated(overlapping: DataFrame) -> DataFrame:
    """One row per document that holds an overlap: doc_id, item_ids (in order) and its longest overlap in words."""
    return overlapping.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"),
                                             F.max("n_words").alias("longest"))
