"""Probability of whole texts under a subword lattice and the words of a corpus.

A word may be cut into pieces of an existing vocabulary in many ways. The lattice model gives each piece a weight and a word the
sum over all its cuts of the product of their weights, found by a forward recursion over its bytes in log space. A piece that
opens a word carries a blank in front, and every single byte is a piece, so each text has a probability. Weights start from the
vocabulary's own scores (for a vocabulary of merges these are ranks, taken as 1 / rank) and are re-estimated from the word types
of the training documents by expectation-maximisation, forward and backward.

The corpus adds what it knows about whole words: a token with count c in N training tokens of V types has probability
(max(c - D, 0) + D V p) / N, where p is its lattice probability and the discount D follows from the numbers of words seen once and
twice: n1 / (n1 + 2 n2). Training documents may carry a class, such as their language; counts and weights are then kept by
class. A document is scored without its class: its marginal probability is the sum over classes of the class's share times the
product over words and end.

Counting words and looking them up run in packed form over buckets (``blocks``): each block asks for each of its words once.

Cases: a null or empty text is one token, its end; with no training documents N is 0 and the lattice alone decides; a null
``held_out`` counts as training; identical rows are counted and scored each; an empty table gives no rows; a null
class is a class; other columns are ignored. Words are told apart by 64-bit hashes; within a bucket equal hashes count as equal words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import blocks as bl
from .sequences import (buffer_of, byte_values, first_of_groups, lower_ascii, mix, prefix_hashes, ragged, run_hashes, slices, window_hashes,
                        word_hashes, words_of)

#: Rounds of re-estimation.
ROUNDS = 2
#: Classes told apart; the rarer ones share the last.
CLASSES = 16
#: Bytes of words in one pass of the lattice.
PASS_BYTES = 1 << 18
ASKED, WORDS = 0, 1


class Lattice:
    """Pieces (bytes; a leading blank opens a word), found by hash, with natural-log weights: one row per class."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        weights = np.atleast_2d(weights)
        self.pieces, self.log = pieces, np.column_stack([weights, np.full(len(weights), -np.inf)])
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        start = np.cumsum(size) - size
        prefix = prefix_hashes(byte_values(data))
        self.key = mix(run_hashes(prefix, start, start + size) + size.astype(np.uint64))
        order = np.argsort(self.key)
        # places in the ordered keys by their leading bits: two neighbours bound the search
        self.sorted, self.id = self.key[order], order.astype(np.int32)
        self.lead = np.searchsorted(self.sorted, np.arange(0, (1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.steps = int(np.diff(self.lead).max(initial=0))
        self.sizes = sorted(set(size.tolist()))

    def find(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """Piece at each position for pieces of n bytes (the last index, of weight zero, where there is none)."""
        key = mix(window_hashes(prefix, n) + np.uint64(n))
        at = self.lead[(key >> np.uint64(44)).astype(np.int64)]
        out = np.full(len(key), len(self.pieces), dtype=np.int32)
        for k in range(self.steps):
            place = np.minimum(at + k, len(self.sorted) - 1)
            hit = self.sorted[place] == key
            out[hit] = self.id[place[hit]]
        return out

    def _layout(self, data: np.ndarray, offsets: np.ndarray):
        """Words with a blank in front, longest first, and the piece found at each place for each length."""
        size = np.diff(offsets) + 1
        order = np.argsort(-size, kind="stable")
        size = size[order]
        base = np.cumsum(size) - size
        text = np.full(int(size.sum()), 32, dtype=np.uint8)
        text[ragged(base + 1, size - 1)] = data[ragged(offsets[:-1][order], size - 1)]
        prefix = prefix_hashes(byte_values(text))
        found = {n: self.find(prefix, n) for n in self.sizes if n <= int(size[0])}
        # how many words reach each length
        reach = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="right")
        return order, size, base, found, reach

    def _forward(self, log, size, base, found, reach) -> np.ndarray:
        state = base + np.arange(len(size))
        alpha = np.full(int(size.sum()) + len(size), -np.inf)
        alpha[state] = 0
        for t in range(1, int(size[0]) + 1):
            n = reach[t]
            terms = [alpha[state[:n] + t - k] + log[found[k][base[:n] + t - k]] for k in found if k <= t]
            alpha[state[:n] + t] = np.logaddexp.reduce(np.stack(terms), axis=0)
        return alpha

    def passes(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words with a bounded number of bytes."""
        edge = offsets + np.arange(len(offsets))
        at = 0
        while at < len(offsets) - 1:
            stop = max(at + 1, int(np.searchsorted(edge, edge[at] + PASS_BYTES, side="right")) - 1)
            yield at, stop
            at = stop

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural-log probability of each word under each class, summed over all its cuts."""
        out = np.zeros((len(self.log), len(offsets) - 1))
        for a, b in self.passes(data, offsets):
            order, *shape = self._layout(data, offsets[a:b + 1])
            size, base = shape[:2]
            for k, log in enumerate(self.log):
                out[k, a + order] = self._forward(log, *shape)[base + np.arange(len(size)) + size]
        return out

    def expected(self, data: np.ndarray, offsets: np.ndarray, klass: int = 0) -> np.ndarray:
        """Expected number of uses of each piece over the words, under the weights of a class."""
        out = np.zeros(len(self.pieces) + 1)
        log = self.log[klass]
        for a, b in self.passes(data, offsets):
            order, size, base, found, reach = self._layout(data, offsets[a:b + 1])
            alpha = self._forward(log, size, base, found, reach)
            state = base + np.arange(len(size))
            beta = np.full(len(alpha), -np.inf)
            beta[state + size] = 0
            total = alpha[state + size]
            used, share = [], []
            # from the right: at distance t from its end, every word that is at least that long
            for t in range(1, int(size[0]) + 1):
                n = reach[t]
                here = size[:n] - t
                terms = []
                for k in found:
                    if k > t:
                        continue
                    piece = found[k][np.minimum(base[:n] + here, len(found[k]) - 1)]
                    value = log[piece] + beta[state[:n] + here + k]
                    terms.append(value)
                    real = np.flatnonzero(piece < len(self.pieces))
                    used.append(piece[real])
                    share.append(alpha[(state[:n] + here)[real]] + value[real] - total[real])
                beta[state[:n] + here] = np.logaddexp.reduce(np.stack(terms), axis=0)
            if used:
                out += np.bincount(np.concatenate(used), np.exp(np.concatenate(share)), minlength=len(out))
        return out[:-1]


def piece_vocabulary(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model and all single bytes, with log weights from the model's scores: log probabilities as
    they are, ranks of merges (whole negative numbers) as 1 / rank. Pieces that differ in the case of ASCII letters are one, with
    the best of their scores. Bytes that are no piece get the least weight."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    score = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        body = (" " + piece[1:] if piece.startswith("▁") else piece).encode("utf-8")
        if " " not in piece and "▁" not in piece[1:] and model.get_score(i) > -1e6:
            key = body.lower()  # of bytes: ASCII letters only, as in the texts
            score[key] = max(model.get_score(i), score.get(key, -np.inf))
    values = np.array(list(score.values()))
    if len(values) and (values == np.round(values)).all():
        values = -np.log(2 - values)
    pieces = list(score)
    least = values.min(initial=0.0) - np.log(256)
    rest = [bytes([b]) for b in range(256) if bytes([b]) not in score]
    values = np.concatenate([values, np.full(len(rest), least)])
    return pieces + rest, values - np.logaddexp.reduce(values)


def _unique_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, where each hash begins in it, and a place of each hash."""
    order = np.argsort(hashes, kind="stable")
    first = first_of_groups(hashes[order])
    return order, first, order[first]


def _counted(buckets: int):
    """Different words of each slice of text with their counts, packed by bucket and class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=2 << 20):
                data, offsets = buffer_of(part.column("text"))
                data = lower_ascii(data)
                starts, ends, first = words_of(data, offsets)
                if len(starts) == 0:
                    continue
                every = word_hashes(data, starts, ends)
                klass = np.repeat(np.asarray(part.column("klass")), np.diff(first))
                rows = []
                for c in np.unique(klass):
                    of = np.flatnonzero(klass == c)
                    hashes = every[of]
                    order, first, one = _unique_words(hashes)
                    count = np.diff(np.append(first, len(order))).astype(np.int64)
                    for k, i in bl.deal(hashes[one], buckets):
                        w = of[one[i]]
                        size = ends[w] - starts[w]
                        rows.append(bl.pack(0, k, int(c), every[w], count[i], size, data[ragged(starts[w], size)]))
                yield from bl.rows_table(rows).to_batches()
    return run


def _merged(classes: int):
    def run(bucket: int, rows: list[tuple]) -> list[tuple]:
        """All words of a bucket with their counts in each class."""
        hashes, count, size = (np.concatenate([np.frombuffer(r[k], t) for r in rows])
                               for k, t in ((2, np.uint64), (3, np.int64), (4, np.int64)))
        klass = np.repeat([r[1] for r in rows], [len(r[2]) // 8 for r in rows])
        data = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows])
        start = np.cumsum(size) - size
        order, first, one = _unique_words(hashes)
        total = np.stack([np.add.reduceat(np.where(klass[order] == c, count[order], 0), first) for c in range(classes)])
        return [bl.pack(-1, bucket, WORDS, hashes[one], total, size[one], data[ragged(start[one], size[one])])]
    return run


def _words_of_row(size: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(size, np.int64)
    return np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(n)))


class CorpusModel:
    """Lattices re-estimated on the training words of each class, the words themselves by bucket, and their totals."""

    def __init__(self, words: DataFrame, buckets: int, lattice: Lattice, ends: np.ndarray, rounds: int = ROUNDS):
        self.words, self.buckets, self.ends, classes = words, buckets, ends, len(ends)

        def totals(batches):
            for batch in batches:
                for b in batch.column("b").to_pylist():
                    count = np.frombuffer(b, np.int64).reshape(classes, -1)
                    yield pa.record_batch([pa.array([-1, *range(classes)], pa.int32()),
                                           pa.array([count.sum(), *count.sum(axis=1)], pa.int64()),
                                           pa.array([count.shape[1], *(count > 0).sum(axis=1)], pa.int64()),
                                           *[pa.array([0, *(count == c).sum(axis=1)], pa.int64()) for c in (1, 2)]],
                                          names=["klass", "n", "v", "once", "twice"])
        rows = words.mapInArrow(totals, "klass int, n bigint, v bigint, once bigint, twice bigint").groupBy("klass").agg(
            *[F.sum(c).alias(c) for c in ("n", "v", "once", "twice")]).collect()
        by = {r["klass"]: r for r in rows}
        self.tokens = (by[-1]["n"] if by else 0) + int(ends.sum())
        self.types = (by[-1]["v"] if by else 0) + int(ends.sum() > 0)
        size = np.array([by[k]["n"] if by else 0 for k in range(classes)]) + ends
        once, twice = (np.array([by[k][c] if by else 0 for k in range(classes)]) for c in ("once", "twice"))
        types = np.array([by[k]["v"] if by else 0 for k in range(classes)])
        # without words, the lattice has all of the probability
        self.discount = np.clip((once + 0.5) / (once + 2 * twice + 1.0), 0.05, 0.95)
        self.mass = np.where(size > 0, self.discount * (types + (ends > 0)), 1.0)
        self.size = np.maximum(size, 1).astype(float)
        lattice = Lattice(lattice.pieces, np.repeat(lattice.log[:1, :-1], classes, axis=0))
        for _ in range(rounds if types.sum() else 0):
            lattice = self._again(lattice, types)
        self.lattice = lattice
        opening = np.array([p.startswith(b" ") for p in lattice.pieces])
        # a word ends where a piece with a blank or the end of the text follows
        with np.errstate(divide="ignore"):
            end = np.log(np.maximum(1, ends)) - np.log(np.maximum(1, size))
            log_end = end - np.logaddexp(end, np.logaddexp.reduce(lattice.log[:, :-1][:, opening], axis=1))
            self.log_share = np.log((ends + 1e-9) / (ends + 1e-9).sum())
        self.end10 = self.log10(ends[:, None], log_end[:, None])[:, 0]

    def log10(self, count: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """log10 of the discounted share of a count and the lattice's part; one row per class."""
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(count - self.discount[:, None], 0))
            return (np.logaddexp(own, np.log(self.mass)[:, None] + log_p) - np.log(self.size)[:, None]) / np.log(10)

    def _again(self, lattice: Lattice, types: np.ndarray) -> Lattice:
        """One round of expectation-maximisation over the word types of each class; every piece keeps a small share of its
        old weight."""
        sent, classes = self.words.sparkSession.sparkContext.broadcast(lattice), len(types)

        def run(batches):
            total = np.zeros((classes, len(sent.value.pieces)))
            for batch in batches:
                for b, size, data in zip(*[batch.column(c).to_pylist() for c in "bcd"]):
                    count = np.frombuffer(b, np.int64).reshape(classes, -1)
                    data, offsets = _words_of_row(size, data)
                    n = np.diff(offsets)
                    for k in range(classes):
                        of = np.flatnonzero(count[k])
                        if len(of):
                            total[k] += sent.value.expected(data[ragged(offsets[of], n[of])], np.concatenate(([0], np.cumsum(n[of]))), k)
            klass, piece = np.nonzero(total)
            yield pa.record_batch([pa.array(klass, pa.int32()), pa.array(piece, pa.int64()), pa.array(total[klass, piece])],
                                  names=["klass", "piece", "uses"])
        # one row per class and piece of the vocabulary, whatever the corpus
        uses = self.words.mapInArrow(run, "klass int, piece bigint, uses double").groupBy("klass", "piece").agg(
            F.sum("uses").alias("uses")).toArrow()
        value = np.exp(lattice.log[:, :-1]) * 0.001 * (types + 1)[:, None]
        value[np.asarray(uses["klass"]), np.asarray(uses["piece"])] += np.asarray(uses["uses"])
        return Lattice(lattice.pieces, np.log(value) - np.log(value.sum(axis=1, keepdims=True)))


def learn(docs: DataFrame, held_out: Column, model_path: str, classes: str | None = None, rounds: int = ROUNDS) -> CorpusModel:
    """Counts the lower-cased words of the documents that are not held out and fits the lattices to them. ``classes`` names
    a column of the training documents' classes; at most ``CLASSES`` are told apart."""
    buckets = bl.buckets_for(max(1, bl.text_bytes(docs) // bl.BLOCK_BYTES))
    label = F.coalesce(F.col(classes).cast("string"), F.lit("")) if classes else F.lit("")
    training = docs.filter(~F.coalesce(held_out, F.lit(False))).select("text", label.alias("label"))
    common = training.groupBy("label").agg(F.count("*").alias("n"))
    head = common.orderBy(F.desc("n"), "label").limit(CLASSES).collect()
    ends = np.array([r["n"] for r in head] or [0], dtype=np.int64)
    total = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ends[-1] += total - ends.sum()
    klass = F.lit(len(ends) - 1)
    for k, r in reversed(list(enumerate(head))):
        klass = F.when(F.col("label") == r["label"], k).otherwise(klass)
    counted = training.select("text", klass.cast("int").alias("klass")).mapInArrow(_counted(buckets), bl.ROW)
    words = materialize(bl.per_bucket(counted, _merged(len(ends))))
    return CorpusModel(words, buckets, Lattice(*piece_vocabulary(model_path)), ends, rounds)


class _Scorer:
    """What the tasks need of a model."""

    def __init__(self, model: CorpusModel):
        self.lattice, self.mass, self.size, self.discount = model.lattice, model.mass, model.size, model.discount
        self.end10, self.log_share, self.ends = model.end10, model.log_share, int(model.ends.sum())

    log10 = CorpusModel.log10


def score(docs: DataFrame, held_out: Column, model: CorpusModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, log10_counts (sum of log10(c + 1)) and score (log10 probability of the text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocked, _ = bl.blocked(rows, more=("held_out",))
    sent = docs.sparkSession.sparkContext.broadcast(_Scorer(model))
    buckets, classes = model.buckets, len(model.ends)

    def parts(table: pa.Table):
        data, offsets = buffer_of(table["text"].combine_chunks())
        data = lower_ascii(data)
        starts, ends, first = words_of(data, offsets)
        hashes = word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
        return data, starts, ends, first, hashes

    def ask(block: int, table: pa.Table) -> pa.Table:
        *_, hashes = parts(table)
        unique = np.unique(hashes)
        return bl.rows_table([bl.pack(block, k, ASKED, unique[i]) for k, i in bl.deal(unique, buckets)])

    def answer(bucket: int, rows: list[tuple]) -> list[tuple]:
        """Count of each asked word and its log10 probability in each class; not a number where training has no such word."""
        own = next((r for r in rows if r[0] == -1), None)
        known, total, value = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((classes, 0), np.float32)
        if own:
            known, count = np.frombuffer(own[2], np.uint64), np.frombuffer(own[3], np.int64).reshape(classes, -1)
            total = count.sum(axis=0)
            value = sent.value.log10(count, sent.value.lattice.score(*_words_of_row(own[4], own[5]))).astype(np.float32)
        out = []
        for r in rows:
            if r[0] >= 0:
                asked = np.frombuffer(r[2], np.uint64)
                at = np.searchsorted(known, asked)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == asked[hit]
                c, p = np.zeros(len(asked), np.int64), np.full((classes, len(asked)), np.nan, np.float32)
                c[hit], p[:, hit] = total[at[hit]], value[:, at[hit]]
                out.append(bl.pack(r[0], bucket, ASKED, c, p))
        return out

    def finish(block: int, table: pa.Table, answers: list[tuple]) -> pa.Table:
        data, starts, ends, first, hashes = parts(table)
        model = sent.value
        order, head, one = _unique_words(hashes)
        unique = hashes[one]
        told = {r[0]: r for r in answers}
        count, log10 = np.zeros(len(unique), np.int64), np.full((classes, len(unique)), np.nan)
        for k, i in bl.deal(unique, buckets):
            count[i], log10[:, i] = np.frombuffer(told[k][2], np.int64), np.frombuffer(told[k][3], np.float32).reshape(classes, -1)
        new = np.flatnonzero(np.isnan(log10[0]))
        if len(new):  # words that no training document has
            w = one[new]
            size = ends[w] - starts[w]
            log_p = model.lattice.score(data[ragged(starts[w], size)], np.concatenate(([0], np.cumsum(size))))
            log10[:, new] = model.log10(np.zeros(log_p.shape), log_p)
        index = np.empty(len(hashes), dtype=np.int64)
        index[order] = np.repeat(np.arange(len(unique)), np.diff(np.append(head, len(order))))

        def by_doc(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(values[index])))
            return sums[first[1:]] - sums[first[:-1]]
        whole = np.stack([by_doc(log10[k]) + model.end10[k] + model.log_share[k] / np.log(10) for k in range(classes)])
        score = np.logaddexp.reduce(whole * np.log(10), axis=0) / np.log(10)
        return pa.table([table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(),
                         pa.array(np.diff(first) + 1, pa.int64()), pa.array(by_doc(count > 0) + (model.ends > 0), pa.int64()),
                         pa.array(by_doc(np.log10(count + 1.0)) + np.log10(model.ends + 1.0)), pa.array(score)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "log10_counts", "score"])
    asked = bl.per_block(blocked, ask)
    answers = bl.per_bucket(asked.unionByName(model.words), answer)
    return bl.back_to_blocks(blocked, answers, finish,
                             "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log10_counts double, score double")


def with_base(scored: DataFrame, model: CorpusModel) -> DataFrame:
    """Adds train_tokens and the add-one word model's log10 probability."""
    each = math.log10(model.tokens + model.types + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
                         (F.col("log10_counts") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")
