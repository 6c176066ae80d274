"""Quality scores from weak labels.

Heuristic labellers look at a document and vote good, bad or abstain. How far each can be trusted is estimated without any true
label: expectation-maximisation fits the share of good documents and, for each labeller, how often it votes which way on
good and on bad ones, from how often the labellers agree. The votes of all documents are counted by pattern first, so the fit
reads a table with a row per pattern that occurs (at most 3 to the number of labellers), whatever the corpus. The posterior labels
of a sample of documents then train a linear scorer over hashed features of words and word shapes, which
judges what no heuristic speaks about.

Cases: a null or empty text gets votes like any other and is rejected by its score (no words: score 0); identical rows get equal
scores; a null id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .sequences import (buffer_of, byte_values, first_of_groups, lower_ascii, mix, prefix_hashes, run_hashes, slices, word_hashes,
                        words_of)

#: Hashed features, different texts that train the scorer at most, and the score under which a document is rejected.
FEATURES, TRAIN_DOCS, KEEP_FROM = 1 << 16, 6000, 0.5
GOOD, BAD, ABSTAIN = 1, 0, 2
#: The first labellers speak about every document; the others look for one fault each and abstain where they do not see it.
GENERAL = 3
#: Frequent short words of the languages expected.
COMMON = ("the of and to in is that it for on was with as be by this are at or from "
          "der die und das den von zu mit ist im für auf des ein eine nicht "
          "le la les de et des un une est que en du pour qui dans "
          "el los las y que se por con una para del es lo al").split()
_NOT_LINE_END = np.ones(256, dtype=bool)
_NOT_LINE_END[10] = False
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]=+\\|_"]] = 1
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[[ord(c) for c in "!?"]] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
#: Byte classes of a word's shape: letters by case, digits; every other byte is itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97
_COMMON = None


def _common() -> np.ndarray:
    global _COMMON
    if _COMMON is None:
        data, offsets = buffer_of(pa.array(sorted(set(COMMON))))
        _COMMON = np.sort(word_hashes(data, offsets[:-1], offsets[1:]))
    return _COMMON


class Batch:
    """Words and line statistics of a batch of documents."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = buffer_of(texts)
        self.starts, self.ends, self.first = words_of(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def bytes_of(self, table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(table[self.data])))[self.offsets])

    def words_with(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[self.first])

    def repeated_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines of each document, and those that an earlier line of it equals."""
        starts, ends, first = words_of(self.data, self.offsets, _NOT_LINE_END)
        if len(starts) == 0:
            return np.diff(first), np.diff(first)
        hashes = word_hashes(self.data, starts, ends)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((hashes, doc))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        return np.diff(first), np.bincount(doc[order][again], minlength=len(first) - 1)

    def shapes(self) -> np.ndarray:
        """Hash of each word's shape: byte classes with runs taken together."""
        shape = _SHAPE[self.data]
        keep = np.ones(len(shape), dtype=bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[self.starts] = True
        place = np.concatenate(([0], np.cumsum(keep)))
        prefix = prefix_hashes(byte_values(shape[keep]))
        a, b = place[self.starts], place[self.ends]
        return mix(run_hashes(prefix, a, b) + (b - a).astype(np.uint64) + np.uint64(1 << 40))

    def votes(self) -> np.ndarray:
        """One row per document, one column per labeller."""
        n = np.maximum(1, self.n_words)
        letters = np.maximum(1, self.bytes_of(_LETTER))
        size = np.maximum(1, np.diff(self.offsets))
        length = self.ends - self.starts
        same = np.zeros(len(self.hashes), dtype=np.int64)
        if len(same) > 1:
            same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.doc[1:] == self.doc[:-1])
        lower = lower_ascii(self.data)
        plain = word_hashes(lower, self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(_common(), plain), len(_common()) - 1)
        common = self.words_with((_common()[at] == plain).astype(np.int64)) / n
        order = np.lexsort((self.hashes, self.doc))
        new = np.ones(len(order), dtype=np.int64)
        new[1:] = (self.hashes[order][1:] != self.hashes[order][:-1]) | (self.doc[order][1:] != self.doc[order][:-1])
        different = np.bincount(self.doc[order], new, minlength=len(n)) / n
        lines, again = self.repeated_lines()
        upper = self.bytes_of(_UPPER) / letters
        symbols = self.bytes_of(_SYMBOL) / size
        marks = self.bytes_of(_MARK) / n
        lone = self.words_with((length == 1) & (_LETTER[self.data[self.starts]] == 0) if len(length) else length) / n
        mean = self.words_with(length) / n
        digits = self.bytes_of(_DIGIT) / size
        long = self.n_words >= 20  # shares of fewer words say little

        def vote(bad, good=np.zeros(len(n), dtype=bool)):
            return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
        return np.stack([
            vote(long & (common < 0.02), long & (common > 0.08)),
            vote(long & ((mean < 2.5) | (mean > 14)), long & (mean > 3.5) & (mean < 10)),
            vote(long & (different < 0.1), long & (different > 0.25)),
            vote(self.n_words == 0),
            vote(upper > 0.5),
            vote(symbols > 0.02),
            vote(marks > 0.2),
            vote(lone > 0.12),
            vote(self.words_with(same) / n > 0.15),
            vote(again > 0.4 * np.maximum(1, lines)),
            vote(digits > 0.2),
        ], axis=1)

    def features(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value) of all hashed features: the shape of each word, a word after itself, and each word; values
        are shares of the document's words, drawn towards zero where there are few."""
        same = np.zeros(len(self.hashes), dtype=bool)
        if len(same) > 1:
            same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.doc[1:] == self.doc[:-1])
        key = np.concatenate([self.shapes(), np.full(int(same.sum()), 1 << 41, dtype=np.uint64), self.hashes])
        doc = np.concatenate([self.doc, self.doc[same], self.doc])
        slot = (mix(key) % np.uint64(size)).astype(np.int64)
        code = doc * size + slot
        order = np.sort(code)
        first = first_of_groups(order)
        count = np.diff(np.append(first, len(order)))
        doc, slot = order[first] // size, order[first] % size
        return doc, slot, count / (self.n_words + 8)[doc]


class LabelModel:
    """Trust in labellers and share of good documents, fitted to counted patterns of votes."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        labellers = patterns.shape[1]
        hot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # pattern, labeller, vote
        self.good = 0.9
        # what is believed at the start of bad and good documents: votes BAD, GOOD, ABSTAIN
        general = np.array([[0.3, 0.4, 0.3], [0.02, 0.78, 0.2]])
        detector = np.array([[0.12, 0.0, 0.88], [0.001, 0.0, 0.999]])
        self.share = np.stack([general] * GENERAL + [detector] * (labellers - GENERAL), axis=1)  # class, labeller, vote
        # what is believed of good documents counts like all documents, so that a fault only one labeller sees stays a fault
        belief = self.share * counts.sum() * np.array([0.005, 1.0])[:, None, None]
        self.share = np.maximum(self.share, 1e-9)
        for _ in range(rounds):
            post = self.posterior(patterns)
            weight = np.stack([counts * (1 - post), counts * post])
            self.good = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
            seen = np.einsum("cp,plv->clv", weight, hot) + belief
            self.share = np.maximum(seen / seen.sum(axis=2, keepdims=True), 1e-9)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        each = np.arange(patterns.shape[1])
        log = np.stack([np.log(self.share[c][each, patterns]).sum(axis=1) for c in (0, 1)])
        log += np.log([1 - self.good, self.good])[:, None]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


class Scorer:
    """A logistic scorer over hashed features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, size: int, rounds: int = 150,
            decay: float = 1e-4, weight: np.ndarray | None = None) -> Scorer:
        """Full-batch descent with a step per feature (Adagrad); targets are probabilities, ``weight`` the documents' weights."""
        weight = np.ones(len(target)) if weight is None else weight / weight.mean()
        share = np.clip((weight * target).mean(), 0.01, 0.99)
        weights, bias = np.zeros(size), float(np.log(share / (1 - share)))
        seen, seen_bias = np.full(size, 1e-8), 1e-8
        for _ in range(rounds):
            guess = 1 / (1 + np.exp(-(np.bincount(doc, weights[slot] * value, minlength=len(target)) + bias)))
            gap = weight * (guess - target) / len(target)
            step = np.bincount(slot, gap[doc] * value, minlength=size) + decay * weights / len(target)
            seen += step**2
            weights -= 1.0 * step / np.sqrt(seen)
            seen_bias += gap.sum()**2
            bias -= 0.5 * gap.sum() / np.sqrt(seen_bias)
        return cls(weights, bias)

    def score(self, batch: Batch) -> np.ndarray:
        doc, slot, value = batch.features(len(self.weights))
        raw = np.bincount(doc, self.weights[slot] * value, minlength=len(batch.n_words)) + self.bias
        return np.where(batch.n_words > 0, 1 / (1 + np.exp(-np.clip(raw, -500, 500))), 0.0)


def fit_quality(docs: DataFrame, train_docs: int = TRAIN_DOCS, features: int = FEATURES) -> Scorer:
    """Votes of all documents, their fit, and a scorer trained on the posterior labels of at most ``train_docs`` different texts. Texts
    that make up a share of 1 / ``train_docs`` of the rows or more are all taken, the others by the smallest hashes; the former weigh
    what they hold of the rows, the latter share the rest by their numbers of rows."""
    rows = docs.select("text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                code = Batch(part.column("text")).votes()
                yield pa.record_batch([pa.array(["".join(map(str, v)) for v in code], pa.string())], names=["votes"])
    counted = rows.mapInArrow(vote, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()
    if not counted:
        return Scorer(np.zeros(features), 0.0)
    patterns = np.array([[int(c) for c in r["votes"]] for r in counted])
    counts = np.array([r["n"] for r in counted], dtype=float)
    model = LabelModel(patterns, counts)
    hashed = rows.select(F.xxhash64("text").alias("h"), "text")
    often = F.col("n") * train_docs >= int(counts.sum())
    sizes = hashed.groupBy("h").agg(F.count("*").alias("n"))
    chosen = materialize(sizes.orderBy(F.desc(often), "h").limit(train_docs).select("h", often.alias("often")))
    sample = hashed.join(F.broadcast(chosen), "h").groupBy("h", "often", "text").agg(F.count("*").alias("n"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                b = Batch(part.column("text"))
                target = model.posterior(b.votes())
                doc, slot, value = b.features(features)
                edge = np.searchsorted(doc, np.arange(len(target) + 1)).astype(np.int32)
                yield pa.record_batch([part.column("h"), part.column("often"), part.column("n"), pa.array(target), pa.ListArray.from_arrays(edge, pa.array(slot.astype(np.int32))),
                                       pa.ListArray.from_arrays(edge, pa.array(value.astype(np.float32)))],
                                      names=["h", "often", "n", "target", "slots", "shares"])
    known = sample.mapInArrow(describe, "h long, often boolean, n long, target double, slots array<int>, shares array<float>").toArrow()
    known = known.sort_by([("h", "ascending"), ("target", "ascending")])
    lengths = np.asarray(pc.list_value_length(known["slots"])) if known.num_rows else np.empty(0, np.int64)
    if len(lengths) == 0:
        return Scorer(np.zeros(features), 0.0)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    often, n = np.asarray(known["often"]).astype(bool), np.asarray(known["n"]).astype(float)
    weight = np.where(often, n, n * ((counts.sum() - n[often].sum()) / max(1.0, n[~often].sum())))
    slots, shares = (np.asarray(known[c].combine_chunks().flatten()) for c in ("slots", "shares"))
    return Scorer.fit(doc, slots.astype(np.int64), shares.astype(np.float64), np.asarray(known["target"]), features, weight=weight)


def score_quality(docs: DataFrame, scorer: Scorer, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows with ``quality_score`` and ``keep``; columns of these names are replaced."""
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
    new = ("quality_score", "keep")
    rows = docs.drop(*new)
    schema = StructType([*rows.schema.fields, StructField(new[0], DoubleType()), StructField(new[1], BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = sent.value.score(Batch(part.column("text")))
                yield pa.record_batch([*part.columns, pa.array(score), pa.array(score >= keep_from)],
                                      names=[*part.schema.names, *new])
    return rows.mapInArrow(run, schema)
