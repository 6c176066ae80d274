"""Toxicity of whole texts by a recurrent network over overlapping windows.

A window is a run of words; windows overlap, so a phrase at a border stands whole in one of them. A word's input joins two hashed
word vectors (two hashes tell apart words that share one) and the mean of vectors of its character trigrams. Gated recurrent
units read each window in both directions, attention pools their states, and a logistic unit gives the window's probability.
A document's score is that of its worst window. The network is trained here, in numpy, by descent through time.

Labels belong to documents, not windows. So training alternates: score all windows of the training documents, then learn
from the worst window of each document (and, of clean ones, another by chance). It uses at most ``TRAIN_DOCS`` documents of
each label, chosen by the hash of their id; texts are never cut.

Cases: a null or empty text scores 0; if the labels hold one value only or none, every score is 0; identical rows get equal
scores; a null id is kept and counts as not held out; of rows that share an id in the labels, the largest label counts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import (buffer_of, byte_values, first_of_groups, lower_ascii, mix, prefix_hashes, ragged, slices, window_hashes,
                        word_hashes, words_of)

WORDS, STRIDE = 64, 48
#: Sizes: hidden units in a direction, hashed word vectors and their width, trigram vectors and their width, attention.
HIDDEN, WORD_ROWS, WORD_WIDTH, CHAR_ROWS, CHAR_WIDTH, ATTEND = 8, 1 << 15, 6, 1 << 13, 6, 8
INPUT = 2 * WORD_WIDTH + CHAR_WIDTH
#: Training documents of each label at most, rounds, windows in a step of training at most and steps in a round at least.
TRAIN_DOCS, ROUNDS, BATCH, STEPS = 1500, 10, 256, 40


class Texts:
    """Words of a batch of texts: the different ones with their hashed inputs, and the windows as indices into them."""

    def __init__(self, texts: pa.Array):
        data, offsets = buffer_of(texts)
        data = lower_ascii(data)
        starts, ends, first = words_of(data, offsets)
        self.documents = len(first) - 1
        hashes = word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        head = first_of_groups(hashes[order])
        one = order[head]
        self.index = np.empty(len(hashes), dtype=np.int64)
        self.index[order] = np.repeat(np.arange(len(one)), np.diff(np.append(head, len(order))))
        word = hashes[one]
        self.one = (word % np.uint64(WORD_ROWS)).astype(np.int64)
        self.two = (mix(word) % np.uint64(WORD_ROWS)).astype(np.int64)
        # trigrams of the word between blanks
        size = ends[one] - starts[one]
        base = np.cumsum(size + 2) - (size + 2)
        text = np.full(int((size + 2).sum()), 32, dtype=np.uint8)
        text[ragged(base + 1, size)] = data[ragged(starts[one], size)]
        grams = window_hashes(prefix_hashes(byte_values(text)), 3)
        self.gram_count = size
        self.grams = (mix(grams[ragged(base, size)]) % np.uint64(CHAR_ROWS)).astype(np.int64)
        # windows: one every STRIDE words until the end of the document is reached
        n = np.diff(first)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WORDS) // STRIDE)), 0)
        self.window_doc = np.repeat(np.arange(len(n)), count)
        self.window_start = first[:-1][self.window_doc] + STRIDE * ragged(np.zeros(len(n), np.int64), count)
        self.window_size = np.minimum(WORDS, first[1:][self.window_doc] - self.window_start)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word indices (words, windows) and which places are filled."""
        at = self.window_start[which][None, :] + np.arange(WORDS)[:, None]
        filled = np.arange(WORDS)[:, None] < self.window_size[which][None, :]
        return self.index[np.where(filled, at, self.window_start[which][None, :])], filled.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters with forward and backward passes."""

    def __init__(self, seed: int = 6):
        self.rng = rng = np.random.default_rng(seed)

        def normal(*shape):
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        # an input unseen in training adds nothing: vectors start at zero
        self.tables = {"one": np.zeros((WORD_ROWS, WORD_WIDTH), np.float32), "two": np.zeros((WORD_ROWS, WORD_WIDTH), np.float32),
                       "gram": np.zeros((CHAR_ROWS, CHAR_WIDTH), np.float32)}
        self.dense = {"out": normal(2 * HIDDEN), "out_b": np.array([-1.0], np.float32), "attend": normal(2 * HIDDEN, ATTEND),
                      "attend_v": normal(ATTEND)}
        for way in ("f", "b"):
            self.dense |= {f"w{way}": normal(INPUT, 3 * HIDDEN), f"u{way}": normal(HIDDEN, 3 * HIDDEN),
                           f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.seen = {k: np.full(len(v), 1e-6, np.float32) for k, v in self.tables.items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.dense.items()}
        self.steps = 0

    def inputs(self, texts: Texts, which: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of different words."""
        one, two = (texts.one, texts.two) if which is None else (texts.one[which], texts.two[which])
        grams, count = self._grams(texts, which)
        first = np.cumsum(count) - count
        chars = np.add.reduceat(self.tables["gram"][grams], first, axis=0) / count[:, None] if len(count) else np.zeros((0, CHAR_WIDTH))
        return np.concatenate([self.tables["one"][one], self.tables["two"][two], chars.astype(np.float32)], axis=1)

    @staticmethod
    def _grams(texts: Texts, which: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if which is None:
            return texts.grams, texts.gram_count
        first = np.cumsum(texts.gram_count) - texts.gram_count
        return texts.grams[ragged(first[which], texts.gram_count[which])], texts.gram_count[which]

    def _read(self, way: str, gates: np.ndarray, filled: np.ndarray, keep: bool):
        """States after each word in reading order; ``gates`` are the projected inputs."""
        u = self.dense[f"u{way}"]
        steps, windows = filled.shape
        state = np.zeros((windows, HIDDEN), np.float32)
        states = np.empty((steps, windows, HIDDEN), np.float32)
        cache = []
        for t in range(steps):
            x, own = gates[t], state @ u
            zr = _sigmoid(x[:, :2 * HIDDEN] + own[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN:] + r * own[:, 2 * HIDDEN:])
            m = filled[t][:, None]
            following = state + m * (1 - z) * (new - state)
            if keep:
                cache.append((state, z, r, new, own[:, 2 * HIDDEN:], m))
            state = following
            states[t] = state
        return states, cache

    def forward(self, inputs: np.ndarray, index: np.ndarray, filled: np.ndarray, keep: bool = False):
        """Probability of each window."""
        ways, caches = [], []
        for way, turn in (("f", slice(None)), ("b", slice(None, None, -1))):
            projected = inputs @ self.dense[f"w{way}"] + self.dense[f"c{way}"]
            states, cache = self._read(way, projected[index[turn]] if keep else _Rows(projected, index[turn]), filled[turn], keep)
            ways.append(states[turn])
            caches.append(cache)
        states = np.concatenate(ways, axis=2)
        hidden = np.tanh(states @ self.dense["attend"])
        energy = hidden @ self.dense["attend_v"] + (filled - 1) * 1e4
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        chance = _sigmoid(pooled @ self.dense["out"] + self.dense["out_b"][0])
        return chance, (states, hidden, weight, pooled, caches)

    def train(self, texts: Texts, which: np.ndarray, target: np.ndarray, rate: float = 0.02) -> float:
        """One step of descent on some windows; returns the mean loss."""
        index, filled = texts.windows(which)
        words, index = np.unique(index, return_inverse=True)
        index = index.reshape(filled.shape)
        inputs = self.inputs(texts, words)
        # half of the words are seen through their characters alone, so that these learn too
        shown = np.ones_like(inputs)
        shown[:, :2 * WORD_WIDTH] = 2 * (self.rng.random(len(words)) < 0.5)[:, None]
        inputs *= shown
        chance, (states, hidden, weight, pooled, caches) = self.forward(inputs, index, filled, keep=True)
        n = len(which)
        gap = ((chance - target) / n).astype(np.float32)
        grad = {"out": pooled.T @ gap, "out_b": np.array([gap.sum()], np.float32)}
        d_pooled = gap[:, None] * self.dense["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["attend_v"] = np.einsum("tb,tba->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * self.dense["attend_v"] * (1 - hidden**2)
        grad["attend"] = np.einsum("tbh,tba->ha", states, d_hidden)
        d_states = d_states + d_hidden @ self.dense["attend"].T
        d_inputs = np.zeros_like(inputs)
        for k, (way, turn) in enumerate((("f", slice(None)), ("b", slice(None, None, -1)))):
            d_gates, grad[f"u{way}"] = self._back(way, caches[k], d_states[turn][:, :, k * HIDDEN:(k + 1) * HIDDEN])
            flat, at = d_gates.reshape(-1, 3 * HIDDEN), index[turn].ravel()
            per_word = np.stack([np.bincount(at, flat[:, j], minlength=len(words)) for j in range(3 * HIDDEN)], axis=1).astype(np.float32)
            grad[f"w{way}"], grad[f"c{way}"] = inputs.T @ per_word, per_word.sum(axis=0)
            d_inputs += per_word @ self.dense[f"w{way}"].T
        d_inputs *= shown
        self._step(grad, rate)
        self._move("one", texts.one[words], d_inputs[:, :WORD_WIDTH])
        self._move("two", texts.two[words], d_inputs[:, WORD_WIDTH:2 * WORD_WIDTH])
        grams, count = self._grams(texts, words)
        self._move("gram", grams, np.repeat(d_inputs[:, 2 * WORD_WIDTH:] / count[:, None], count, axis=0))
        return float(-np.mean(target * np.log(chance + 1e-9) + (1 - target) * np.log(1 - chance + 1e-9)))

    def _back(self, way: str, cache: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = self.dense[f"u{way}"]
        d_u = np.zeros_like(u)
        d_gates = np.empty((*d_states.shape[:2], 3 * HIDDEN), np.float32)
        d_state = np.zeros(d_states.shape[1:], np.float32)
        for t in range(len(cache) - 1, -1, -1):
            state, z, r, new, own, m = cache[t]
            d = d_state + d_states[t]
            d_new = d * m * (1 - z) * (1 - new**2)
            d_z = -d * m * (new - state) * z * (1 - z)
            d_r = d_new * own * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u += state.T @ d_own
            d_state = d * (1 - m * (1 - z)) + d_own @ u.T
        return d_gates, d_u

    def _step(self, grad: dict, rate: float) -> None:
        """Adam on the dense parameters."""
        self.steps += 1
        for k, g in grad.items():
            m, v = self.moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.dense[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)

    def _move(self, name: str, rows: np.ndarray, grad: np.ndarray, rate: float = 0.3) -> None:
        """Adagrad on the rows of a table, with one sum of squares per row."""
        used, at = np.unique(rows, return_inverse=True)
        total = np.stack([np.bincount(at, grad[:, j], minlength=len(used)) for j in range(grad.shape[1])], axis=1).astype(np.float32)
        self.seen[name][used] += (total**2).sum(axis=1)
        self.tables[name][used] -= rate * total / np.sqrt(self.seen[name][used])[:, None]

    def score_windows(self, texts: Texts, which: np.ndarray) -> np.ndarray:
        inputs = self.inputs(texts)
        out = np.empty(len(which), np.float32)
        for at in range(0, len(which), 2048):
            index, filled = texts.windows(which[at:at + 2048])
            out[at:at + 2048] = self.forward(inputs, index, filled)[0]
        return out

    def score(self, texts: Texts) -> np.ndarray:
        """The score of each text: that of its worst window, 0 without words."""
        out = np.zeros(texts.documents)
        windows = self.score_windows(texts, np.arange(len(texts.window_doc)))
        np.maximum.at(out, texts.window_doc, windows.astype(np.float64))
        return out

    def shipped(self) -> Network:
        """Without what only training needs."""
        self.seen = self.moments = self.rng = None
        return self


class _Rows:
    """Rows of projected inputs, gathered word by word so that no array holds all windows' inputs at once."""

    def __init__(self, values: np.ndarray, index: np.ndarray):
        self.values, self.index = values, index

    def __getitem__(self, t: int) -> np.ndarray:
        return self.values[self.index[t]]


def train(texts: Texts, toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 6) -> Network:
    network, rng = Network(seed), np.random.default_rng(seed)
    doc = texts.window_doc
    label = toxic[doc].astype(np.float32)
    order = np.arange(len(doc))
    for k in range(rounds):
        chance = rng.random(len(doc)) if k == 0 else network.score_windows(texts, order)
        ranked = np.lexsort((-chance, doc))
        worst = ranked[first_of_groups(doc[ranked])]
        if k == 0:  # nothing is known yet: some windows of every document
            mixed = np.lexsort((rng.random(len(doc)), doc))
            rank = np.arange(len(doc)) - np.repeat(first_of_groups(doc[mixed]), np.bincount(doc)[np.unique(doc)])
            chosen = mixed[rank < 6]
        else:
            other = np.lexsort((rng.random(len(doc)), doc))
            other = other[first_of_groups(doc[other])]
            chosen = np.concatenate([worst, other[label[other] == 0]])
        chosen = rng.permutation(chosen)
        size = int(np.clip(len(chosen) // STEPS, 8, BATCH))
        for at in range(0, len(chosen), size):
            part = chosen[at:at + size]
            network.train(texts, part, label[part], rate=0.02 if k < rounds - 2 else 0.005)
    return network


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, train_docs: int = TRAIN_DOCS) -> Network | None:
    """A network trained on labelled documents that are not held out; None if they do not hold both labels."""
    known = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~F.coalesce(held_out, F.lit(False)))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.filter("toxic = 1").orderBy(*by_hash).limit(train_docs).unionByName(
        known.filter("toxic = 0").orderBy(*by_hash).limit(train_docs))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.length("text") > 0).orderBy("doc_id", "text").toArrow()
    toxic = np.asarray(rows["toxic"].combine_chunks()) if rows.num_rows else np.empty(0)
    if len(set(toxic.tolist())) < 2:
        return None
    return train(Texts(rows["text"].combine_chunks()), toxic).shipped()


def score_toxicity(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and toxicity (0 to 1) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=1 << 19):
                model = sent.value
                score = np.zeros(part.num_rows) if model is None else model.score(Texts(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), pa.array(score)], names=["doc_id", "toxicity"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, toxicity double")
