"""Fuzzy matches, complete: every pair that reaches the cutoff is found.

Texts that are equal are one text with several rows. Different texts meet in blocks: the rows of a length class (fuzzy pairs) or of a
side (matches across sources) are dealt into blocks of bounded size, and a task holds two blocks. What it compares is cut down
by bounds that cannot lose a pair: the length band, the weight of common tokens, the number of five-character pieces that must
survive the edits a cutoff allows; scores are computed for the rest, on whole texts. The number of block pairs grows with the
square of a length class, as it must for a complete comparison at such cutoffs; ``sample_max`` compares a fixed number of
drawn rows with all others instead, which is linear."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy as fz
from ..session import discard, materialize
from . import lsh, meetings
from .running import running_total
from .sampling import sample_n

#: Bytes of text in a block of a length class and of a side, and the ratio of neighbouring length classes (over 1 / 0.9, so a band touches two of them).
BLOCK_BYTES, SIDE_BYTES = 1 << 20, 512 << 10
LENGTH_STEP = 1.12


def length_band(a: int, b: int) -> bool:
    """Whether the length of b is within a tenth of the length of a."""
    return a > 0 and b > 0 and abs(a - b) / max(a, 1) <= 0.1


def _texts(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Different texts (``id`` of their first row, text) and the rows that hold them (``id``, ``member``)."""
    rows = df.where(F.length(text) > 0).select(F.col(key).cast("bigint").alias("member"), F.col(text).alias("text"))
    keyed = rows.select("member", "text", F.sha2("text", 256).alias("digest"))
    first = materialize(keyed.groupBy("digest").agg(F.min("member").alias("id"), F.any_value("text").alias("text")))
    members = materialize(keyed.select("member", "digest").join(first.select("digest", "id"), "digest").select("id", "member"))
    texts = first.select("id", "text")
    texts._promptmill_path = getattr(first, "_promptmill_path", None)  # for who discards it
    return texts, members


def _blocks(rows: DataFrame, count: str, by: list[str], size: int) -> DataFrame:
    """How many blocks of ``size`` bytes the texts of each class make, and their bytes."""
    total = F.sum(F.octet_length("text"))
    return rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(total / size)).cast("int").alias(count), total.alias("bytes"))


def _met_blocks(score: Callable[[pa.Table], pa.Table]):
    """``score`` over the texts of two blocks that meet, or of one that meets itself (on the left and on the right)."""
    def run(met: Iterator[dict]) -> Iterator[pa.Table]:
        for m in met:
            sides = [m["rows"], m["others"]]
            same = (m["step"], m["block"]) == (m["other_step"], m["other_block"])
            yield score(pa.table({
                "side": np.repeat(np.arange(2, dtype=np.int32), [len(s) for s in sides]), "same": np.full(sum(map(len, sides)), same),
                **{name: pa.chunked_array([s.field(name) for s in sides]) for name in ("id", "text")}}))
    return run


def _home(count: Column | str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(count) if isinstance(count, str) else count).cast("int")


class _Sets:
    """Token sets of a block's texts, with what bounds a score without comparing characters: weights (a token weighs its length and
    one blank), and how often each character and each pair of neighbours inside a token occurs."""

    def __init__(self, rows: list[tuple[int, str]], numbers: dict[str, int]):
        rows = sorted(rows, key=lambda r: (len(r[1]), r[0]))
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.lengths = np.array([len(t) for _, t in rows], dtype=np.int64)
        self.sets = [set(t.split()) for _, t in rows]
        self.words = [sorted(s) for s in self.sets]
        self.tokens = [np.array([numbers.setdefault(w, len(numbers)) for w in s], dtype=np.int64) for s in self.words]
        self.weights = np.array([sum(map(len, s)) + len(s) for s in self.sets], dtype=np.int64)
        self.letters, self.pairs = np.zeros((len(rows), 64), np.int32), np.zeros((len(rows), 512), np.int32)
        for k, s in enumerate(self.sets):
            codes = np.frombuffer(" ".join(s).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            self.letters[k] = np.bincount(codes[codes != 32] % 64, minlength=64)
            inside = (codes[1:] != 32) & (codes[:-1] != 32)
            self.pairs[k] = np.bincount((codes[:-1] * 31 + codes[1:])[inside] % 512, minlength=512)


#: Shares of the sorted tokens of the left and of the right text that are aligned first, and bytes of right texts that are aligned at once.
LEFT_SHARE, RIGHT_SHARE, AT_ONCE = 0.30, 0.34, 8 << 10
#: Letters count as equal if they agree modulo this.
LETTERS = 64


class _Beginnings:
    """The first characters of each text's sorted tokens (a blank after each token), as bits: which of them are a given letter."""

    def __init__(self, sets: _Sets, none: int):
        self.ids, self.sizes, self.masks, self.text, self.bytes = [], [], [], [], []
        for words, tokens, weight in zip(sets.words, sets.tokens, sets.weights.tolist()):
            n = math.ceil(RIGHT_SHARE * weight)
            wide = n // 8 + 1  # at least one bit after the text, where carries end
            ends = np.minimum(np.cumsum([len(w) + 1 for w in words], dtype=np.int64), n)
            sizes = np.diff(ends, prepend=0)
            some = int(np.searchsorted(ends, n)) + 1
            self.ids.append(np.append(tokens[:some], none))
            self.sizes.append(np.append(sizes[:some], wide * 8 - n))
            codes = np.frombuffer("".join(w + " " for w in words[:some])[:n].encode("utf-32-le"), dtype=np.uint32) % LETTERS
            bits = np.zeros((LETTERS, wide * 8), dtype=np.uint8)
            bits[codes, np.arange(n)] = 1
            self.masks.append(np.packbits(bits, axis=1, bitorder="little"))
            self.text.append(np.packbits(np.arange(wide * 8) < n, bitorder="little"))
            self.bytes.append(wide)


def _can_reach(left: _Sets, k: int, right: _Sets, begin: _Beginnings, at: np.ndarray, holders, common: np.ndarray,
               allowed: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the right texts ``at`` have a rest that may be within ``allowed`` edits of left text k's.

    The first third of the left rest is aligned with the beginnings of all right rests at once: these stand in one integer, one bit
    a character, with a gap between texts. Characters of common tokens match nothing, which is as if they were not there. With
    p characters of the left rest done and d more characters in the right one, the whole can have no more in common than
    the p characters have with the first p + d of the right rest, and all characters that the left one has left."""
    tokens, words = left.tokens[k], left.words[k]
    ends = np.cumsum(weight[tokens]).astype(np.int64)
    some = int(np.searchsorted(ends, LEFT_SHARE * ends[-1])) + 1
    inside = np.zeros(len(weight) + 1, dtype=bool)
    inside[tokens], inside[-1] = True, True
    first, owner = holders
    low, count = first[tokens[:some]], first[tokens[:some] + 1] - first[tokens[:some]]
    place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    step, holder = np.repeat(np.arange(some), count), owner[place]
    slot = np.full(len(right.ids), -1, dtype=np.int64)
    wide = np.array([begin.bytes[j] for j in at], dtype=np.int64)
    part = np.cumsum(wide) // AT_ONCE
    good = np.zeros(len(at), dtype=bool)
    for chunk in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
        rows, size = at[chunk], wide[chunk]
        slot[rows] = np.arange(len(rows))
        held = slot[holder] >= 0
        of_step, of_slot = step[held], slot[holder[held]]
        slot[rows] = -1
        kept = np.repeat(~inside[np.concatenate([begin.ids[j] for j in rows])], np.concatenate([begin.sizes[j] for j in rows]))
        masks = np.concatenate([begin.masks[j] for j in rows], axis=1) & np.packbits(kept, bitorder="little")
        text = np.concatenate([begin.text[j] for j in rows])
        full = free = int.from_bytes(text.tobytes(), "little")
        letters: dict[int, int] = {}
        bounds = np.searchsorted(of_step, np.arange(some + 1))
        for s in range(some):
            codes = [ord(c) % LETTERS for c in words[s]] + [32 % LETTERS]
            for c in codes:
                if c not in letters:
                    letters[c] = int.from_bytes(masks[c].tobytes(), "little")
            if bounds[s] == bounds[s + 1]:
                for c in codes:
                    hit = free & letters[c]
                    free = ((free + hit) | (free ^ hit)) & full
            else:  # not for right texts that hold this token too
                apart = np.ones(len(rows), dtype=bool)
                apart[of_slot[bounds[s]:bounds[s + 1]]] = False
                if not apart.any():
                    continue
                other = int.from_bytes(np.repeat(apart * np.uint8(255), size).tobytes(), "little")
                for c in codes:
                    hit = free & letters[c] & other
                    free = ((free + hit) | (free ^ hit)) & full
        matched = np.unpackbits(text & ~np.frombuffer(free.to_bytes(len(text), "little"), dtype=np.uint8), bitorder="little")
        matched, so_far = np.append(0, np.cumsum(matched, dtype=np.int64)), np.append(0, np.cumsum(kept, dtype=np.int64))
        stop = np.cumsum(size) * 8
        start = stop - size * 8
        rest_left, rest_right = left.weights[k] - common[chunk], right.weights[rows] - common[chunk]
        done = ends[some - 1] - np.bincount(of_slot, weight[tokens[of_step]], minlength=len(rows)).astype(np.int64)
        reach = np.maximum(rest_right - rest_left + done, 0)
        there = so_far[stop] - so_far[start]
        until = np.searchsorted(so_far, so_far[start] + np.minimum(reach, there), "left")
        most = matched[np.maximum(until, start)] - matched[start] + np.maximum(reach - there, 0) + rest_left - done
        # both rests end with a blank here, which they have in common and the alignment does not
        good[chunk] = 2 * (most - 1) >= rest_left + rest_right - 2 - allowed[chunk]
    return good


def _score_sets(cutoff: float):
    """Pairs of a left and a right text, or of two texts of one block, whose lengths are close and whose token sets agree.

    The weight of the common tokens comes from inverted lists of the right block, and with it containment and the comparisons of the common
    tokens with either rest. The rests themselves are aligned only where they could still be near enough: one edit changes the
    letters by one and the neighbours inside tokens by three at most, and common tokens cancel out in both counts; what that leaves of
    a left text's partners is aligned in part, all at once."""
    def run(table: pa.Table) -> pa.Table:
        sides: list[list[tuple[int, str]]] = [[], []]
        for side, i, t in zip(*[table[c].to_pylist() for c in ("side", "id", "text")]):
            sides[side].append((i, t))
        one, numbers = table["same"][0].as_py(), {}
        left, right = _Sets(sides[0], numbers), _Sets(sides[1], numbers)
        weight = np.zeros(len(numbers), dtype=np.float64)
        weight[list(numbers.values())] = [len(w) + 1 for w in numbers]
        owner = np.repeat(np.arange(len(right.ids)), [len(t) for t in right.tokens])
        token = np.concatenate(right.tokens) if right.tokens else np.empty(0, np.int64)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        first = np.searchsorted(token, np.arange(len(numbers) + 1))
        begin = _Beginnings(right, len(numbers))
        found = []
        for k in range(len(left.ids)):
            n = left.lengths[k]
            low, high = np.searchsorted(right.lengths, [0.9 * n - 1, n / 0.9 + 1], "left")
            m = right.lengths[low:high + 1]
            base = np.where(left.ids[k] < right.ids[low:high + 1], n, m)
            near = (np.abs(m - n) <= 0.1 * base + 1e-9) & (right.ids[low:high + 1] != left.ids[k])
            if one:
                near &= right.ids[low:high + 1] > left.ids[k]
            at = low + np.flatnonzero(near)
            if not len(at):
                continue
            mine = left.tokens[k]
            count = first[mine + 1] - first[mine]
            place = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            common = np.bincount(owner[place], np.repeat(weight[mine], count), minlength=len(right.ids))[at].astype(np.int64)
            w_a, w_b = left.weights[k], right.weights[at]
            shared = np.maximum(common - 1, 0)
            side_a, side_b = np.maximum(w_a - 1, 0), np.maximum(w_b - 1, 0)
            smaller = np.minimum(side_a, side_b)
            best = np.where(common > 0, 200.0 * shared / np.maximum(smaller + shared, 1), 0.0)
            allowed = (1 - np.maximum(best, cutoff) / 100.0) * (side_a + side_b) + 1e-6
            hopeful = np.abs(w_a - w_b) <= allowed
            apart = np.zeros(len(at), np.int64)
            apart[hopeful] = np.abs(right.letters[at[hopeful]] - left.letters[k]).sum(axis=1)
            hopeful &= apart <= allowed
            apart[hopeful] = np.abs(right.pairs[at[hopeful]] - left.pairs[k]).sum(axis=1)
            hopeful &= apart <= 3 * allowed
            hit = (best >= cutoff - 1e-6) | ((common > 0) & ((common == w_a) | (common == w_b)))
            rest = np.flatnonzero(hopeful & ~hit)
            if len(rest):
                hit[rest] = _can_reach(left, k, right, begin, at[rest], (first, owner), common[rest], allowed[rest], weight)
            for j in at[hit]:
                score = fz.token_set_ratio(left.sets[k], right.sets[j], cutoff)
                if score >= cutoff and length_band(*((n, right.lengths[j]) if left.ids[k] < right.ids[j] else (right.lengths[j], n))):
                    found.append((int(min(left.ids[k], right.ids[j])), int(max(left.ids[k], right.ids[j])), score))
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                         pa.array([f[2] for f in found], pa.float64())], names=["a", "b", "score"])
    return run


#: Counters that tokens are ordered by (a token's is found by its hash), bytes of the texts of a block whose pairs are compared together,
#: and how many pairs, and bytes of partners from other blocks, one task takes of a block.
COUNTERS, PAIR_BLOCK, TASK_PAIRS, TASK_BYTES = 1 << 20, 4 << 20, 1 << 17, 32 << 20
#: How often a round's rare tokens meet an entry of their lists, at most, and what is known of a pair (whether neither text has copies).
ROUND_MEETINGS, SCORED = 64_000_000, "a bigint, b bigint, score double, alone boolean"


def _token_rows(texts: DataFrame) -> DataFrame:
    """id, length, length class, distinct tokens joined by blanks."""
    tokens = F.array_distinct(F.filter(F.split("text", r"(?U)\s+"), lambda t: t != ""))
    step = F.floor(F.ln(F.greatest(F.length("text"), F.lit(1))) / math.log(LENGTH_STEP)).cast("int")
    return texts.select("id", F.length("text").alias("n"), step.alias("step"), F.array_join(tokens, " ").alias("tokens"))


def _hashed(rows: DataFrame) -> DataFrame:
    """With the tokens' hashes and weights (a token weighs its length and one blank), which are not kept: they take more than the texts."""
    tokens = F.filter(F.split("tokens", " "), lambda t: t != "")
    return rows.select("id", "n", "step", F.transform(tokens, lambda t: F.xxhash64(t)).alias("hashes"),
                       F.transform(tokens, lambda t: F.length(t) + 1).alias("weights"))


def _rare_tokens(often, share: float):
    """Each text's tokens that others have, the rarest first, with the weight of those before; which of them are among those that a text may not do without."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            sizes = np.diff(np.asarray(lists.offsets))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            token, weight = np.asarray(lists.flatten()), np.asarray(batch.column("weights").flatten()).astype(np.int64)
            count = often.value[token & (COUNTERS - 1)]
            order = np.lexsort((token, count, owner))
            token, weight, count = token[order], weight[order], count[order]
            total = np.bincount(owner, weight, minlength=len(sizes)).astype(np.int64)
            before = np.cumsum(weight) - weight - np.repeat(np.cumsum(total) - total, sizes)
            shared = np.flatnonzero(count > 1)
            at = owner[shared]
            yield pa.record_batch([
                *(pa.array(np.asarray(batch.column(c))[at]) for c in ("id", "n", "step")), pa.array(total[at]), pa.array(token[shared]),
                pa.array(before[shared]), pa.array(before[shared] <= (total[at] - 1) * share + 1e-6)],
                names=["id", "n", "step", "weight", "token", "before", "needed"])
    return run


def _often(rows: DataFrame):
    """How many tokens have each counter, for all tasks."""
    slot = F.transform("hashes", lambda h: h.bitwiseAND(F.lit(COUNTERS - 1)))
    counted = _hashed(rows).select(F.explode(slot).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toArrow()  # at most COUNTERS rows
    often = np.zeros(COUNTERS, dtype=np.int64)
    often[np.asarray(counted["slot"])] = np.asarray(counted["n"])
    return rows.sparkSession.sparkContext.broadcast(often)


def _listed(rows: DataFrame, cutoff: float, often) -> DataFrame:
    c = cutoff / 100.0
    return _hashed(rows).mapInArrow(
        _rare_tokens(often, (2 - 2 * c) / (2 - c)), "id bigint, n int, step int, weight bigint, token bigint, before bigint, needed boolean")


def _rounds(rows: DataFrame, cutoff: float, often) -> list[tuple[int, int, int, int]]:
    """Length classes from and to, part and number of parts of the rounds that pairs are formed in: ``ROUND_MEETINGS`` entries of lists and
    meetings of a probe with an entry at most, or a part of the probes of one class."""
    held = materialize(_listed(rows, cutoff, often).groupBy("token", "step").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("needed"), 1)).alias("asked")))
    asked = held.where("asked > 0").select("token", F.col("step").alias("of"), "asked", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    met = asked.join(held.select("token", "step", "n"), ["token", "step"]).select("of", (F.col("asked") * F.col("n")).alias("met"))
    entries = held.select(F.col("step").alias("of"), (3 * F.col("n")).alias("met"))  # in the lists of its own round and of neighbours
    steps = sorted(map(tuple, met.unionByName(entries).groupBy("of").agg(F.sum("met")).collect()))  # a row per length class
    discard(held)
    rounds, first, total = [], None, 0
    for step, n in steps:
        if first is not None and total + n > ROUND_MEETINGS:
            rounds.append((first[0], first[1], total))
            first, total = None, 0
        first, total = (step if first is None else first[0], step), total + n
    if first is not None:
        rounds.append((*first, total))
    return [(low, high, part, -(-n // ROUND_MEETINGS)) for low, high, n in rounds for part in range(-(-n // ROUND_MEETINGS))]


def _candidates(rows: DataFrame, cutoff: float, often=None, part: int = 0, parts: int = 1, low: int | None = None, high: int | None = None) -> DataFrame:
    """``a, b``: pairs of near length that have a token in common, rare in both: to reach the cutoff with c = cutoff / 100, the tokens that the
    lighter text does not share may weigh (2 - 2c) / (2 - c) of it at most, and those that the other does not share what it weighs
    beyond c / (2 - c) of the lighter one. Of the common tokens the rarest has no more than that before it in either text. ``part`` and the
    length classes say which texts are the lighter ones."""
    c = cutoff / 100.0
    every = _listed(rows, cutoff, often or _often(rows))
    mine = F.col("needed") & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
    if low is not None:
        mine &= F.col("step").between(low, high)
    probes = every.where(mine).select(F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("weight").alias("w_x"), "token",
                                      F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    lists = every.select(F.col("id").alias("y"), F.col("n").alias("n_y"), F.col("weight").alias("w_y"), "before", "token", "step")
    first = F.when(F.col("x") < F.col("y"), F.col("n_x")).otherwise(F.col("n_y"))
    lighter = (F.col("w_x") < F.col("w_y")) | ((F.col("w_x") == F.col("w_y")) & (F.col("x") < F.col("y")))
    enough = F.col("before") <= (F.col("w_y") - 1) - (F.col("w_x") - 1) * (c / (2 - c)) + 1e-6
    met = probes.join(lists, ["token", "step"]).where(
        lighter & enough & (F.abs(F.col("n_x") - F.col("n_y")) <= 0.1 * first + 1e-9))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _homes(rows: DataFrame) -> DataFrame:
    """The block of each text that is the first of a pair. Blocks hold neighbouring lengths, so the many partners of like texts
    are in few blocks and are sent to few; many texts of one length are dealt on by id."""
    by_length = materialize(rows.groupBy("n").agg(F.sum(F.octet_length("tokens") + 1).alias("bytes")))  # a row per length
    first = running_total(by_length, ["bytes"], ["n"]).select(
        "n", F.floor(F.col("bytes_before") / PAIR_BLOCK).alias("block"), F.ceil(F.col("bytes") / PAIR_BLOCK).alias("share"))
    return materialize(rows.select("id", "n", "step").join(materialize(first), "n").select(
        F.col("id").alias("a"), (F.col("block") * (1 << 20) + F.pmod(F.xxhash64("id"), "share")).alias("block"), "step"))


def _by_block(rows: DataFrame, homes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the block of their first text and a part of it."""
    sized = materialize(pairs.join(homes.select("a", "block"), "a").join(rows.select(F.col("id").alias("b"), F.col("n").alias("size")), "b"))
    partners = sized.groupBy("block", "b").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    shares = materialize(partners.groupBy("block").agg(F.greatest(F.ceil(F.sum("n") / TASK_PAIRS), F.ceil(F.sum("size") / TASK_BYTES)).alias("share")))
    dealt = materialize(sized.join(shares, "block").select("block", F.pmod(F.xxhash64("b"), "share").alias("part"), "a", "b"))
    discard(sized)
    discard(shares)
    return dealt


def _score_shared(cutoff: float):
    """Scores of the pairs of a part from the weight of their common tokens."""
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets = {i: set(t.split(" ")) for i, t in zip(texts["id"].to_pylist(), texts["tokens"].to_pylist())}
        weights = {i: len("".join(s)) + len(s) for i, s in sets.items()}
        alone = dict(zip(texts["id"].to_pylist(), texts["alone"].to_pylist()))
        found = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            both = sets[a] & sets[b]
            if not both:
                continue
            common, w_a, w_b = len("".join(both)) + len(both), weights[a], weights[b]
            score = 100.0 if common in (w_a, w_b) else 200.0 * (common - 1) / (min(w_a, w_b) - 1 + common - 1)
            if score >= cutoff:
                found.append((a, b, score, alone[a] and alone[b]))
        return pa.table([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.bool_()))],
                        names=["a", "b", "score", "alone"])
    return run


def shared_token_pairs(df: DataFrame, key: str = "row_id", text: str = "prompt", cutoff: float = 90.0, copies: bool = True) -> DataFrame:
    """``id_a, id_b, score``: all pairs of rows whose lengths are close and whose common tokens reach the cutoff against the smaller of
    both token sets (100 where that is contained in the other). These are the pairs of :func:`fuzzy_pairs` that need no
    alignment of characters.

    No pair is formed without a common token that is rare in both texts; adaptive execution splits the lists of frequent ones. Pairs are
    ids until they are compared, in blocks to which each text that takes part is sent once, not once a pair. They are formed in rounds of
    a bounded number of meetings, each of which leaves its scored pairs on disk and nothing else."""
    texts, members = _texts(df.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != ""), key, text)
    alone = members.groupBy("id").agg((F.count("*") == 1).alias("alone"))
    rows = materialize(_token_rows(texts).where(F.col("tokens") != "").join(alone, "id").sort("step", "id"))
    discard(texts)
    often, homes = _often(rows), _homes(rows)
    scored = [_scored_round(rows, homes, cutoff, often, *one) for one in _rounds(rows, cutoff, often)]
    scored = functools.reduce(DataFrame.unionByName, scored or [rows.sparkSession.createDataFrame([], SCORED)])
    if not copies:
        return scored.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "score")
    plain = scored.where("alone").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "score")
    return plain.unionByName(_with_copies(scored.where("NOT alone").drop("alone"), members, cutoff))


def _scored_round(rows: DataFrame, homes: DataFrame, cutoff: float, often, low: int, high: int, part: int, parts: int) -> DataFrame:
    """The pairs whose lighter text is in the classes and the part. What forming them takes on disk goes with the round."""
    near = F.col("step").between(low - 1, high + 1)
    rows, homes = rows.where(near), homes.where(near)
    pairs = _by_block(rows, homes, _candidates(rows, cutoff, often, part, parts, low, high))
    asked = (pairs.select(F.col("block").alias("to_block"), F.col("part").alias("to_part"), F.explode(F.array("a", "b")).alias("id")).distinct()
             .join(rows.select("id", "tokens", "alone"), "id"))
    scored = materialize(pairs.groupBy("block", "part").cogroup(asked.groupBy("to_block", "to_part")).applyInArrow(_score_shared(cutoff), SCORED))
    discard(pairs)
    return scored


def _with_copies(pairs: DataFrame, members: DataFrame, cutoff: float) -> DataFrame:
    """From pairs of texts to pairs of rows; rows with one text pair with a score of 100."""
    left, right = members.toDF("a", "id_1"), members.toDF("b", "id_2")
    between = pairs.join(left, "a").join(right, "b").select("id_1", "id_2", "score")
    inside = left.join(right.withColumnRenamed("b", "a"), "a").where("id_1 < id_2").select("id_1", "id_2", F.lit(100.0).alias("score"))
    return between.unionByName(inside).select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"), "score")


def fuzzy_pairs(df: DataFrame, key: str = "row_id", text: str = "prompt", sample_max: int | None = None,
                cutoff: float = 90.0, seed: int = 42, copies: bool = True) -> DataFrame:
    """``id_a, id_b, score``: all pairs of rows whose lengths are close and whose token-set ratio reaches the cutoff, ``id_a``
    < ``id_b``, each pair once. ``sample_max`` keeps the pairs with at least one of that many drawn rows. ``copies=False`` gives
    pairs of different texts, each named by its first row."""
    texts, members = _texts(df.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != ""), key, text)
    step = F.floor(F.ln(F.length("text")) / math.log(LENGTH_STEP)).cast("int")
    rows = texts.withColumn("step", step)
    counts = materialize(_blocks(rows, "n", ["step"], BLOCK_BYTES))
    probes = None
    if sample_max is not None:
        drawn = sample_n(df.where(F.length(text) > 0).select(key), key, sample_max, seed).select(F.col(key).cast("bigint").alias("member"))
        probes = materialize(drawn)
    blocks = meetings.packed(rows.join(counts, "step").withColumn("block", _home("n")), ["step", "block"], ["id", "text"])
    others = blocks.toDF("other_step", "other_block", "others")
    # pairs of two blocks of one class are met once; a left block of a class meets all right blocks of the class above
    met = (((F.col("step") == F.col("other_step")) & (F.col("block") <= F.col("other_block")))
           | (F.col("step") + 1 == F.col("other_step")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    pairs = meetings.meet(blocks, others, total["n"] or 1, total["bytes"] or 0, met, _met_blocks(_score_sets(cutoff)),
                          "a bigint, b bigint, score double").distinct()
    if not copies:
        return pairs.toDF("id_a", "id_b", "score")
    found = _with_copies(pairs, members, cutoff)
    if probes is None:
        return found
    drawn_a = found.join(probes.withColumnRenamed("member", "id_a"), "id_a", "left_semi")
    drawn_b = found.join(probes.withColumnRenamed("member", "id_b"), "id_b", "left_semi")
    return drawn_a.unionByName(drawn_b).distinct()


def fuzzy_counts(df: DataFrame, by: str = "source", key: str = "row_id", text: str = "prompt", cutoff: float = 90.0) -> DataFrame:
    """``by, fuzzy_pairs``: how many of ``fuzzy_pairs`` have both rows in one group. Copies are counted, not paired."""
    said = F.trim(F.regexp_replace(text, r"\s+", " ")) != ""
    held = materialize(df.groupBy(by, F.sha2(text, 256).alias("digest")).agg(
        F.count(F.when(said, 1)).alias("n"), F.min(F.col(key).cast("bigint")).alias("first")))
    ids = held.groupBy("digest").agg(F.min("first").alias("id"))
    sizes = materialize(held.join(ids, "digest").select(by, "id", "n"))
    between = (fuzzy_pairs(df, key, text, cutoff=cutoff, copies=False).join(sizes.toDF(by, "id_a", "n_a"), "id_a")
               .join(sizes.toDF(by, "id_b", "n_b"), [by, "id_b"]).select(by, (F.col("n_a") * F.col("n_b")).alias("n")))
    inside = held.select(by, F.expr("n * (n - 1) div 2").alias("n"))
    return inside.unionByName(between).groupBy(by).agg(F.sum("n").alias("fuzzy_pairs"))


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    keys = [c for c in pairs.columns if c.startswith("id_")]
    return pairs.orderBy(F.desc("score"), *keys).limit(n)


class _Pieces:
    """Inverted lists of all pieces of a block's texts: sorted codes, with the text and place of each."""

    def __init__(self, texts: list, size: int):
        self.size, self.sizes = size, np.array([len(t.text) for t in texts], dtype=np.int64)
        codes = [fz.piece_codes(t.text, size) for t in texts]
        every = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        counts = np.array([len(c) for c in codes], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(every, kind="stable")
        self.codes, self.owner, self.place = every[order], owner[order], place[order]


def _survivors(short: list, long: list, cutoff: float) -> list[tuple[int, int]]:
    """Pairs (short, long) that the pieces leave: cut into pieces of five characters (four, if the text is too short for that), all but as
    many of the shorter text's pieces as the cutoff allows edits stand in the longer one, shifted by no more than that number. Only the
    pieces with the shortest lists are looked up, half of the spare ones beyond the number of edits. Their shifts fall into two neighbouring
    classes; where these hold enough of them, they are counted for every start of a window."""
    out = []
    indexes = [_Pieces(long, size) for size in (fz.PIECE, fz.SHORT_PIECE)]
    sizes = indexes[0].sizes
    for k, t in enumerate(short):
        n = len(t.text)
        fits = sizes >= n
        if not fits.any():
            continue
        slack = int(2 * (1 - cutoff / 100.0) * n + 1e-9)
        for index in indexes:
            pieces = fz.piece_codes(t.text, index.size)[::index.size]
            spare = len(pieces) - slack
            if spare <= 0:
                continue
            needed = max(1, spare // 2)
            low, high = np.searchsorted(index.codes, pieces, "left"), np.searchsorted(index.codes, pieces, "right")
            rarest = np.argsort(high - low, kind="stable")[:slack + needed]
            low, count = low[rarest], (high - low)[rarest]
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            owner, piece = index.owner[at], np.repeat(rarest, count)
            mine = fits[owner]
            at, owner, piece = at[mine], owner[mine], piece[mine]
            shift = index.place[at] - piece * index.size + n
            width = 2 * slack + 1
            classes = (int(sizes.max()) + n) // width + 2
            cell, hits = np.unique(owner * classes + shift // width, return_counts=True)
            if len(cell):
                hits[:-1] += np.where(cell[1:] == cell[:-1] + 1, hits[1:], 0)  # a shift's class with the one above
            enough = np.zeros(len(long), dtype=bool)
            enough[cell[hits >= needed] // classes] = True
            fits &= enough
            if fits.any():
                asked = np.flatnonzero(fits)
                fits[asked] = _most_pieces(asked, sizes, n, slack, owner, piece, shift) >= needed
            break
        out += [(k, int(j)) for j in np.flatnonzero(fits)]
    return out


def _most_pieces(asked: np.ndarray, sizes: np.ndarray, n: int, slack: int, owner: np.ndarray, piece: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The most pieces that any start of a window in each text ``asked`` finds within ``slack`` of its shift. The finds come by piece, then by
    text and place; where two of a piece overlap in a text the later one begins after the earlier, so that it counts once a start."""
    slot = np.full(len(sizes), -1, dtype=np.int64)
    slot[asked] = np.arange(len(asked))
    mine = slot[owner] >= 0
    owner, piece, shift = slot[owner[mine]], piece[mine], shift[mine]
    begin = shift - slack
    same = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
    begin[1:][same] = np.maximum(begin[1:][same], shift[:-1][same] + slack + 1)
    size = n + sizes[asked] + 1
    base = np.cumsum(size + 1) - (size + 1)
    total, last = int((size + 1).sum()), size[owner]
    opened = np.bincount(base[owner] + np.clip(begin, 0, last), minlength=total)
    closed = np.bincount(base[owner] + np.clip(shift + slack + 1, 0, last), minlength=total)
    return np.maximum.reduceat(np.cumsum(opened - closed), base)


def _score_parts(cutoff: float):
    def run(table: pa.Table) -> pa.Table:
        sides = [[], []]
        for side, i, t in zip(*[table[c].to_pylist() for c in ("side", "id", "text")]):
            sides[side].append((i, fz.SearchText(t)))
        left, right = sides
        l_texts, r_texts = [t for _, t in left], [t for _, t in right]
        pairs = set(_survivors(l_texts, r_texts, cutoff))
        pairs |= {(a, b) for b, a in _survivors(r_texts, l_texts, cutoff)}
        found = []
        for a, b in sorted(pairs):
            score = fz.partial_ratio(l_texts[a], r_texts[b], cutoff)
            if score >= cutoff:
                found.append((left[a][0], right[b][0], score))
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                         pa.array([f[2] for f in found], pa.float64())], names=["a", "b", "score"])
    return run


def cross_source_matches(left: DataFrame, right: DataFrame, key: str = "row_id", text: str = "prompt",
                         sample_max: int | None = None, cutoff: float = 92.0, shown: int = 120, seed: int = 42) -> DataFrame:
    """All matches between two tables by best-substring ratio. Whole texts are compared; only the copies in the result are cut
    for display. ``sample_max`` draws that many rows of the left table."""
    if sample_max is not None:
        left = sample_n(left.where(F.length(text) > 0), key, sample_max, seed)
    (l_texts, l_members), (r_texts, r_members) = _texts(left, key, text), _texts(right, key, text)
    l_size, r_size = (_blocks(t, "n", [], SIDE_BYTES).first() for t in (l_texts, r_texts))

    def blocks(texts: DataFrame, side: int, n: int) -> DataFrame:
        return meetings.packed(texts.withColumn("step", F.lit(side)).withColumn("block", _home(F.lit(n))), ["step", "block"], ["id", "text"])
    pairs = materialize(meetings.meet(
        blocks(l_texts, 0, l_size["n"] or 1), blocks(r_texts, 1, r_size["n"] or 1).toDF("other_step", "other_block", "others"),
        l_size["n"] or 1, r_size["bytes"] or 0, None, _met_blocks(_score_parts(cutoff)), "a bigint, b bigint, score double"))
    shown_left = l_texts.select(F.col("id").alias("a"), F.substring("text", 1, shown).alias("left_text"))
    shown_right = r_texts.select(F.col("id").alias("b"), F.substring("text", 1, shown).alias("right_text"))
    return (pairs.join(shown_left, "a").join(shown_right, "b").join(l_members.toDF("a", "id_left"), "a")
            .join(r_members.toDF("b", "id_right"), "b").select("id_left", "id_right", "score", "left_text", "right_text"))


def token_set_score(a, b):
    """Token-set ratio of two text columns, as a column."""
    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([fz.token_set_ratio(set((s or "").split()), set((t or "").split())) for s, t in zip(x, y)])
    return score(a, b)


def partial_score(a, b, cutoff: float = 0.0):
    """Best-substring ratio of two text columns, as a column."""
    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([fz.partial_ratio(fz.SearchText(s or ""), fz.SearchText(t or ""), cutoff)
                          for s, t in zip(x, y)])
    return score(a, b)


def fuzzy_star_pairs(df: DataFrame, key: str = "row_id", text: str = "prompt", cutoff: float = 90.0) -> DataFrame:
    """A cheap look at a large table: every row against the centres of its near-duplicate clusters only. Linear, but not complete:
    two members of a cluster are not compared, nor rows that share no band (``fuzzy_pairs`` finds those too)."""
    stars = lsh.near_duplicate_clusters(df, key, text).where("cluster <> member")
    texts = df.select(F.col(key).alias("member"), F.col(text).alias("text"))
    # Cluster centres are few per member, and a member's text is joined once per cluster it is in.
    pairs = (stars.join(texts, "member")
             .join(texts.toDF("cluster", "centre_text"), "cluster"))
    size, centre = F.length("text"), F.length("centre_text")
    first = F.when(F.col("cluster") < F.col("member"), centre).otherwise(size)
    near = F.abs(size - centre) <= first * 0.1
    return (pairs.where(near & (size > 0) & (centre > 0))
            .select(F.least("cluster", "member").alias("id_a"), F.greatest("cluster", "member").alias("id_b"),
                    token_set_score(F.col("centre_text"), F.col("text")).alias("score"))
            .where(F.col("score") >= cutoff).distinct())


