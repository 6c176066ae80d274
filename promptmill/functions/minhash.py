"""MinHash signatures, computed over Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

EMPTY = np.iinfo(np.int64).max
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit word (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    odd = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, count, dtype=np.uint64)


def _signatures(rows: list[np.ndarray], count: int) -> list[np.ndarray]:
    """Minimum of each permuted hash over the shingles of each row."""
    out = np.full((len(rows), count), EMPTY, dtype=np.int64)
    filled = [i for i, r in enumerate(rows) if len(r)]
    if filled:
        starts = np.cumsum([0] + [len(rows[i]) for i in filled[:-1]])
        shingles = _mix(np.concatenate([rows[i] for i in filled]))
        factors, shifts = _permutations(count)
        for p in range(count):
            low = np.minimum.reduceat(shingles * factors[p] + shifts[p], starts)
            out[filled, p] = (low >> np.uint64(1)).astype(np.int64)
    return list(out)


def _window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` neighbouring tokens; a shorter row is one run."""
    if len(tokens) == 0:
        return tokens
    n = min(n, len(tokens))
    acc = np.zeros(len(tokens) - n + 1, dtype=np.uint64)
    for k in range(n):
        acc = _mix((acc + GOLDEN) ^ tokens[k:len(tokens) - n + 1 + k])
    return acc


def _chunks(series: pd.Series, budget: int = 2_000_000) -> Iterator[list]:
    """Rows in groups of bounded total length, so that long texts do not pile up in one array."""
    chunk, size = [], 0
    for item in series:
        chunk.append(item)
        size += 0 if item is None else len(item)
        if size >= budget:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def word_minhash(c, num_perm: int = 128, n: int = 3) -> Column:
    """Signature over word n-grams of the normalised text. Tokens are split and hashed in the JVM."""
    @F.pandas_udf("array<bigint>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for chunk in _chunks(batch):
                rows = [np.empty(0, np.uint64) if t is None else
                        _window_hashes(np.asarray(t, dtype=np.int64).view(np.uint64), n) for t in chunk]
                out += _signatures(rows, num_perm)
            yield pd.Series(out)
    tokens = tx.ws_tokens(F.lower(F.col(c) if isinstance(c, str) else c))
    return signature(F.transform(tokens, lambda t: F.xxhash64(t)))


def char_minhash(c, num_perm: int = 64, k: int = 5) -> Column:
    """Signature over character k-grams of a text."""
    @F.pandas_udf("array<bigint>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for chunk in _chunks(batch):
                codes = [np.frombuffer((t or "").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) for t in chunk]
                out += _signatures([_window_hashes(x, k) for x in codes], num_perm)
            yield pd.Series(out)
    return signature(F.col(c) if isinstance(c, str) else c)


def band_plan(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows per band) for which the collision curve 1 - (1 - s^r)^b errs least around the
    threshold: area above the curve right of it plus area below the curve left of it."""
    s = (np.arange(2000) + 0.5) / 2000
    left = s < threshold
    best = None
    for rows in range(1, num_perm + 1):
        for bands in range(1, num_perm // rows + 1):
            hit = 1 - (1 - s**rows)**bands
            error = (hit[left].sum() + (1 - hit[~left]).sum()) / len(s)
            if best is None or error < best[0]:
                best = (error, bands, rows)
    return best[1], best[2]


def band_keys(signature, bands: int, rows: int) -> Column:
    """One 64-bit key per band; the band number is part of the key."""
    sig = F.col(signature) if isinstance(signature, str) else signature
    return tx.let(sig, lambda v: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                                             lambda b: F.xxhash64(b, F.slice(v, b * rows + 1, rows))))
