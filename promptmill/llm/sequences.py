"""Hashes over sequences of bytes or words, for many documents at once with numpy.

A batch of documents is one array of elements plus offsets. Prefix polynomial hashes (arithmetic modulo 2**64) give the hash
of any run of elements in constant time, so nothing here loops over elements in Python.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 2**64)
#: One random odd-looking value per byte, so that neighbouring letters have unrelated values.
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEPARATORS = (9, 10, 11, 12, 13, 32)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, np.ndarray] = {}
#: Elements that are hashed or copied at a time where all at once would need several arrays of that length.
STEP = 1 << 18


def _table(base: int, n: int) -> np.ndarray:
    """At least n powers. The longest table so far is kept."""
    held = _TABLES.get(base)
    if held is None or len(held) < n:
        size = -(-max(n, 1 << 16) // (1 << 16)) * (1 << 16)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        _TABLES[base] = np.multiply.accumulate(held, out=held)
    return held


def release_memory() -> None:
    """Give memory that is not used any more back to the system, for the workers that share a machine's."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@functools.lru_cache(maxsize=1)
def _trim():
    import ctypes
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def prefix_hashes(x: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers the first i elements."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.multiply(x, _table(BASE, len(x))[:len(x)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def run_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the elements from start to end, the same wherever the run stands."""
    return (prefix[end] - prefix[start]) * _table(_INVERSE, len(prefix))[start]


def window_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours (runs across documents included: mask them)."""
    m = len(prefix) - n
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = prefix[n:] - prefix[:m]
    out *= _table(_INVERSE, m)[:m]
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an array of texts in one piece, and the offset of each (a null text is empty)."""
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    elif not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the offset of each document's first word. A word is a run of bytes other than
    blank and the controls 9 to 13 (or of those that the table ``inside`` names); it never crosses documents."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = word[edges]
    end[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word (words in the order of their places). A hash does not depend on where the word stands, so stretches of the
    bytes are hashed one after the other."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP, side="right")))
        base = starts[at]
        prefix = prefix_hashes(byte_values(data[base:ends[stop - 1]]))
        out[at:stop] = run_hashes(prefix, starts[at:stop] - base, ends[at:stop] - base)
        at = stop
    return mix(out + (ends - starts).astype(np.uint64))


def valid_runs(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which positions start a run of n elements that ends in the same document (positions that have n elements)."""
    out = np.ones(max(0, total - n + 1), dtype=bool)
    if len(out):
        last = np.minimum(np.diff(offsets), n - 1)
        at = ragged(offsets[1:] - last, last)
        out[at[at < len(out)]] = False
    return out


def window_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbouring grams, the position of its least gram in a pseudo-random order, the leftmost
    of equal ones. The choice depends on the contents of the run alone, so equal runs choose the same place."""
    m = len(grams) - width + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64)
    low = (mix(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low[:m] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _portions(lengths: np.ndarray) -> Iterator[slice]:
    """Neighbouring runs of about ``STEP`` elements together."""
    done = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + STEP, side="right")))
        yield slice(at, stop)
        at = stop


def copy_runs(target: np.ndarray, to: np.ndarray, source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy runs of ``source`` to places of ``target``."""
    for part in _portions(lengths):
        target[ragged(to[part], lengths[part])] = source[ragged(starts[part], lengths[part])]


def fill_runs(target: np.ndarray, starts: np.ndarray, lengths: np.ndarray, value) -> None:
    for part in _portions(lengths):
        target[ragged(starts[part], lengths[part])] = value


def first_of_groups(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in an ordered array."""
    if len(ordered) == 0:
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``budget`` bytes of text each; a longer text is a part of its own. After the last one, memory that
    working on them took is given back."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)
    release_memory()
