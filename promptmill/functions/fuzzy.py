"""Scores of two short texts: longest common subsequence, token-set ratio, best-substring ratio. Small
helpers for the tasks of :mod:`promptmill.operators.fuzzy`; 100 means equal."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def lcs_length(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``. As soon as the rests of ``a`` and ``b`` cannot bring it to
    ``least`` any more, what there is is returned."""
    where: dict[str, int] = {}
    codes = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32)
    for ch in set(a):
        where[ch] = int.from_bytes(np.packbits(codes == ord(ch), bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    free = full
    for at in range(0, len(b), 128):
        for ch in b[at:at + 128]:
            hit = free & where.get(ch, 0)
            free = ((free + hit) | (free - hit)) & full
        # a character of ``a`` that lies so far on that the rest of ``b`` is longer than what follows it can help no more than one of that rest
        rest = len(b) - at - 128
        early = full >> min(max(rest, 0), len(a))
        if rest > 0 and early.bit_count() - (free & early).bit_count() + rest < least:
            break
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 100.0 if size == 0 else 200.0 * lcs_length(a, b) / size


def token_set_ratio(a: set[str], b: set[str], cutoff: float = 0.0) -> float:
    """Compare token sets: 100 when one contains the other, else the best of three ratios between the
    common tokens, the common tokens with the rest of a, and the common tokens with the rest of b. Below the cutoff the
    value may be too low (the common subsequence of the rests is given up as soon as it cannot matter)."""
    if not a or not b:
        return 0.0
    common, only_a, only_b = a & b, a - b, b - a
    if common and (not only_a or not only_b):
        return 100.0
    shared = len(" ".join(common))
    gap = 1 if common else 0
    rest_a, rest_b = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    side_a, side_b = shared + gap + len(rest_a), shared + gap + len(rest_b)
    best = 0.0
    if common:
        for side in (side_a, side_b):
            best = max(best, 100.0 * (1 - (side - shared) / (side + shared)))
    # Both strings start with the common part, so only the rests can differ.
    allowed = (1 - max(best, cutoff) / 100.0) * (side_a + side_b)
    least = int((len(rest_a) + len(rest_b) - allowed) / 2)
    if min(len(rest_a), len(rest_b)) >= least:
        apart = len(rest_a) + len(rest_b) - 2 * lcs_length(rest_a, rest_b, least)
        best = max(best, 100.0 * (1 - apart / (side_a + side_b)))
    return best


PIECE, SHORT_PIECE = 5, 4


def piece_codes(text: str, size: int = PIECE) -> np.ndarray:
    """One integer per run of ``size`` characters."""
    x = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(x) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc = acc * np.uint64(1_000_003) + x[k:k + n]
    return acc


class SearchText:
    """A text with an index of its character runs."""

    __slots__ = ("text", "codes", "order", "sorted")

    def __init__(self, text: str):
        self.text = text
        self.codes = piece_codes(text)
        self.order = np.argsort(self.codes, kind="stable")
        self.sorted = self.codes[self.order]


def _starts(short: SearchText, long: SearchText, cutoff: float) -> tuple[np.ndarray, int]:
    """Window starts that can reach the cutoff, and which of them looks best. A window that does differs from the short text by at most
    ``slack`` insertions and deletions; cut into pieces of five characters, all but ``slack`` pieces of the
    short text are found in the window unharmed and shifted by no more than ``slack``."""
    n, m = len(short.text), len(long.text)
    every = np.arange(-n + 1, m)
    slack = int(2 * (1 - cutoff / 100.0) * n + 1e-9)
    pieces = short.codes[::PIECE]
    if slack == 0:
        # No edit is allowed: only the text itself will do.
        at = long.text.find(short.text)
        return np.array([at] if at >= 0 else [], dtype=np.int64), 0
    needed = len(pieces) - slack
    if needed <= 0:
        if int((1 - cutoff / 100.0) * n + 1e-9) == 0:
            # a whole window has as many insertions as deletions, none here: only windows that the ends of the long text cut short
            every = every[(every < 0) | (every > m - n)]
        return every, 0
    left = np.searchsorted(long.sorted, pieces, "left")
    found = np.searchsorted(long.sorted, pieces, "right") - left
    if np.count_nonzero(found) < needed:
        return every[:0], 0
    owner = np.repeat(np.arange(len(pieces)), found)
    first = np.repeat(left - np.concatenate(([0], np.cumsum(found)[:-1])), found)
    shift = long.order[np.arange(len(owner)) + first] - owner * PIECE + n
    # Every find allows the starts within `slack` of its shift. The finds of a piece come in rising order,
    # so where two of them overlap the later one begins after the earlier: a piece counts once per start.
    begin = shift - slack
    same = owner[1:] == owner[:-1]
    begin[1:][same] = np.maximum(begin[1:][same], shift[:-1][same] + slack + 1)
    size = n + m + 1
    opened = np.bincount(np.clip(begin, 0, size), minlength=size + 1)
    closed = np.bincount(np.clip(shift + slack + 1, 0, size), minlength=size + 1)
    per_start = np.cumsum(opened - closed)
    starts = every[per_start[every + n] >= needed]
    if len(starts) == 0:
        return starts, 0
    # unharmed pieces stand in the window one after the other: runs of neighbouring starts need a rising row of finds
    place = long.order[np.arange(len(owner)) + first]
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    kept = []
    for run in np.split(starts, cut):
        near = (shift - n >= run[0] - slack) & (shift - n <= run[-1] + slack)
        if _rising(owner[near], place[near]) >= needed:
            kept.append(run)
    starts = np.concatenate(kept) if kept else starts[:0]
    if len(starts) == 0:
        return starts, 0
    # a find speaks for the starts on both sides of its own: the middle of those with most
    most = np.flatnonzero(per_start[starts + n] == per_start[starts + n].max())
    return starts, int(most[len(most) // 2])


def _rising(piece: np.ndarray, place: np.ndarray) -> int:
    """Length of the longest row of finds with rising pieces and rising places (one find a piece)."""
    tails: list[int] = []
    for at in place[np.lexsort((-place, piece))].tolist():
        k = bisect_left(tails, at)
        if k == len(tails):
            tails.append(at)
        else:
            tails[k] = at
    return len(tails)


def window_lcs(a: str, b: str) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with all windows of ``b`` that are as long, from the one that ends after the first
    character of ``b`` to the one that begins with its last, all from one comb: a strand begins at each character of either text; at
    each pair of characters two strands meet, and change sides if the characters agree or if they have crossed before. A window's length
    less its strands that pass from top to bottom inside it is what the window has in common with ``a``. The pairs of a
    diagonal are independent and combed at once."""
    n, m = len(a), len(b)
    left = np.frombuffer(a[::-1].encode("utf-32-le"), dtype=np.uint32)
    top = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    side, down = np.arange(n, dtype=np.int32), np.arange(n, n + m, dtype=np.int32)
    for d in range(n + m - 1):
        last = min(n - 1, d)
        size = last - max(0, d - m + 1) + 1
        h, j = n - 1 - last, d - last
        x, y = side[h:h + size], down[j:j + size]
        turn = (left[h:h + size] == top[j:j + size]) | (x > y)
        moved = np.where(turn, y, x)
        down[j:j + size] = np.where(turn, x, y)
        side[h:h + size] = moved
    end = np.flatnonzero(down >= n)
    begin = down[end] - n
    # window i (from -n + 1 on) holds the strands with begin >= i and end < i + n
    first, stop = np.maximum(end - n + 1, -n + 1), begin + 1
    inside = first < stop
    change = np.bincount(first[inside] + n - 1, minlength=n + m) - np.bincount(stop[inside] + n - 1, minlength=n + m)
    starts = np.arange(-n + 1, m)
    return np.minimum(starts + n, m) - np.maximum(starts, 0) - np.cumsum(change)[:n + m - 1]


#: Windows that are compared one by one before all are.
ONE_BY_ONE = 24


def _best_window(short: SearchText, long: SearchText, cutoff: float) -> float:
    s, t = short.text, long.text
    if s in t:
        return 100.0
    n, best = len(s), 0.0
    starts, likely = _starts(short, long, cutoff)
    if len(starts) == 0:
        return 0.0

    def score(i: int) -> int:
        """How many starts to the next window that could be better than the best so far, on either side: one step changes the common
        length and the window length by one at most."""
        nonlocal best
        window = t[max(i, 0):i + n]
        common = lcs_length(s, window)
        best = max(best, 200.0 * common / (n + len(window)))
        goal = max(cutoff, best) / 200.0
        return max(1, int((goal * (n + len(window)) - common) / (1 + goal)))
    # from the window that most pieces speak for to both sides, where the scores fall and the steps grow
    step, tried = score(int(starts[likely])), 1
    for side, order in ((1, starts[likely + 1:]), (-1, starts[:likely][::-1])):
        due = starts[likely] + side * step
        for k, i in enumerate(order):
            if side * (i - due) < 0:
                continue
            if tried == ONE_BY_ONE and len(order) - k > ONE_BY_ONE and n > 64:
                # many windows are nearly as good: all at once
                low, high = max(0, int(starts[0])), min(len(t), int(starts[-1]) + n)
                common = window_lcs(s, t[low:high])
                at = starts - low
                size = np.minimum(starts + n, len(t)) - np.maximum(starts, 0)
                ratios = 200.0 * common[at + n - 1] / (n + size)
                best = max(best, float(ratios.max()))
                return best if best >= cutoff else 0.0
            due = i + side * score(int(i))
            tried += 1
    return best if best >= cutoff else 0.0


def partial_ratio(a: SearchText, b: SearchText, cutoff: float) -> float:
    """Best ratio of the shorter text with any window of the longer one that is as long (or, at the ends,
    shorter); 0 below the cutoff."""
    if not a.text or not b.text:
        return 100.0 if a.text == b.text else 0.0
    short, long = (a, b) if len(a.text) <= len(b.text) else (b, a)
    best = _best_window(short, long, cutoff)
    if len(a.text) == len(b.text) and best < 100.0:
        best = max(best, _best_window(long, short, cutoff))
    return best
