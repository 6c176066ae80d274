"""The three de-duplication operators against brute force."""

import collections
import hashlib
import re

import cases
import harness
import numpy as np
import pytest

from promptmill.llm import minhash_bbit, path_dedup, suffix_dedup
from promptmill.llm.queries import ORACLES, QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def strings_left(rows, length):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            least[s] = min(least.get(s, 2**63), cases.key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p:p + length]] < cases.key(i):
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((cases.key(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def spans_left(rows, length):
    count, words = collections.Counter(), [WORD.findall((t or "").encode()) for _, t in rows]
    for w in words:
        count.update(tuple(w[k:k + length]) for k in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [0] * len(w)
        for p in range(len(w) - length + 1):
            if count[tuple(w[p:p + length])] > 1:
                gone[p:p + length] = [1] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((cases.key(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def near_components(rows, size, percent):
    """Rows that share an id count as one document to the links."""
    sets = []
    for _, t in rows:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    posts = collections.defaultdict(list)
    for n, s in enumerate(sets):
        for g in s:
            posts[g].append(n)
    common = collections.Counter((a, b) for ns in posts.values() for k, b in enumerate(ns) for a in ns[:k])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and rows[a][0] is not None and rows[b][0] is not None:
            x, y = find(rows[a][0]), find(rows[b][0])
            parent[max(x, y)] = min(x, y)
    return sorted((cases.key(i), len(s), cases.key(None if i is None else find(i)), i is not None and find(i) == i)
                  for (i, _), s in zip(rows, sets))


def rows_of(df):
    return sorted(tuple(cases.key(x) if k in ("doc_id", "component_id") else x for k, x in r.asDict().items()) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_earlier_strings_of_awkward_texts(spark, seed):
    rows = cases.awkward(seed)
    cut = suffix_dedup.remove_earlier_strings(cases.frame(spark, rows), length=12, gram=5, block_bytes=1500)
    assert rows_of(suffix_dedup.digests(cut)) == strings_left(rows, 12)


def test_wide_buckets_are_sorted_in_portions(spark, monkeypatch):
    rows, deals, deal = cases.awkward(4), [], suffix_dedup.bl.buckets_for
    monkeypatch.setattr(suffix_dedup.bl, "buckets_for", lambda blocks, each: deals.append((blocks, each)) or deal(blocks, each))
    for name, value in (("MANY", 3), ("WIDE", 4), ("PORTION_BYTES", 200)):
        monkeypatch.setattr(suffix_dedup, name, value)
    cut = suffix_dedup.remove_earlier_strings(cases.frame(spark, rows), length=12, gram=5, block_bytes=1500)
    assert rows_of(suffix_dedup.digests(cut)) == strings_left(rows, 12)
    assert deals[0][0] > 8 and deals[0][1] == min(4, deals[0][0] // 3)  # rows are blocks times buckets


def test_smallest_ids_travel_as_runs():
    rng, length = np.random.default_rng(2), 12
    texts = [rng.integers(97, 123, 400).astype(np.uint8) for _ in range(3)]
    rows = []
    for block, (text, least) in enumerate([(texts[0], 7), (texts[1], 5), (texts[0], 3), (texts[2], 9)]):
        shape = np.array([[20, len(text) - length + 1]], dtype=np.uint16)
        anchor = np.array([int(text[0]) * 1000 + int(text[1])], dtype=np.uint64)
        rows.append((block, suffix_dedup.PIECES, anchor.tobytes(), shape.tobytes(), np.array([least]).tobytes(), text.tobytes()))
    answers = suffix_dedup._least(length, 4)(0, rows)
    assert [(a[0], np.frombuffer(a[3], np.int64).tolist(), np.frombuffer(a[4], np.uint32).tolist()) for a in answers] == [
        (0, [3], [389]), (1, [5], [389]), (2, [3], [389]), (3, [9], [389])]


def test_repeated_spans_of_awkward_texts(spark):
    rows = cases.awkward(3)
    cut = path_dedup.remove_repeated_spans(cases.frame(spark, rows), length=7, gram=3, block_bytes=1500, carry=("lang", "score"))
    assert rows_of(path_dedup.digests(cut)) == spans_left(rows, 7)
    for r in cut.collect():
        assert r.kept.split() == r.rest.split() and r.score == 0.5 and r.lang is None


def test_near_duplicates_of_awkward_texts(spark):
    rows = cases.awkward(4, words=[f"w{k}" for k in range(300)])
    base = [f"w{k}" for k in range(120)]
    for n in range(30):  # versions of one text that drift apart: a chain of links
        rows.append((1000 + n, " ".join(base[n:] + [f"v{k}" for k in range(n)])))
    found = minhash_bbit.near_duplicates(cases.frame(spark, rows), size=4, percent=80)
    assert rows_of(found) == near_components(rows, 4, 80)


def test_empty_tables(spark):
    nothing = cases.frame(spark, cases.awkward()).limit(0)
    assert suffix_dedup.remove_earlier_strings(nothing).count() == 0
    assert path_dedup.remove_repeated_spans(nothing).count() == 0
    assert minhash_bbit.near_duplicates(nothing).count() == 0


def test_suffixes_come_out_sorted():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(380)
    begin = np.array([0, 100, 101, 250])
    sorter = suffix_dedup.SuffixSort(data, starts, 20)
    order = sorter.order(begin)
    for a, b in zip(begin, [*begin[1:], 380]):
        got = [data[s:s + 20].tobytes() for s in starts[order[a:b]]]
        assert got == sorted(got)


def test_queries(spark, folder, documents):
    assert rows_of(QUERIES["op1_suffix_dedup"](spark, folder)) == strings_left(documents, 50)
    assert rows_of(QUERIES["op8_substring_dedup"](spark, folder)) == spans_left(documents, 35)
    assert rows_of(QUERIES["op4_minhash"](spark, folder)) == near_components(documents, 4, 80)


@pytest.mark.parametrize("name", ["op4_minhash", "op8_substring_dedup"])
def test_sql_says_the_same_as_brute_force(folder, documents, name):
    expected = near_components(documents, 4, 80) if name == "op4_minhash" else spans_left(documents, 35)
    got = harness.connect(folder).execute(ORACLES[name]).to_arrow_table().to_pylist()
    assert sorted(tuple(r.values()) for r in got) == expected
