"""Periodic runs against all periods, the id store against the library, clustering against plain rounds."""

import hashlib
import random
import zlib

import cases
import harness
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promptmill.llm import heap_kmeans, id_store, periodic_runs
from promptmill.llm.queries import ORACLES, QUERIES

MODEL = public_tokenizers.path("word_bpe_49k.json")
SEPARATORS = b" \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in (text or "").translate({c: " " for c in SEPARATORS}).split(" ") if w]


def all_runs(words, least=24):
    """Every period up to a third of the words, tried word by word."""
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], dtype=np.int64)
    found = {}
    for p in range(1, len(w) // 3 + 1):
        edge = np.diff(np.concatenate(([False], w[:-p] == w[p:], [False])).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p):
            if b - a >= max(least, 3 * p):
                found.setdefault((int(a), int(b - a)), p)
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def rest(words, runs):
    dropped = set()
    for a, n, p in runs:
        dropped.update(range(a + p, a + n))
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def check_runs(spark, texts):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    found = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id int, text string, runs string, n_words int"))
    got = {r.doc_id: r for r in found.collect()}
    for k, text in enumerate(texts):
        words = words_of(text)
        runs = all_runs(words)
        assert [(r.start, r.length, r.period) for r in got[k].runs] == runs, text
        assert (got[k].n_words, got[k].collapsed) == (len(words), rest(words, runs))
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        assert (tuple(got[k].strongest) if got[k].strongest else None) == best


def test_runs_of_periodic_words(spark):
    rnd = random.Random(3)

    def some(letters, n):
        return [rnd.choice(letters) for _ in range(n)]
    texts = []
    for p in (1, 2, 5, 8, 9, 11, 12, 13, 16, 23, 24, 25, 48, 96, 131):
        texts += [(some("abc", p) * 9)[:3 * p + extra] + some("xyz", rnd.randrange(9)) for extra in (-1, 0, 1, 2 * p)]
    for _ in range(40):  # a small period inside a large one, and broken at its end
        inner = some("ab", rnd.randrange(1, 7)) * rnd.randrange(1, 20) + some("abc", rnd.randrange(1, 5))
        texts.append(some("q", rnd.randrange(3)) + (inner * 5)[:rnd.randrange(1, 5 * len(inner))] + (inner[:7] * 9))
    texts += [["a"] * 5000, ["b", "a"] * 40 + ["a"] * 40]
    first, second = ["a"], ["b"]
    for _ in range(13):
        first, second = first + second, first
    check_runs(spark, [" ".join(t) for t in (*texts, first)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=30), st.integers(1, 9)), max_size=6))
def test_runs_of_any_powers(parts):
    import pyarrow as pa
    words = [c for text, times in parts for c in text * times]
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array(["\t".join(words)])], names=["doc_id", "text"])
    row = periodic_runs.runs_of_batch(batch).to_pylist()[0]
    runs = all_runs(words)
    assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == runs
    assert row["collapsed"] == rest(words, runs)


def test_words_that_only_their_hashes_equal(monkeypatch):
    """With hashes that take many words for one, the words themselves decide."""
    import pyarrow as pa
    monkeypatch.setattr(periodic_runs, "word_hashes", lambda data, starts, ends: data[starts].astype(np.uint64) % np.uint64(2))
    words = [random.Random(8).choice(["a", "c", "b"]) for _ in range(300)] + ["b"] * 40
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array([" ".join(words)])], names=["doc_id", "text"])
    row = periodic_runs.runs_of_batch(batch).to_pylist()[0]
    assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == all_runs(words)


def test_runs_of_awkward_rows(spark):
    rows = cases.awkward()
    found = periodic_runs.find_runs(cases.frame(spark, rows))
    got = sorted((cases.key(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    expected = []
    for i, t in rows:
        words = words_of(t)
        expected.append((cases.key(i), len(words), all_runs(words), rest(words, all_runs(words))))
    assert got == sorted(expected)
    assert periodic_runs.find_runs(cases.frame(spark, rows).limit(0)).count() == 0


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def test_periodic_runs_query(spark, folder, documents):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, folder).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        words = planted(i, words_of(text))
        runs = all_runs(words)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        start, length, period = best or (None, None, None)
        assert got[i] == (len(runs), start, length, period, 1000 * length // period if best else None,
                          hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest(words, runs).encode()).hexdigest())


def expected_ids(rows, tokenizer, end=2):
    """(id, number, start, ids) of rows in the store's order, identical ids by the hash that the caller adds."""
    out, start, seen = [], 0, {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, seen.setdefault(i, 0), start, ids))
        seen[i] += 1
        start += len(ids)
    return out


def test_store_of_awkward_rows(spark):
    whole = Tokenizer.from_file(MODEL)
    rows = cases.awkward(words=("a", "Don't", "'s", "  ", "\n", "é", "ÅÇ", "汉字", "123", "!?", "<|endoftext|>", "x y", "ǅ", "İ"))
    rows += [(3, "repeated")] * 40 + [(None, "a b")] * 5
    docs = cases.frame(spark, rows).repartition(5)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    ordered = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (cases.key(r.doc_id), r.h))]
    store = id_store.write(docs, id_store.WordEncoder(spark, MODEL), end=2, range_bytes=900, shard_bytes=600, shard_rows=7, bucket_keys=20)
    found = store.read(id_store.keys_of(docs)).collect()
    got = sorted((cases.key(r.doc_id), r.number, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    assert got == sorted((cases.key(i), k, s, ids) for i, k, s, ids in expected_ids(ordered, whole))
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)
    # keys without document, and single keys
    asked = spark.createDataFrame([(3, 1), (3, 999), (777777, 0), (0, 0), (None, 2)], "doc_id long, number long")
    assert sorted((cases.key(r.doc_id), r.number) for r in store.read(asked).collect()) == [(0, 0), (3, 1), (cases.key(None), 2)]
    empty = id_store.write(docs.limit(0), id_store.WordEncoder(spark, MODEL), end=2)
    assert empty.read(id_store.keys_of(docs)).count() == 0


def test_files_are_raw_ids_in_order(spark, tmp_path):
    whole = Tokenizer.from_file(MODEL)
    rows = [(k, "word " * (k % 5) + str(k)) for k in range(200, 0, -1)] + [(0, '"')]
    id_store.write(cases.frame(spark, rows), id_store.WordEncoder(spark, MODEL), end=2, path=str(tmp_path), range_bytes=700, shard_bytes=120)
    shards = sorted((tmp_path / "ids").glob("shard=*"), key=lambda p: int(p.name[6:]))
    assert len(shards) > 10 and all(len(list(s.glob("part-*"))) == 1 for s in shards)
    raw = b"".join(p.read_bytes() for s in shards for p in s.glob("part-*"))
    assert np.frombuffer(raw, "<u2").tolist() == [i for _, _, _, ids in expected_ids(sorted(rows), whole) for i in ids]


def test_store_query(spark, folder, documents):
    whole = Tokenizer.from_file(MODEL)
    got = sorted(tuple(r) for r in QUERIES["op12_id_store"](spark, folder).collect())
    assert got == [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                   for i, _, s, ids in expected_ids(sorted(documents, key=lambda r: r[0]), whole)]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 70000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    ids = rng.permutation(np.unique(rng.integers(-2**62, 2**62, n)))
    numbers = rng.integers(-3, 3, len(ids))
    perfect = id_store.PerfectHash.build(ids, numbers)
    assert sorted(perfect.slots(ids, numbers)) == list(range(len(ids)))
    if n > 100:
        assert sum(perfect.sizes) < 4 * n
        assert (perfect.slots(ids + 1, numbers) < n).all()


def test_perfect_hash_keeps_keys_of_equal_hash(monkeypatch):
    monkeypatch.setattr(id_store, "key_hashes", lambda ids, numbers: (ids // 3).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ids = np.arange(50)
    perfect = id_store.PerfectHash.build(ids, ids * 0)
    assert len(perfect.rest) and sorted(perfect.slots(ids, ids * 0)) == list(range(50))


def lloyd(vectors, starts, rounds):
    centroids = [vectors[i].tolist() for i in starts]
    for r in range(rounds + 1):
        d = np.array([[sum((int(a) - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in vectors])
        own = d.argmin(axis=1)
        if r < rounds:
            centroids = [[int(s) // int((own == j).sum()) for s in vectors[own == j].sum(axis=0)] if (own == j).any() else c
                         for j, c in enumerate(centroids)]
    return own, d.min(axis=1), centroids


@pytest.mark.parametrize("size", [1, 5, 400])
def test_clusters_with_ties_and_awkward_vectors(spark, size):
    rng = np.random.default_rng(size)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.round(rng.normal(size=(size, 4)) * 2) / 2)]
    rows += [(k, v) for k, v in rows[:size // 3]] + [(None, [0.5, 0.5, -0.5, 1.0])]
    good = list(rows)
    rows += [(5000, None), (5001, []), (5002, [1.0, None, 0.0, 0.0]), (5003, [float("nan")] * 4), (5004, [1.0] * 5),
             (5005, [float("inf")] * 4), (5006, [1e300] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, pack int")
    assigned, centroids = heap_kmeans.cluster_vectors(df, k=6, rounds=7, dim=4, scale=10, pack_rows=32)
    vectors = np.array([np.floor(10 * np.array(v)).astype(np.int64) for _, v in good])
    digest = [hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~" for i, _ in good]
    starts = sorted(range(len(good)), key=lambda j: (digest[j], vectors[j].tolist()))[:6]
    own, distance, expected = lloyd(vectors, starts, 7)
    assert centroids.tolist() == expected
    got = sorted((cases.key(r.vec_id), r.cluster, r.distance) for r in assigned.collect())
    assert got == sorted((cases.key(i), int(c), int(d)) for (i, _), c, d in zip(good, own, distance))
    table = heap_kmeans.with_inertia(assigned, centroids).toPandas()
    assert (table["inertia"] == distance.sum()).all()
    assert table.groupby("cluster")["distance"].sum().to_dict() == table.groupby("cluster")["cluster_inertia"].first().to_dict()
    nothing, _ = heap_kmeans.cluster_vectors(df.limit(0), dim=4)
    assert nothing.count() == 0


def test_only_expired_vectors_are_looked_at_again():
    """Far from all borders the heaps stay closed; a drift beyond an entry opens it."""
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-20, 20, (500, 8)), rng.integers(980, 1020, (500, 8))]).astype(np.int64)
    now = heap_kmeans.Round(np.array([[0] * 8, [1000] * 8]), np.zeros(2))
    _, sizes, members, entries, changes = heap_kmeans.first_round(0, points, now)
    assert sizes == [500, 500] and changes[0] == changes[9] == 500
    state = np.frombuffer(members, np.int32), np.frombuffer(entries, np.float64)
    calls = []
    original = heap_kmeans.squared_distances
    heap_kmeans.squared_distances = lambda p, c: calls.append(len(p)) or original(p, c)
    try:
        moved = heap_kmeans.Round(now.centroids + 3, now.drift + 20.0)
        assert heap_kmeans.next_round(0, points, sizes, *state, moved)[4] is None and calls == []
        swapped = heap_kmeans.Round(now.centroids[::-1].copy(), now.drift + 6000.0)
        assert heap_kmeans.next_round(0, points, sizes, *state, swapped)[1] == [500, 500] and calls == [1000]
    finally:
        heap_kmeans.squared_distances = original


def test_squared_distances_beyond_doubles():
    points = np.array([[2**27, -2**27], [2**27 - 1, 1], [0, 0]])
    got = heap_kmeans.squared_distances(points, points)
    assert got.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in points] for p in points]


def test_cluster_query_matches_sql(spark, folder):
    result = QUERIES["op13_heap_kmeans"](spark, folder).toArrow()
    assert harness.difference(result, harness.connect(folder).execute(ORACLES["op13_heap_kmeans"]).to_arrow_table()) is None
