"""Top-k search against brute force and SQL, decontamination against planted passages."""

import itertools
import random

import cases
import harness
import numpy as np
from pyspark.sql import functions as F

from promptmill.llm import decontaminate, kd_topk
from promptmill.llm.queries import ORACLES, QUERIES


def test_top_k_with_ties_and_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.round(rng.normal(size=(600, 4)), 1))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    rows += [(2000, None), (2050, [1.0, float("nan"), 0.0, 0.0]), (2100, [1.0, None, 0.0, 0.0]), (2150, []), (2200, [1.0, 2.0]),
             (2201, [3.0, -1.0]), (None, [1.0] * 4), (0, rows[0][1]), (2250, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, vector string, shard int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in kd_topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=60).collect())
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows
            if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    expected = []
    for i, q in {i: q for i, q in good if i % 50 == 0}.items():
        best = sorted({(-int(q @ v), j) for j, v in good if j != i and len(v) == len(q)})[:5]
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(expected)
    assert kd_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_visits_less_than_everything():
    rng = np.random.default_rng(1)
    points = rng.integers(-1000, 1000, (5000, 3)).astype(np.float64)
    tree = kd_topk.Tree(points, np.arange(5000))
    for q in rng.integers(-9, 9, (20, 3)).astype(np.float64):
        found = tree.search(q, -1, tree.bounds(q[None])[0], 5, kd_topk.NOTHING)
        assert [s for s, _ in found] == sorted(map(int, points @ q), reverse=True)[:5]


def test_top_k_query_matches_sql(spark, folder):
    result = QUERIES["op2_topk"](spark, folder).toArrow()
    assert harness.difference(result, harness.connect(folder).execute(ORACLES["op2_topk"]).to_arrow_table()) is None


def test_overlaps_survive_substitutions_and_short_items(spark):
    rnd = random.Random(2)

    def text(n):
        return ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    items = [text(30), text(20), text(9), text(4)]
    changed = items[0][:]
    changed[7] = changed[19] = "other"
    docs = [(1, " ".join(text(50) + changed + text(9)).upper()), (2, " ".join(text(3) + items[1][3:17] + text(40))),
            (3, " ".join(items[2])), (4, " ".join(text(40) + items[3])), (5, " ".join(text(9000))), (6, None), (7, ""),
            (8, ", ".join(items[1]) + "!"), (None, " ".join(items[1])), (9, " ".join(items[0][:8] + text(30)))]
    bench = spark.createDataFrame([(k, " ".join(x), 0) for k, x in enumerate(items)] + [(9, None, 0), (10, "", 0), (None, "a b", 0)],
                                  "item_id long, text string, doc_id long")
    found = decontaminate.find_overlaps(cases.frame(spark, docs), bench)
    assert sorted((cases.key(r.doc_id), r.item_id, r.n_words, r.n_agree) for r in found.collect()) == [
        (1, 0, 30, 28), (2, 1, 14, 14), (3, 2, 9, 9), (8, 1, 20, 20), (2**62, 1, 20, 20)]
    span = {r.doc_id: (r.begin_byte, r.end_byte) for r in found.collect()}[2]
    assert docs[1][1][span[0]:span[1]] == " ".join(items[1][3:17])
    kept = decontaminate.without_overlaps(cases.frame(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 9}
    # a benchmark in several parts finds the same
    parts = decontaminate.find_overlaps(cases.frame(spark, docs), bench, pass_words=20)
    assert sorted(map(str, parts.collect())) == sorted(map(str, found.collect()))
    assert decontaminate.find_overlaps(cases.frame(spark, docs).limit(0), bench).count() == 0
    assert decontaminate.find_overlaps(cases.frame(spark, docs), bench.limit(0)).count() == 0


def test_every_placement_of_replaced_words_is_found():
    for n in range(8, 17):
        item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        docs = []
        for k in range(n // 5 + 1):
            for places in itertools.combinations(range(1, n - 1), k):
                doc = item.copy()
                doc[list(places)] += np.uint64(1)
                docs.append(doc)
        items = decontaminate.Items(np.arange(1), item, np.array([0, n]), decontaminate.MASKS)
        first = np.arange(len(docs) + 1) * n
        found = decontaminate.overlaps(np.concatenate(docs), first, items, decontaminate.MIN_WORDS, decontaminate.SIMILARITY)
        assert [r[:4] for r in found] == [(d, 0, 0, n) for d in range(len(docs))]


def test_masks_hit_every_window_with_a_fifth_replaced():
    for n in range(13, 26):
        missed = np.array([sum(1 << k for k in places) for places in itertools.combinations(range(n), n // 5)])
        for mask in decontaminate.MASKS:
            ones = int(mask[::-1], 2)
            for at in range(n - len(mask) + 1):
                missed = missed[missed & (ones << at) != 0]
        assert len(missed) == 0


def test_short_items_are_found_where_a_document_is_little_else(spark):
    bench = spark.createDataFrame([(0, "What is two plus two?"), (1, "Yes."), (2, "a b a")], "item_id long, text string")
    docs = cases.frame(spark, [(1, "what is two plus two"), (2, "Q: what is two plus TWO? Four, it is"), (3, "yes"), (4, "oh yes, indeed"),
                               (5, "what is three plus two"), (6, "word " * 9 + "what is two plus two"), (7, "a b a b a"), (8, ""), (9, None)])
    found = decontaminate.find_overlaps(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.n_agree) for r in found) == [
        (1, 0, 0, 5, 5), (2, 0, 1, 5, 5), (3, 1, 0, 1, 1), (7, 2, 0, 3, 3), (7, 2, 2, 3, 3)]
    assert sorted(r.doc_id for r in decontaminate.without_overlaps(docs, bench).collect()) == [4, 5, 6, 8, 9]


def test_decontamination_query_finds_whole_items(spark, folder, documents):
    import pyarrow.parquet as pq
    items = pq.read_table(f"{folder}/benchmark.parquet").to_pylist()
    expected = {(i, b["item_id"]) for i, t in documents for b in items if b["text"].rstrip(".") in t}
    got = {(r.doc_id, k) for r in QUERIES["op3_decontamination"](spark, folder).collect() for k in r.item_ids}
    assert expected <= got
    # what is found beyond whole items shares most of its words with the item
    texts = dict(documents)
    for i, k in got - expected:
        words = set(items[k]["text"].lower().replace(".", "").replace(",", "").split())
        assert len(words & set(texts[i].lower().replace(".", "").replace(",", "").split())) >= 8
