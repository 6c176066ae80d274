"""What a task holds, reads or writes stays bounded as tables grow, with the same results."""

from __future__ import annotations

import io
import itertools
import random
import time
import tracemalloc
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from promptmill.functions import fuzzy as fz
from promptmill.functions import text as tx
from promptmill.operators import dedup, density, fuzzy, language, lexical, meetings, neighbours
from promptmill.plans import balance
from promptmill.session import materialize
from promptmill.sources import versioned


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_shared_token_pairs_in_many_blocks_and_few_candidates(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i:03d}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(60)]
    texts += [t.replace(rng.choice(t.split()), "other") for t in texts[:20]] + texts[:3] + ["", "  ", None]
    df = spark.createDataFrame([*enumerate(texts)], "row_id long, prompt string")
    want = set()
    for i, s in enumerate(texts):
        for j in range(i + 1, len(texts)):
            t = texts[j]
            if s and t and s.split() and t.split() and fuzzy.length_band(len(s), len(t)):
                a, b = set(s.split()), set(t.split())
                weight = lambda x: sum(map(len, x)) + len(x)
                common, w_a, w_b = weight(a & b), weight(a), weight(b)
                score = 0.0 if not common else 100.0 if common in (w_a, w_b) else 200 * (common - 1) / (min(w_a, w_b) - 1 + common - 1)
                if score >= 90:
                    want.add((i, j, round(score, 6)))
    assert want
    for name, value in (("PAIR_BLOCK", 1000), ("TASK_PAIRS", 4), ("TASK_BYTES", 400)):
        monkeypatch.setattr(fuzzy, name, value)
    assert {(r.id_a, r.id_b, round(r.score, 6)) for r in fuzzy.shared_token_pairs(df).collect()} == want
    # texts that share one token, rare in one of them only, are no candidates any more
    rows = fuzzy._token_rows(spark.createDataFrame(
        [(0, "rare aaaa bbbb cccc dddd eeee"), (1, "rare ffff gggg hhhh iiii jjjj"), (2, "rare aaaa bbbb cccc dddd ffff"),
         *[(i, "ffff gggg hhhh iiii jjjj kkkk") for i in range(3, 9)]], "id long, text string"))
    found = {(r.a, r.b) for r in fuzzy._candidates(rows, 90.0).collect()}
    assert (0, 2) in found and (1, 3) in found


def test_ngrams_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a b c{i % 7} d", "xy"[i % 2]) for i in range(200)], "row_id long, prompt string, source string")
    tops, overlap = lexical.top_ngrams(df).collect(), lexical.ngram_jaccard(df, "x", "y").collect()
    monkeypatch.setattr(lexical, "PART_BYTES", 50)
    dealt, parts = lexical._dealt(df, "prompt", "row_id")
    assert parts == dealt.rdd.getNumPartitions() == -(-1600 // 50)
    assert sorted(lexical.top_ngrams(df).collect()) == sorted(tops) and sorted(lexical.ngram_jaccard(df, "x", "y").collect()) == sorted(overlap)
    plans = []
    monkeypatch.setattr(lexical, "materialize", lambda made: plans.append(plan(made)) or made)
    lexical.ngram_jaccard(df, "x", "y")
    assert f", {parts}), ENSURE_REQUIREMENTS" in plans[0]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_character_runs_are_cut_by_arrays(spark):
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))
    texts = ["", "abc", "abcde", "abcabcabcabc", "été à l'île", "😀😀😀😀😀😀x", None, wide + wide]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.char_shingles("t", 5).alias("s"))
    assert "ArrowEvalPython" in plan(df)
    want = [None if t is None else [*dict.fromkeys(t[i:i + 5] for i in range(max(1, len(t) - 4)))] for t in texts]
    assert [r.s for r in df.collect()] == want
    assert tx._shingle_lists(pa.array(["aXbXa"]), 1).to_pylist() == [["a", "X", "b"]]


def test_language_profiles_are_counted_by_arrays(spark, monkeypatch):
    rows = [("ab  AB\t😀", "en"), ("", "en"), (None, "fr"), ("x", "fr"), ("xyz", None)]
    got = language.language_profiles(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert {(r.lang, r.gram) for r in got.collect()} == {
        ("en", ""), *[("en", " ab ab 😀 "[i:i + 3]) for i in range(7)], ("fr", ""), ("fr", " x ")}
    seen = []
    monkeypatch.setattr(language, "materialize", lambda df: seen.append(plan(df)) or df)
    language.language_profiles(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert "MapInArrow" in seen[0]


def test_lists_and_edges_of_one_task_are_arrays():
    rng, n = np.random.default_rng(0), 60_000
    a = rng.integers(0, 20_000, n)
    edges = pa.table({"ca": a, "cb": a + 1 + rng.integers(0, 5, n), "w": rng.random(n), "a": a, "b": a + 7})
    forest = pa.table({"a": np.arange(n), "b": np.arange(n) + 1, "w": rng.random(n)})
    points = rng.random((3000, 4))
    for run, most in ((lambda: density._last_edges(edges), 16), (lambda: density._fallen_in_one_task(10)(forest), 28),
                      (lambda: neighbours._list_table(neighbours._search_group(np.arange(3000), points, 15, 256, 1)), 12)):
        tracemalloc.start()
        assert run().num_rows
        peak = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        assert peak < most, peak


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "FILE_BYTES", 10_000)
    df = spark.createDataFrame([(i, "x" * 100) for i in range(1000)], "row_id long, prompt string")
    assert versioned.files_for(df) == -(-108_000 // 10_000)
    table = versioned.VersionedTable(spark, str(tmp_path), "row_id long, prompt string", "row_id")
    table.append(df)
    assert len([*tmp_path.glob("parts/*/*.parquet")]) > 5 and table.read().count() == 1000


def test_runs_share_what_they_read_of_the_source(spark, monkeypatch):
    calls, signatures = [], dedup.signatures
    monkeypatch.setattr(dedup, "signatures", lambda *args: calls.append(args) or signatures(*args))
    df = spark.createDataFrame([(i, f"prompt number {i} about subject {i % 5}", i % 2 if i < 12 else 0, 0.5) for i in range(30)],
                               "row_id long, prompt string, intent_disc int, intent_cont double")
    both = balance.repeat_runs(df, 2, target_coverage=50)[0].augmented
    assert len(calls) == 1
    alone = balance.balance_dataset(df, target_coverage=50, seed=43, run=2).augmented
    columns = ["prompt", "intent_disc", "intent_cont"]
    assert sorted(both.where("run = 2").select(columns).collect()) == sorted(alone.select(columns).collect())


def test_few_fuzzy_pairs_are_aligned_whole(monkeypatch):
    rng = random.Random(8)
    parts = "the on er and ing ti ha é ß 字 que los mi ja bo rr ver sch geö un".split()
    word = lambda: "".join(rng.choices(parts, k=rng.randrange(1, 5)))
    spoil = lambda w: w[:-1] + "x" if len(w) > 4 and rng.random() < 0.6 else w
    texts = [" ".join(word() for _ in range(rng.randrange(85, 92))) for _ in range(60)] + [" ".join(word() for _ in range(n)) for n in range(1, 25)]
    texts += [" ".join(map(spoil, t.split())) for t in texts] + ["a", "b", "ab", "ba", "the the"]
    sets = [set(t.split()) for t in texts]
    want = {(i, j, round(s, 6)) for i, j in itertools.combinations(range(len(texts)), 2)
            if fuzzy.length_band(len(texts[i]), len(texts[j])) and (s := fz.token_set_ratio(sets[i], sets[j])) >= 90}
    assert len(want) > 40
    aligned, exact = [], fz.token_set_ratio
    monkeypatch.setattr(fz, "token_set_ratio", lambda *a: aligned.append(1) or exact(*a))
    n = len(texts)
    rows = {"side": [0] * n + [1] * n, "id": [*range(n)] * 2, "text": texts * 2, "same": [True] * (2 * n)}
    for size in (fuzzy.AT_ONCE, 300):
        monkeypatch.setattr(fuzzy, "AT_ONCE", size)
        aligned.clear()
        got = fuzzy._score_sets(90.0)(pa.table(rows)).to_pylist()
        assert {(r["a"], r["b"], round(r["score"], 6)) for r in got} == want
        assert len(aligned) < len(want) + 200  # thousands of pairs are alike in length, weight and letters


def test_few_windows_across_sources_are_compared(monkeypatch):
    rng = random.Random(9)
    parts = "the on er and ing ti ha é ß 字 que los mi ja bo rr ver sch geö un".split()
    say = lambda n: " ".join("".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(n))
    left = [say(rng.randrange(40, 60)) for _ in range(40)] + [say(60)[:n] for n in range(5, 20)]
    right = [say(rng.randrange(60, 90)) for _ in range(40)] + [say(9) + " " + t[:30] + "x" + t[31:] + " " + say(9) for t in left[:5]]
    right += [t[1:] + say(5) for t in left[-15:]] + [say(5) + t[:-1] for t in left[-15:]] + [t[:2] + "x" + t[3:] for t in left[-15:]]

    def best(a, b):
        s, t = sorted((a, b), key=len)
        windows = lambda s, t: max(fz.indel_ratio(s, t[max(i, 0):i + len(s)]) for i in range(1 - len(s), len(t)))
        return max(windows(s, t), windows(t, s)) if len(s) == len(t) else windows(s, t)
    short = range(40, 55)
    want = {(i, j, round(s, 6)) for i in short for j in range(len(right)) if (s := best(left[i], right[j])) >= 92}
    assert want
    compared, exact = [], fz.partial_ratio
    monkeypatch.setattr(fz, "partial_ratio", lambda *a: compared.append(len(a[0].text)) or exact(*a))
    rows = {"side": [0] * len(left) + [1] * len(right), "id": [*range(len(left)), *range(len(right))], "text": left + right}
    got = {(r["a"], r["b"], round(r["score"], 6)) for r in fuzzy._score_parts(92.0)(pa.table(rows)).to_pylist()}
    assert {g for g in got if g[0] >= 40} == want and {(i, 40 + i) for i in range(5)} <= {g[:2] for g in got}
    assert sum(n > 100 for n in compared) < 1400  # more if only the classes of shifts are counted
    # a text of seven characters allows one edit, which a whole window cannot have: windows at the ends only
    assert len(fz._starts(fz.SearchText("abcdefg"), fz.SearchText("x" * 500), 92.0)[0]) < 20


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_shuffles_go_when_a_table_is_written(spark):
    before = shuffle_files(spark)
    kept = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_vectors_are_not_copied_for_each_block_they_meet(spark, monkeypatch):
    rng, n, k = np.random.default_rng(5), 90, 6
    points = rng.integers(0, 4, (n, 3)).astype(float)  # many ties
    points[40:48] = points[3]
    rows = [(i, points[i].tolist()) for i in range(n)] + [(None, [0.0] * 3), (200, None)]
    df = spark.createDataFrame(rows, "key long, v array<double>")
    far = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)), 9)
    want = {i: sorted((float(far[i, j]), j) for j in range(n) if j != i)[:k] for i in range(n) if i % 3}
    for held in (1 << 20, 800):
        monkeypatch.setattr(meetings, "HELD_BYTES", held)
        found = neighbours.exact_neighbours(df, df.where("key % 3 <> 0"), "key", "v", k, block_rows=11)
        assert "CartesianProduct" in plan(found) and "Generate" not in plan(found)
        assert {r.id: [(e.distance, e.id) for e in r.list] for r in found.collect()} == want


def test_texts_are_not_copied_for_each_block_they_meet(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"word{i:02d}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(4, 9))) for _ in range(70)]
    texts += [t[:-1] + "x" for t in texts[:25]] + [t + " more" for t in texts[25:35]] + texts[:4] + ["", " ", None]
    df = spark.createDataFrame([*enumerate(texts)], "row_id long, prompt string")
    want, sides = set(), [[], []]
    for i, s in enumerate(texts):
        sides[i % 2] += [(i, s)] if s else []
        for j in range(i + 1, len(texts)):
            t = texts[j]
            if s and t and s.split() and t.split() and fuzzy.length_band(len(s), len(t)):
                score = fz.token_set_ratio(set(s.split()), set(t.split()))
                if score >= 90:
                    want.add((i, j, round(score, 6)))
    matches = {(i, j, round(score, 6)) for i, s in sides[0] for j, t in sides[1]
               if (score := fz.partial_ratio(fz.SearchText(s), fz.SearchText(t), 92.0)) >= 92}
    assert len(want) > 30 and len(matches) > 10
    seen, wrote = [], fuzzy.materialize
    monkeypatch.setattr(fuzzy, "materialize", lambda made: seen.append(plan(made)) or wrote(made))
    for name, value in (("BLOCK_BYTES", 300), ("SIDE_BYTES", 300)):
        monkeypatch.setattr(fuzzy, name, value)
    for held in (1 << 20, 700):
        monkeypatch.setattr(meetings, "HELD_BYTES", held)
        pairs = fuzzy.fuzzy_pairs(df)
        assert "CartesianProduct" in plan(pairs) and "Generate" not in plan(pairs)
        assert {(r.id_a, r.id_b, round(r.score, 6)) for r in pairs.collect()} == want
        seen.clear()
        found = fuzzy.cross_source_matches(df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1"))
        assert {(r.id_left, r.id_right, round(r.score, 6)) for r in found.collect()} == matches
        assert any("CartesianProduct" in p for p in seen) and not any("Generate" in p for p in seen)


def test_shared_token_pairs_form_in_rounds_that_leave_their_pairs_only(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i:02d}" for i in range(80)]
    texts = [" ".join(rng.choices(words, k=rng.choice([6, 12, 30]))) for _ in range(80)]
    texts += [t + " z" for t in texts[:40]] + texts[:5]
    df = spark.createDataFrame([*enumerate(texts)], "row_id long, prompt string")
    whole = sorted(fuzzy.shared_token_pairs(df).collect())
    assert len(whole) > 40
    rounds, wrote, gone, scored = [], [], [], fuzzy._scored_round
    write, discard = fuzzy.materialize, fuzzy.discard
    monkeypatch.setattr(fuzzy, "ROUND_MEETINGS", 3000)
    monkeypatch.setattr(fuzzy, "_scored_round", lambda *a: rounds.append(a[4:]) or scored(*a))
    monkeypatch.setattr(fuzzy, "materialize", lambda d: wrote.append(write(d)) or wrote[-1])
    monkeypatch.setattr(fuzzy, "discard", lambda d: gone.append(d._promptmill_path) or discard(d))
    assert sorted(fuzzy.shared_token_pairs(df).collect()) == whole
    assert len({r[:2] for r in rounds}) > 1 and max(r[3] for r in rounds) > 1
    kept = [d.columns for d in wrote if d._promptmill_path not in gone]
    assert kept.count(["a", "b", "score", "alone"]) == len(rounds) and not any("hashes" in c or "size" in c or "part" in c for c in kept)
