"""Operators against plain Python on small tables, and the published figures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from promptmill.functions import fuzzy as fz
from promptmill.functions import minhash as mh
from promptmill.operators import answers, dedup, fuzzy, language, lexical, lsh, profile, running, sampling, scoring, semantic, stats, topics
from promptmill.plans import balance
from promptmill.plans import generate as gen
from promptmill.sources import readers, views, writers

COUNTS = [(2, 1005), (0, 600), (3, 222), (1, 205), (4, 50)]


def counts(spark, rows):
    return spark.createDataFrame(rows, "intent_disc int, n bigint")


def test_plan_published_quotas(spark):
    plan = {r["intent_disc"]: r["n_new"] for r in balance.plan_quotas(counts(spark, COUNTS), 50, 2000).collect()}
    assert plan == {2: 0, 0: 202, 3: 392, 1: 400, 4: 478} and sum(plan.values()) == 1472


def test_plan_small(spark):
    plan = {r["intent_disc"]: r["n_new"] for r in balance.plan_quotas(counts(spark, [(0, 10), (1, 5), (2, 0)]), 100, 100).collect()}
    assert (plan[1], plan[2]) == (5, 10)
    assert balance.plan_quotas(counts(spark, []), 100, 100).count() == 0


def test_published_entropy(spark):
    got = counts(spark, COUNTS).agg(stats.entropy_bits().alias("e")).first()["e"]
    assert got == pytest.approx(1.8273170567, abs=1e-9)


def test_coverage(spark):
    row = spark.range(1).select(balance.coverage_percent(F.lit(1592), F.lit(1472)).alias("a"), balance.coverage_percent(F.lit(3), F.lit(0)).alias("b")).first()
    assert round(row["a"], 2) == 108.15 and row["b"] == 100.0


def test_dedup_hello(spark):
    df = spark.createDataFrame([(0, "Hello"), (1, "Hello "), (2, "World")], "row_id bigint, prompt string")
    assert sorted(r["row_id"] for r in dedup.dedup_exact_normalised(df, "prompt", "row_id").collect()) == [0, 2]
    assert sorted(r["row_id"] for r in lsh.dedup_near(df, "row_id", "prompt").collect()) == [0, 2]


def test_mean_similarity_of_no_pairs(spark):
    none = spark.createDataFrame([], "cosine double")
    assert semantic.mean_pair_similarity(none, none).first()[0] == 1.0


def test_combine_keeps_one_null(spark):
    base = spark.createDataFrame([(0, None), (1, "A"), (2, None)], "row_id bigint, prompt string")
    new = spark.createDataFrame([(0, " a "), (1, "b")], "row_id bigint, prompt string")
    assert sorted((r["prompt"] or "") for r in dedup.combine(base, new).collect()) == ["", "A", "b"]


def numpy_percentile(xs, p):
    xs = sorted(xs)
    at = (len(xs) - 1) * p
    low = math.floor(at)
    high = min(low + 1, len(xs) - 1)
    return xs[low] + (xs[high] - xs[low]) * (at - low)


def test_exact_percentiles_and_running_total(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("ab"), rnd.choice([1.0, 2.0, rnd.random() * 10])) for i in range(500)]
    df = spark.createDataFrame(rows, "i bigint, g string, x double")
    got = {r["g"]: r for r in running.exact_percentiles(df, "x", {"a": 0.1, "m": 0.5, "z": 0.99}, ["g"]).collect()}
    for g in "ab":
        xs = [x for _, h, x in rows if h == g]
        assert got[g]["n"] == len(xs)
        for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
            assert got[g][name] == pytest.approx(numpy_percentile(xs, p))
    run = {r["i"]: r["x_before"] for r in running.running_total(df, ["x"], ["i"]).collect()}
    total = 0.0
    for i, _, x in rows:
        assert run[i] == pytest.approx(total)
        total += x


@pytest.mark.parametrize("sizes", [[250, 1, 0, 99, 100, 3, 148], [30, 20], [100], [1] * 205])
def test_msttr(spark, sizes):
    rnd = random.Random(len(sizes))
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(n)) for n in sizes]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "row_id bigint, source string, prompt string")
    stream = " ".join(texts).split()
    pieces = [stream[i:i + 100] for i in range(0, len(stream) - 99, 100)] or [stream]
    want = sum(len(set(p)) / len(p) for p in pieces) / len(pieces)
    assert lexical.msttr(df).first()["msttr"] == pytest.approx(want)


def greedy(rows):
    """Accept rows in order unless they share a band key with an accepted one."""
    taken, kept = set(), []
    for i, keys in sorted(rows):
        if not taken & set(keys):
            kept.append(i)
            taken |= set(keys)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_first_accepted_is_the_ordered_walk(spark, seed):
    rnd = random.Random(seed)
    # One key is shared by a third of all rows; the others make chains.
    rows = [(i, [rnd.randint(0, 60), 100 + rnd.randint(0, 60), 200 if rnd.random() < 0.34 else 1000 + i]) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, keys array<bigint>")
    accepted, members = lsh.first_accepted(df)
    shared = {r["id"] for r in members.select("id").distinct().collect()}
    assert sorted({r["id"] for r in accepted.collect()} | ({i for i, _ in rows} - shared)) == greedy(rows)


def test_chain_keeps_both_ends(spark):
    df = spark.createDataFrame([(0, [1]), (1, [1, 2]), (2, [2])], "id bigint, keys array<bigint>")
    assert sorted(r["id"] for r in lsh.first_accepted(df)[0].collect()) == [0, 2]


def star_clusters(rows):
    """Rows in order; one not yet in a cluster opens one with all rows it collides with."""
    visited, out = set(), set()
    for i, keys in rows:
        if i in visited:
            continue
        bucket = [j for j, other in rows if set(keys) & set(other)]
        visited.update(bucket)
        if len(bucket) > 1:
            out |= {(i, j) for j in bucket}
    return out


def test_clusters_against_walk(spark, folder):
    df = views.prompts(spark, "/root/testdata/sf0.001")
    rows = lsh.banded(df, "row_id", "prompt", lsh.CHARS, 0.8, 64).collect()
    want = star_clusters(sorted((r["id"], r["keys"]) for r in rows))
    got = {(r["cluster"], r["member"]) for r in lsh.near_duplicate_clusters(df, "row_id", "prompt").collect()}
    assert got == want and want


def test_near_dedup_against_walk_and_partitioning(spark):
    df = views.prompts(spark, "/root/testdata/sf0.001")
    rows = lsh.banded(df, "row_id", "prompt", lsh.WORDS, 0.9, 128).collect()
    want = greedy(sorted((r["id"], r["keys"]) for r in rows))
    for parts in (1, 7):
        got = lsh.dedup_near(df.repartition(parts), "row_id", "prompt")
        assert sorted(r["row_id"] for r in got.collect()) == want


def test_band_plan():
    assert mh.band_plan(0.9, 128) == (5, 25)
    assert mh.band_plan(0.8, 64) == (5, 11)


def test_signature_estimates_jaccard(spark):
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:300] + [f"v{i}" for i in range(100)])
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(mh.word_minhash("a").alias("a"), mh.word_minhash("b").alias("b")).first()
    shingles = lambda t: {tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)}
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert sum(x == y for x, y in zip(rows["a"], rows["b"])) / 128 == pytest.approx(true, abs=0.15)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_and_ratios():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        assert fz.lcs_length(a, b) == lcs(a, b)
    assert fz.token_set_ratio({"a", "b"}, {"a", "b", "c"}) == 100.0
    assert fz.token_set_ratio(set(), {"a"}) == 0.0
    assert fz.token_set_ratio({"helloworld"}, {"helloworlds"}) == pytest.approx(100 * 20 / 21)


def brute_partial(a, b, cutoff):
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    best = lambda s, t: max(fz.indel_ratio(s, t[max(i, 0):i + len(s)]) for i in range(-len(s) + 1, len(t)))
    score = max(best(s, t), best(t, s)) if len(s) == len(t) else best(s, t)
    return score if score >= cutoff else 0.0


def test_partial_ratio_against_all_windows():
    rnd = random.Random(3)
    for _ in range(200):
        s = [rnd.choice("abcde ") for _ in range(rnd.randint(1, 60))]
        t = list(s)
        for _ in range(rnd.randint(0, 6)):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice("abcde "))
        pad = lambda: [rnd.choice("abcde ") for _ in range(rnd.randint(0, 30))]
        a, b = "".join(s), "".join(pad() + t + pad())
        for cutoff in (80.0, 92.0):
            assert fz.partial_ratio(fz.SearchText(a), fz.SearchText(b), cutoff) == pytest.approx(brute_partial(a, b, cutoff))


def test_fuzzy_pairs_against_all_pairs(spark):
    df = views.prompts(spark, "/root/testdata/sf0.001").where(F.length("prompt") < 1500)
    rows = sorted((r["row_id"], r["prompt"]) for r in df.collect())
    want = set()
    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1:]:
            if fuzzy.length_band(len(s), len(t)) and fz.token_set_ratio(set(s.split()), set(t.split())) >= 90:
                want.add((a, b))
    got = [(r["id_a"], r["id_b"]) for r in fuzzy.fuzzy_pairs(df, sample_max=10_000).collect()]
    assert set(got) == want and len(got) == len(want)


def test_cross_matches_find_embedded_text(spark):
    left = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "row_id bigint, prompt string")
    right = spark.createDataFrame([(7, "x " * 40 + "the quick brown fox jumped over the lazy dog" + " y" * 40), (8, "nothing alike here at all")], "row_id bigint, prompt string")
    assert [(r["id_left"], r["id_right"]) for r in fuzzy.cross_source_matches(left, right).collect()] == [(1, 7)]


def test_gates_fail_one_by_one(spark):
    good = {"coverage_percent": 95.0, "class_histogram_cv_percent": 3.0, "paraphrase_mean_similarity": 0.9, "duplicate_ratio": 0.0}
    assert balance.quality_gates(spark.createDataFrame([good])).first()["all_pass"]
    bad = {"coverage_percent": (80.0, "coverage_ok"), "class_histogram_cv_percent": (6.0, "class_cv_ok"),
           "paraphrase_mean_similarity": (0.96, "similarity_ok"), "duplicate_ratio": (0.02, "duplicates_ok")}
    for name, (value, gate) in bad.items():
        row = balance.quality_gates(spark.createDataFrame([{**good, name: value}])).first()
        assert not row["all_pass"] and row["failed_gates"] == gate
    assert not balance.quality_gates(spark.createDataFrame([{"coverage_percent": 95.0}])).first()["all_pass"]


def test_balance_smoke_with_constant_generator(spark):
    df = spark.createDataFrame([(0, "Hello", 0, 0.1), (1, "World", 1, 0.2)], "row_id bigint, prompt string, intent_disc int, intent_cont double")
    result = balance.balance_dataset(df, lambda messages, params: "This is a test prompt")
    rows = result.augmented.collect()
    assert [r["prompt"] for r in rows] == ["This is a test prompt"] and rows[0]["dataset"] == "augmented"
    lines = [r["value"] for r in balance.report_text([result.report]).collect()]
    assert lines[1] == "Original rows: 2" and len(lines) == 10
    assert result.metrics.first()["coverage_percent"] == 100.0


def test_failing_calls_lose_their_rows(spark):
    def picky(messages, params):
        if params["number"] % 2:
            raise RuntimeError("no")
        return "ok"
    requests = spark.range(10).select("id", F.col("id").alias("number"), gen.build_request("brainstorm").alias("messages"))
    good, bad = gen.drop_failed(gen.run_generator(requests, picky, {}, ["id"]))
    assert (good.count(), bad.count()) == (5, 5)


def test_quota_rows_of_a_long_quota(spark):
    quotas = spark.createDataFrame([(0, 10, 0), (1, 5, 3000), (2, 1, 7)], "intent_disc int, n bigint, n_new bigint")
    rows = gen.quota_rows(quotas).collect()
    assert sorted(r["seq"] for r in rows) == list(range(3007))
    assert sum(r["intent_disc"] == 1 for r in rows) == 3000


def test_class_draw_follows_weights(spark):
    quotas = spark.createDataFrame([(0, 10, 0), (1, 5, 900), (2, 1, 99)], "intent_disc int, n bigint, n_new bigint")
    got = {r["intent_disc"]: r["count"] for r in sampling.weighted_class_draw(quotas, 5000).groupBy("intent_disc").count().collect()}
    assert got[1] == pytest.approx(4500, rel=0.05) and got[2] == pytest.approx(495, rel=0.3)


def test_readers(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    lines = [json.dumps({"prompt": "Hello", "dataset": "x", "intent_disc": 0, "intent_cont": 0.1}), "", "{broken",
             json.dumps({"prompt": "World", "dataset": "x", "intent_disc": 1, "intent_cont": None})]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, bad = readers.read_prompts_tolerant(spark, str(path), "mapped", with_lines=True)
    assert sorted((r["prompt"], r["line_no"]) for r in good.collect()) == [("Hello", 0), ("World", 3)]
    assert [r["line_no"] for r in bad.collect()] == [2]
    with pytest.raises(Exception):
        readers.read_prompts(spark, str(path)).collect()
    clean = tmp_path / "clean.jsonl"
    clean.write_text("\n".join([lines[0], "", lines[3]]), encoding="utf-8")
    df = readers.read_prompts(spark, str(clean))
    assert {r["intent_disc"]: r["n"] for r in stats.class_counts(df).collect()} == {0: 1, 1: 1}
    other = tmp_path / "other.jsonl"
    other.write_text('{"prompt": "x"}', encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_prompts(spark, str(other))


def test_discovery_and_nested_json(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text(json.dumps([{"id": 1, "m": {"k": "v", "n": {"z": 2}}}]))
    (tmp_path / "deep" / "b_combined.json").write_text(json.dumps([{"id": 7, "m": {"k": "w", "n": {"z": 3}}}]))
    df = readers.read_any(spark, str(tmp_path))
    assert df.columns == ["id", "m.k", "m.n.z"] and df.first()["id"] == 7


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("é", "augmented", 1, None)], "prompt string, dataset string, intent_disc int, intent_cont double")
    writers.write_augmented(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert json.loads(text) == {"prompt": "é", "dataset": "augmented", "intent_disc": 1, "intent_cont": None} and "é" in text
    writers.write_metrics(df, str(tmp_path / "metrics"))
    assert any((tmp_path / "metrics" / "csv").glob("*.csv"))


def test_normalise_fills_gaps(spark):
    df = spark.createDataFrame([(0, " é ", "3.7", "x"), (1, "é", "abc", "x"), (2, None, None, "x")], "row_id bigint, prompt string, intent_cont string, source string")
    rows = {r["row_id"]: r for r in profile.normalise(df).collect()}
    assert set(rows) == {0, 2} and rows[0]["intent_cont"] == 3.7 and rows[0]["id"] == "gen_0"
    assert rows[0]["language"] == "FR" and rows[2]["language"] == "unk"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "row_id bigint, prompt string, intent_disc int, intent_cont double, source string")
    assert lexical.ttr(empty).first()["ttr"] == 0.0
    assert lexical.unigram_entropy(empty).first()[0] == 0.0
    assert stats.class_cv_percent(empty).first()[0] == 0.0
    assert dedup.duplicate_ratio(empty, empty).first()[0] == 0.0
    assert lsh.dedup_near(empty, "row_id", "prompt").count() == 0


def test_grade_of_repeated_answers(spark):
    rows = [(i, f"q{i}", "Brazil" if i < 6 else f"a{i}", "name") for i in range(10)]
    df = spark.createDataFrame(rows, "qa_id bigint, questions string, answer string, type string")
    row = answers.grade(df).first()
    assert row["diversity_ratio"] == 0.5 and row["grade"] == "low" and "artefacts" in row["advice"]


def test_language_of_labelled_rows(spark, folder):
    docs = views.table(spark, "/root/testdata/sf0.001", "documents")
    model = language.language_profiles(docs, "text", "lang")
    found = language.detect_language(docs.where(F.length("text") > 200).select("doc_id", "text", "lang"), "text", model)
    row = found.agg(F.avg((F.col("detected") == F.col("lang")).cast("double")).alias("share")).first()
    assert row["share"] > 0.9
    blank = spark.createDataFrame([(1, " "), (2, None)], "doc_id bigint, text string")
    assert {r["detected"] for r in language.detect_language(blank, "text", model).collect()} == {"unknown"}


def test_clusters_and_assignment_shapes(spark):
    vectors = views.vectors(spark, "/root/testdata/sf0.001")
    model = semantic.fit_clusters(vectors, "embedding", 5)
    labelled = semantic.cluster_embeddings(vectors, "embedding", 5, min_size=3, model=model)
    assert labelled.count() == vectors.count()
    assert {r["cluster"] for r in labelled.select("cluster").distinct().collect()} <= set(range(-1, 5))
    row = topics.assign_topics(vectors, "embedding", model).first()
    assert sum(row["probabilities"]) == pytest.approx(1.0) and len(row["probabilities"]) == 5


def test_cached_embeddings_embed_new_texts_only(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "row_id bigint, prompt string")
    more = spark.createDataFrame([(3, "b"), (4, "c")], "row_id bigint, prompt string")
    _, cache = semantic.embed_with_cache(first, "prompt", None)
    rows, grown = semantic.embed_with_cache(more, "prompt", cache)
    assert grown.count() == 3 and all(len(r["embedding"]) == 384 for r in rows.collect())


def test_random_pairs(spark):
    vectors = views.vectors(spark, "/root/testdata/sf0.001")
    pairs = semantic.random_pairs(vectors, "embedding", "vec_id", 50)
    first = {r["draw"]: r["cosine"] for r in pairs.collect()}
    again = {r["draw"]: r["cosine"] for r in semantic.random_pairs(vectors.repartition(5), "embedding", "vec_id", 50).collect()}
    assert 40 <= len(first) <= 50 and set(first) == set(again)
    assert all(first[d] == pytest.approx(again[d]) and -1.001 <= first[d] <= 1.001 for d in first)
    assert semantic.random_pairs(vectors.limit(1), "embedding", "vec_id").count() == 0


def test_pluggable_models(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b")], "row_id bigint, prompt string")
    rows = semantic.embed(df, "prompt", model=lambda: lambda texts: [[float(len(t)), 0.0] for t in texts]).collect()
    assert {r["row_id"]: list(r["embedding"]) for r in rows} == {1: [2.0, 0.0], 2: [1.0, 0.0]}
    params = stats.label_params(None)
    scored = scoring.score_rows(df, "prompt", params, predictor=lambda: lambda texts: [len(t) - 1 for t in texts]).collect()
    assert {r["row_id"]: r["intent_predicted_denormalized"] for r in scored} == {1: 1700.0, 2: 1500.0}


def test_score_columns(spark):
    df = spark.createDataFrame([("helloworld", "helloworlds"), ("a b", "b a c"), ("", "x")], "a string, b string")
    rows = df.select(fuzzy.token_set_score(F.col("a"), F.col("b")).alias("t"), fuzzy.partial_score(F.col("a"), F.col("b")).alias("p")).collect()
    assert [round(r["t"], 3) for r in rows] == [round(100 * 20 / 21, 3), 100.0, 0.0]
    assert [r["p"] for r in rows][0] == 100.0 and rows[2]["p"] == 0.0


def test_seed_policies(spark):
    rows = [(i, f"p{i}", i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id bigint, prompt string, intent_disc int")
    per = lambda policy: {r["intent_disc"]: r["count"] for r in sampling.stratified_seeds(df, 50, 200, policy=policy).groupBy("intent_disc").count().collect()}
    assert per("prefix") == {0: 50, 1: 50, 2: 50, 3: 50}
    assert per("per_class") == {c: 40 for c in range(5)}


def test_hot_answer_keeps_every_row(spark):
    rows = [(i, f"q{i}", "hot" if i % 3 == 0 else f"a{i}", "name") for i in range(900)]
    df = spark.createDataFrame(rows, "qa_id bigint, questions string, answer string, type string")
    got = answers.with_answer_frequency(df).collect()
    assert len(got) == 900 and {r["frequency"] for r in got if r["answer"] == "hot"} == {300}


def test_hot_copies_form_one_cluster(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(i, long if i % 3 == 0 else f"entry {i} about {i * 7919 % 104729} and {i * 31 % 997}") for i in range(150)]
    df = spark.createDataFrame(rows, "row_id bigint, prompt string")
    clusters = lsh.near_duplicate_clusters(df, "row_id", "prompt").where("cluster = 0")
    assert sorted(r["member"] for r in clusters.collect()) == list(range(0, 150, 3))
    kept = {r["row_id"] for r in lsh.dedup_near(df, "row_id", "prompt").collect()}
    assert 0 in kept and not any(i in kept for i in range(3, 150, 3))
