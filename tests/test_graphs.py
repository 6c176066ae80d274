"""Topic trees against always joining the nearest two, diverse candidates, exact p-values against all orders, pairs of shared tokens."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmill.functions import fuzzy as fz
from promptmill.functions import vectors as vec
from promptmill.operators import compare, fuzzy, topics
from promptmill.plans import generate as gen
from promptmill.sources import views

SMALL = "/root/testdata/sf0.001"


def nearest_two(nodes):
    """Merges of (id, n, centre) by trying all pairs at every step."""
    nodes, out = dict(nodes), []
    following = max(nodes) + 1
    while len(nodes) > 1:
        h, a, b = min((math.sqrt(2 * x[0] * y[0] / (x[0] + y[0])) * float(np.linalg.norm(x[1] - y[1])), i, j)
                      for (i, x), (j, y) in itertools.combinations(sorted(nodes.items()), 2))
        (n, c), (m, d) = nodes.pop(a), nodes.pop(b)
        nodes[following] = (n + m, (n * c + m * d) / (n + m))
        out.append((len(out), a, b, following, h, n + m))
        following += 1
    return out


@pytest.mark.parametrize("count", [1, 2, 3, 25])
def test_topic_tree(spark, count):
    rng = np.random.default_rng(count)
    rows = [(int(i) - 1, rng.normal(size=5), int(rng.integers(1, 50))) for i in range(count)]
    df = spark.createDataFrame([(i, [float(x) for x in c], n) for i, c, n in rows], "topic int, centre array<double>, n long")
    tree = topics.topic_tree(df, "topic")
    got = [tuple(r) for r in tree.orderBy("step").collect()]
    expected = nearest_two({i: (n, c) for i, c, n in rows})
    assert [g[:4] + g[5:] for g in got] == [e[:4] + e[5:] for e in expected]
    assert [g[4] for g in got] == pytest.approx([e[4] for e in expected])
    groups = {r.topic: r.node for r in topics.topics_at(tree, df, "topic", 3).collect()}
    assert len(set(groups.values())) == min(3, count)
    for _, a, b, node, _, _ in expected[:max(0, count - 3)]:
        assert a not in groups.values() and b not in groups.values()
    assert topics.topic_tree(df.limit(0), "topic").count() == 0


def test_diverse_candidates(spark):
    rnd = random.Random(1)
    rows = [(s, k, f"seed {s}", "".join(rnd.choice("abc") for _ in range(9))) for s in range(30) for k in range(s % 7)]
    rows += [(50, k, "seed", "the same") for k in range(3)]
    df = spark.createDataFrame(rows, "seed_id long, candidate int, seed_prompt string, prompt string")
    cosines = {(r.a, r.b): r.c for r in spark.createDataFrame(
        [(a, b) for s in {r[0] for r in rows} for a in {x for r in rows if r[0] == s for x in r[2:]} for b in {r[3] for r in rows if r[0] == s}],
        "a string, b string").select("a", "b", vec.dot(vec.hash_unit("a"), vec.hash_unit("b")).alias("c")).collect()}
    expected = []
    for s in {r[0] for r in rows}:
        left = {k: (cosines[seed, p], p) for i, k, seed, p in rows if i == s and 0.6 <= cosines[seed, p] <= 0.9}
        taken = []
        while left and len(taken) < 3:
            near = {k: max([cosines[p, q] for _, q in taken]) if taken else c for k, (c, p) in left.items()}
            k = min(left, key=lambda k: (near[k], left[k][0], k))
            taken.append((k, left.pop(k)[1]))
            expected.append((s, k, len(taken), round(near[k], 9)))
    got = [(r.seed_id, r.candidate, r["rank"], round(r.nearest, 9)) for r in gen.diverse_of_k(df, 0.6, 0.9, 3).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 40


def gap_of(marks):
    n, m = sum(marks), len(marks) - sum(marks)
    a = b = best = 0
    for left in marks:
        a, b = (a + 1, b) if left else (a, b + 1)
        best = max(best, abs(a * m - b * n))
    return best / (n * m)


@pytest.mark.parametrize("n, m", [(1, 1), (2, 3), (4, 4), (5, 3), (6, 2), (1, 7)])
def test_exact_p_values_against_all_orders(n, m):
    gaps = [gap_of([k in chosen for k in range(n + m)]) for chosen in itertools.combinations(range(n + m), n)]
    for observed in sorted(set(gaps)):
        assert compare.ks_exact_p(observed, n, m) == pytest.approx(sum(g >= observed - 1e-12 for g in gaps) / len(gaps))
    assert compare.ks_exact_p(0.0, n, m) == 1.0


def test_two_samples_by_group(spark):
    rnd = random.Random(2)
    rows = [(g, side, float(rnd.randrange(40) + 9 * (side == "b") * (g == 2))) for g in (1, 2, 3) for side, n in (("a", 30), ("b", 20))
            for _ in range(n)] + [(4, "a", 1.0), (1, "c", 5.0), (1, "a", None), (5, "a", 1.0), (5, "b", 1.0)]
    df = spark.createDataFrame(rows, "g int, source string, x double")
    exact = {r.g: r for r in compare.ks_two_sample_by(df, "x", "a", "b", ["g"]).collect()}
    series = {r.g: r for r in compare.ks_two_sample_by(df, "x", "a", "b", ["g"], exact=10).collect()}
    assert set(exact) == {1, 2, 3, 5} and {r.method for r in exact.values()} == {"exact"}
    assert {g: r.method for g, r in series.items()} == {1: "asymptotic", 2: "asymptotic", 3: "asymptotic", 5: "exact"}
    for g in (1, 2, 3):
        alone = compare.ks_two_sample(df.where(f"g = {g}"), "x", "a", "b").first()
        assert (series[g].statistic, series[g].p_value) == pytest.approx((alone.statistic, alone.p_value))
        assert exact[g].p_value == pytest.approx(compare.ks_exact_p(alone.statistic, 30, 20)) and abs(exact[g].p_value - alone.p_value) < 0.1
    assert exact[2].p_value < 0.05 and exact[5].p_value == 1.0


def test_pairs_of_shared_tokens(spark):
    rnd = random.Random(5)
    texts = [r.prompt for r in views.prompts(spark, SMALL).select("prompt").collect()]
    texts += [" ".join(rnd.choice(["the", "of", "and", "x%d" % rnd.randrange(30)]) for _ in range(rnd.randrange(1, 25))) for _ in range(300)]
    texts += ["the", "the the the", "of the", "  ", "", None, "a b c", "b a c"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, prompt string")
    sets = {i: set(t.split()) for i, t in enumerate(texts) if t and t.split()}
    weight = {i: sum(map(len, s)) + len(s) for i, s in sets.items()}
    expected = []
    for i, j in itertools.combinations(sorted(sets), 2):
        if fuzzy.length_band(len(texts[i]), len(texts[j])) and (both := sets[i] & sets[j]):
            common = sum(map(len, both)) + len(both)
            contained = common in (weight[i], weight[j])
            score = 100.0 if contained else 200.0 * (common - 1) / (min(weight[i], weight[j]) + common - 2)
            if score >= 90:
                expected.append((i, j, round(score, 6)))
                assert fz.token_set_ratio(sets[i], sets[j]) >= score - 1e-9
    got = sorted((r.id_a, r.id_b, round(r.score, 6)) for r in fuzzy.shared_token_pairs(df).collect())
    assert got == expected and len(got) > 50
    assert fuzzy.shared_token_pairs(df.limit(0)).count() == 0


def test_bounds_lose_no_fuzzy_pair_of_short_texts(spark):
    rnd = random.Random(6)
    words = ["hello", "helo", "world", "worlds", "a", "ab", "abc", "stone", "stones", "ston", "rock"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 7))) for _ in range(220)] + ["helloworld foobar", "hello world foo bar"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, prompt string")
    sets = [set(t.split()) for t in texts]
    expected = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
                if fuzzy.length_band(len(texts[i]), len(texts[j])) and fz.token_set_ratio(sets[i], sets[j]) >= 90]
    assert sorted((r.id_a, r.id_b) for r in fuzzy.fuzzy_pairs(df).collect()) == expected
    ready = [fz.SearchText(t) for t in texts]
    expected = sorted((i, j) for i in range(0, len(texts), 2) for j in range(1, len(texts), 2) if fz.partial_ratio(ready[i], ready[j], 92.0) >= 92)
    got = fuzzy.cross_source_matches(df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1")).collect()
    assert sorted((r.id_left, r.id_right) for r in got) == expected
    assert df.where(F.col("row_id") < 0).count() == 0
