"""Completeness and behaviour that SQL does not check: all fuzzy pairs, long chains of near-duplicates, readers, generators, and a
session whose workers know nothing of the package."""

import itertools
import json
import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptmill.functions import fuzzy as fz
from promptmill.operators import fuzzy, lsh
from promptmill.plans import balance
from promptmill.plans import compare as plans_compare
from promptmill.plans import generate as gen
from promptmill.session import discard, materialize
from promptmill.sources import readers, views

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return views.prompts(spark, SMALL)


@pytest.fixture(scope="module")
def texts(small):
    return {r.row_id: r.prompt for r in small.select("row_id", "prompt").collect()}


def test_every_fuzzy_pair_is_found(small, texts):
    tokens = {i: set(t.split()) for i, t in texts.items()}
    expected = [(i, j, round(s, 6)) for i, j in itertools.combinations(sorted(texts), 2)
                if fuzzy.length_band(len(texts[i]), len(texts[j])) and (s := fz.token_set_ratio(tokens[i], tokens[j])) >= 90]
    got = sorted((r.id_a, r.id_b, round(r.score, 6)) for r in fuzzy.fuzzy_pairs(small).collect())
    assert got == sorted(expected) and len(got) > 10
    drawn = fuzzy.fuzzy_pairs(small, sample_max=40).collect()
    assert {(r.id_a, r.id_b) for r in drawn} < {(a, b) for a, b, _ in got}


def test_synthesis_table_counts_fuzzy_pairs_of_each_side(spark, texts):
    rows = [(r, t) for r, t in texts.items()] + [(1000 + 2 * r, t) for r, t in list(texts.items())[:9]] + [(5000, " "), (5002, " ")]
    tokens = {i: set(t.split()) for i, t in rows}
    said = dict(rows)
    docs = spark.createDataFrame([(i, t, 0, 0.5) for i, t in rows], "row_id long, prompt string, intent_disc int, intent_cont double")
    sides = views.two_sides(docs)
    expected = {}
    for side, parity in (("mapped", 0), ("augmented", 1)):
        ids = [i for i in sorted(said) if i % 2 == parity]
        pairs = [1 for i, j in itertools.combinations(ids, 2) if tokens[i] and tokens[j] and fuzzy.length_band(len(said[i]), len(said[j]))
                 and fz.token_set_ratio(tokens[i], tokens[j]) >= 90]
        expected[side] = 100.0 * len(pairs) / len(ids)
    got = plans_compare.synthesis_table(sides, fuzzy=fuzzy.fuzzy_counts(sides)).collect()
    assert {r.source: round(r.quasi_dup_prompt_pct, 6) for r in got} == {k: round(v, 6) for k, v in expected.items()}
    from promptmill.queries.registry import QUERIES
    query = QUERIES["synthesis_table_fuzzy"](spark, SMALL).collect()
    assert len(query) == 2 and all(r.quasi_dup_prompt_pct is not None and r.mean_semantic_intra is not None for r in query)


def test_every_match_across_sources_is_found(small, texts):
    ready = {i: fz.SearchText(t) for i, t in texts.items()}
    expected = [(i, j) for i in texts for j in texts if i % 2 == 0 and j % 2 == 1 and fz.partial_ratio(ready[i], ready[j], 92.0) >= 92]
    got = fuzzy.cross_source_matches(small.where("row_id % 2 = 0"), small.where("row_id % 2 = 1")).collect()
    assert sorted((r.id_left, r.id_right) for r in got) == sorted(expected) and expected


def test_giving_up_early_changes_no_score_that_counts():
    pairs = [({"alpha", "beta", "gamma"}, {"alpha", "beta", "gamme"}), ({"aaaa", "bbbb"}, {"aaab", "bbbb", "cc"}), ({"x" * 300}, {"x" * 290 + "y" * 10})]
    for a, b in pairs:
        full = fz.token_set_ratio(a, b)
        assert fz.token_set_ratio(a, b, full) == pytest.approx(full)
        assert fz.token_set_ratio(a, b, full + 1) <= full


def test_a_chain_of_near_duplicates_is_walked_in_order(spark):
    rows = [(k, ["a%d" % k, "a%d" % (k + 1)]) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, names array<string>").select("id", F.transform("names", lambda n: F.xxhash64(n)).alias("keys"))
    accepted, members = lsh.first_accepted(df)
    assert sorted(r.id for r in accepted.collect()) == list(range(0, 200, 2))
    assert members.select("id").distinct().count() == 200


def test_large_components_give_the_same_walk(spark, monkeypatch):
    rows = [(k, [k // 3, 1000 + k // 5]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, keys array<long>")
    at_once = sorted(r.id for r in lsh.first_accepted(df)[0].collect())
    monkeypatch.setattr(lsh, "WALK_ROWS", 0)
    assert sorted(r.id for r in lsh.first_accepted(df)[0].collect()) == at_once


def test_written_tables_can_be_discarded(spark):
    table = materialize(spark.range(10))
    path = table._promptmill_path.removeprefix("file:")
    assert os.path.exists(path)
    discard(table)
    assert not os.path.exists(path)


def test_tolerant_reader_keeps_valid_json(spark, tmp_path):
    lines = ['{"prompt": "a", "intent_disc": 1}', '{"prompt": "b", "intent_disc": "x", "id": 7}', '{"prompt": "c", "intent_disc": 1.5}',
             "", '{"prompt": "d", "intent_disc": "2", "intent_cont": "0.5"}', '{"prompt": "e"', "   ", '[1, 2]', '{"prompt": ["f"], "language": "fr"}']
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(lines))
    good, bad = readers.read_prompts_tolerant(spark, str(path), "mapped", with_lines=True)
    assert good.columns == ["prompt", "dataset", "intent_disc", "intent_cont", "id", "language", "line_no", "source"]
    got = {r.line_no: (r.prompt, r.intent_disc, r.intent_cont, r.id, r.language) for r in good.collect()}
    assert got == {0: ("a", 1, None, None, None), 1: ("b", None, None, "7", None), 2: ("c", None, None, None, None),
                   4: ("d", 2, 0.5, None, None), 8: ('["f"]', None, None, None, "fr")}
    assert {r.line_no for r in bad.collect()} == {5, 7}


def test_a_file_without_the_class_fails_even_with_a_schema(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text(json.dumps({"prompt": "a", "dataset": "b"}))
    with pytest.raises(ValueError, match="intent_disc"):
        readers.read_prompts(spark, str(path), schema=readers.PROMPT_SCHEMA)


def test_generators_by_batch(spark):
    @gen.batch_generator
    def whole(batches, params):
        for batch in batches:
            size = len(batch)
            yield pd.DataFrame({"text": [f"{params['stage']} {size}"] * size, "error": [None] * size}, dtype=object)

    @gen.batch_generator
    def short(batches, params):
        for batch in batches:
            yield pd.DataFrame({"text": ["x"] * (len(batch) - 1), "error": [None] * (len(batch) - 1)}, dtype=object)
    requests = spark.range(6).repartition(1).select("id", gen.build_request("brainstorm").alias("messages"), F.col("id").alias("number"))
    made = gen.run_generator(requests, whole, {"stage": "s"}, ["id"]).collect()
    assert {r.text for r in made} == {"s 6"} and {r.error for r in made} == {None}
    with pytest.raises(Exception, match="5 rows for 6 requests"):
        gen.run_generator(requests, short, {"stage": "s"}, ["id"]).collect()


def test_a_run_reports_its_failures(small):
    def sometimes(messages, params):
        if params["number"] % 2:
            raise ValueError("odd")
        return gen.rule_based(messages, params)
    result = balance.balance_dataset(small, generator=sometimes, target_coverage=30, min_similarity=0.0)
    failed = result.failures.groupBy("stage").count().collect()
    assert {r["stage"] for r in failed} >= {"paraphrase", "syntax", "conditional"}
    assert result.failures.where(~F.col("error").contains("odd")).count() == 0
    assert result.augmented.count() > 0


def test_workers_get_the_package(tmp_path):
    """Another directory, no PYTHONPATH: only the driver's path knows the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "import __spark_entry__ as e\n"
            "from promptmill.session import build_session\n"
            "s = build_session('local[2]', 2)\n"
            f"print('rows', e.queries()['minhash_signatures'](s, {SMALL!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
