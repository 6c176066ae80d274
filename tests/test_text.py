"""Text and vector expressions on edge rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmill.functions import text as tx
from promptmill.functions import vectors as vec

NBSP = chr(0xA0)
EDGES = ["", " ", "Hello", "Hello ", "two words", f"a{NBSP}b  c\n", "- x", "1. x", "Prompt: x", "`quoted`", "Élan vital, déjà vu!",
         "汉字 text", "is this 12/05/2021 or 1999?", "a b c d e a b c"]


def column(spark, expression):
    rows = spark.createDataFrame(list(enumerate(EDGES)), "i int, t string").select("i", expression.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_normalised_text(spark):
    assert column(spark, tx.norm_text("t")) == [" ".join(t.lower().split()) for t in EDGES]


def test_tokens(spark):
    assert column(spark, tx.ws_tokens("t")) == [t.split() for t in EDGES]


def test_trim_key(spark):
    assert column(spark, tx.trim_key("t")) == [t.strip().lower() for t in EDGES]


def test_word_tokens(spark):
    assert column(spark, tx.word_tokens("t")) == [re.findall(r"\b\w\w+\b", t.lower()) for t in EDGES]


def test_signature(spark):
    assert column(spark, tx.text_signature("t")) == [hashlib.md5(" ".join(t.lower().split()).encode()).hexdigest() for t in EDGES]


def test_clean_output(spark):
    got = dict(zip(EDGES, column(spark, tx.clean_output("t"))))
    assert (got["- x"], got["1. x"], got["Prompt: x"], got["`quoted`"], got[""]) == ("x", "1. x", "x", "quoted", "")


def test_shingles(spark):
    got = column(spark, tx.word_shingles("t", 3))
    for text, shingles in zip(EDGES, got):
        words = text.lower().split()
        want = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
        assert shingles == want
    for text, shingles in zip(EDGES, column(spark, tx.char_shingles("t", 5))):
        assert set(shingles) == {text[j:j + 5] for j in range(max(1, len(text) - 4))}


def test_script_language(spark):
    got = dict(zip(EDGES, column(spark, tx.script_language("t"))))
    assert (got["汉字 text"], got["Élan vital, déjà vu!"], got["Hello"]) == ("CN", "FR", "EN")


def test_entity_and_date_counts(spark):
    assert column(spark, tx.n_dates("t"))[-2] == 2
    assert column(spark, tx.n_numbers("t"))[-2] == 4


def test_hash_embedding_cosine(spark):
    rows = spark.createDataFrame([("Hello", "World")], "a string, b string").select(
        vec.dot(vec.hash_unit("a"), vec.hash_unit("b")).alias("short"),
        vec.dot(vec.hash_embedding("a"), vec.hash_embedding("b")).alias("long"), vec.hash_embedding("a").alias("v")).first()
    assert rows["short"] == pytest.approx(0.6770514162, abs=1e-9)
    assert rows["long"] == pytest.approx(rows["short"], abs=1e-6)
    assert len(rows["v"]) == 384 and np.linalg.norm(rows["v"]) == pytest.approx(1, abs=1e-6)


def test_numeric_text(spark):
    df = spark.createDataFrame([("1,234.5",), ("3.7",), ("abc",), ("",)], "t string")
    assert [r[0] for r in df.select(tx.is_numeric_text("t")).collect()] == [True, True, False, False]


def test_indicators(spark):
    df = spark.createDataFrame([("Who knows how many?",)], "t string")
    assert df.select(F.array_join(tx.indicators_found("t"), ",")).first()[0] == "who,how many"
