"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Sums of doubles differ in their last bits between engines.
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def query(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return rounded(run(spark, folder))
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# Common table expressions of the SQL side.
PROMPTS = """prompts AS (SELECT doc_id AS row_id, text AS prompt, source AS dataset,
  CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS INTEGER) AS intent_disc,
  CAST(n_chars % 1000 AS DOUBLE) / 1000 AS intent_cont FROM documents)"""
CORPUS = PROMPTS + """, corpus AS (SELECT *, CASE WHEN row_id % 2 = 0 THEN 'mapped' ELSE 'augmented' END AS source FROM prompts)"""
QA = """qa AS (SELECT p_partkey AS qa_id, p_name AS questions, p_brand AS answer, p_type AS type FROM part)"""
COUNTS = QA + """, ac AS (SELECT lower(trim(answer)) AS answer_key, count(*) AS cnt FROM qa WHERE answer IS NOT NULL GROUP BY 1)"""
QA_TEXT = """qa_text AS (SELECT conv_id * 1000000 + turn AS qa_id, text AS questions, nxt AS answer, role AS type FROM
  (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nxt_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nxt_role = 'assistant')"""


def tokens(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({column}, '\s+'), lambda x: x <> '')"


def words(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def norm(column: str) -> str:
    return rf"trim(regexp_replace(lower({column}), '\s+', ' ', 'g'))"


def windows(tokens_column: str, n: int, sep: str = " ") -> str:
    return (f"list_transform(range(1, len({tokens_column}) - {n} + 2), "
            f"lambda i: array_to_string({tokens_column}[i:i + {n} - 1], '{sep}'))")


def any_of(column: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{k}')" for k in keywords) + ")"
