"""Documents through five training-data operators: low quality out, one document of each near-duplicate group, repeated
spans out, benchmark passages out, and token ids in the end.

Each stage takes (spark, docs, sf_dir) and judges all of ``docs``, the rows that its predecessor kept.

Cases: a null or empty text has no words, and the first stage rejects it; rows without id are judged like others, and near-duplicates of
any row among them stay, as nothing names them; rows that share an id go together where one of them is a later near-duplicate;
identical rows are separate rows to all stages; an empty table gives no rows; columns other than those of ``documents`` are left out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.llm.bpe_codec import BytePairCoder
from promptmill.llm.decontaminate import without_overlaps
from promptmill.llm.minhash_bbit import near_duplicates
from promptmill.llm.path_dedup import remove_repeated_spans
from promptmill.llm.quality import fit_quality, score_quality
from promptmill.session import materialize, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, trained on weak labels of these documents, does not reject."""
    ship_package(spark)
    return score_quality(docs, fit_quality(docs)).filter("keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component over word 5-grams at a similarity of 0.8; rows without id stay."""
    ship_package(spark)
    later = near_duplicates(docs, size=5, percent=80).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(materialize(later.distinct()), "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of at least 35 words that occur more than once in what is left of the corpus."""
    ship_package(spark)
    cut = remove_repeated_spans(docs.drop("n_chars"), carry=("lang", "source"), forms=("rest",))
    return cut.select("doc_id", F.col("rest").alias("text"), "lang", "source", F.length("rest").cast("bigint").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    ship_package(spark)
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to."""
    ship_package(spark)
    coder = BytePairCoder(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coder.decode(coder.encode(docs)).select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.col("decoded").cast("string").alias("text"))


STAGES = [("quality classifier", quality_classifier), ("near-duplicates", near_dedup), ("substring dedup", substring_dedup),
          ("decontamination", decontamination), ("byte-level BPE", byte_bpe)]
#: Training, components and hashes are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one kept is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
