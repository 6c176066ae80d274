"""The tables the registered queries read, as views over the given parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import dense_index


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled prompts: ``row_id, prompt, dataset, intent_disc, intent_cont``."""
    lang = F.col("lang")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("prompt"), F.col("source").alias("dataset"),
        F.when(lang == "en", 0).when(lang == "fr", 1).when(lang == "de", 2).otherwise(3).alias("intent_disc"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("intent_cont"))


def dealt_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompts dealt out by id, for queries whose work per text is dear: the small test tables lie in one row group, which
    is one task. (Library operators deal nothing out; they work on the splits they are given.)"""
    return prompts(spark, folder).repartition("row_id")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Two prompt tables under one schema, told apart by ``source``: even rows are the base
    (``mapped``), odd rows the generated one (``augmented``)."""
    return two_sides(prompts(spark, folder))


def dealt_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return two_sides(dealt_prompts(spark, folder))


def two_sides(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source", F.when(F.col("row_id") % 2 == 0, "mapped").otherwise("augmented"))


def qa(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("qa_id"), F.col("p_name").alias("questions"),
        F.col("p_brand").alias("answer"), F.col("p_type").alias("type"))


def qa_text(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn with the turn that follows it, if that is the assistant's. Turn numbers may have gaps, so the turns are put in
    places first (``dense_index``, over the keys alone); the next turn is then an equi join on the place: no window, and no
    task per conversation, however long one is."""
    turns = table(spark, folder, "conversations")
    places = dense_index(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    before = places.where(F.col("role") == "user").select("conv_id", "turn", "pos")
    after = places.where(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("next"), (F.col("pos") - 1).alias("pos"))
    pairs = before.join(after, ["conv_id", "pos"]).select("conv_id", "turn", "next")
    asked = turns.select("conv_id", "turn", F.col("text").alias("questions"), F.col("role").alias("type"))
    answered = turns.select("conv_id", F.col("turn").alias("next"), F.col("text").alias("answer"))
    return pairs.join(asked, ["conv_id", "turn"]).join(answered, ["conv_id", "next"]).select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("qa_id"), "questions", "answer", "type")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
