"""One row of key figures per dataset, and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, lexical, stats

LOW_TTR = 0.20


def synthesis_table(df: DataFrame, fuzzy: DataFrame | None = None, semantic: DataFrame | None = None,
                    by: str = "source") -> DataFrame:
    """Rows, classes, label entropy, mean score, type-token and hapax ratio, exact repeats; and, where
    their tables (``source, fuzzy_pairs`` and ``source, mean_cosine``) are given, fuzzy pairs per
    hundred rows and mean inner cosine."""
    base = df.groupBy(by).agg(F.count("*").alias("n_rows"), F.avg("intent_cont").alias("mean_intent_cont"))
    words = lexical.token_stats(df, ["prompt"], by).select(by, F.col("ttr").alias("ttr_prompt"), F.col("hapax_ratio").alias("hapax_prompt"))
    out = (base.join(stats.label_entropy(df, by), by, "left").join(words, by, "left")
           .join(dedup.duplicated_pct(df, ["prompt"], by), by, "left"))
    pairs = fuzzy if fuzzy is not None else df.sparkSession.createDataFrame([], f"{by} string, fuzzy_pairs bigint")
    cosines = semantic if semantic is not None else df.sparkSession.createDataFrame([], f"{by} string, mean_cosine double")
    return out.join(pairs, by, "left").join(cosines, by, "left").select(
        by, "n_rows", "unique_labels", F.col("entropy").alias("label_entropy"), "mean_intent_cont", "ttr_prompt", "hapax_prompt",
        F.col("duplicated_pct").alias("dup_exact_prompt_pct"),
        (F.lit(100.0) * F.col("fuzzy_pairs") / F.col("n_rows")).alias("quasi_dup_prompt_pct"),
        F.col("mean_cosine").alias("mean_semantic_intra"))


def recommendations(table: DataFrame, ttr: Column | str = "ttr_prompt", low: float = LOW_TTR, by: str = "source") -> DataFrame:
    """Advice for datasets whose vocabulary is small for their size."""
    return table.where(F.col(ttr) < low).select(
        by, F.concat(F.lit("["), F.col(by), F.lit("] low type-token ratio: add varied sources or paraphrases")).alias("advice"))
