"""Exact de-duplication. Keys are digests, so long texts are not shuffled as keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .sampling import keep_first_n


def digest(columns: list[str]) -> Column:
    """One key for several nullable columns; a null differs from every text."""
    return F.md5(F.concat_ws("\x1f", *[
        F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]))


def dedup_exact_normalised(df: DataFrame, text: str, order: str) -> DataFrame:
    """First row of every normalised text."""
    keyed = df.withColumn("_sig", tx.text_signature(text))
    return keep_first_n(keyed, ["_sig"], [order], 1).drop("_sig")


def duplicate_ratio(rows: DataFrame, kept: DataFrame, out: str = "duplicate_ratio") -> DataFrame:
    """1 - kept / rows, 0 for an empty table."""
    total = rows.agg(F.count("*").alias("n")).scalar()
    return kept.agg(F.count("*").alias("n")).select(
        F.when(total == 0, 0.0).otherwise(1 - F.col("n") / F.greatest(total, F.lit(1))).alias(out))


def signatures(source: DataFrame, text: str) -> DataFrame:
    """``_sig``: the different normalised texts of a table, as digests."""
    return source.select(tx.text_signature(text).alias("_sig")).distinct()


def anti_join_source(df: DataFrame, source: DataFrame, text: str, source_text: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows whose normalised text is not in the source. ``known``: the source's ``signatures``, if they are there already."""
    known = known if known is not None else signatures(source, source_text or text)
    return df.withColumn("_sig", tx.text_signature(text)).join(known, "_sig", "left_anti").drop("_sig")


def dedup_against(df: DataFrame, source: DataFrame, text: str, order: str, source_text: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Drop rows whose text is in the source, and later repeats. Repeats go first: after that every
    signature occurs once, and no signature can make the anti join uneven."""
    return anti_join_source(dedup_exact_normalised(df, text, order), source, text, source_text, known)


def combine(base: DataFrame, new: DataFrame, order: str = "row_id") -> DataFrame:
    """Base rows, then new rows; the first row of every prompt, compared without case and outer white
    space. Of the rows without a prompt one stays."""
    both = (base.withColumn("_part", F.lit(0))
            .unionByName(new.withColumn("_part", F.lit(1)), allowMissingColumns=True)
            .withColumn("_key", F.md5(tx.trim_key("prompt"))))
    return keep_first_n(both, ["_key"], ["_part", order], 1).drop("_part", "_key")


def drop_strict_duplicates(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    return keep_first_n(df.withColumn("_key", digest(columns)), ["_key"], [order], 1).drop("_key")


def exact_dup_groups(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """The largest groups of equal keys, represented by their first row id."""
    return (df.groupBy(digest(columns).alias("_key")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
            .where("n > 1").orderBy(F.desc("n"), "first_row").limit(top).drop("_key"))


def exact_dup_summary(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Per dataset: repeated keys and the share of rows that belong to one."""
    groups = df.groupBy(by, digest(columns).alias("_key")).agg(F.count("*").alias("n"))
    return groups.groupBy(by).agg(
        F.count_if(F.col("n") > 1).alias("dup_groups"),
        (F.lit(100.0) * F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("rows_involved_pct"))


def duplicated_pct(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Share of rows that repeat an earlier one."""
    groups = df.groupBy(by, digest(columns).alias("_key")).agg(F.count("*").alias("n"))
    return groups.groupBy(by).agg(
        (F.lit(100.0) * (F.sum("n") - F.count("*")) / F.sum("n")).alias("duplicated_pct"))
