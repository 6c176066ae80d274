"""Repeatable samples and top-k. Draws hash the row key with a seed, so they do not depend on how the
table is partitioned. ``row_number() <= n`` lets Spark cut every group to ``n`` rows before the shuffle
(window group limit), so a class that holds a third of the table costs no more than a small one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key, seed: int) -> Column:
    """Pseudo-random rank of a row; md5 so that any engine can compute it."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def uniform(parts: list) -> Column:
    """Number in [0, 1) from hashed parts: the first 32 bits of an md5, so that any engine can compute it."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def keep_first_n(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every key, in the given order. Null keys form one group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stratified_sample(df: DataFrame, label: str, key: str, per_class: int = 50, seed: int = 42) -> DataFrame:
    """Up to ``per_class`` hashed draws of every class."""
    return keep_first_n(df.where(F.col(label).isNotNull()), [label], [draw(key, seed), F.col(key)], per_class)


def stratified_seeds(df: DataFrame, per_class: int = 50, max_seeds: int | None = None, seed: int = 42,
                     policy: str = "per_class", label: str = "intent_disc", key: str = "row_id") -> DataFrame:
    """Seeds for generation: all rows of a small class, ``per_class`` hashed draws of a large one.

    With ``max_seeds`` the list is cut to that many in all: ``per_class`` takes the same number of every class before the cut;
    ``prefix`` lists the classes in ascending order and cuts the list, so late classes may get no seeds."""
    w = Window.partitionBy(label).orderBy(draw(key, seed), F.col(key))
    ranked = (df.where(F.col(label).isNotNull()).withColumn("seed_rank", F.row_number().over(w))
              .where(F.col("seed_rank") <= per_class))
    if max_seeds is None:
        return ranked
    order = [label, "seed_rank"] if policy == "prefix" else ["seed_rank", label]
    return ranked.orderBy(*order).limit(max_seeds)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(key, seed), F.col(key)).limit(n)


def sample_or_strata(df: DataFrame, label: str, key: str, per_class: int = 50, fallback: int = 200,
                     seed: int = 42) -> DataFrame:
    """Stratified sample, or ``fallback`` draws of the whole table when no row has a class."""
    if df.where(F.col(label).isNotNull()).limit(1).count():
        return stratified_sample(df, label, key, per_class, seed)
    return sample_n(df, key, fallback, seed)


def top_n(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), key).limit(n)


def bottom_n(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(score).asc_nulls_last(), key).limit(n)


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties by value."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("freq"))
            .orderBy(F.desc("freq"), column).limit(n))


def examples_per_group(df: DataFrame, group: str, key: str, m: int, seed: int = 42) -> DataFrame:
    """Up to ``m`` hashed draws of every group."""
    return keep_first_n(df, [group], [draw(key, seed), F.col(key)], m)


def example_per_language(df: DataFrame, language: str, key: str) -> DataFrame:
    """First row of every detected language."""
    return keep_first_n(df.where(F.col(language) != "unknown"), [language], [F.col(key)], 1)


def weighted_class_draw(quotas: DataFrame, k: int, seed: int = 42, runs: list[int] = (1,)) -> DataFrame:
    """``k`` class draws per run with weights max(1, quota): ``run, draw, intent_disc``.

    The quotas have one row per class; their cumulative weights travel as one array inside a scalar
    subquery, so a draw is a look-up in that array and not a join."""
    w = Window.partitionBy(F.lit(0)).orderBy("intent_disc")
    weight = F.greatest(F.col("n_new"), F.lit(1))
    steps = quotas.select("intent_disc", F.sum(weight).over(w).alias("upto"))
    table = steps.agg(F.sort_array(F.collect_list(F.struct("upto", "intent_disc"))).alias("s"))
    spark = quotas.sparkSession
    draws = spark.range(k * len(runs)).select(
        F.element_at(F.array(*[F.lit(r) for r in runs]), (F.floor(F.col("id") / k) + 1).cast("int")).alias("run"),
        (F.col("id") % k).alias("draw"))
    u = uniform([F.lit("class"), F.lit(seed), F.col("run"), F.col("draw")])
    return (draws.withColumn("_s", table.scalar())
            .withColumn("_u", u * F.element_at("_s", -1).getField("upto"))
            .select("run", "draw", F.element_at(F.filter("_s", lambda s: s.getField("upto") > F.col("_u")), 1)
                    .getField("intent_disc").alias("intent_disc")))
