"""Comparison of two datasets held in one table and told apart by a ``source`` column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import dense_index, running_total
from .stats import class_counts, histogram


def union_all(tables: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Tables below each other, each row labelled with the name of its table."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def class_frequencies(df: DataFrame, left: str, right: str, label: str = "intent_disc",
                      by: str = "source") -> DataFrame:
    """Counts over the union of classes, 0 where a side has none, and the difference. One aggregation
    holds both sides of what would be a full outer join of two frequency tables."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count_if(F.col(by) == left).alias("freq_left"), F.count_if(F.col(by) == right).alias("freq_right")
    ).withColumn("delta", F.col("freq_right") - F.col("freq_left"))


def outer_frequencies(left: DataFrame, right: DataFrame, label: str = "intent_disc") -> DataFrame:
    """The same from two separate tables, by a full outer join of their class counts."""
    a = class_counts(left.where(F.col(label).isNotNull()), label).withColumnRenamed("n", "freq_left")
    b = class_counts(right.where(F.col(label).isNotNull()), label).withColumnRenamed("n", "freq_right")
    return a.join(b, label, "full").na.fill(0, ["freq_left", "freq_right"])


def class_coverage(df: DataFrame, left: str, right: str, label: str = "intent_disc",
                   by: str = "source") -> DataFrame:
    """Classes on one side only, common ones, and the share of left classes that the right side has."""
    seen = class_frequencies(df, left, right, label, by)
    on_left, on_right = F.col("freq_left") > 0, F.col("freq_right") > 0
    return seen.agg(
        F.count_if(on_left & ~on_right).alias("only_left"), F.count_if(on_right & ~on_left).alias("only_right"),
        F.count_if(on_left & on_right).alias("common"),
        (F.lit(100.0) * F.count_if(on_left & on_right) / F.greatest(F.count_if(on_left), F.lit(1))).alias("coverage_pct"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def js_distance(df: DataFrame, value: str, left: str, right: str, bins: int = 20, by: str = "source",
                floor: float = 1e-8) -> DataFrame:
    """Square root of the Jensen-Shannon divergence (natural log) of two histograms over one range."""
    cells = histogram(df.where(F.col(by).isin(left, right)), value, bins, [by])
    sides = cells.groupBy("bin").agg(
        (F.max(F.when(F.col(by) == left, F.col("density"))) + floor).alias("p"),
        (F.max(F.when(F.col(by) == right, F.col("density"))) + floor).alias("q"))
    totals = sides.agg(F.struct(F.sum("p").alias("p"), F.sum("q").alias("q")).alias("t"))
    p, q = F.col("p") / totals.scalar().getField("p"), F.col("q") / totals.scalar().getField("q")
    shares = sides.select(p.alias("p"), q.alias("q"), ((p + q) / 2).alias("m"))
    part: Column = (F.col("p") * F.ln(F.col("p") / F.col("m")) + F.col("q") * F.ln(F.col("q") / F.col("m"))) / 2
    return shares.agg(F.sqrt(F.greatest(F.sum(part), F.lit(0.0))).alias("js_distance"))


def ecdf(df: DataFrame, value: str, left: str, right: str, by: str = "source") -> DataFrame:
    """Empirical distribution functions of both sides at every distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(
        F.count_if(F.col(by) == left).alias("a"), F.count_if(F.col(by) == right).alias("b"))
    run = running_total(counts, ["a", "b"], ["x"])
    return run.select("x", "a_total", "b_total",
                      F.try_divide(F.col("a_before") + F.col("a"), F.col("a_total")).alias("cdf_left"),
                      F.try_divide(F.col("b_before") + F.col("b"), F.col("b_total")).alias("cdf_right"))


def ks_two_sample(df: DataFrame, value: str, left: str, right: str, by: str = "source") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: largest gap of the distribution functions and the asymptotic
    p-value (Kolmogorov's series)."""
    gap = ecdf(df, value, left, right, by).agg(
        F.max(F.abs(F.col("cdf_left") - F.col("cdf_right"))).alias("statistic"),
        F.max("a_total").cast("double").alias("n"), F.max("b_total").cast("double").alias("m"))
    lam2 = F.col("n") * F.col("m") / (F.col("n") + F.col("m")) * F.pow("statistic", F.lit(2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2))
    return gap.select("statistic", F.when(lam2 < 0.04, 1.0).otherwise(
        F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))).alias("p_value"))


#: Largest product of the two numbers of rows whose p-value is counted.
EXACT = 1 << 20


def ks_exact_p(statistic: float, n: int, m: int) -> float:
    """Share of the orders of n and m different values whose distribution functions are somewhere at least ``statistic`` apart. An order is
    a path of steps to the right and up; those that stay nearer are counted column by column, as shares of all paths so far, so
    that no number grows."""
    if n == 0 or m == 0 or statistic <= 0:
        return 1.0
    # in units of 1 / (n m): a place (i, j) is near when |i m - j n| is below the observed gap
    gap = round(statistic * n * m)
    up = np.arange(m + 1, dtype=np.int64) * n
    share = (np.abs(up) < gap).astype(float)
    share = np.minimum.accumulate(share)
    for i in range(1, n + 1):
        near = np.abs(i * m - up) < gap
        before, share = share, np.zeros(m + 1)
        running = 0.0
        for j in range(m + 1):
            # of all paths to (i, j), i / (i + j) come from the left and j / (i + j) from below
            running = (before[j] * i + running * j) / (i + j) if near[j] else 0.0
            share[j] = running
    return float(min(1.0, max(0.0, 1.0 - share[m])))


def ks_two_sample_by(df: DataFrame, value: str, left: str, right: str, groups: list[str], by: str = "source", exact: int = EXACT) -> DataFrame:
    """``statistic, n_left, n_right, p_value, method`` of the two-sample Kolmogorov-Smirnov test in every group: counted over all orders
    where the product of both numbers of rows is at most ``exact``, else the asymptotic series. Groups with rows on one side only are left out."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isin(left, right))
    counts = rows.groupBy(*groups, F.col(value).cast("double").alias("x")).agg(
        F.count_if(F.col(by) == left).alias("a"), F.count_if(F.col(by) == right).alias("b"))
    run = running_total(counts, ["a", "b"], ["x"], groups).where("a_total > 0 AND b_total > 0")
    # the gap as a whole number of 1 / (n m)
    apart = F.abs((F.col("a_before") + F.col("a")) * F.col("b_total") - (F.col("b_before") + F.col("b")) * F.col("a_total"))
    gaps = run.groupBy(*groups).agg(F.max(apart).alias("gap"), F.max("a_total").alias("n_left"), F.max("b_total").alias("n_right"))

    @F.pandas_udf("double")
    def counted(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks_exact_p(x, int(a), int(b)) if a * b <= exact else None for x, a, b in zip(d, n, m)], dtype="float64")
    n, m = F.col("n_left").cast("double"), F.col("n_right").cast("double")
    lam2 = n * m / (n + m) * F.pow("statistic", F.lit(2))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(
        k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2))
    asymptotic = F.when(lam2 < 0.04, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    small = F.col("n_left") * F.col("n_right") <= exact
    return gaps.withColumn("statistic", F.col("gap") / (n * m)).select(
        *groups, "statistic", "n_left", "n_right",
        F.when(small, counted("statistic", "n_left", "n_right")).otherwise(asymptotic).alias("p_value"),
        F.when(small, "exact").otherwise("asymptotic").alias("method"))


def positional_pairs(df: DataFrame, value: str, left: str, right: str, key: str = "row_id",
                     by: str = "source") -> DataFrame:
    """The nth non-null value of one side next to the nth of the other."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isin(left, right)).select(by, key, value)
    placed = dense_index(rows, [key], [by])
    return placed.groupBy("pos").agg(
        F.max(F.when(F.col(by) == left, F.col(value))).alias("left_value"),
        F.max(F.when(F.col(by) == right, F.col(value))).alias("right_value")).na.drop()


def positional_correlation(df: DataFrame, value: str, left: str, right: str, key: str = "row_id",
                           by: str = "source") -> DataFrame:
    return positional_pairs(df, value, left, right, key, by).agg(
        F.count("*").alias("n"), F.corr("left_value", "right_value").alias("correlation"))
