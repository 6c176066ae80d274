"""Aggregates over classes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixedvalues as fv
from ..session import lookup
from .running import QUARTILES, exact_percentiles, value_counts


def class_counts(df: DataFrame, label: str = "intent_disc") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def entropy_bits(count: str = "n") -> Column:
    """Entropy in bits of a column of counts, as an aggregate."""
    total = F.sum(count).cast("double")
    weighted = F.sum(F.when(F.col(count) > 0, F.col(count) * F.log2(F.col(count).cast("double"))).otherwise(0.0))
    return F.coalesce(F.log2(F.nullif(total, F.lit(0.0))) - weighted / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def label_entropy(df: DataFrame, by: str = "source", label: str = "intent_disc") -> DataFrame:
    """Distinct labels and entropy of the label distribution per dataset."""
    counts = df.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.count("*").alias("unique_labels"), entropy_bits().alias("entropy"))


def class_cv_percent(df: DataFrame, label: str = "intent_disc") -> DataFrame:
    """Population deviation of the class counts over their mean, in percent; 0 for an empty table."""
    return class_counts(df, label).agg(
        F.coalesce(F.try_divide(F.stddev_pop("n") * 100, F.avg("n")), F.lit(0.0)).alias("class_histogram_cv_percent"))


def class_mean_score(df: DataFrame, label: str = "intent_disc", score: str = "intent_cont") -> DataFrame:
    """Mean score per class over rows without nulls."""
    return df.na.drop(subset=["prompt", label, score]).groupBy(label).agg(F.avg(score).alias("class_mean"))


def prompt_score_lookup(df: DataFrame, order: str = "row_id", score: str = "intent_cont") -> DataFrame:
    """Prompt -> score; of several rows with one prompt the last counts."""
    return (df.na.drop(subset=["prompt", "intent_disc", score]).groupBy("prompt")
            .agg(F.max_by(score, order).alias("seed_score")))


def score_moments(df: DataFrame, value: str = "intent_cont", by: str = "source") -> DataFrame:
    """Mean, sample deviation, population skew and excess kurtosis, interquartile range."""
    moments = df.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    spread = exact_percentiles(df, value, QUARTILES, [by])
    return moments.join(spread.select(by, (F.col("q75") - F.col("q25")).alias("iqr")), by)


def quantile_bins(df: DataFrame, value: str = "intent_cont", q: int = 10, by: str = "source") -> DataFrame:
    """Counts in the bins between interpolated quantile edges; equal edges are merged, bins are closed
    on the right and the first one on the left too."""
    edges = exact_percentiles(df, value, {f"e{i:03d}": i / q for i in range(q + 1)}, [by])
    packed = edges.select(by, F.array_distinct(F.array(*[f"e{i:03d}" for i in range(q + 1)])).alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    # Distinct values carry their counts, so the edge search runs once per value.
    binned = lookup(value_counts(df, value, [by]), packed, by, "inner").withColumn(
        "bin", F.size(F.filter(inner, lambda e: e < F.col("_value"))))
    return binned.groupBy(by, "bin").agg(
        F.first(F.element_at("_edges", F.col("bin") + 1)).alias("lower"),
        F.first(F.element_at("_edges", F.col("bin") + 2)).alias("upper"), F.sum("_count").alias("n"))


def top_quantile_bins(df: DataFrame, value: str = "intent_cont", q: int = 10, by: str = "source",
                      n: int = 5) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("n"), "bin")
    return (quantile_bins(df, value, q, by).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def histogram(df: DataFrame, value: str, bins: int, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """Equal-width bins over the range of the whole table, the last one closed; every group gets all
    bins, empty ones with 0. ``weight`` counts a row more than once."""
    x = F.col(value).cast("double")
    data = df.where(x.isNotNull()).select(*by, x.alias("_x"), (F.lit(1) if weight is None else weight)
                                          .cast("bigint").alias("_w"))
    bounds = data.agg(F.struct(
        F.when(F.min("_x") == F.max("_x"), F.min("_x") - 0.5).otherwise(F.min("_x")).alias("lo"),
        F.when(F.min("_x") == F.max("_x"), F.max("_x") + 0.5).otherwise(F.max("_x")).alias("hi")).alias("b"))
    lo, hi = (bounds.scalar().getField(side) for side in ("lo", "hi"))
    place = F.least(F.floor((F.col("_x") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    counts = data.groupBy(*by, place.alias("bin")).agg(F.sum("_w").alias("n"))
    # A group has at most `bins` rows here; the empty bins are filled in from one array per group.
    filled = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"),
                                     F.sum("n").alias("_total"))
    width = (hi - lo) / bins
    return (filled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
            .withColumn("n", F.coalesce(F.try_element_at("_m", "bin"), F.lit(0)).cast("bigint"))
            .select(*by, "bin", (lo + width * F.col("bin")).alias("lower"), "n",
                    (F.col("n") / (F.col("_total") * width)).alias("density")))


def kde(df: DataFrame, value: str, points: int = 50, by: list[str] = (), margin: float = 0.5) -> DataFrame:
    """Gaussian density per group on a common grid, with Scott's bandwidth. The grid covers the range of
    the data and ``margin`` of it on both sides. The work follows the distinct values: equal ones are counted
    first, and only ``points`` numbers per group and task are shuffled after that."""
    if not by:
        return kde(df.withColumn("_all", F.lit(0)), value, points, ["_all"], margin).drop("_all")
    data = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    spread = data.groupBy(*by).agg(
        F.count("*").alias("_n"), (F.stddev_samp("_x") * F.pow(F.count("*"), F.lit(-0.2))).alias("_h"))
    spread = spread.where(F.col("_h") > 0)
    limits = data.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("b"))
    lo, hi = (limits.scalar().getField(side) for side in ("lo", "hi"))

    def grid(i) -> Column:
        return lo - (hi - lo) * margin + (hi - lo) * (1 + 2 * margin) * i / (points - 1)

    # Equal values are one row with a weight; a row meets the grid points one by one and is summed up before the shuffle.
    weighted = lookup(value_counts(df, value, by), spread, by, "inner")
    terms = weighted.select(*by, "_n", "_h", "_count", "_value", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    near = F.exp(-0.5 * F.pow((grid(F.col("point")) - F.col("_value")) / F.col("_h"), F.lit(2)))
    scale = F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi())
    return (terms.groupBy(*by, "_n", "_h", "point").agg(F.sum(near * F.col("_count")).alias("_s"))
            .select(*by, "point", grid(F.col("point")).alias("x"), (F.col("_s") / scale).alias("density")))


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers at the outermost values within 1.5 interquartile ranges, outlier count."""
    quarters = exact_percentiles(df, value, QUARTILES, by)
    x = F.col("_value")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = x.between(F.col("q25") - reach, F.col("q75") + reach)
    return lookup(value_counts(df, value, by), quarters, by, "inner").groupBy(*by, "n", "q25", "q50", "q75").agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_count"))).alias("outliers"))


def linear_fit(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def correlation(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.agg(F.corr(x, y).alias("correlation"))


def score_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Count, mean, median, deviation, min and max in all (group ``*``) and per group."""
    both = df.where(F.col(value).isNotNull()).select(
        F.explode(F.array(F.lit("*"), F.col(by))).alias(by), F.col(value).cast("double").alias(value))
    moments = both.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                   F.min(value).alias("min"), F.max(value).alias("max"))
    return moments.join(exact_percentiles(both, value, {"median": 0.5}, [by]), by)


def label_params(df: DataFrame | None, target: str | None = None) -> DataFrame:
    """Mean and sample deviation of the score column; fixed defaults when there is no table."""
    from .profile import pick_target_column
    if df is None:
        from pyspark.sql import SparkSession
        return SparkSession.active().range(1).select(
            F.lit(fv.DEFAULT_LABEL_MEAN).alias("label_mean"), F.lit(fv.DEFAULT_LABEL_STD).alias("label_std"))
    x = F.col(target or pick_target_column(df)).cast("double")
    return df.where(x.isNotNull()).agg(F.avg(x).alias("label_mean"), F.stddev_samp(x).alias("label_std"))
