"""Order-dependent building blocks without a single-task window: running totals, dense row numbers and
exact interpolated percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_total(df: DataFrame, values: list[str], order_by: list[str], by: list[str] = ()) -> DataFrame:
    """Add, for every column v of ``values``, ``v_before`` (the sum of v over the rows that come earlier in
    ``order_by``, restarting for every ``by`` group) and ``v_total`` (its sum over the group).

    The rows are range-partitioned by the order and written once, so every range has a fixed number.
    The per-range sums are a table of at most (ranges + groups) rows; a window over that small table
    gives each range its offset, and a window inside each range does the rest. No task ever sees more
    than one range."""
    by = list(by)
    ranged = materialize(df.repartitionByRange(*by, *order_by).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    per_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = per_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_offset_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(per_group).alias(f"{v}_total") for v in values])
    inside = (Window.partitionBy(*by, "_range").orderBy(*order_by)
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = ranged.join(offsets, [*by, "_range"])
    return joined.select(
        *df.columns, *[f"{v}_total" for v in values],
        *[(F.col(f"_offset_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before") for v in values])


def dense_index(df: DataFrame, order_by: list[str], by: list[str] = (), out: str = "pos") -> DataFrame:
    """Zero-based position of every row in the given (total) order."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return (running_total(ones, ["_one"], order_by, by).drop("_one", "_one_total")
            .withColumnRenamed("_one_before", out))


def value_counts(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Distinct non-null values with their number of rows, as ``_value`` and ``_count``."""
    x = F.col(value).cast("double")
    return (df.where(x.isNotNull()).groupBy(*by, x.alias("_value"))
            .agg(F.count("*").alias("_count")))


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Linearly interpolated percentiles per group, one column per entry of ``probs`` (name -> fraction),
    and ``n``, the number of non-null values.

    Equal values are counted first; the ranks come from a distributed running total over the distinct
    values, so a group is never collected into one buffer as the built-in ``percentile`` would do."""
    by = list(by)
    ranked = running_total(value_counts(df, value, by), ["_count"], ["_value"], by)
    last = F.col("_count_total") - 1
    picks = []
    for name, p in probs.items():
        for side, rank in (("lo", F.floor(last * p)), ("hi", F.ceil(last * p))):
            hit = (F.col("_count_before") <= rank) & (rank < F.col("_count_before") + F.col("_count"))
            picks.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{name}_{side}"))
    out = ranked.groupBy(*by).agg(F.max("_count_total").alias("n"), *picks)
    position = {name: (F.col("n") - 1) * p for name, p in probs.items()}
    return out.select(*by, "n", *[
        (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (pos - F.floor(pos))).alias(name)
        for name, pos in position.items()])


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
