"""Schema and column profiles, table repair, and simple projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixedvalues as fv
from ..functions import text as tx
from .running import QUARTILES, dense_index, exact_percentiles


def _null_counts(df: DataFrame) -> DataFrame:
    """One row: number of rows and, per column, of non-null cells. One scan of the table."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}")
                                                  for i, c in enumerate(df.columns)])


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null cells, null cells, percentage of nulls."""
    counts = _null_counts(df)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"c{i}").alias("non_null"))
                        for i, (c, t) in enumerate(df.dtypes)])
    return (counts.select("n_rows", F.inline(entries))
            .select("column", "dtype", "non_null", (F.col("n_rows") - F.col("non_null")).alias("nulls"),
                    F.round(F.try_divide(F.lit(100.0) * (F.col("n_rows") - F.col("non_null")), F.col("n_rows")), 2)
                    .alias("null_pct")))


def missing_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, missing cells and their percentage."""
    width = len(df.columns)
    filled = sum((F.col(f"c{i}") for i in range(width)), F.lit(0))
    cells = F.col("n_rows") * width
    return _null_counts(df).select(
        "n_rows", F.lit(width).alias("n_cols"), cells.alias("cells"), (cells - filled).alias("missing"),
        F.try_divide(F.lit(100.0) * (cells - filled), cells).alias("missing_pct"))


def _column_table(df: DataFrame) -> DataFrame:
    """Column names and types as rows (as many as the table has columns)."""
    return df.sparkSession.createDataFrame(
        [(c, t) for c, t in df.dtypes], "column string, dtype string").coalesce(1)


def dtype_histogram(df: DataFrame) -> DataFrame:
    return _column_table(df).groupBy("dtype").agg(F.count("*").alias("n_columns"))


def role_of(name: Column) -> Column:
    """Role of a column by keywords in its name; the first role that matches wins."""
    role = None
    for label, words in fv.ROLE_WORDS.items():
        hit = tx.contains_any(name, words)
        role = F.when(hit, label) if role is None else role.when(hit, label)
    return role


def column_roles(df: DataFrame) -> DataFrame:
    return _column_table(df).select("column", role_of(F.col("column")).alias("role"))


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _lengths(df: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.length(c).alias("length")) for c in _string_columns(df)]
    return df.select(F.inline(F.array(*cells))).where(F.col("length").isNotNull())


def text_column_stats(df: DataFrame) -> DataFrame:
    """Per string column: min, max, mean and median length, and number of distinct values."""
    columns = _string_columns(df)
    lengths = _lengths(df)
    basic = lengths.groupBy("column").agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"),
                                          F.avg("length").alias("mean_length"))
    median = exact_percentiles(lengths, "length", {"median_length": 0.5}, ["column"]).drop("n")
    # Hashes stand in for the texts, so that the distinct count shuffles 16 bytes per value.
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.xxhash64(c).alias("h1"), F.hash(c).alias("h2"),
                 F.col(c).isNotNull().alias("filled")) for c in columns])))
    distinct = (values.where("filled").select("column", "h1", "h2").distinct()
                .groupBy("column").agg(F.count("*").alias("distinct_values")))
    return basic.join(median, "column").join(distinct, "column")


def mean_lengths(df: DataFrame) -> DataFrame:
    return _lengths(df).groupBy("column").agg(F.avg("length").alias("mean_length"))


def long_text_columns(df: DataFrame, min_mean_length: float = 50.0) -> DataFrame:
    """String columns with substantial text, used when no column name tells the prompt column."""
    return mean_lengths(df).where(F.col("mean_length") > min_mean_length)


def prompt_columns(df: DataFrame) -> list[str]:
    """Prompt columns by name, else the string columns with long text, in table order."""
    named = {r["column"] for r in column_roles(df).where("role = 'prompt'").collect()}
    if not named:
        named = {r["column"] for r in long_text_columns(df).collect()}
    return [c for c in df.columns if c in named]


def conform(df: DataFrame) -> DataFrame:
    """``prompt, intent_disc, intent_cont``: missing columns become null, text that is no number too."""
    def numeric(name: str) -> Column:
        return (F.col(name).try_cast("double") if name in df.columns else F.lit(None).cast("double")).alias(name)
    prompt = F.col("prompt") if "prompt" in df.columns else F.lit(None)
    return df.select(prompt.cast("string").alias("prompt"), numeric("intent_disc"), numeric("intent_cont"))


def normalise(df: DataFrame, order: str = "row_id") -> DataFrame:
    """The comparison schema: ids filled in, types coerced, texts trimmed, language guessed where it
    is missing, and strict duplicates of (prompt, response, source) dropped keeping the first."""
    from .dedup import drop_strict_duplicates
    have = set(df.columns)

    def optional(name: str, kind: str) -> Column:
        return F.col(name).try_cast(kind) if name in have else F.lit(None).cast(kind)

    if "id" not in have:
        # Without ids each row is numbered by its place in the table; only the keys are put in order.
        places = dense_index(df.select(order), [order], out="_place")
        df = df.join(places.select(order, F.concat(F.lit("gen_"), F.col("_place").cast("string")).alias("id")), order)
    prompt = tx.strip(optional("prompt", "string"))
    guessed = tx.script_language(prompt)
    language = F.coalesce(F.col("language"), guessed) if "language" in have else guessed
    shaped = df.select(
        F.col(order), F.col("id").cast("string").alias("id"), prompt.alias("prompt"),
        tx.strip(optional("response", "string")).alias("response"),
        optional("intent_disc", "double").cast("int").alias("intent_disc"),
        optional("intent_cont", "double").alias("intent_cont"), language.alias("language"),
        optional("source", "string").alias("source"))
    return drop_strict_duplicates(shaped, ["prompt", "response", "source"], order)


def global_stats(df: DataFrame, by: str = "source") -> DataFrame:
    """Per dataset: rows, columns, missing shares and mean lengths of prompt and response."""
    response = F.col("response") if "response" in df.columns else F.lit(None).cast("string")
    missing = lambda c: F.avg(F.when(c.isNull(), 1.0).otherwise(0.0))
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"),
        (missing(F.col("prompt")) * 100).alias("missing_prompt_pct"),
        (missing(response) * 100).alias("missing_response_pct"),
        F.avg(F.length("prompt")).alias("len_prompt_mean"), F.avg(F.length(response)).alias("len_response_mean"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max, one row per numeric column."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))).where("x is not null")
    moments = cells.groupBy("column").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
                                          F.min("x").alias("min"), F.max("x").alias("max"))
    quarters = exact_percentiles(cells, "x", QUARTILES, ["column"]).withColumnRenamed("n", "count")
    return moments.join(quarters, "column")


def output_rows(df: DataFrame, *extra: str) -> DataFrame:
    """The rows a run hands out: prompt, dataset ``augmented``, class (0 when unknown) and score."""
    return df.select("prompt", F.lit("augmented").alias("dataset"),
                     F.coalesce(F.col("intent_disc"), F.lit(0)).alias("intent_disc"), "intent_cont", *extra)


def pick_target_column(df: DataFrame) -> str:
    for name in ("intent_cont", "target", "score"):
        if name in df.columns:
            return name
    raise ValueError("no score column: expected one of intent_cont, target, score")


def scatter_points(df: DataFrame, x: Column, y: Column, key: str) -> DataFrame:
    return df.select(key, x.alias("x"), y.alias("y"))


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.na.drop(subset=keys)


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """First rows in table order."""
    return df.orderBy(order).limit(n)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as top-level columns named by their path."""
    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = path + (f.name,)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                column = F.col(f"`{here[0]}`")
                for part in here[1:]:
                    column = column.getField(part)
                out.append(column.alias(sep.join(here)))
        return out
    return df.select(*leaves(df.schema, ()))


def content_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: mean length and words, shares of factual, creative, neutral, question,
    instruction and triplet-friendly texts, mean number of named entities. Whole table, one pass."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns]))).where("text is not null")
    share = lambda flag: F.avg(F.when(flag, 1.0).otherwise(0.0))
    factual, creative = tx.is_factual("text"), tx.is_creative("text")
    return cells.groupBy("column").agg(
        F.count("*").alias("n"), F.avg(F.length("text")).alias("avg_length"), F.avg(tx.n_words("text")).alias("avg_words"),
        share(factual).alias("factual_ratio"), share(creative).alias("creative_ratio"),
        share(~factual & ~creative).alias("neutral_ratio"), share(tx.is_question("text")).alias("question_ratio"),
        share(tx.is_instruction("text")).alias("instruction_ratio"), share(tx.is_triplet_friendly("text")).alias("triplet_ratio"),
        F.avg(tx.n_entities("text")).alias("avg_entities"))
