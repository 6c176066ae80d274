"""Lexical diversity and n-grams. Tokens are exploded inside the map task and counted there first, so
what is shuffled is the vocabulary of a task and not its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import lookup, materialize, partitions
from .running import running_total
from .stats import entropy_bits


def ttr(df: DataFrame, column: str = "prompt") -> DataFrame:
    """Distinct over all lowercased white-space tokens; 0 for no tokens."""
    counts = (df.select(F.explode(tx.ws_tokens(F.lower(column))).alias("tok"))
              .groupBy("tok").agg(F.count("*").alias("n")))
    return counts.agg(F.coalesce(F.try_divide(F.count("*"), F.sum("n")), F.lit(0.0)).alias("ttr"))


def unigram_entropy(df: DataFrame, column: str = "prompt") -> DataFrame:
    counts = (df.select(F.explode(tx.word_tokens(column)).alias("tok"))
              .groupBy("tok").agg(F.count("*").alias("n")))
    return counts.agg(entropy_bits().alias("unigram_entropy"))


def _field_tokens(df: DataFrame, fields: list[str], by: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    return df.select(by, F.inline(cells)).select(by, "field", F.explode(tx.ws_tokens("text")).alias("tok"))


def token_stats(df: DataFrame, fields: list[str], by: str = "source") -> DataFrame:
    """Tokens, types, type-token ratio, share of types seen once, entropy; case kept."""
    counts = _field_tokens(df, fields, by).groupBy(by, "field", "tok").agg(F.count("*").alias("n"))
    return counts.groupBy(by, "field").agg(
        F.sum("n").alias("tokens"), F.count("*").alias("types"), (F.count("*") / F.sum("n")).alias("ttr"),
        (F.count_if(F.col("n") == 1) / F.count("*")).alias("hapax_ratio"), entropy_bits().alias("entropy_token"))


def msttr(df: DataFrame, column: str = "prompt", key: str = "row_id", by: str = "source",
          window: int = 100) -> DataFrame:
    """Mean type-token ratio of the full ``window``-token pieces of each dataset's token stream (texts in
    key order); the plain ratio when the stream is shorter than one piece.

    Every row learns its place in the stream from a running total of token counts. Pieces that lie
    inside one row are counted there; only the ends of rows, at most two short lists per row, are
    shuffled to be put together."""
    sizes = df.select(by, key, tx.n_words(column).alias("n")).where("n > 0")
    places = running_total(sizes, ["n"], [key], [by])
    placed = df.select(by, key, tx.ws_tokens(column).alias("t")).join(places, [by, key])
    w = F.lit(window)
    head = F.least(F.pmod(-F.col("n_before"), w), F.col("n")).cast("int")
    whole = F.floor((F.col("n") - F.col("head")) / w).cast("int")
    tail_from = F.col("head") + F.col("whole") * window
    first_piece = F.floor(F.col("n_before") / w)
    cut = placed.withColumn("head", head).withColumn("whole", whole).select(
        by, "n_total", F.col("whole").cast("bigint").alias("whole"),
        F.aggregate(
            F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(0).cast("bigint"),
            lambda acc, i: acc + F.size(F.array_distinct(F.slice("t", F.col("head") + 1 + i * window, w)))).alias("seen"),
        F.array(
            F.struct(F.lit(-1).cast("bigint").alias("piece"), F.lit(None).cast("array<string>").alias("part")),
            F.struct(first_piece.alias("piece"), F.slice("t", F.lit(1), F.col("head")).alias("part")),
            F.struct(F.floor((F.col("n_before") + tail_from) / w).alias("piece"),
                     F.slice("t", tail_from + 1, F.lit(window)).alias("part"))).alias("parts"))
    rows = (cut.select(by, "n_total", "whole", "seen", F.inline("parts"))
            .where((F.col("piece") == -1) | (F.size("part") > 0)))
    own = F.col("piece") == -1
    pieces = rows.groupBy(by, "piece").agg(
        F.max("n_total").alias("total"),
        F.sum(F.when(own, F.col("whole"))).alias("own_pieces"), F.sum(F.when(own, F.col("seen"))).alias("own_seen"),
        F.sum(F.size("part")).alias("size"),
        F.size(F.array_distinct(F.flatten(F.collect_list("part")))).alias("seen"))
    full = (F.col("piece") >= 0) & (F.col("size") == window)
    short = (F.col("piece") >= 0) & (F.col("total") < window)
    done = pieces.groupBy(by).agg(
        F.max("total").alias("total"),
        (F.sum(F.when(full, 1).otherwise(0)) + F.coalesce(F.sum("own_pieces"), F.lit(0))).alias("pieces"),
        (F.sum(F.when(full, F.col("seen")).otherwise(0)) + F.coalesce(F.sum("own_seen"), F.lit(0))).alias("seen"),
        F.max(F.when(short, F.col("seen"))).alias("short_seen"))
    return done.select(by, F.when(F.col("total") < window, F.col("short_seen") / F.col("total"))
                       .otherwise(F.col("seen") / (F.col("pieces") * window)).alias("msttr"))


#: Bytes of text whose n-grams one task counts (up to some four million different ones, in well under a gigabyte).
PART_BYTES = 8 << 20


def _dealt(df: DataFrame, column: str, key: str) -> tuple[DataFrame, int]:
    """The rows dealt into parts of ``PART_BYTES`` on average by their key (or text), and how many parts."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return df.repartition(parts, key if key in df.columns else column), parts


def _grams(df: DataFrame, column: str, sizes: list[int], keep: list[str]) -> DataFrame:
    tokens = df.select(*keep, tx.ws_tokens(column).alias("t"))
    cells = F.array(*[F.struct(F.lit(n).alias("n"), tx.windows_of(F.col("t"), n).alias("g")) for n in sizes])
    return tokens.select(*keep, F.inline(cells)).select(*keep, "n", F.explode("g").alias("ngram"))


def top_ngrams(df: DataFrame, column: str = "prompt", sizes: list[int] = (1, 2, 3), top: int = 20,
               by: str = "source", key: str = "row_id") -> DataFrame:
    """Most frequent n-grams per dataset and n, with their share of all n-grams. Ties by n-gram.

    N-grams are counted inside parts of bounded size, and the counts brought together in as many: the number of different n-grams
    grows with the text, so a fixed number of partitions would not do."""
    sizes = list(sizes)
    dealt, parts = _dealt(df.select(*{by, column, *({key} & {*df.columns})}), column, key)
    # Counted under two hashes (96 bits); the text of a gram is not shuffled.
    grams = _grams(dealt, column, sizes, [by])
    counts = grams.groupBy(by, "n", F.xxhash64("ngram").alias("h1"), F.hash("ngram").alias("h2")).agg(F.count("*").alias("freq"))
    # Everything as frequent as the last of the top is looked up, so that ties can be broken by the whole text.
    w = Window.partitionBy(by, "n").orderBy(F.desc("freq"))
    with partitions(df.sparkSession, parts):
        frequent = materialize(counts.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= top).drop("_r"))
    named = (lookup(grams.withColumn("h1", F.xxhash64("ngram")).withColumn("h2", F.hash("ngram")), frequent, [by, "n", "h1", "h2"], "inner")
             .groupBy(by, "n", "ngram", "freq").agg(F.lit(1)).select(by, "n", "ngram", "freq"))
    # All n-grams of a text are counted from its token count, without exploding it again.
    totals = (df.select(by, tx.n_words(column).alias("w"))
              .groupBy(by).agg(*[F.sum(F.greatest(F.col("w") - (n - 1), F.lit(0))).alias(f"_{n}") for n in sizes])
              .select(by, F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("total")) for n in sizes]))))
    w = Window.partitionBy(by, "n").orderBy(F.desc("freq"), "ngram")
    best = named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(totals, [by, "n"]).select(
        by, "n", "rank", "ngram", "freq", (F.col("freq") / F.col("total")).alias("rel_freq"))


def ngram_jaccard(df: DataFrame, left: str, right: str, column: str = "prompt", sizes: list[int] = (1, 2, 3),
                  by: str = "source", key: str = "row_id") -> DataFrame:
    """Overlap of the n-gram sets of two datasets. The n-grams of parts of bounded size are shuffled once, each under two hashes (96 bits)
    instead of its text, to as many partitions as there are parts."""
    dealt, parts = _dealt(df.select(*{by, column, *({key} & {*df.columns})}), column, key)
    grams = _grams(dealt, column, list(sizes), [by])
    seen = grams.groupBy("n", F.xxhash64("ngram").alias("h1"), F.hash("ngram").alias("h2")).agg(
        F.bool_or(F.col(by) == left).alias("l"), F.bool_or(F.col(by) == right).alias("r"))
    both, only_l, only_r = F.col("l") & F.col("r"), F.col("l") & ~F.col("r"), F.col("r") & ~F.col("l")
    with partitions(df.sparkSession, parts):
        return materialize(seen.groupBy("n").agg(
            (F.count_if(both) / F.count_if(F.col("l") | F.col("r"))).alias("jaccard"),
            F.count_if(only_l).alias("left_only"), F.count_if(only_r).alias("right_only")))


def word_frequencies(df: DataFrame, column: str, stopwords: list[str], top: int = 100) -> DataFrame:
    """Most frequent words outside a stop list."""
    words = df.select(F.explode(tx.word_tokens(column)).alias("word")).where(~F.col("word").isin(stopwords))
    return words.groupBy("word").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "word").limit(top)
