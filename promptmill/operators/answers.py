"""Answer duplication and concentration of a question/answer table (``qa_id, questions, answer, type``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixedvalues as fv
from ..functions import text as tx
from ..session import lookup
from .sampling import draw, keep_first_n
from .stats import histogram


def answer_counts(df: DataFrame) -> DataFrame:
    """Rows per cleaned answer: the table most of this module is computed from."""
    return (df.where(F.col("answer").isNotNull()).groupBy(tx.trim_key("answer").alias("answer_key"))
            .agg(F.count("*").alias("cnt")))


def version_key() -> Column:
    """Cleaned answer for the de-duplicated versions, where a missing answer is a group of its own."""
    return tx.trim_key(F.coalesce(F.col("answer"), F.lit("None")))


def dup_summary(df: DataFrame) -> DataFrame:
    repeated = F.col("cnt") > 1
    return answer_counts(df).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_answers"), F.count("*").alias("unique_answers"),
        F.count_if(repeated).alias("duplicated_answers"),
        F.coalesce(F.sum(F.when(repeated, F.col("cnt"))), F.lit(0)).alias("duplicated_rows"),
        F.try_divide(F.count("*"), F.sum("cnt")).alias("diversity_ratio"))


def dup_buckets(df: DataFrame) -> DataFrame:
    """How many answers occur 2, 3-5, 6-10, 11-20 and 21 or more times."""
    c = F.col("cnt")
    bucket = (F.when(c == 2, "2").when(c <= 5, "3-5").when(c <= 10, "6-10").when(c <= 20, "11-20").otherwise("21+"))
    return answer_counts(df).where(c > 1).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_answers"))


def _top(df: DataFrame, k: int) -> DataFrame:
    """The k most frequent answers; ties by answer."""
    return answer_counts(df).orderBy(F.desc("cnt"), "answer_key").limit(k)


def _total(df: DataFrame, answered_only: bool = False) -> Column:
    return df.agg(F.count("answer" if answered_only else "*").alias("n")).scalar()


def top_answers(df: DataFrame, k: int = 10, width: int = 50) -> DataFrame:
    total = _total(df, answered_only=True)
    return _top(df, k).select("answer_key", tx.ellipsize("answer_key", width).alias("shown"), "cnt",
                              (100.0 * F.col("cnt") / total).alias("share_pct"))


def _typed_counts(df: DataFrame) -> DataFrame:
    return (df.where(F.col("type").isNotNull() & F.col("answer").isNotNull())
            .groupBy("type", tx.trim_key("answer").alias("answer_key")).agg(F.count("*").alias("cnt")))


def dup_by_type(df: DataFrame) -> DataFrame:
    return _typed_counts(df).groupBy("type").agg(
        F.sum("cnt").alias("total"), F.count("*").alias("unique_answers"),
        F.count_if(F.col("cnt") > 1).alias("duplicated_answers"))


def top_answers_by_type(df: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent repeated answers of every type."""
    w = Window.partitionBy("type").orderBy(F.desc("cnt"), "answer_key")
    return (_typed_counts(df).where("cnt > 1").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def frequency_of_frequency(df: DataFrame) -> DataFrame:
    return answer_counts(df).groupBy("cnt").agg(F.count("*").alias("n_answers"))


def diversity_by_type(df: DataFrame) -> DataFrame:
    return _typed_counts(df).groupBy("type").agg((F.count("*") / F.sum("cnt")).alias("diversity"))


def length_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Answer lengths over all rows, split by whether the answer is repeated."""
    flagged = answer_counts(df).select(F.length("answer_key").alias("length"), "cnt",
                                       (F.col("cnt") > 1).alias("repeated"))
    return histogram(flagged, "length", bins, ["repeated"], weight=F.col("cnt"))


def diversity_grade(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "excellent").when(ratio >= 0.6, "acceptable").otherwise("low")


def grade(df: DataFrame) -> DataFrame:
    """Diversity grade and the advice that follows from thresholds."""
    top = answer_counts(df).agg(F.max("cnt").alias("top")).scalar()
    s = dup_summary(df)
    rules = [(F.col("diversity_ratio") < 0.7, "filter very frequent answers"),
             (F.col("duplicated_answers") > F.col("total_answers") * 0.3, "measure the effect of repeats"),
             (top > F.col("total_answers") * 0.05, "check frequent answers for artefacts")]
    advice = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules]))
    return s.select("diversity_ratio", diversity_grade(F.col("diversity_ratio")).alias("grade"),
                    F.array_join(advice, "; ").alias("advice"))


# --- de-duplicated versions -------------------------------------------------------------------------

def version_unique(df: DataFrame) -> DataFrame:
    """First row of every raw answer."""
    return keep_first_n(df, ["answer"], ["qa_id"], 1)


def version_capped(df: DataFrame, n: int = 3) -> DataFrame:
    """First n rows of every cleaned answer."""
    return keep_first_n(df.withColumn("_k", version_key()), ["_k"], ["qa_id"], n).drop("_k")


def with_answer_frequency(df: DataFrame, out: str = "frequency") -> DataFrame:
    """Every row with the number of rows that share its cleaned answer. The counts are aggregated first
    and joined back, so a frequent answer is never one task as it would be in a window."""
    keyed = df.withColumn("_k", version_key())
    counts = keyed.groupBy("_k").agg(F.count("*").alias(out))
    return lookup(keyed, counts, "_k", "inner").drop("_k")


def version_weighted(df: DataFrame) -> DataFrame:
    """All rows, weighted by one over the frequency of their answer."""
    return with_answer_frequency(df, "_f").withColumn("weight", 1.0 / F.col("_f")).drop("_f")


def weight_range(df: DataFrame) -> DataFrame:
    return version_weighted(df).agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))


def version_balanced(df: DataFrame, n: int = 2) -> DataFrame:
    """First n rows of every (type, cleaned answer); rows without a type are left out."""
    typed = df.where(F.col("type").isNotNull()).withColumn("_k", version_key())
    return keep_first_n(typed, ["type", "_k"], ["qa_id"], n).drop("_k")


def balanced_share(df: DataFrame, n: int = 2) -> DataFrame:
    """Rows per type before and after balancing."""
    before = df.where(F.col("type").isNotNull()).groupBy("type").agg(F.count("*").alias("n_before"))
    after = version_balanced(df, n).groupBy("type").agg(F.count("*").alias("n_after"))
    return before.join(after, "type").withColumn("kept_pct", 100.0 * F.col("n_after") / F.col("n_before"))


def kish_effective_size(df: DataFrame, weight: str = "weight") -> DataFrame:
    return df.agg((F.pow(F.sum(weight), F.lit(2)) / F.sum(F.col(weight) * F.col(weight))).alias("effective_size"))


def version_comparison(df: DataFrame) -> DataFrame:
    """Size, distinct raw answers, diversity and reduction of the four versions. Diversity of the weighted
    version uses Kish's effective size; with equal weights that is the plain size, so one formula serves."""
    parts = {"unique": version_unique(df), "max3": version_capped(df), "weighted": version_weighted(df),
             "balanced": version_balanced(df)}
    rows = None
    for name, part in parts.items():
        weight = F.col("weight") if "weight" in part.columns else F.lit(1.0)
        part = part.select(F.lit(name).alias("version"), "answer", weight.alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    per_answer = rows.groupBy("version", "answer").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    return per_answer.groupBy("version").agg(
        F.sum("n").alias("size"), F.count("*").alias("unique_answers"),
        (F.count("*") / (F.pow(F.sum("w"), F.lit(2)) / F.sum("w2"))).alias("diversity"),
        ((1 - F.sum("n") / F.first(_total(df))) * 100).alias("reduction_pct"))


# --- profiles of the most frequent answers ----------------------------------------------------------

def rows_of_top_answers(df: DataFrame, k: int) -> DataFrame:
    """Rows whose answer is one of the k most frequent, with ``answer_key`` and ``cnt``. The k rows are
    broadcast: their number is fixed by the caller."""
    keyed = df.withColumn("answer_key", version_key())
    return keyed.join(F.broadcast(_top(df, k)), "answer_key")


def _display() -> Column:
    """The answer in the casing of its first row."""
    return F.min_by("answer", "qa_id")


def _group_words(rows: DataFrame, min_chars: int = 4, once_per_row: bool = False) -> DataFrame:
    words = tx.ws_tokens(F.lower("questions"))
    if once_per_row:
        words = F.array_distinct(words)
    return (rows.select("answer_key", "cnt", F.explode(words).alias("word"))
            .where(F.length("word") >= min_chars)
            .groupBy("answer_key", "cnt", "word").agg(F.count("*").alias("freq")))


def _ranked_words(words: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("answer_key").orderBy(F.desc("freq"), "word")
    return words.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)


def _joined(words: DataFrame, out: str, shown: Column) -> DataFrame:
    """At most k words per answer as one text, in rank order."""
    entry = F.struct("_r", shown.alias("s"))
    return words.groupBy("answer_key").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.getField("s")), ", ").alias(out))


def group_profile(df: DataFrame, k: int = 6) -> DataFrame:
    """Per frequent answer: count, share, mean question length, vocabulary, its three commonest words
    of more than three characters."""
    rows = rows_of_top_answers(df, k)
    base = rows.groupBy("answer_key").agg(
        _display().alias("answer"), F.count("*").alias("n"),
        F.avg(F.length("questions")).alias("mean_question_length"))
    words = _group_words(rows, min_chars=1)
    vocabulary = words.groupBy("answer_key").agg(F.count("*").alias("vocabulary"))
    common = _joined(_ranked_words(words.where(F.length("word") > 3), 3), "common_words",
                     F.concat("word", F.lit("("), F.col("freq").cast("string"), F.lit(")")))
    return (base.join(vocabulary, "answer_key", "left").join(common, "answer_key", "left")
            .withColumn("share_pct", 100.0 * F.col("n") / _total(df)).drop("answer_key"))


def group_types(df: DataFrame, k: int = 6) -> DataFrame:
    """Type split of the most frequent answers."""
    return rows_of_top_answers(df, k).groupBy("answer_key", "type").agg(F.count("*").alias("n"))


def recurrent_words(df: DataFrame, k: int = 6) -> DataFrame:
    """Words of more than three characters found in over half of the questions of an answer."""
    rows = rows_of_top_answers(df, k).where("cnt >= 3")
    words = _group_words(rows, once_per_row=True).where((F.col("freq") > F.col("cnt") * 0.5) & (F.col("freq") >= 2))
    return _joined(_ranked_words(words, 3), "patterns", F.col("word"))


def key_words(df: DataFrame, k: int = 4) -> DataFrame:
    """Top three words per answer that occur at least max(2, 30 % of the rows) times."""
    words = _ranked_words(_group_words(rows_of_top_answers(df, k)), 3)
    return _joined(words.where(F.col("freq") >= F.greatest(F.lit(2.0), F.col("cnt") * 0.3)), "key_words",
                   F.col("word"))


def _shown_top(df: DataFrame, k: int) -> DataFrame:
    rows = rows_of_top_answers(df, k)
    return rows.groupBy("answer_key").agg(_display().alias("answer"))


def theme_flags(df: DataFrame, k: int = 10, at_least: int = 3) -> DataFrame:
    """Themes among the k most frequent answers: number of matching answers and whether it is enough."""
    shown = _shown_top(df, k)
    counts = shown.agg(
        *[F.count_if(tx.contains_any("answer", words)).alias(t) for t, words in fv.THEME_WORDS.items()],
        F.count_if(tx.is_numeric_text("answer")).alias("numeric"))
    needed = {t: at_least for t in fv.THEME_WORDS} | {"numeric": 1}
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("theme"), F.col(t).alias("n_answers"), (F.col(t) >= n).alias("detected"))
        for t, n in needed.items()])))


def coherence_flags(df: DataFrame, k: int = 6) -> DataFrame:
    """Whether the most frequent answers are mostly of one field."""
    shown = _shown_top(df, k)
    counts = shown.agg(F.count("*").alias("total"), *[
        F.count_if(tx.contains_any("answer", words)).alias(t) for t, (words, _) in fv.COHERENCE_WORDS.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("field"), F.col(t).alias("n_answers"),
                 (F.col(t) >= F.col("total") * share).alias("coherent"))
        for t, (_, share) in fv.COHERENCE_WORDS.items()])))


def top5_concentration(df: DataFrame) -> DataFrame:
    share = F.lit(100.0) * F.sum("cnt") / F.first(_total(df))
    return _top(df, 5).agg(share.alias("top5_pct")).withColumn(
        "level", F.when(F.col("top5_pct") > 50, "strong").when(F.col("top5_pct") > 30, "moderate")
        .otherwise("acceptable"))


def question_uniqueness(df: DataFrame) -> DataFrame:
    """Share of distinct questions (a missing one counts as a value) with a label."""
    groups = df.groupBy("questions").agg(F.count("*").alias("c"))
    return groups.agg(F.count("*").alias("unique_questions"),
                      F.try_divide(F.count("*"), F.sum("c")).alias("uniqueness")).withColumn(
        "level", F.when(F.col("uniqueness") > 0.95, "varied").when(F.col("uniqueness") > 0.8, "moderate")
        .otherwise("repetitive"))


def group_length_table(df: DataFrame, k: int = 4) -> DataFrame:
    """Question lengths and vocabulary of the most frequent answers."""
    rows = rows_of_top_answers(df, k)
    base = rows.groupBy("answer_key").agg(
        tx.ellipsize(_display(), 30).alias("answer"), F.count("*").alias("n"),
        F.avg(F.length("questions")).alias("mean_length"), F.min(F.length("questions")).alias("min_length"),
        F.max(F.length("questions")).alias("max_length"))
    vocabulary = _group_words(rows, 1).groupBy("answer_key").agg(F.count("*").alias("unique_words"))
    return base.join(vocabulary, "answer_key", "left").withColumn(
        "share_pct", 100.0 * F.col("n") / _total(df)).drop("answer_key")


def sampled_question_lengths(df: DataFrame, k: int = 4, m: int = 8, seed: int = 42) -> DataFrame:
    """Up to m drawn questions of each of the k most frequent answers, their lengths and mean length."""
    rows = keep_first_n(rows_of_top_answers(df, k), ["answer_key"], [draw("qa_id", seed), F.col("qa_id")], m)
    w = Window.partitionBy("answer_key")
    return rows.select("answer_key", "qa_id", tx.ellipsize("questions", 37).alias("shown"),
                       F.length("questions").alias("length"),
                       F.avg(F.length("questions")).over(w).alias("mean_length"))


def lexical_diversity_by_group(df: DataFrame, k: int = 4) -> DataFrame:
    """Type-token ratio of the questions of each frequent answer, ranked, with the grade of the mean."""
    words = _group_words(rows_of_top_answers(df, k), 1)
    scored = words.groupBy("answer_key").agg((F.count("*") / F.sum("freq")).alias("lexical_diversity"))
    # At most k rows from here on.
    everything = Window.partitionBy(F.lit(0))
    mean = F.avg("lexical_diversity").over(everything)
    return scored.select(
        "answer_key", "lexical_diversity",
        F.rank().over(everything.orderBy(F.desc("lexical_diversity"))).alias("rank"),
        F.when(mean > 0.7, "excellent").when(mean > 0.5, "good").otherwise("limited").alias("overall"))


# --- concentration curves ---------------------------------------------------------------------------
# Both curves are straight between answers of equal count, so they are computed at the breakpoints given
# by the frequencies of the frequencies. N rows have at most sqrt(2 N) different counts, which bounds the
# one-partition windows below.

def cumulative_coverage(df: DataFrame) -> DataFrame:
    """Share of rows covered by the most frequent answers, at every change of the count."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    rows = F.col("cnt") * F.col("n_answers")
    return frequency_of_frequency(df).select(
        "cnt", F.sum("n_answers").over(w).alias("n_distinct"),
        (F.sum(rows).over(w) / F.sum(rows).over(everything)).alias("coverage"))


def lorenz_curve(df: DataFrame) -> DataFrame:
    """Cumulative share of answers against cumulative share of rows, rarest answers first."""
    w = Window.partitionBy(F.lit(0)).orderBy("cnt").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    rows = F.col("cnt") * F.col("n_answers")
    return frequency_of_frequency(df).select(
        "cnt", "n_answers", (F.sum("n_answers").over(w) / F.sum("n_answers").over(everything)).alias("x"),
        (F.sum(rows).over(w) / F.sum(rows).over(everything)).alias("y"), F.sum("n_answers").over(everything).alias("n"))


def gini(df: DataFrame) -> DataFrame:
    """``gini_trapz`` integrates the polyline that starts at the first answer; ``gini`` starts at the
    origin and is exact."""
    w = Window.partitionBy(F.lit(0)).orderBy("cnt")
    c = lorenz_curve(df).select(
        "n", "x", "y", F.coalesce(F.lag("x").over(w), F.lit(0.0)).alias("x0"),
        F.coalesce(F.lag("y").over(w), F.lit(0.0)).alias("y0"))
    area = F.sum((F.col("x") - F.col("x0")) * ((F.col("x") - F.col("y")) + (F.col("x0") - F.col("y0"))))
    # The first answer's own triangle, which the polyline from (1/n, y1) leaves out.
    first_y = (F.col("y") - F.col("y0")) / F.nullif((F.col("x") - F.col("x0")) * F.col("n"), F.lit(0.0))
    corner = F.min_by((1 / F.col("n")) * (1 / F.col("n") - first_y), "x")
    return c.agg((area - corner).alias("gini_trapz"), area.alias("gini"))


def type_shares(df: DataFrame) -> DataFrame:
    """Rows, share and mean lengths per type."""
    return df.groupBy("type").agg(
        F.count("*").alias("n"), (F.lit(100.0) * F.count("*") / F.first(_total(df))).alias("share_pct"),
        F.avg(F.length("questions")).alias("mean_question_length"), F.avg(F.length("answer")).alias("mean_answer_length"))
