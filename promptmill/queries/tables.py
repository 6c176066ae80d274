"""Schema profiles, table repair and class and score statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixedvalues as fv
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import compare, fuzzy, lexical, profile, running, sampling, semantic, stats
from ..plans import balance
from ..plans import compare as plans_compare
from ..sources import views
from .registry import CORPUS, PROMPTS, QA, QA_TEXT, any_of, register, tokens, words
from .texts import LABELLED, PROMPT_SCORE, QA_SCORE, digest_bytes, labelled

L, R = "mapped", "augmented"


def annotated(spark, folder):
    """Documents with their partly missing labels."""
    return views.table(spark, folder, "documents").join(views.table(spark, folder, "labels"), "doc_id", "left")


ANNOTATED = "annotated AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
COLUMNS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
           ("quality", "int"), ("toxic", "int")]

register("schema_profile", lambda s, d: profile.schema_profile(annotated(s, d)), f"WITH {ANNOTATED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_pct FROM annotated" for c, t in COLUMNS))

register("missing_summary", lambda s, d: profile.missing_summary(annotated(s, d)), f"""
WITH {ANNOTATED}, m AS (SELECT count(*) AS n_rows, count(*) * 7 AS cells, {' + '.join(f'(count(*) - count({c}))' for c, _ in COLUMNS)} AS missing FROM annotated)
SELECT n_rows, CAST(7 AS INTEGER) AS n_cols, cells, missing, round(100.0::DOUBLE * missing / cells, 6) AS missing_pct FROM m""")

DESCRIBED = """cols AS (SELECT column_name AS c, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' END AS t
  FROM (DESCRIBE SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""
register("dtype_histogram", lambda s, d: profile.dtype_histogram(annotated(s, d)),
         f"WITH {DESCRIBED} SELECT t AS dtype, count(*) AS n_columns FROM cols GROUP BY 1")
register("column_roles", lambda s, d: profile.column_roles(annotated(s, d)), f"""
WITH {DESCRIBED} SELECT c AS "column", CASE {' '.join(f"WHEN {any_of('c', w)} THEN '{role}'" for role, w in fv.ROLE_WORDS.items())} END AS role FROM cols""")

register("text_column_stats", lambda s, d: profile.text_column_stats(views.table(s, d, "documents")), " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length, "
    f"round(avg(length({c})), 6) AS mean_length, round(median(length({c})), 6) AS median_length, count(DISTINCT {c}) AS distinct_values FROM documents"
    for c in ("text", "lang", "source")))

register("long_text_columns", lambda s, d: profile.long_text_columns(views.table(s, d, "documents")), """
SELECT 'text' AS "column", round(avg(length(text)), 6) AS mean_length FROM documents HAVING avg(length(text)) > 50""")


def untidy(spark, folder):
    """Prompts whose class is text and sometimes no number."""
    return views.prompts(spark, folder).withColumn(
        "intent_disc", F.when(F.col("row_id") % 7 == 0, "abc").otherwise(F.col("intent_disc").cast("string"))).drop("intent_cont")


register("conform", lambda s, d: profile.conform(untidy(s, d)).groupBy("intent_disc", "intent_cont").agg(
    F.count("*").alias("n"), F.sum(F.length("prompt")).alias("chars")), f"""
WITH {PROMPTS} SELECT CASE WHEN row_id % 7 = 0 THEN NULL ELSE intent_disc::DOUBLE END AS intent_disc, NULL::DOUBLE AS intent_cont,
 count(*) AS n, CAST(sum(length(prompt)) AS BIGINT) AS chars FROM prompts GROUP BY 1, 2""")

NORMALISED = rf"""{CORPUS}, trimmed AS (SELECT row_id, 'gen_' || (row_number() OVER (ORDER BY row_id) - 1) AS id,
  regexp_replace(prompt, '^\s+|\s+$', '', 'g') AS prompt, intent_disc, intent_cont, source FROM corpus),
 normalised AS (SELECT *, CASE WHEN regexp_matches(lower(prompt), '{fv.ACCENT_PATTERN}') THEN 'FR' ELSE 'EN' END AS language FROM
  (SELECT *, row_number() OVER (PARTITION BY prompt, source ORDER BY row_id) AS rn FROM trimmed) WHERE rn = 1)"""
register("normalise", lambda s, d: profile.normalise(views.corpus(s, d).drop("dataset")).select(
    "row_id", "id", F.md5("prompt").alias("prompt"), "response", "intent_disc", "intent_cont", "language", "source"), f"""
WITH {NORMALISED} SELECT row_id, id, md5(prompt) AS prompt, NULL::VARCHAR AS response, intent_disc, round(intent_cont, 6) AS intent_cont, language, source FROM normalised""")

register("global_stats", lambda s, d: profile.global_stats(views.corpus(s, d).withColumn(
    "response", F.when(F.col("row_id") % 3 > 0, F.col("dataset")))), f"""
WITH {CORPUS} SELECT source, count(*) AS n_rows, CAST(7 AS INTEGER) AS n_cols, 0.0::DOUBLE AS missing_prompt_pct,
 round(avg(CASE WHEN row_id % 3 > 0 THEN 0.0 ELSE 1.0 END) * 100, 6) AS missing_response_pct, round(avg(length(prompt)), 6) AS len_prompt_mean,
 round(avg(CASE WHEN row_id % 3 > 0 THEN length(dataset) END), 6) AS len_response_mean FROM corpus GROUP BY source""")

register("describe", lambda s, d: profile.describe(views.prompts(s, d), ["intent_disc", "intent_cont"]), f"WITH {PROMPTS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, "
    f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM prompts" for c in ("intent_disc", "intent_cont")))

register("output_rows", lambda s, d: profile.output_rows(views.prompts(s, d).withColumn(
    "intent_disc", F.when(F.col("row_id") % 5 > 0, F.col("intent_disc")))).withColumn("prompt", F.md5("prompt")), f"""
WITH {PROMPTS} SELECT md5(prompt) AS prompt, 'augmented' AS dataset, CAST(CASE WHEN row_id % 5 > 0 THEN intent_disc ELSE 0 END AS INTEGER) AS intent_disc,
 round(intent_cont, 6) AS intent_cont FROM prompts""")

register("drop_null_keys", lambda s, d: profile.drop_null_keys(annotated(s, d), ["quality", "toxic"]).select("doc_id", "quality"),
         f"WITH {ANNOTATED} SELECT doc_id, quality FROM annotated WHERE quality IS NOT NULL AND toxic IS NOT NULL")

register("preview", lambda s, d: profile.preview(views.prompts(s, d), "row_id", 5), f"""
WITH {PROMPTS} SELECT row_id, prompt, dataset, intent_disc, round(intent_cont, 6) AS intent_cont FROM prompts ORDER BY row_id LIMIT 5""")

register("flatten", lambda s, d: profile.flatten(views.table(s, d, "documents").select(
    "doc_id", F.struct("lang", F.struct("source", "n_chars").alias("origin")).alias("meta"))), """
SELECT doc_id, lang AS "meta.lang", source AS "meta.origin.source", n_chars AS "meta.origin.n_chars" FROM documents""")

register("generated_with_score", lambda s, d: views.corpus(s, d).where((F.col("source") == R) & F.col("intent_cont").isNotNull())
         .select("row_id", "intent_disc", "intent_cont"),
         f"WITH {CORPUS} SELECT row_id, intent_disc, round(intent_cont, 6) AS intent_cont FROM corpus WHERE source = 'augmented' AND intent_cont IS NOT NULL")

# --- classes and scores -----------------------------------------------------------------------------

register("class_counts", lambda s, d: stats.class_counts(views.prompts(s, d)),
         f"WITH {PROMPTS} SELECT intent_disc, count(*) AS n FROM prompts GROUP BY 1")

register("plan_quotas", lambda s, d: balance.plan_quotas(stats.class_counts(views.prompts(s, d)), 50, 100), f"""
WITH {PROMPTS}, c AS (SELECT intent_disc, count(*) AS n FROM prompts GROUP BY 1), w AS (SELECT *, CAST(round_even(((SELECT max(n) FROM c) - n) * 0.5::DOUBLE, 0) AS BIGINT) AS n_wanted FROM c)
SELECT *, least(n_wanted, 100) AS n_new FROM w""")

register("novel_budget", lambda s, d: balance.plan_quotas(stats.class_counts(views.prompts(s, d)), 50).agg(
    F.sum("n_new").alias("total_new"), balance.novel_budget(F.sum(F.least("n", F.lit(50))), F.sum("n_new"), 0.15).alias("k")), f"""
WITH {PROMPTS}, c AS (SELECT intent_disc, count(*) AS n FROM prompts GROUP BY 1),
q AS (SELECT n, CAST(round_even(((SELECT max(n) FROM c) - n) * 0.5::DOUBLE, 0) AS BIGINT) AS n_new FROM c)
SELECT CAST(sum(n_new) AS BIGINT) AS total_new, CAST(least(greatest(10, floor(sum(least(n, 50)) / 10)), floor(0.15::DOUBLE * greatest(sum(n_new), 1))) AS BIGINT) AS k FROM q""")

register("class_cv_percent", lambda s, d: stats.class_cv_percent(views.prompts(s, d)), f"""
WITH {PROMPTS}, c AS (SELECT count(*) AS n FROM prompts GROUP BY intent_disc)
SELECT round(stddev_pop(n) * 100 / avg(n), 6) AS class_histogram_cv_percent FROM c""")

register("label_entropy", lambda s, d: stats.label_entropy(views.corpus(s, d)), f"""
WITH {CORPUS}, c AS (SELECT source, intent_disc, count(*) AS n FROM corpus GROUP BY 1, 2)
SELECT source, count(*) AS unique_labels, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY 1""")

register("class_mean_score", lambda s, d: stats.class_mean_score(views.prompts(s, d)),
         f"WITH {PROMPTS} SELECT intent_disc, round(avg(intent_cont), 6) AS class_mean FROM prompts GROUP BY 1")

register("prompt_score_lookup", lambda s, d: stats.prompt_score_lookup(views.prompts(s, d)).withColumn("prompt", F.md5("prompt")), f"""
WITH {PROMPTS} SELECT md5(prompt) AS prompt, round(max_by(intent_cont, row_id), 6) AS seed_score FROM prompts GROUP BY prompt""")

register("score_moments", lambda s, d: stats.score_moments(views.corpus(s, d)), f"""
WITH {CORPUS}, m AS (SELECT source, avg(intent_cont) AS m FROM corpus GROUP BY 1),
c AS (SELECT c.source, intent_cont AS x, intent_cont - m AS e FROM corpus c JOIN m USING (source))
SELECT source, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(avg(e * e * e) / pow(avg(e * e), 1.5), 6) AS skew,
 round(avg(e * e * e * e) / pow(avg(e * e), 2) - 3, 6) AS kurt, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM c GROUP BY 1""")

EDGES = f"""{CORPUS}, edges AS (SELECT source, list_sort(list_distinct(quantile_cont(intent_cont, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM corpus GROUP BY 1),
binned AS (SELECT c.source, e, CAST(len(list_filter(e[2:len(e) - 1], lambda b: b < intent_cont)) AS INTEGER) AS bin FROM corpus c JOIN edges USING (source)),
bins AS (SELECT source, bin, e[bin + 1] AS lower, e[bin + 2] AS upper, count(*) AS n FROM binned GROUP BY ALL)"""
register("quantile_bins", lambda s, d: stats.quantile_bins(views.corpus(s, d)),
         f"WITH {EDGES} SELECT source, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, n FROM bins")
register("top_quantile_bins", lambda s, d: stats.top_quantile_bins(views.corpus(s, d)), f"""
WITH {EDGES} SELECT source, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, n, CAST(rank AS INTEGER) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, bin) AS rank FROM bins) WHERE rank <= 5""")


def histogram_sql(prefix: str, table: str, value: str, bins: int, by: str, weight: str = "1") -> str:
    return f"""WITH {prefix}, b AS (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM {table}),
h AS (SELECT {by}, CAST(least(floor(({value}::DOUBLE - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin, CAST(sum({weight}) AS BIGINT) AS n FROM {table}, b GROUP BY 1, 2),
g AS (SELECT {by}, sum(n) AS total FROM h GROUP BY 1), k AS (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin)
SELECT g.{by}, k.bin, round(lo + (hi - lo) / {bins} * k.bin, 6) AS lower, coalesce(n, 0) AS n,
 round(coalesce(n, 0) / (total * ((hi - lo) / {bins})), 6) AS density FROM g CROSS JOIN k CROSS JOIN b LEFT JOIN h ON h.{by} = g.{by} AND h.bin = k.bin"""


register("score_histogram", lambda s, d: stats.histogram(views.corpus(s, d), "intent_cont", 30, ["source"]),
         histogram_sql(CORPUS, "corpus", "intent_cont", 30, "source"))
register("length_histogram", lambda s, d: stats.histogram(views.prompts(s, d).withColumn("length", F.length("prompt")), "length", 30, ["intent_disc"]),
         histogram_sql(PROMPTS, "prompts", "length(prompt)", 30, "intent_disc"))
register("word_count_histogram", lambda s, d: stats.histogram(views.qa_text(s, d).withColumn("words", tx.n_words("questions")), "words", 30, ["type"]),
         histogram_sql(QA_TEXT, "qa_text", f"len({tokens('questions')})", 30, "type"))

register("kde", lambda s, d: stats.kde(views.corpus(s, d), "intent_cont", 25, ["source"]), f"""
WITH {CORPUS}, h AS (SELECT source, count(*) AS n, stddev_samp(intent_cont) * pow(count(*), -0.2) AS h FROM corpus GROUP BY 1),
l AS (SELECT min(intent_cont) AS lo, max(intent_cont) AS hi FROM corpus), p AS (SELECT CAST(unnest(range(25)) AS INTEGER) AS point),
g AS (SELECT point, lo - (hi - lo) * 0.5 + (hi - lo) * 2 * point / 24 AS x FROM l, p)
SELECT source, point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - intent_cont) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM corpus JOIN h USING (source), g GROUP BY source, point, x""")

register("box_stats", lambda s, d: stats.box_stats(views.corpus(s, d), "intent_cont", ["source"]), f"""
WITH {CORPUS}, q AS (SELECT source, count(*) AS n, quantile_cont(intent_cont, 0.25) AS q25, quantile_cont(intent_cont, 0.5) AS q50, quantile_cont(intent_cont, 0.75) AS q75 FROM corpus GROUP BY 1),
f AS (SELECT c.source, intent_cont AS x, q.*, x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM corpus c JOIN q USING (source))
SELECT source, any_value(n) AS n, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50, round(any_value(q75), 6) AS q75,
 round(min(x) FILTER (inside), 6) AS whisker_low, round(max(x) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY source""")
register("length_box_stats", lambda s, d: stats.box_stats(views.prompts(s, d).withColumn("length", F.length("prompt")), "length", ["intent_disc"]), f"""
WITH {PROMPTS}, q AS (SELECT intent_disc, count(*) AS n, quantile_cont(length(prompt)::DOUBLE, 0.25) AS q25, quantile_cont(length(prompt)::DOUBLE, 0.5) AS q50, quantile_cont(length(prompt)::DOUBLE, 0.75) AS q75 FROM prompts GROUP BY 1),
f AS (SELECT intent_disc, length(prompt)::DOUBLE AS x, n, q25, q50, q75, x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM prompts JOIN q USING (intent_disc))
SELECT intent_disc, any_value(n) AS n, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50, round(any_value(q75), 6) AS q75,
 round(min(x) FILTER (inside), 6) AS whisker_low, round(max(x) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY intent_disc""")

register("linear_fit", lambda s, d: stats.linear_fit(views.qa_text(s, d), F.length("questions"), F.length("answer")),
         f"WITH {QA_TEXT} SELECT round(regr_slope(length(answer), length(questions)), 6) AS slope, round(regr_intercept(length(answer), length(questions)), 6) AS intercept FROM qa_text")
register("correlation", lambda s, d: stats.correlation(views.prompts(s, d), F.length("prompt"), F.col("intent_cont")),
         f"WITH {PROMPTS} SELECT round(corr(length(prompt), intent_cont), 6) AS correlation FROM prompts")
register("score_summary", lambda s, d: stats.score_summary(views.prompts(s, d), "intent_cont", "dataset"), f"""
WITH {PROMPTS}, b AS (SELECT dataset, intent_cont AS x FROM prompts UNION ALL SELECT '*', intent_cont FROM prompts)
SELECT dataset, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS n, round(median(x), 6) AS median FROM b GROUP BY 1""")
register("label_params", lambda s, d: stats.label_params(views.prompts(s, d)),
         f"WITH {PROMPTS} SELECT round(avg(intent_cont), 6) AS label_mean, round(stddev_samp(intent_cont), 6) AS label_std FROM prompts")
register("dense_index", lambda s, d: running.dense_index(views.prompts(s, d).select("row_id", "dataset"), ["row_id"], ["dataset"]),
         f"WITH {PROMPTS} SELECT row_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1 AS pos FROM prompts")

# --- lexical ----------------------------------------------------------------------------------------

register("ttr", lambda s, d: lexical.ttr(views.dealt_prompts(s, d)), f"""
WITH {PROMPTS}, t AS (SELECT unnest({tokens('lower(prompt)')}) AS t FROM prompts) SELECT round(count(DISTINCT t) / count(*), 6) AS ttr FROM t""")
register("unigram_entropy", lambda s, d: lexical.unigram_entropy(views.dealt_prompts(s, d)), f"""
WITH {PROMPTS}, t AS (SELECT unnest({words('prompt')}) AS t FROM prompts), c AS (SELECT t, count(*) AS n FROM t GROUP BY 1)
SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS unigram_entropy FROM c""")
TOKEN_COUNTS = f"""tc AS (SELECT source, field, t, count(*) AS n FROM (SELECT source, 'prompt' AS field, unnest({tokens('prompt')}) AS t FROM corpus
  UNION ALL SELECT source, 'dataset', unnest({tokens('dataset')}) FROM corpus) GROUP BY ALL)"""
register("token_stats", lambda s, d: lexical.token_stats(views.dealt_corpus(s, d), ["prompt", "dataset"]), f"""
WITH {CORPUS}, {TOKEN_COUNTS} SELECT source, field, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, round(count(*) / sum(n), 6) AS ttr,
 round(count(*) FILTER (n = 1) / count(*), 6) AS hapax_ratio, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_token FROM tc GROUP BY 1, 2""")
register("msttr", lambda s, d: lexical.msttr(views.dealt_corpus(s, d)), f"""
WITH {CORPUS}, r AS (SELECT source, row_id, {tokens('prompt')} AS l FROM corpus),
t AS (SELECT source, row_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM r),
p AS (SELECT source, t, (row_number() OVER (PARTITION BY source ORDER BY row_id, i) - 1) // 100 AS seg FROM t),
g AS (SELECT source, seg, count(*) AS c, count(DISTINCT t) AS u FROM p GROUP BY 1, 2)
SELECT source, round(avg(u / 100.0::DOUBLE), 6) AS msttr FROM g WHERE c = 100 GROUP BY 1""")


def grams_sql(keep: str = "source") -> str:
    """n-grams of 1 to 3 tokens by window functions."""
    return f"""r AS (SELECT source, row_id, {tokens('prompt')} AS l FROM corpus),
t AS (SELECT source, row_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM r),
w AS (SELECT source, t, lead(t, 1) OVER q AS t2, lead(t, 2) OVER q AS t3 FROM t WINDOW q AS (PARTITION BY row_id ORDER BY i)),
grams AS (SELECT source, 1 AS n, t AS ngram FROM w UNION ALL SELECT source, 2, t || ' ' || t2 FROM w WHERE t2 IS NOT NULL
  UNION ALL SELECT source, 3, t || ' ' || t2 || ' ' || t3 FROM w WHERE t3 IS NOT NULL)"""


register("top_ngrams", lambda s, d: lexical.top_ngrams(views.corpus(s, d)), f"""
WITH {CORPUS}, {grams_sql()}, c AS (SELECT source, n, ngram, count(*) AS freq FROM grams GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY source, n ORDER BY freq DESC, ngram) AS rank, sum(freq) OVER (PARTITION BY source, n) AS total FROM c)
SELECT source, CAST(n AS INTEGER) AS n, CAST(rank AS INTEGER) AS rank, ngram, freq, round(freq / total, 6) AS rel_freq FROM k WHERE rank <= 20""")
register("ngram_jaccard", lambda s, d: lexical.ngram_jaccard(views.corpus(s, d), L, R), f"""
WITH {CORPUS}, {grams_sql()}, g AS (SELECT n, ngram, bool_or(source = 'mapped') AS l, bool_or(source = 'augmented') AS r FROM grams GROUP BY 1, 2)
SELECT CAST(n AS INTEGER) AS n, round(count(*) FILTER (l AND r) / count(*), 6) AS jaccard, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only FROM g GROUP BY 1""")
register("word_frequencies", lambda s, d: lexical.word_frequencies(views.qa_text(s, d), "questions", fv.QUESTION_STOPWORDS, 100), f"""
WITH {QA_TEXT}, t AS (SELECT unnest({words('questions')}) AS word FROM qa_text)
SELECT word, count(*) AS freq FROM t WHERE word NOT IN ({', '.join(repr(w) for w in fv.QUESTION_STOPWORDS)}) GROUP BY 1 ORDER BY freq DESC, word LIMIT 100""")

# --- two datasets -----------------------------------------------------------------------------------

FREQ = f"""{CORPUS}, f AS (SELECT intent_disc, count(*) FILTER (source = 'mapped') AS freq_left, count(*) FILTER (source = 'augmented') AS freq_right FROM corpus GROUP BY 1)"""
register("class_frequency_delta", lambda s, d: compare.class_frequencies(views.corpus(s, d), L, R),
         f"WITH {FREQ} SELECT *, freq_right - freq_left AS delta FROM f")


def sides(spark, folder):
    both = views.corpus(spark, folder)
    return both.where(F.col("source") == L), both.where(F.col("source") == R)


register("class_frequency_side_by_side", lambda s, d: compare.outer_frequencies(*sides(s, d)),
         f"WITH {FREQ} SELECT intent_disc, freq_left, freq_right FROM f")
register("class_coverage", lambda s, d: compare.class_coverage(views.corpus(s, d), L, R, "dataset"), f"""
WITH {CORPUS}, f AS (SELECT dataset, bool_or(source = 'mapped') AS l, bool_or(source = 'augmented') AS r FROM corpus GROUP BY 1)
SELECT count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (r AND NOT l) AS only_right, count(*) FILTER (l AND r) AS common,
 round(100.0::DOUBLE * count(*) FILTER (l AND r) / count(*) FILTER (l), 6) AS coverage_pct FROM f""")
register("distinct_values", lambda s, d: compare.distinct_values(views.prompts(s, d), "dataset"), f"WITH {PROMPTS} SELECT DISTINCT dataset FROM prompts")
register("union_all", lambda s, d: compare.union_all({
    "base": views.prompts(s, d).select("row_id", "dataset"), "generated": views.qa(s, d).select(F.col("qa_id").alias("row_id"), "answer")}), f"""
WITH {PROMPTS}, {QA} SELECT row_id, dataset, NULL::VARCHAR AS answer, 'base' AS source FROM prompts UNION ALL SELECT qa_id, NULL, answer, 'generated' FROM qa""")


def js_sql(value: str) -> str:
    return f"""WITH {CORPUS}, b AS (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM corpus),
h AS (SELECT source, CAST(least(floor(({value} - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM corpus, b GROUP BY 1, 2),
g AS (SELECT source, sum(n) AS total FROM h GROUP BY 1), k AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin),
e AS (SELECT g.source, k.bin, coalesce(n, 0) / (total * ((hi - lo) / 20)) + 1e-8 AS v FROM g CROSS JOIN k CROSS JOIN b LEFT JOIN h ON h.source = g.source AND h.bin = k.bin),
s AS (SELECT bin, max(v) FILTER (source = 'mapped') AS p, max(v) FILTER (source = 'augmented') AS q FROM e GROUP BY 1),
m AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM s)
SELECT round(sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)), 6) AS js_distance FROM m"""


register("js_distance", lambda s, d: compare.js_distance(views.corpus(s, d), "intent_cont", L, R), js_sql("intent_cont"))
register("js_distance_classes", lambda s, d: compare.js_distance(views.corpus(s, d), "intent_disc", L, R), js_sql("intent_disc"))

ECDF = f"""{CORPUS}, v AS (SELECT intent_cont AS x, count(*) FILTER (source = 'mapped') AS a, count(*) FILTER (source = 'augmented') AS b FROM corpus GROUP BY 1),
e AS (SELECT x, CAST(sum(a) OVER () AS BIGINT) AS a_total, CAST(sum(b) OVER () AS BIGINT) AS b_total, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS cdf_left, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS cdf_right FROM v)"""
register("ecdf", lambda s, d: compare.ecdf(views.corpus(s, d), "intent_cont", L, R),
         f"WITH {ECDF} SELECT round(x, 6) AS x, a_total, b_total, round(cdf_left, 6) AS cdf_left, round(cdf_right, 6) AS cdf_right FROM e")
register("ks_two_sample", lambda s, d: compare.ks_two_sample(views.corpus(s, d), "intent_cont", L, R), f"""
WITH {ECDF}, d AS (SELECT max(abs(cdf_left - cdf_right)) AS d, any_value(a_total)::DOUBLE AS n, any_value(b_total)::DOUBLE AS m FROM e),
l AS (SELECT d, n * m / (n + m) * d * d AS l2 FROM d)
SELECT round(d, 6) AS statistic, round(CASE WHEN l2 < 0.04 THEN 1.0 ELSE least(greatest((SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * l2))
 FROM (SELECT unnest(range(1, 101)) AS k)), 0), 1) END, 6) AS p_value FROM l""")

POSITIONS = f"""{CORPUS}, n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS pos, intent_cont, intent_disc FROM corpus),
pp AS (SELECT a.pos, a.intent_cont AS left_value, b.intent_cont AS right_value FROM n a JOIN n b ON a.pos = b.pos AND a.source = 'mapped' AND b.source = 'augmented')"""
register("positional_pairs", lambda s, d: compare.positional_pairs(views.corpus(s, d), "intent_cont", L, R),
         f"WITH {POSITIONS} SELECT pos, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value FROM pp")
register("positional_correlation", lambda s, d: compare.positional_correlation(views.corpus(s, d), "intent_cont", L, R),
         f"WITH {POSITIONS} SELECT count(*) AS n, round(corr(left_value, right_value), 6) AS correlation FROM pp")

SYNTHESIS = f"""{CORPUS}, {TOKEN_COUNTS}, w AS (SELECT source, count(*) / sum(n) AS ttr, count(*) FILTER (n = 1) / count(*) AS hapax FROM tc WHERE field = 'prompt' GROUP BY 1),
c AS (SELECT source, intent_disc, count(*) AS n FROM corpus GROUP BY 1, 2), e AS (SELECT source, count(*) AS labels, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY 1),
b AS (SELECT source, count(*) AS n_rows, avg(intent_cont) AS mean_intent_cont, 100.0::DOUBLE * (count(*) - count(DISTINCT prompt)) / count(*) AS dup FROM corpus GROUP BY 1)"""
def semantic_means(spark, folder):
    """Exact mean cosine of the hash vectors of each side."""
    rows = views.dealt_corpus(spark, folder).select("source", vec.hash_unit("prompt").alias("v"))
    return semantic.mean_pairwise(rows, "v", 32, ["source"]).select("source", "mean_cosine")


#: The table, with the last column but one as given.
SYNTHESIS_TABLE = f"""{SYNTHESIS}, hb AS (SELECT source, {digest_bytes('prompt')} AS b FROM corpus), he AS (SELECT source, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS e FROM hb),
hu AS (SELECT source, unnest(e) AS x, unnest(range(32)) AS i FROM he), hs AS (SELECT source, i, sum(x) AS t FROM hu GROUP BY 1, 2),
hm AS (SELECT source, (sum(t * t) - any_value(n_rows)) / (any_value(n_rows) * (any_value(n_rows) - 1)) AS cosine FROM hs JOIN b USING (source) GROUP BY 1)"""
SYNTHESIS_COLUMNS = """SELECT source, n_rows, labels AS unique_labels, round(entropy, 6) AS label_entropy, round(mean_intent_cont, 6) AS mean_intent_cont, round(ttr, 6) AS ttr_prompt,
 round(hapax, 6) AS hapax_prompt, round(dup, 6) AS dup_exact_prompt_pct, {fuzzy} AS quasi_dup_prompt_pct, round(cosine, 6) AS mean_semantic_intra
FROM b JOIN e USING (source) JOIN w USING (source) JOIN hm USING (source)"""
register("synthesis_table", lambda s, d: plans_compare.synthesis_table(views.dealt_corpus(s, d), semantic=semantic_means(s, d)),
         f"WITH {SYNTHESIS_TABLE} {SYNTHESIS_COLUMNS.format(fuzzy='NULL::DOUBLE')}")


def synthesis_with_fuzzy(spark, folder):
    rows = views.dealt_corpus(spark, folder)
    return plans_compare.synthesis_table(rows, fuzzy=fuzzy.fuzzy_counts(rows), semantic=semantic_means(spark, folder))


# Pairs by what their texts share of tokens: on the test tables these are all fuzzy pairs (none has rests that are only spelt alike).
register("synthesis_table_fuzzy", synthesis_with_fuzzy, rf"""
WITH {SYNTHESIS_TABLE}, ft AS (SELECT row_id, source, min(row_id) OVER (PARTITION BY prompt) AS first_id, length(prompt) AS n, list_distinct(list_filter(regexp_split_to_array(prompt, '\s+'), lambda x: x <> '')) AS s FROM corpus WHERE length(prompt) > 0),
fw AS MATERIALIZED (SELECT *, list_sum(list_transform(s, lambda x: length(x) + 1)) AS w FROM ft WHERE len(s) > 0),
fc AS (SELECT x.source, x.w AS w_a, y.w AS w_b, list_sum(list_transform(list_intersect(x.s, y.s), lambda x: length(x) + 1)) AS c FROM fw x JOIN fw y ON x.source = y.source AND x.row_id < y.row_id
 AND abs(x.n - y.n) <= 0.1 * CASE WHEN x.first_id <= y.first_id THEN x.n ELSE y.n END),
fz AS (SELECT source, count(*) AS pairs FROM fc WHERE c > 0 AND (c IN (w_a, w_b) OR 200 * (c - 1) >= 90 * (least(w_a, w_b) - 1 + c - 1)) GROUP BY 1)
{SYNTHESIS_COLUMNS.format(fuzzy='round(100.0::DOUBLE * coalesce(pairs, 0) / n_rows, 6)')} LEFT JOIN fz USING (source)""")
register("recommendations", lambda s, d: plans_compare.recommendations(plans_compare.synthesis_table(views.corpus(s, d)), low=0.5), f"""
WITH {SYNTHESIS} SELECT source, '[' || source || '] low type-token ratio: add varied sources or paraphrases' AS advice FROM w WHERE ttr < 0.5""")

# --- samples and rankings ---------------------------------------------------------------------------

RANK = "md5(row_id || '-42'), row_id"
register("stratified_seeds", lambda s, d: sampling.stratified_seeds(views.prompts(s, d)).select("row_id", "intent_disc", "seed_rank"), f"""
WITH {PROMPTS} SELECT row_id, intent_disc, CAST(k AS INTEGER) AS seed_rank FROM (SELECT *, row_number() OVER (PARTITION BY intent_disc ORDER BY {RANK}) AS k FROM prompts)
WHERE k <= 50""")
register("stratified_sample", lambda s, d: sampling.stratified_sample(views.prompts(s, d), "dataset", "row_id", 20).select("row_id", "dataset"), f"""
WITH {PROMPTS} SELECT row_id, dataset FROM prompts QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {RANK}) <= 20""")
register("sample_n", lambda s, d: sampling.sample_n(views.prompts(s, d), "row_id", 200).select("row_id"),
         f"WITH {PROMPTS} SELECT row_id FROM prompts ORDER BY {RANK} LIMIT 200")
register("top_scores", lambda s, d: sampling.top_n(views.prompts(s, d), "intent_cont", "row_id", 5).select("row_id", "intent_cont"),
         f"WITH {PROMPTS} SELECT row_id, round(intent_cont, 6) AS intent_cont FROM prompts ORDER BY intent_cont DESC, row_id LIMIT 5")
register("bottom_scores", lambda s, d: sampling.bottom_n(views.prompts(s, d), "intent_cont", "row_id", 5).select("row_id", "intent_cont"),
         f"WITH {PROMPTS} SELECT row_id, round(intent_cont, 6) AS intent_cont FROM prompts ORDER BY intent_cont, row_id LIMIT 5")
register("most_common", lambda s, d: sampling.most_common(views.prompts(s, d), "dataset", 10),
         f"WITH {PROMPTS} SELECT dataset, count(*) AS freq FROM prompts GROUP BY 1 ORDER BY freq DESC, dataset LIMIT 10")
register("examples_per_group", lambda s, d: sampling.examples_per_group(views.prompts(s, d), "dataset", "row_id", 3).select("row_id", "dataset"), f"""
WITH {PROMPTS} SELECT row_id, dataset FROM prompts QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {RANK}) <= 3""")
register("example_per_language", lambda s, d: sampling.example_per_language(views.prompts(s, d).withColumn(
    "language", tx.script_language("prompt")), "language", "row_id").select("row_id", "language"), f"""
WITH {PROMPTS}, l AS (SELECT row_id, CASE WHEN regexp_matches(lower(prompt), '{fv.ACCENT_PATTERN}') THEN 'FR' ELSE 'EN' END AS language FROM prompts)
SELECT min(row_id) AS row_id, language FROM l GROUP BY 2""")
register("best_prompt_examples", lambda s, d: sampling.top_n(labelled(s, d).withColumn(
    "score", tx.prompt_score("prompt", ["quality"], ["dataset"])), "score", "row_id", 5).select("row_id", "score"),
    f"WITH {LABELLED} SELECT row_id, {PROMPT_SCORE} AS score FROM labelled ORDER BY score DESC, row_id LIMIT 5")
register("best_qa_examples", lambda s, d: sampling.top_n(views.qa_text(s, d).withColumn(
    "score", tx.qa_score("questions", "answer", "type")), "score", "qa_id", 5).select("qa_id", "score"),
    f"WITH {QA_TEXT} SELECT qa_id, {QA_SCORE} AS score FROM qa_text ORDER BY score DESC, qa_id LIMIT 5")
register("weighted_class_draw", lambda s, d: sampling.weighted_class_draw(
    balance.plan_quotas(stats.class_counts(views.prompts(s, d)), 50), 500), f"""
WITH {PROMPTS}, c AS (SELECT intent_disc, count(*) AS n FROM prompts GROUP BY 1),
q AS (SELECT intent_disc, greatest(CAST(round_even(((SELECT max(n) FROM c) - n) * 0.5::DOUBLE, 0) AS BIGINT), 1) AS w FROM c),
s AS (SELECT intent_disc, sum(w) OVER (ORDER BY intent_disc) AS upto, sum(w) OVER (ORDER BY intent_disc) - w AS low, sum(w) OVER () AS total FROM q),
d AS (SELECT unnest(range(500)) AS draw), u AS (SELECT draw, CAST(('0x' || substr(md5(concat_ws('-', 'class', '42', '1', draw::VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM d)
SELECT CAST(1 AS INTEGER) AS run, draw, intent_disc FROM u JOIN s ON u * total >= low AND u * total < upto""")

CONTENT = {"avg_length": "length(t)", "avg_words": f"len({tokens('t')})"}
register("content_profile", lambda s, d: profile.content_profile(views.qa_text(s, d), ["questions", "answer"]), rf"""
WITH {QA_TEXT}, u AS (SELECT 'questions' AS "column", questions AS t FROM qa_text UNION ALL SELECT 'answer', answer FROM qa_text),
x AS (SELECT *, list_distinct(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) AS e FROM u)
SELECT "column", count(*) AS n, round(avg(length(t)), 6) AS avg_length, round(avg({CONTENT['avg_words']}), 6) AS avg_words,
 {', '.join(f"round(avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END), 6) AS {name}" for name, cond in [
     ("factual_ratio", any_of("t", fv.FACTUAL_WORDS)), ("creative_ratio", any_of("t", fv.CREATIVE_WORDS)),
     ("neutral_ratio", f"NOT {any_of('t', fv.FACTUAL_WORDS)} AND NOT {any_of('t', fv.CREATIVE_WORDS)}"),
     ("question_ratio", "contains(t, '?')"), ("instruction_ratio", any_of("t", fv.INSTRUCTION_WORDS)), ("triplet_ratio", any_of("t", fv.TRIPLET_WORDS))])},
 round(avg(len(e)), 6) AS avg_entities FROM x GROUP BY 1""")
