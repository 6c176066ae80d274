"""Answer duplication, versions and concentration of the question/answer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixedvalues as fv
from ..operators import answers as an
from ..sources import views
from .registry import COUNTS, QA, any_of, register, tokens

register("answer_counts", lambda s, d: an.answer_counts(views.qa(s, d)), f"WITH {COUNTS} SELECT * FROM ac")
register("answer_dup_summary", lambda s, d: an.dup_summary(views.qa(s, d)), f"""
WITH {COUNTS} SELECT CAST(sum(cnt) AS BIGINT) AS total_answers, count(*) AS unique_answers, count(*) FILTER (cnt > 1) AS duplicated_answers,
 CAST(coalesce(sum(cnt) FILTER (cnt > 1), 0) AS BIGINT) AS duplicated_rows, round(count(*) / sum(cnt), 6) AS diversity_ratio FROM ac""")
register("question_dup_buckets", lambda s, d: an.dup_buckets(views.qa(s, d).withColumn("answer", F.concat_ws("/", "questions", "answer"))), f"""
WITH {QA}, ac AS (SELECT count(*) AS cnt FROM qa GROUP BY questions, answer)
SELECT CASE WHEN cnt = 2 THEN '2' WHEN cnt <= 5 THEN '3-5' WHEN cnt <= 10 THEN '6-10' WHEN cnt <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS n_answers FROM ac WHERE cnt > 1 GROUP BY 1""")
register("top_answers", lambda s, d: an.top_answers(views.qa(s, d)), f"""
WITH {COUNTS} SELECT answer_key, CASE WHEN length(answer_key) > 50 THEN left(answer_key, 50) || '...' ELSE answer_key END AS shown, cnt,
 round(100.0::DOUBLE * cnt / (SELECT sum(cnt) FROM ac), 6) AS share_pct FROM ac ORDER BY cnt DESC, answer_key LIMIT 10""")
TYPED = f"{QA}, tc AS (SELECT type, lower(trim(answer)) AS answer_key, count(*) AS cnt FROM qa GROUP BY 1, 2)"
register("answer_dup_by_type", lambda s, d: an.dup_by_type(views.qa(s, d)), f"""
WITH {TYPED} SELECT type, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS unique_answers, count(*) FILTER (cnt > 1) AS duplicated_answers FROM tc GROUP BY 1""")
register("top_answers_by_type", lambda s, d: an.top_answers_by_type(views.qa(s, d)), f"""
WITH {TYPED} SELECT type, answer_key, cnt, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY cnt DESC, answer_key) AS k FROM tc WHERE cnt > 1) WHERE k <= 3""")
register("frequency_of_frequency", lambda s, d: an.frequency_of_frequency(views.qa(s, d)), f"WITH {COUNTS} SELECT cnt, count(*) AS n_answers FROM ac GROUP BY 1")
register("diversity_by_type", lambda s, d: an.diversity_by_type(views.qa(s, d)), f"WITH {TYPED} SELECT type, round(count(*) / sum(cnt), 6) AS diversity FROM tc GROUP BY 1")
register("answer_length_histogram", lambda s, d: an.length_histogram(views.qa(s, d).withColumn("answer", F.concat_ws("/", "questions", "answer"))), f"""
WITH {QA}, ac AS (SELECT length(lower(questions || '/' || answer))::DOUBLE AS l, count(*) AS cnt, count(*) > 1 AS repeated FROM qa GROUP BY questions, answer),
b AS (SELECT min(l) AS lo, max(l) AS hi FROM ac),
h AS (SELECT repeated, CAST(least(floor((l - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, CAST(sum(cnt) AS BIGINT) AS n FROM ac, b GROUP BY 1, 2),
g AS (SELECT repeated, sum(n) AS total FROM h GROUP BY 1), k AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin)
SELECT g.repeated, k.bin, round(lo + (hi - lo) / 20 * k.bin, 6) AS lower, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * ((hi - lo) / 20)), 6) AS density
FROM g CROSS JOIN k CROSS JOIN b LEFT JOIN h ON h.repeated = g.repeated AND h.bin = k.bin""")
register("diversity_grade", lambda s, d: an.grade(views.qa(s, d)), f"""
WITH {COUNTS}, s AS (SELECT sum(cnt) AS total, count(*) AS u, count(*) FILTER (cnt > 1) AS dup, max(cnt) AS top FROM ac)
SELECT round(u / total, 6) AS diversity_ratio, CASE WHEN u / total >= 0.8 THEN 'excellent' WHEN u / total >= 0.6 THEN 'acceptable' ELSE 'low' END AS grade,
 array_to_string(list_filter([CASE WHEN u / total < 0.7 THEN 'filter very frequent answers' END, CASE WHEN dup > total * 0.3 THEN 'measure the effect of repeats' END,
 CASE WHEN top > total * 0.05 THEN 'check frequent answers for artefacts' END], lambda x: x IS NOT NULL), '; ') AS advice FROM s""")

# --- versions ---------------------------------------------------------------------------------------

UNIQUE = "SELECT qa_id, answer, type FROM qa QUALIFY row_number() OVER (PARTITION BY answer ORDER BY qa_id) = 1"
MAX3 = "SELECT qa_id, answer, type FROM qa QUALIFY row_number() OVER (PARTITION BY lower(trim(answer)) ORDER BY qa_id) <= 3"
BALANCED = "SELECT qa_id, answer, type FROM qa WHERE type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type, lower(trim(answer)) ORDER BY qa_id) <= 2"
WEIGHTED = "SELECT qa_id, answer, type, 1.0::DOUBLE / count(*) OVER (PARTITION BY lower(trim(answer))) AS weight FROM qa"
register("version_unique", lambda s, d: an.version_unique(views.qa(s, d)).select("qa_id", "answer", "type"), f"WITH {QA} {UNIQUE}")
register("version_capped", lambda s, d: an.version_capped(views.qa(s, d)).select("qa_id", "answer", "type"), f"WITH {QA} {MAX3}")
register("answer_frequency", lambda s, d: an.with_answer_frequency(views.qa(s, d)).select("qa_id", "frequency"),
         f"WITH {QA} SELECT qa_id, count(*) OVER (PARTITION BY lower(trim(answer))) AS frequency FROM qa")
register("version_weighted", lambda s, d: an.version_weighted(views.qa(s, d)).select("qa_id", "answer", "type", "weight"),
         f"WITH {QA}, w AS ({WEIGHTED}) SELECT qa_id, answer, type, round(weight, 6) AS weight FROM w")
register("weight_range", lambda s, d: an.weight_range(views.qa(s, d)), f"WITH {QA}, w AS ({WEIGHTED}) SELECT round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight FROM w")
register("version_balanced", lambda s, d: an.version_balanced(views.qa(s, d)).select("qa_id", "answer", "type"), f"WITH {QA} {BALANCED}")
register("balanced_share", lambda s, d: an.balanced_share(views.qa(s, d)), f"""
WITH {QA}, b AS ({BALANCED}), n AS (SELECT type, count(*) AS n_before FROM qa GROUP BY 1), m AS (SELECT type, count(*) AS n_after FROM b GROUP BY 1)
SELECT type, n_before, n_after, round(100.0::DOUBLE * n_after / n_before, 6) AS kept_pct FROM n JOIN m USING (type)""")
register("kish_effective_size", lambda s, d: an.kish_effective_size(an.version_weighted(views.qa(s, d))),
         f"WITH {QA}, w AS ({WEIGHTED}) SELECT round(pow(sum(weight), 2) / sum(weight * weight), 6) AS effective_size FROM w")
register("version_comparison", lambda s, d: an.version_comparison(views.qa(s, d)), f"""
WITH {QA}, u AS ({UNIQUE}), m AS ({MAX3}), w AS ({WEIGHTED}), b AS ({BALANCED}),
v AS (SELECT 'unique' AS version, answer, 1.0::DOUBLE AS w FROM u UNION ALL SELECT 'max3', answer, 1.0 FROM m UNION ALL SELECT 'weighted', answer, weight FROM w UNION ALL SELECT 'balanced', answer, 1.0 FROM b)
SELECT version, count(*) AS size, count(DISTINCT answer) AS unique_answers, round(count(DISTINCT answer) / (pow(sum(w), 2) / sum(w * w)), 6) AS diversity,
 round((1 - count(*) / (SELECT count(*) FROM qa)) * 100, 6) AS reduction_pct FROM v GROUP BY 1""")

# --- most frequent answers --------------------------------------------------------------------------


def top_rows(k: int) -> str:
    return f"""{COUNTS}, top AS (SELECT * FROM ac ORDER BY cnt DESC, answer_key LIMIT {k}),
rows_ AS (SELECT qa.*, top.answer_key, cnt FROM qa JOIN top ON lower(trim(answer)) = answer_key),
words_ AS (SELECT answer_key, cnt, word, count(*) AS freq FROM (SELECT answer_key, cnt, unnest({tokens('lower(questions)')}) AS word FROM rows_) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY answer_key ORDER BY freq DESC, word) AS r FROM words_ WHERE length(word) >= 4)"""


register("rows_of_top_answers", lambda s, d: an.rows_of_top_answers(views.qa(s, d), 5).select("qa_id", "answer_key", "cnt"),
         f"WITH {top_rows(5)} SELECT qa_id, answer_key, cnt FROM rows_")
register("group_profile", lambda s, d: an.group_profile(views.qa(s, d)), f"""
WITH {top_rows(6)}, b AS (SELECT answer_key, min_by(answer, qa_id) AS answer, count(*) AS n, avg(length(questions)) AS l FROM rows_ GROUP BY 1),
v AS (SELECT answer_key, count(*) AS vocabulary FROM words_ GROUP BY 1), c AS (SELECT answer_key, string_agg(word || '(' || freq || ')', ', ' ORDER BY r) AS common_words FROM ranked WHERE r <= 3 GROUP BY 1)
SELECT answer, n, round(l, 6) AS mean_question_length, vocabulary, common_words, round(100.0::DOUBLE * n / (SELECT count(*) FROM qa), 6) AS share_pct FROM b LEFT JOIN v USING (answer_key) LEFT JOIN c USING (answer_key)""")
register("group_types", lambda s, d: an.group_types(views.qa(s, d)), f"WITH {top_rows(6)} SELECT answer_key, type, count(*) AS n FROM rows_ GROUP BY 1, 2")
register("recurrent_words", lambda s, d: an.recurrent_words(views.qa(s, d).withColumn("answer", F.element_at(F.split("questions", " "), -1))), f"""
WITH {QA}, q2 AS (SELECT qa_id, questions, list_last(string_split(questions, ' ')) AS answer FROM qa), ac AS (SELECT answer AS answer_key, count(*) AS cnt FROM q2 GROUP BY 1),
top AS (SELECT * FROM ac ORDER BY cnt DESC, answer_key LIMIT 6),
w AS (SELECT answer_key, cnt, word, count(*) AS freq FROM (SELECT answer_key, cnt, unnest(list_distinct({tokens('lower(questions)')})) AS word FROM q2 JOIN top ON answer = answer_key WHERE cnt >= 3) WHERE length(word) > 3 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY answer_key ORDER BY freq DESC, word) AS r FROM w WHERE freq > cnt * 0.5 AND freq >= 2)
SELECT answer_key, string_agg(word, ', ' ORDER BY r) AS patterns FROM k WHERE r <= 3 GROUP BY 1""")
register("key_words", lambda s, d: an.key_words(views.qa(s, d).withColumn("answer", F.element_at(F.split("questions", " "), -1))), f"""
WITH {QA}, q2 AS (SELECT qa_id, questions, list_last(string_split(questions, ' ')) AS answer FROM qa), ac AS (SELECT answer AS answer_key, count(*) AS cnt FROM q2 GROUP BY 1),
top AS (SELECT * FROM ac ORDER BY cnt DESC, answer_key LIMIT 4),
w AS (SELECT answer_key, cnt, word, count(*) AS freq FROM (SELECT answer_key, cnt, unnest({tokens('lower(questions)')}) AS word FROM q2 JOIN top ON answer = answer_key) WHERE length(word) > 3 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY answer_key ORDER BY freq DESC, word) AS r FROM w)
SELECT answer_key, string_agg(word, ', ' ORDER BY r) AS key_words FROM k WHERE r <= 3 AND freq >= greatest(2.0, cnt * 0.3) GROUP BY 1""")


def shown(k: int) -> str:
    return f"{top_rows(k)}, shown AS (SELECT answer_key, min_by(answer, qa_id) AS answer FROM rows_ GROUP BY 1)"


register("theme_flags", lambda s, d: an.theme_flags(views.qa(s, d)), f"WITH {shown(10)} " + " UNION ALL ".join(
    f"SELECT '{t}' AS theme, count(*) FILTER ({any_of('answer', w)}) AS n_answers, count(*) FILTER ({any_of('answer', w)}) >= 3 AS detected FROM shown"
    for t, w in fv.THEME_WORDS.items()) + r""" UNION ALL SELECT 'numeric', count(*) FILTER (regexp_full_match(translate(answer, ',.', ''), '\d+')),
 count(*) FILTER (regexp_full_match(translate(answer, ',.', ''), '\d+')) >= 1 FROM shown""")
register("coherence_flags", lambda s, d: an.coherence_flags(views.qa(s, d)), f"WITH {shown(6)} " + " UNION ALL ".join(
    f"SELECT '{t}' AS field, count(*) FILTER ({any_of('answer', w)}) AS n_answers, count(*) FILTER ({any_of('answer', w)}) >= count(*) * {share} AS coherent FROM shown"
    for t, (w, share) in fv.COHERENCE_WORDS.items()))
register("top5_concentration", lambda s, d: an.top5_concentration(views.qa(s, d)), f"""
WITH {COUNTS}, t AS (SELECT 100.0::DOUBLE * sum(cnt) / (SELECT count(*) FROM qa) AS p FROM (SELECT cnt FROM ac ORDER BY cnt DESC, answer_key LIMIT 5))
SELECT round(p, 6) AS top5_pct, CASE WHEN p > 50 THEN 'strong' WHEN p > 30 THEN 'moderate' ELSE 'acceptable' END AS level FROM t""")
register("question_uniqueness", lambda s, d: an.question_uniqueness(views.qa(s, d)), f"""
WITH {QA}, t AS (SELECT count(DISTINCT questions) AS u, count(DISTINCT questions) / count(*) AS p FROM qa)
SELECT u AS unique_questions, round(p, 6) AS uniqueness, CASE WHEN p > 0.95 THEN 'varied' WHEN p > 0.8 THEN 'moderate' ELSE 'repetitive' END AS level FROM t""")
register("group_length_table", lambda s, d: an.group_length_table(views.qa(s, d)), f"""
WITH {top_rows(4)}, v AS (SELECT answer_key, count(*) AS unique_words FROM words_ GROUP BY 1)
SELECT min_by(answer, qa_id) AS answer, count(*) AS n, round(avg(length(questions)), 6) AS mean_length, CAST(min(length(questions)) AS INTEGER) AS min_length,
 CAST(max(length(questions)) AS INTEGER) AS max_length, any_value(unique_words) AS unique_words, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM qa), 6) AS share_pct
FROM rows_ JOIN v USING (answer_key) GROUP BY answer_key""")
register("sampled_question_lengths", lambda s, d: an.sampled_question_lengths(views.qa(s, d)), f"""
WITH {top_rows(4)}, k AS (SELECT answer_key, qa_id, questions FROM rows_ QUALIFY row_number() OVER (PARTITION BY answer_key ORDER BY md5(qa_id || '-42'), qa_id) <= 8)
SELECT answer_key, qa_id, CASE WHEN length(questions) > 37 THEN left(questions, 37) || '...' ELSE questions END AS shown, CAST(length(questions) AS INTEGER) AS length,
 round(avg(length(questions)) OVER (PARTITION BY answer_key), 6) AS mean_length FROM k""")
register("lexical_diversity_by_group", lambda s, d: an.lexical_diversity_by_group(views.qa(s, d)), f"""
WITH {top_rows(4)}, t AS (SELECT answer_key, count(*) / sum(freq) AS x FROM words_ GROUP BY 1)
SELECT answer_key, round(x, 6) AS lexical_diversity, CAST(rank() OVER (ORDER BY x DESC) AS INTEGER) AS rank,
 CASE WHEN avg(x) OVER () > 0.7 THEN 'excellent' WHEN avg(x) OVER () > 0.5 THEN 'good' ELSE 'limited' END AS overall FROM t""")

CURVE = f"{COUNTS}, f AS (SELECT cnt, count(*) AS a FROM ac GROUP BY 1)"
register("cumulative_coverage", lambda s, d: an.cumulative_coverage(views.qa(s, d)), f"""
WITH {CURVE} SELECT cnt, CAST(sum(a) OVER w AS BIGINT) AS n_distinct, round(sum(cnt * a) OVER w / sum(cnt * a) OVER (), 6) AS coverage FROM f WINDOW w AS (ORDER BY cnt DESC)""")
register("lorenz_curve", lambda s, d: an.lorenz_curve(views.qa(s, d)), f"""
WITH {CURVE} SELECT cnt, a AS n_answers, round(sum(a) OVER w / sum(a) OVER (), 6) AS x, round(sum(cnt * a) OVER w / sum(cnt * a) OVER (), 6) AS y, CAST(sum(a) OVER () AS BIGINT) AS n FROM f WINDOW w AS (ORDER BY cnt)""")
register("gini", lambda s, d: an.gini(views.qa(s, d)), f"""
WITH {COUNTS}, p AS (SELECT row_number() OVER (ORDER BY cnt, answer_key) / count(*) OVER () AS x, sum(cnt) OVER (ORDER BY cnt, answer_key) / sum(cnt) OVER () AS y FROM ac),
l AS (SELECT x, y, lag(x) OVER (ORDER BY x) AS x0, lag(y) OVER (ORDER BY x) AS y0 FROM p)
SELECT round(sum((x - x0) * ((x - y) + (x0 - y0))), 6) AS gini_trapz, round(sum((x - coalesce(x0, 0)) * ((x - y) + (coalesce(x0, 0) - coalesce(y0, 0)))), 6) AS gini FROM l""")
register("type_shares", lambda s, d: an.type_shares(views.qa(s, d)), f"""
WITH {QA} SELECT type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM qa), 6) AS share_pct, round(avg(length(questions)), 6) AS mean_question_length,
 round(avg(length(answer)), 6) AS mean_answer_length FROM qa GROUP BY 1""")
