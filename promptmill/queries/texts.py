"""Text expressions, flags, scores, hashes and requests, row by row over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixedvalues as fv
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import profile, semantic
from ..plans import generate as gen
from ..sources import views
from .registry import PROMPTS, QA, QA_TEXT, any_of, norm, register, tokens, windows, words

register("clean_output", lambda s, d: views.prompts(s, d).select(
    "row_id", F.md5(tx.clean_output("prompt")).alias("cleaned"), F.length(tx.clean_output("prompt")).alias("length")), rf"""
WITH {PROMPTS}, a AS (SELECT row_id, regexp_replace(prompt, '^\s+|\s+$', '', 'g') AS t FROM prompts),
b AS (SELECT row_id, regexp_replace(t, '^[`"'' \n]+|[`"'' \n]+$', '', 'g') AS t FROM a),
c AS (SELECT row_id, regexp_replace(regexp_replace(t, '^\s*[\-*\d.)]\s+', ''), '(?i)^prompt\s*:\s*', '') AS t FROM b),
e AS (SELECT row_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM c)
SELECT row_id, md5(t) AS cleaned, CAST(length(t) AS INTEGER) AS length FROM e""")

register("text_keys", lambda s, d: views.prompts(s, d).select(
    "row_id", tx.text_signature("prompt").alias("signature"), F.md5(tx.trim_key("prompt")).alias("trim_key"),
    F.md5(tx.norm_simple("prompt")).alias("simple_key")), rf"""
WITH {PROMPTS} SELECT row_id, md5({norm('prompt')}) AS signature,
 md5(lower(regexp_replace(prompt, '^\s+|\s+$', '', 'g'))) AS trim_key,
 md5(regexp_replace(translate(lower(prompt), '{fv.PUNCTUATION.replace("'", "''")}', ''), '^\s+|\s+$', '', 'g')) AS simple_key
FROM prompts""")

register("answer_keys", lambda s, d: views.qa(s, d).select("qa_id", tx.trim_key("answer").alias("answer_key")),
         f"WITH {QA} SELECT qa_id, lower(trim(answer)) AS answer_key FROM qa")

register("word_shingles", lambda s, d: views.dealt_prompts(s, d).withColumn("g", tx.word_shingles("prompt", 3)).select(
    "row_id", F.size("g").alias("n"), F.md5(F.array_join("g", "|")).alias("joined")), rf"""
WITH {PROMPTS}, t AS (SELECT row_id, {tokens('lower(prompt)')} AS t FROM prompts),
g AS (SELECT row_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE {windows('t', 3)} END AS g FROM t)
SELECT row_id, CAST(len(g) AS INTEGER) AS n, md5(coalesce(array_to_string(g, '|'), '')) AS joined FROM g""")

register("char_shingles", lambda s, d: views.dealt_prompts(s, d).select(
    "row_id", F.size(tx.char_shingles(tx.norm_simple("prompt"), 5)).alias("n")), rf"""
WITH {PROMPTS}, s AS (SELECT row_id, regexp_replace(translate(lower(prompt), '{fv.PUNCTUATION.replace("'", "''")}', ''), '^\s+|\s+$', '', 'g') AS t FROM prompts),
g AS (SELECT row_id, substr(t, unnest(range(1, greatest(length(t) - 4, 1) + 1)), 5) AS g FROM s)
SELECT row_id, CAST(count(DISTINCT g) AS INTEGER) AS n FROM g GROUP BY row_id""")

register("ngram_lists", lambda s, d: views.dealt_prompts(s, d).withColumn("g", tx.ngrams("prompt", 2)).select(
    "row_id", F.size("g").alias("n"), F.md5(F.array_join("g", "|")).alias("joined")), rf"""
WITH {PROMPTS}, t AS (SELECT row_id, {tokens('prompt')} AS t FROM prompts),
g AS (SELECT row_id, CASE WHEN len(t) < 2 THEN [] ELSE {windows('t', 2)} END AS g FROM t)
SELECT row_id, CAST(len(g) AS INTEGER) AS n, md5(coalesce(array_to_string(g, '|'), '')) AS joined FROM g""")

register("token_lists", lambda s, d: views.dealt_prompts(s, d).select(
    "row_id", F.length("prompt").alias("n_chars"), tx.n_words("prompt").alias("n_tokens"),
    F.md5(F.array_join(tx.ws_tokens("prompt"), " ")).alias("tokens"),
    F.size(tx.word_tokens("prompt")).alias("n_words"), F.md5(F.array_join(tx.word_tokens("prompt"), " ")).alias("words")), rf"""
WITH {PROMPTS}, t AS (SELECT row_id, length(prompt) AS c, {tokens('prompt')} AS t, {words('prompt')} AS w FROM prompts)
SELECT row_id, CAST(c AS INTEGER) AS n_chars, CAST(len(t) AS INTEGER) AS n_tokens, md5(coalesce(array_to_string(t, ' '), '')) AS tokens,
 CAST(len(w) AS INTEGER) AS n_words, md5(coalesce(array_to_string(w, ' '), '')) AS words FROM t""")

register("script_languages", lambda s, d: views.prompts(s, d).groupBy(tx.script_language("prompt").alias("language")).agg(
    F.count("*").alias("n")), rf"""
WITH {PROMPTS} SELECT CASE WHEN prompt IS NULL THEN 'unk' WHEN regexp_matches(prompt, '[\x{{4e00}}-\x{{9fff}}]') THEN 'CN'
 WHEN regexp_matches(lower(prompt), '{fv.ACCENT_PATTERN}') THEN 'FR' ELSE 'EN' END AS language, count(*) AS n FROM prompts GROUP BY 1""")

register("entity_counts", lambda s, d: views.prompts(s, d).select(
    "row_id", tx.n_entities("prompt").alias("entities"), tx.n_dates("prompt").alias("dates"), tx.n_numbers("prompt").alias("numbers")), rf"""
WITH {PROMPTS}, w AS (SELECT row_id, prompt, list_filter(regexp_extract_all(prompt, '[\p{{L}}\p{{N}}_]+'),
  lambda x: regexp_full_match(x, '[A-Z][a-z]+')) AS e FROM prompts)
SELECT row_id, CAST(len(list_distinct(e)) AS INTEGER) AS entities,
 CAST(len(regexp_extract_all(prompt, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b\d{{4}}\b')) AS INTEGER) AS dates,
 CAST(len(regexp_extract_all(prompt, '\b\d+\b')) AS INTEGER) AS numbers FROM w""")

register("content_flags", lambda s, d: views.prompts(s, d).select(
    "row_id", tx.is_factual("prompt").alias("factual"), tx.is_creative("prompt").alias("creative"),
    tx.is_instruction("prompt").alias("instruction"), tx.is_question("prompt").alias("question"),
    tx.is_triplet_friendly("prompt").alias("triplet")), f"""
WITH {PROMPTS} SELECT row_id, {any_of('prompt', fv.FACTUAL_WORDS)} AS factual, {any_of('prompt', fv.CREATIVE_WORDS)} AS creative,
 {any_of('prompt', fv.INSTRUCTION_WORDS)} AS instruction, contains(prompt, '?') AS question,
 {any_of('prompt', fv.TRIPLET_WORDS)} AS triplet FROM prompts""")

PROMPT_SCORE = rf"""CAST(CASE WHEN length(prompt) BETWEEN 50 AND 300 THEN 2 WHEN length(prompt) > 300 THEN 1 ELSE 0 END
 + CASE WHEN {any_of('prompt', fv.PROMPT_SCORE_WORDS)} THEN 2 ELSE 0 END
 + least(len(list_filter(regexp_extract_all(prompt, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))), 2)
 + CASE WHEN contains(prompt, '?') THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 3 ELSE 0 END
 + CASE WHEN dataset IS NOT NULL THEN 2 ELSE 0 END AS INTEGER)"""
LABELLED = f"""{PROMPTS}, labelled AS (SELECT p.*, l.quality FROM prompts p LEFT JOIN labels l ON l.doc_id = p.row_id)"""


def labelled(spark, folder):
    """Prompts with the annotation that some of them have."""
    marks = views.table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return views.prompts(spark, folder).join(marks, "row_id", "left")


register("prompt_scores", lambda s, d: labelled(s, d).select(
    "row_id", tx.prompt_score("prompt", ["quality"], ["dataset"]).alias("score")),
    f"WITH {LABELLED} SELECT row_id, {PROMPT_SCORE} AS score FROM labelled")

QA_SCORE = f"""CAST(CASE WHEN length(questions) BETWEEN 50 AND 150 THEN 2 WHEN length(questions) <= 200 THEN 1 ELSE 0 END
 + CASE WHEN {any_of('questions', fv.QA_SCORE_WORDS)} THEN 3 ELSE 0 END + CASE WHEN length(answer) <= 50 THEN 2 ELSE 0 END
 + CASE WHEN type IN ('name', 'numeric') THEN 2 ELSE 0 END
 + CASE WHEN {any_of('questions', fv.QA_BONUS_WORDS)} THEN 1 ELSE 0 END AS INTEGER)"""

register("qa_scores", lambda s, d: views.qa_text(s, d).withColumn("type", F.when(F.col("qa_id") % 3 == 0, "name").when(
    F.col("qa_id") % 3 == 1, "numeric").otherwise("user")).select("qa_id", tx.qa_score("questions", "answer", "type").alias("score")),
    f"""WITH {QA_TEXT}, typed AS (SELECT * REPLACE (CASE qa_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'numeric' ELSE 'user' END AS type) FROM qa_text)
SELECT qa_id, {QA_SCORE} AS score FROM typed""")

register("prompt_annotations", lambda s, d: views.prompts(s, d).select(
    "row_id", tx.prompt_kind("prompt").alias("kind"), tx.factual_potential("prompt").alias("potential"),
    F.array_join(F.slice(tx.entities("prompt"), 1, 3), ",").alias("entities"),
    F.array_join(tx.indicators_found("prompt"), ",").alias("indicators")), rf"""
WITH {PROMPTS}, w AS (SELECT row_id, prompt, list_filter(regexp_extract_all(prompt, '[\p{{L}}\p{{N}}_]+'),
  lambda x: regexp_full_match(x, '[A-Z][a-z]+')) AS e FROM prompts)
SELECT row_id, CASE WHEN contains(prompt, '?') THEN 'Question' WHEN {any_of('prompt', fv.KIND_INSTRUCTION_WORDS)} THEN 'Instruction'
  ELSE 'Affirmation' END AS kind, CASE WHEN {any_of('prompt', fv.FACTUAL_POTENTIAL_WORDS)} THEN 'High' ELSE 'Moderate' END AS potential,
 coalesce(array_to_string(e[1:3], ','), '') AS entities,
 coalesce(array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(prompt), '{k}') THEN '{k}' END" for k in fv.QA_INDICATOR_WORDS)}],
   lambda x: x IS NOT NULL), ','), '') AS indicators FROM w""")

register("answer_verifiability", lambda s, d: views.qa(s, d).select(
    "qa_id", F.when(tx.is_numeric_text("answer"), "numeric").otherwise("name").alias("kind")).withColumn(
    "verifiable", tx.verifiability("kind")), rf"""
WITH {QA} SELECT qa_id, kind, CASE kind WHEN 'name' THEN 'named entity' WHEN 'numeric' THEN 'numeric value' END AS verifiable FROM
 (SELECT qa_id, CASE WHEN regexp_full_match(translate(answer, ',.', ''), '\d+') THEN 'numeric' ELSE 'name' END AS kind FROM qa)""")

register("ellipsized_texts", lambda s, d: views.prompts(s, d).select("row_id", tx.ellipsize("prompt", 50).alias("shown")),
         f"WITH {PROMPTS} SELECT row_id, CASE WHEN length(prompt) > 50 THEN left(prompt, 50) || '...' ELSE prompt END AS shown FROM prompts")

register("numeric_answers", lambda s, d: views.table(s, d, "orders").select(
    "o_orderkey", F.format_number("o_totalprice", 2).alias("shown")).select(
    "o_orderkey", tx.is_numeric_text("shown").alias("numeric_price"),
    tx.is_numeric_text(F.concat(F.lit("#"), F.col("o_orderkey").cast("string"))).alias("numeric_label")), r"""
SELECT o_orderkey, true AS numeric_price, regexp_full_match('#' || o_orderkey, '\d+') AS numeric_label FROM orders""")

register("denormalised_scores", lambda s, d: views.prompts(s, d).select(
    "row_id", tx.denormalise("intent_cont", F.lit(fv.DEFAULT_LABEL_MEAN), F.lit(fv.DEFAULT_LABEL_STD)).alias("score")),
    f"WITH {PROMPTS} SELECT row_id, round(intent_cont * 200.0::DOUBLE + 1500.0::DOUBLE, 6) AS score FROM prompts")


def digest_bytes(column: str) -> str:
    nibble = lambda at: f"(strpos('0123456789abcdef', substr(sha256({column}), {at}, 1)) - 1)"
    return f"list_transform(range(32), lambda i: CAST({nibble('2 * i + 1')} * 16 + {nibble('2 * i + 2')} AS DOUBLE))"


register("pair_similarity", lambda s, d: semantic.pair_similarity(views.qa_text(s, d), "questions", "answer").select("qa_id", "cosine"), f"""
WITH {QA_TEXT}, v AS (SELECT qa_id, {digest_bytes('questions')} AS a, {digest_bytes('answer')} AS b FROM qa_text)
SELECT qa_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS cosine FROM v""")

register("similarity_band", lambda s, d: semantic.similarity_band(
    semantic.pair_similarity(views.qa_text(s, d), "questions", "answer"), 0.72, 0.95).select("qa_id", "cosine"), f"""
WITH {QA_TEXT}, v AS (SELECT qa_id, {digest_bytes('questions')} AS a, {digest_bytes('answer')} AS b FROM qa_text),
c AS (SELECT qa_id, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS cosine FROM v)
SELECT qa_id, round(cosine, 6) AS cosine FROM c WHERE cosine BETWEEN 0.72 AND 0.95""")

register("mean_pair_similarity", lambda s, d: (lambda pairs: semantic.mean_pair_similarity(
    semantic.similarity_band(pairs, 0.82, 0.95), pairs))(semantic.pair_similarity(views.qa_text(s, d), "questions", "answer")), f"""
WITH {QA_TEXT}, v AS (SELECT qa_id, {digest_bytes('questions')} AS a, {digest_bytes('answer')} AS b FROM qa_text),
c AS (SELECT qa_id, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS cosine FROM v)
SELECT round(coalesce((SELECT avg(cosine) FROM c WHERE cosine BETWEEN 0.82 AND 0.95), (SELECT avg(cosine) FROM c), 1.0), 6) AS mean_similarity""")

register("hash_embedding", lambda s, d: semantic.embed(views.dealt_prompts(s, d), "prompt").select(
    "row_id", F.size("embedding").alias("dim"), vec.norm("embedding").alias("length"),
    F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.round(F.col("embedding")[383].cast("double"), 5).alias("last")), f"""
WITH {PROMPTS}, v AS (SELECT row_id, {digest_bytes('prompt')} AS b FROM prompts)
SELECT row_id, CAST(384 AS INTEGER) AS dim, CAST(1.0 AS DOUBLE) AS length, round(CAST(b[1] / sqrt(12 * list_dot_product(b, b)) AS FLOAT)::DOUBLE, 5) AS first,
 round(CAST(b[32] / sqrt(12 * list_dot_product(b, b)) AS FLOAT)::DOUBLE, 5) AS last FROM v""")

register("vector_lengths", lambda s, d: views.vectors(s, d).select("vec_id", vec.dot("embedding", "embedding").alias("square")), """
SELECT vec_id, round(list_dot_product(e, e), 6) AS square FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""")

register("generation_requests", lambda s, d: views.prompts(s, d).withColumn(
    "p", gen.build_request("paraphrase", F.col("prompt"))).withColumn("c", gen.build_request("conditional", label=F.col("intent_disc"))).select(
    "row_id", F.md5(F.col("p")[1]["content"]).alias("paraphrase"), F.col("p")[0]["role"].alias("first_role"),
    F.col("c")[1]["content"].alias("conditional")), rf"""
WITH {PROMPTS} SELECT row_id, md5('Text: ' || prompt || chr(10) || 'Stay close in meaning (cosine of at least 0.82).') AS paraphrase,
 'system' AS first_role, 'Class: ' || intent_disc || chr(10) || 'One line, no list.' AS conditional FROM prompts""")

register("parsed_responses", lambda s, d: views.prompts(s, d).select("row_id", F.to_json(F.struct(
    F.array(F.struct(F.struct(F.col("prompt").alias("content")).alias("message"))).alias("choices"),
    F.struct(F.length("prompt").alias("prompt_tokens"), F.lit(7).alias("completion_tokens"),
             (F.length("prompt") + 7).alias("total_tokens")).alias("usage"))).alias("body")).select(
    "row_id", gen.parse_response("body").alias("r")).select(
    "row_id", F.md5("r.text").alias("text"), "r.prompt_tokens", "r.completion_tokens", "r.total_tokens"), f"""
WITH {PROMPTS} SELECT row_id, md5(prompt) AS text, length(prompt) AS prompt_tokens, CAST(7 AS BIGINT) AS completion_tokens,
 length(prompt) + 7 AS total_tokens FROM prompts""")

register("language_quality", lambda s, d: gen.language_quality(views.prompts(s, d), "prompt", ["damn", "hell"]).agg(
    F.count_if("has_blocked").alias("blocked"), F.count_if("has_stutter").alias("stutter"), F.count_if("no_letters").alias("no_letters"),
    F.count_if("usable").alias("usable")), rf"""
WITH {PROMPTS}, t AS (SELECT prompt, regexp_split_to_array(lower(prompt), '[^\p{{L}}\p{{N}}_]+') AS w, regexp_extract_all(lower(prompt), '[\p{{L}}\p{{N}}_]+|\s+|[^\p{{L}}\p{{N}}_\s]+') AS p FROM prompts),
f AS (SELECT len(list_filter(w, lambda x: x IN ('damn', 'hell'))) > 0 AS b, NOT regexp_matches(prompt, '\p{{L}}') AS n,
 len(list_filter(range(1, len(p) - 1), lambda i: p[i] = p[i + 2] AND regexp_full_match(p[i + 1], '\s+') AND regexp_full_match(p[i], '[\p{{L}}\p{{N}}_]+'))) > 0 AS s FROM t)
SELECT count(*) FILTER (b) AS blocked, count(*) FILTER (s) AS stutter, count(*) FILTER (n) AS no_letters, count(*) FILTER (NOT (b OR s OR n)) AS usable FROM f""")

register("length_points", lambda s, d: profile.scatter_points(
    views.qa(s, d), F.length("questions"), F.length("answer"), "qa_id"),
    f"WITH {QA} SELECT qa_id, CAST(length(questions) AS INTEGER) AS x, CAST(length(answer) AS INTEGER) AS y FROM qa")

register("score_points", lambda s, d: profile.scatter_points(
    views.prompts(s, d), F.length("prompt"), F.col("intent_cont"), "row_id"),
    f"WITH {PROMPTS} SELECT row_id, CAST(length(prompt) AS INTEGER) AS x, round(intent_cont, 6) AS y FROM prompts")
