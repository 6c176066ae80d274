"""De-duplication, near-duplicates, fuzzy matches, vectors, topics, language, and the balancing flow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixedvalues as fv

from ..operators import dedup, fuzzy, language, lsh, scoring, semantic, stats, topics
from ..plans import balance
from ..plans import generate as gen
from ..session import scratch_root
from ..sources import readers, views, writers
from .registry import CORPUS, ORACLES, PROMPTS, QA_TEXT, norm, register, words
from .tables import L, R, sides
from .texts import digest_bytes

# --- exact de-duplication ---------------------------------------------------------------------------

register("dedup_exact_normalised", lambda s, d: dedup.dedup_exact_normalised(views.prompts(s, d), "prompt", "row_id").select("row_id"),
         f"WITH {PROMPTS} SELECT min(row_id) AS row_id FROM prompts GROUP BY {norm('prompt')}")
register("duplicate_ratio", lambda s, d: (lambda p: dedup.duplicate_ratio(p, dedup.dedup_exact_normalised(p, "prompt", "row_id")))(views.prompts(s, d)),
         f"WITH {PROMPTS} SELECT round(1 - count(DISTINCT {norm('prompt')}) / count(*), 6) AS duplicate_ratio FROM prompts")
register("anti_join_source", lambda s, d: dedup.anti_join_source(sides(s, d)[1], sides(s, d)[0], "prompt").select("row_id"), f"""
WITH {CORPUS} SELECT row_id FROM corpus WHERE source = 'augmented' AND {norm('prompt')} NOT IN (SELECT {norm('prompt')} FROM corpus WHERE source = 'mapped')""")
register("dedup_against", lambda s, d: dedup.dedup_against(sides(s, d)[1], sides(s, d)[0], "prompt", "row_id").select("row_id"), f"""
WITH {CORPUS} SELECT min(row_id) AS row_id FROM corpus WHERE source = 'augmented' AND {norm('prompt')} NOT IN (SELECT {norm('prompt')} FROM corpus WHERE source = 'mapped') GROUP BY {norm('prompt')}""")
register("combine", lambda s, d: dedup.combine(sides(s, d)[0], sides(s, d)[1]).select("row_id", "source"), rf"""
WITH {CORPUS} SELECT row_id, source FROM corpus QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(prompt, '^\s+|\s+$', '', 'g')) ORDER BY source DESC, row_id) = 1""")
register("drop_strict_duplicates", lambda s, d: dedup.drop_strict_duplicates(views.corpus(s, d), ["prompt", "source"], "row_id").select("row_id"),
         f"WITH {CORPUS} SELECT min(row_id) AS row_id FROM corpus GROUP BY prompt, source")
register("exact_dup_groups", lambda s, d: dedup.exact_dup_groups(views.prompts(s, d), ["prompt"]),
         f"WITH {PROMPTS} SELECT count(*) AS n, min(row_id) AS first_row FROM prompts GROUP BY prompt HAVING count(*) > 1 ORDER BY n DESC, first_row LIMIT 10")
register("exact_dup_summary", lambda s, d: dedup.exact_dup_summary(views.corpus(s, d), ["prompt"], "source"), f"""
WITH {CORPUS}, g AS (SELECT source, count(*) AS n FROM corpus GROUP BY source, prompt)
SELECT source, count(*) FILTER (n > 1) AS dup_groups, round(100.0::DOUBLE * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS rows_involved_pct FROM g GROUP BY 1""")
register("duplicated_pct", lambda s, d: dedup.duplicated_pct(views.corpus(s, d), ["prompt"], "source"),
         f"WITH {CORPUS} SELECT source, round(100.0::DOUBLE * (count(*) - count(DISTINCT prompt)) / count(*), 6) AS duplicated_pct FROM corpus GROUP BY 1")

# --- near-duplicates and fuzzy matches --------------------------------------------------------------

register("minhash_signatures", lambda s, d: lsh.with_signature(views.dealt_prompts(s, d), "prompt").select(
    "row_id", F.size("signature").alias("n"), F.md5(F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")).alias("signature")))
register("dedup_near", lambda s, d: lsh.dedup_near(views.dealt_prompts(s, d), "row_id", "prompt").select("row_id"))
register("near_duplicate_clusters", lambda s, d: lsh.near_duplicate_clusters(views.dealt_prompts(s, d), "row_id", "prompt"))
register("first_match", lambda s, d: lsh.first_match(sides(s, d)[1], sides(s, d)[0], "row_id", "prompt"))
register("fuzzy_pairs", lambda s, d: fuzzy.fuzzy_pairs(views.prompts(s, d)))
register("top_fuzzy_pairs", lambda s, d: fuzzy.top_pairs(fuzzy.fuzzy_pairs(views.prompts(s, d))))
register("near_duplicate_links", lambda s, d: fuzzy.fuzzy_star_pairs(views.prompts(s, d)))
register("cross_source_matches", lambda s, d: fuzzy.cross_source_matches(*sides(s, d)))

# --- vectors ----------------------------------------------------------------------------------------


def parity(spark, folder):
    return views.vectors(spark, folder).withColumn("source", F.when(F.col("vec_id") % 2 == 0, L).otherwise(R))


VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, CASE WHEN vec_id % 2 = 0 THEN 'mapped' ELSE 'augmented' END AS source FROM embeddings)"
DIMS = f"{VECTORS}, u AS (SELECT vec_id, label, source, unnest(e) AS x, unnest(range(len(e))) AS i FROM v)"
register("mean_pairwise_cosine", lambda s, d: semantic.mean_pairwise(parity(s, d), "embedding", 64, ["source"]), f"""
WITH {DIMS}, s AS (SELECT source, i, sum(x) AS t FROM u GROUP BY 1, 2), n AS (SELECT source, count(*) AS n FROM v GROUP BY 1)
SELECT source, any_value(n) AS n, round((sum(t * t) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS mean_cosine FROM s JOIN n USING (source) GROUP BY 1""")
register("mean_cross_cosine", lambda s, d: semantic.mean_cross(parity(s, d), "embedding", 64, "source", L, R), f"""
WITH {DIMS}, m AS (SELECT i, avg(x) FILTER (source = 'mapped') AS l, avg(x) FILTER (source = 'augmented') AS r FROM u GROUP BY 1) SELECT round(sum(l * r), 6) AS mean_cosine FROM m""")
register("semantic_summary", lambda s, d: semantic.semantic_summary(parity(s, d), "embedding", 64, "source", L, R), f"""
WITH {DIMS}, s AS (SELECT source, i, sum(x) AS t, avg(x) AS m FROM u GROUP BY 1, 2), n AS (SELECT source, count(*) AS n FROM v GROUP BY 1),
p AS (SELECT sum(m) FILTER (source = 'mapped') * sum(m) FILTER (source = 'augmented') AS x FROM s GROUP BY i)
SELECT CASE source WHEN 'mapped' THEN 'mean_intra_left' ELSE 'mean_intra_right' END AS metric, round((sum(t * t) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS mean_cosine,
 CAST(any_value(n) * (any_value(n) - 1) // 2 AS BIGINT) AS n_pairs FROM s JOIN n USING (source) GROUP BY source
UNION ALL SELECT 'mean_inter', round(sum(x), 6), (SELECT CAST(product(n) AS BIGINT) FROM n) FROM p""")


def unit_draw(*parts: str) -> str:
    """The number in [0, 1) that ``sampling.uniform`` makes of the parts."""
    return f"CAST(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


register("random_pairs", lambda s, d: semantic.random_pairs(views.vectors(s, d), "embedding", "vec_id"), f"""
WITH {VECTORS}, p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, e FROM v), n AS (SELECT count(*) AS n FROM v),
r AS (SELECT unnest(range((SELECT least(n, 1000) FROM n))) AS draw),
d AS (SELECT draw, floor({unit_draw("'pair'", "'42'", "'i'", "draw::VARCHAR")} * (SELECT n FROM n)) AS i, floor({unit_draw("'pair'", "'42'", "'j'", "draw::VARCHAR")} * (SELECT n FROM n)) AS j FROM r)
SELECT draw, round(list_dot_product(a.e, b.e), 6) AS cosine FROM d JOIN p a ON a.pos = i JOIN p b ON b.pos = j WHERE i <> j""")
register("modulo_pairs", lambda s, d: semantic.modulo_pairs(
    parity(s, d).where(F.col("source") == L), parity(s, d).where(F.col("source") == R), "embedding", "vec_id"), f"""
WITH {VECTORS}, a AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, e FROM v WHERE source = 'mapped'),
b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS j, e AS f FROM v WHERE source = 'augmented')
SELECT pos, round(list_dot_product(e, f), 6) AS cosine FROM a JOIN b ON a.pos % (SELECT count(*) FROM b) = b.j WHERE pos < 1000""")
register("projection", lambda s, d: topics.document_map(views.vectors(s, d), "vec_id", "embedding"))
register("embedding_clusters", lambda s, d: semantic.cluster_embeddings(views.vectors(s, d), "embedding", 10).select("vec_id", "cluster"))


def label_centres(spark, folder):
    """The mean vector of each label, a handful of rows."""
    rows = topics.topic_vectors(views.vectors(spark, folder), "label", "embedding", 64).orderBy("label").collect()
    return [r["centre"] for r in rows]


CENTRES = f"""{DIMS}, cm AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), cl AS (SELECT label, list(x ORDER BY i) AS c FROM cm GROUP BY 1),
o AS (SELECT row_number() OVER (ORDER BY label) - 1 AS topic, c FROM cl)"""
register("novelty_scores", lambda s, d: semantic.novelty_score(views.vectors(s, d), "embedding", "vec_id", label_centres(s, d)), f"""
WITH {CENTRES} SELECT vec_id, round(1 - max(list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c)))), 6) AS novelty FROM v CROSS JOIN o GROUP BY 1""")
register("cached_embeddings", lambda s, d: semantic.embed_with_cache(views.dealt_prompts(s, d), "prompt", semantic.embed_with_cache(
    sides(s, d)[0], "prompt", None)[1])[0].select("row_id", F.size("embedding").alias("dim"), *[
        F.round(F.col("embedding")[i].cast("double"), 5).alias(f"x{i}") for i in (0, 100, 383)]), f"""
WITH {PROMPTS}, v AS (SELECT row_id, {digest_bytes('prompt')} AS b FROM prompts)
SELECT row_id, CAST(384 AS INTEGER) AS dim, {', '.join(f"round(CAST(b[{i % 32 + 1}] / sqrt(12 * list_dot_product(b, b)) AS FLOAT)::DOUBLE, 5) AS x{i}" for i in (0, 100, 383))} FROM v""")

# --- topics (labels as given) -----------------------------------------------------------------------

register("topic_keywords", lambda s, d: topics.topic_keywords(views.dealt_prompts(s, d), ["intent_disc"], "prompt", fv.QUESTION_STOPWORDS).drop("n"), f"""
WITH {PROMPTS}, r AS (SELECT intent_disc, row_id, list_filter({words('prompt')}, lambda w: w NOT IN ({', '.join(repr(w) for w in fv.QUESTION_STOPWORDS)})) AS l FROM prompts),
t AS (SELECT intent_disc, row_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM r), w AS (SELECT intent_disc, t, lead(t) OVER (PARTITION BY row_id ORDER BY i) AS t2 FROM t),
c AS (SELECT intent_disc, term, count(*) AS n FROM (SELECT intent_disc, t AS term FROM w UNION ALL SELECT intent_disc, t || ' ' || t2 FROM w WHERE t2 IS NOT NULL) GROUP BY 1, 2),
f AS (SELECT term, sum(n) AS f FROM c GROUP BY 1 HAVING count(*) >= 2 ), k AS (SELECT c.*, f FROM c JOIN f USING (term)),
z AS (SELECT *, sum(n) OVER (PARTITION BY intent_disc) AS size FROM k), a AS (SELECT floor(avg(size)) AS a FROM (SELECT DISTINCT intent_disc, size FROM z)),
s AS (SELECT intent_disc, term, n / size * ln(1 + a / f) AS score FROM z, a)
SELECT intent_disc, term, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY intent_disc ORDER BY round(score, 9) DESC, term) AS r FROM s) WHERE r <= 10""")
LABELS = "t AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic FROM embeddings)"


def labelled_vectors(spark, folder):
    """Vectors with their label as topic; label 0 plays the outliers."""
    return views.vectors(spark, folder).withColumn("topic", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))


register("topic_sizes", lambda s, d: topics.topic_sizes(labelled_vectors(s, d), "topic"), f"""
WITH {LABELS} SELECT topic, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM t), 6) AS share_pct FROM t WHERE topic <> -1 GROUP BY 1 ORDER BY n DESC, topic LIMIT 20""")
register("topic_summary", lambda s, d: topics.topic_summary(labelled_vectors(s, d), "topic"), f"""
WITH {LABELS} SELECT count(DISTINCT topic) FILTER (topic <> -1) AS n_topics, count(*) AS n_rows, round(100.0::DOUBLE * count(*) FILTER (topic = -1) / count(*), 6) AS outlier_pct FROM t""")
register("topic_gini", lambda s, d: topics.topic_gini(labelled_vectors(s, d), "topic"), f"""
WITH {LABELS}, c AS (SELECT count(*) AS n FROM t WHERE topic <> -1 GROUP BY topic), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM c)
SELECT round(2.0::DOUBLE * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM r""")
register("topics_per_class", lambda s, d: topics.topics_per_class(views.corpus(s, d), "intent_disc", "source"),
         f"WITH {CORPUS} SELECT intent_disc, source, count(*) AS n FROM corpus GROUP BY 1, 2")
register("topic_examples", lambda s, d: topics.topic_examples(views.prompts(s, d), "intent_disc", "row_id", "prompt"), f"""
WITH {PROMPTS} SELECT intent_disc, row_id, CASE WHEN length(prompt) > 80 THEN left(prompt, 80) || '...' ELSE prompt END AS shown FROM prompts
QUALIFY row_number() OVER (PARTITION BY intent_disc ORDER BY md5(row_id || '-42'), row_id) <= 3""")
register("topic_answers", lambda s, d: topics.topic_answers(views.prompts(s, d), "intent_disc", "dataset"), f"""
WITH {PROMPTS}, c AS (SELECT intent_disc, dataset, count(*) AS n FROM prompts GROUP BY 1, 2)
SELECT intent_disc, dataset, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY intent_disc ORDER BY n DESC, dataset) AS r FROM c) WHERE r <= 3""")
register("topic_similarity", lambda s, d: topics.topic_similarity(topics.topic_vectors(views.vectors(s, d), "label", "embedding", 64), "label"), f"""
WITH {DIMS}, m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2) GROUP BY 1)
SELECT a.label AS topic_a, b.label AS topic_b, round(list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))), 6) AS cosine FROM m a CROSS JOIN m b""")
register("topic_hierarchy", lambda s, d: topics.topic_hierarchy(topics.topic_vectors(views.vectors(s, d), "label", "embedding", 64), "label"))
register("topic_map", lambda s, d: topics.topic_map(views.vectors(s, d), "label", "embedding", 64))
register("topic_assignment", lambda s, d: topics.assign_topics(views.vectors(s, d), "embedding", label_centres(s, d)).select(
    "vec_id", "topic", F.array_max("probabilities").alias("probability")), f"""
WITH {CENTRES}, ds AS (SELECT vec_id, topic, sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i])))) AS d FROM v CROSS JOIN o),
lo AS (SELECT vec_id, min(d) AS low, min_by(topic, d) AS topic FROM ds GROUP BY 1)
SELECT vec_id, CAST(any_value(lo.topic) AS INTEGER) AS topic, round(1 / sum(exp(low - d)), 6) AS probability FROM ds JOIN lo USING (vec_id) GROUP BY 1""")
register("topic_model", lambda s, d: topics.topic_model(views.vectors(s, d), "", 10, 10, vector="embedding").select("vec_id", "topic"))
register("keyword_rerank", lambda s, d: topics.keyword_rerank(views.dealt_prompts(s, d), "intent_disc", "prompt", "row_id", fv.QUESTION_STOPWORDS))
register("topic_labels", lambda s, d: topics.label_topics(topics.topic_keywords(
    views.dealt_prompts(s, d), ["intent_disc"], "prompt", fv.QUESTION_STOPWORDS), "intent_disc", gen.rule_based))

# --- language and scores ----------------------------------------------------------------------------


def profiles(spark, folder):
    return language.language_profiles(views.table(spark, folder, "documents").repartition("doc_id"), "text", "lang")


PROFILES = f"""s AS (SELECT lang, ' ' || {norm('text')} || ' ' AS t FROM documents), g AS (SELECT lang, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram FROM s),
c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2), k AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM c) AS total FROM c GROUP BY 1),
profiles AS (SELECT lang, gram, CAST(round(ln((n + 1) / total) * 1000000) AS BIGINT) AS weight FROM c JOIN k USING (lang)
 UNION ALL SELECT lang, '', CAST(round(ln(1.0::DOUBLE / total) * 1000000) AS BIGINT) FROM k)"""
DETECTED = f"""nt AS (SELECT id, ' ' || {norm('text')} || ' ' AS t FROM texts), tg AS (SELECT id, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram FROM nt),
u AS (SELECT lang, weight AS unseen FROM profiles WHERE gram = ''),
hit AS (SELECT id, lang, sum(weight - unseen) AS gain FROM tg JOIN profiles USING (gram) JOIN u USING (lang) GROUP BY 1, 2),
known AS (SELECT DISTINCT id FROM hit),
sc AS (SELECT nt.id, u.lang AS detected, coalesce(gain, 0) + (length(t) - 2) * unseen AS score FROM nt JOIN known USING (id) CROSS JOIN u LEFT JOIN hit ON hit.id = nt.id AND hit.lang = u.lang),
best AS (SELECT id, detected FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, detected) = 1)"""
register("language_detection", lambda s, d: language.detect_language(
    views.table(s, d, "documents").select("doc_id", "text", "lang").repartition("doc_id"), "text", profiles(s, d)).groupBy(
    "lang", "detected").agg(F.count("*").alias("n")), f"""
WITH {PROFILES}, texts AS (SELECT doc_id AS id, text FROM documents), {DETECTED}
SELECT lang, coalesce(detected, 'unknown') AS detected, count(*) AS n FROM documents LEFT JOIN best ON id = doc_id GROUP BY 1, 2""")
register("language_distribution", lambda s, d: language.language_distribution(
    views.qa_text(s, d), ["questions", "answer"], "qa_id", profiles(s, d)), f"""
WITH {PROFILES}, {QA_TEXT}, texts AS (SELECT 'questions/' || qa_id AS id, questions AS text FROM qa_text UNION ALL SELECT 'answer/' || qa_id, answer FROM qa_text), {DETECTED},
n AS (SELECT split_part(texts.id, '/', 1) AS field, coalesce(detected, 'unknown') AS detected, count(*) AS n FROM texts LEFT JOIN best ON best.id = texts.id GROUP BY 1, 2)
SELECT field, detected, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY field), 6) AS share_pct, row_number() OVER (PARTITION BY field ORDER BY n DESC, detected) = 1 AS is_main,
 (SELECT max(c) > 1 FROM (SELECT count(*) AS c FROM n GROUP BY field)) AS multilingual FROM n""")
register("language_profiles", profiles, f"WITH {PROFILES} SELECT * FROM profiles")
register("score_inference", lambda s, d: scoring.score_rows(
    views.dealt_prompts(s, d), "prompt", stats.label_params(views.dealt_prompts(s, d)), scoring.fit_regressor(views.dealt_prompts(s, d), "prompt")).select(
    "row_id", "intent_predicted_normalized", "intent_predicted_denormalized"))

# --- generation and the whole flow ------------------------------------------------------------------


def _quotas(spark, folder, coverage=50):
    return balance.plan_quotas(stats.class_counts(views.prompts(spark, folder)), coverage)


QUOTAS = f"""{PROMPTS}, c AS (SELECT intent_disc, count(*) AS n FROM prompts GROUP BY 1),
q AS (SELECT intent_disc, n, CAST(round_even(((SELECT max(n) FROM c) - n) * 0.5::DOUBLE, 0) AS BIGINT) AS n_new FROM c)"""
register("quota_rows", lambda s, d: gen.quota_rows(_quotas(s, d)), f"""
WITH {QUOTAS}, f AS (SELECT *, coalesce(sum(n_new) OVER (ORDER BY n DESC, intent_disc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM q)
SELECT CAST(s + unnest(range(n_new)) AS BIGINT) AS seq, intent_disc FROM f WHERE n_new > 0""")


def _seeds(spark, folder):
    return balance.seed_table(views.prompts(spark, folder), 50, None, "per_class", 42)


SEEDS = f"""{PROMPTS}, seeds AS (SELECT row_number() OVER (ORDER BY intent_disc, k) - 1 AS seed_id, row_id, prompt, intent_disc FROM
 (SELECT *, row_number() OVER (PARTITION BY intent_disc ORDER BY md5(row_id || '-42'), row_id) AS k FROM prompts) WHERE k <= 50)"""
register("seed_scores", lambda s, d: _seeds(s, d).join(stats.prompt_score_lookup(views.prompts(s, d)), "prompt", "left").select(
    "seed_id", "intent_disc", "seed_score"), f"""
WITH {SEEDS}, l AS (SELECT prompt, max_by(intent_cont, row_id) AS x FROM prompts GROUP BY 1)
SELECT seed_id, intent_disc, round(x, 6) AS seed_score FROM seeds LEFT JOIN l USING (prompt)""")
register("pair_with_seed", lambda s, d: gen.pair_with_seed(
    _seeds(s, d).select("seed_id", F.concat(F.lit("  "), "prompt").alias("generated")), _seeds(s, d)).select(
    "seed_id", "intent_disc", F.md5(F.trim("generated")).alias("generated"), F.md5("prompt").alias("prompt")), f"""
WITH {SEEDS} SELECT seed_id, intent_disc, md5(trim(prompt)) AS generated, md5(prompt) AS prompt FROM seeds""")


PROMPT_ROWS = f"WITH {PROMPTS} SELECT * FROM prompts"


def cleaned_sql(t: str) -> str:
    """What ``clean_output`` makes of a text."""
    t = rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
    t = rf"""regexp_replace({t}, '^[`"'' \n]+|[`"'' \n]+$', '', 'g')"""
    t = rf"regexp_replace(regexp_replace({t}, '^\s*[\-*\d.)]\s+', ''), '(?i)^prompt\s*:\s*', '')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def turned_sql(text: str, turn: str) -> str:
    """The words of a text with the first ``turn`` of them (an expression over the list l) at the end."""
    words_ = rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"
    return f"array_to_string(list_transform([{words_}], lambda l: array_to_string(list_concat(l[{turn} + 1:], l[1:{turn}]), ' ')), '')"


def picked_sql(stage: str, number: str, content: str) -> str:
    """What the rule-based generator makes of a request without a text."""
    h = f"sha256('{stage}|' || {number} || '|' || {content})"
    byte = lambda i: f"CAST(('0x' || substr({h}, {2 * i + 1}, 2)) AS BIGINT)"
    choice = lambda options, i: f"({options!r})[{byte(i)} % {len(options)} + 1]"
    return (f"{choice(gen.OPENERS, 0)} || ' ' || {choice(gen.SUBJECTS, 1)} || ' ' || {choice(gen.ANGLES, 2)} || ', case ' || "
            f"CAST(('0x' || substr({h}, 9, 8)) AS BIGINT)")


def place_sql(stage: str, seq: str) -> str:
    return f"CAST({gen.STAGE_RANK[stage] * gen.STAGE_ROOM} + {seq} AS BIGINT) AS item"


MEANS = "m AS (SELECT intent_disc, avg(intent_cont) AS m FROM prompts GROUP BY 1)"
QUOTA_ROWS = """f AS (SELECT *, coalesce(sum(n_new) OVER (ORDER BY n DESC, intent_disc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM q),
qr AS (SELECT CAST(s + unnest(range(n_new)) AS BIGINT) AS seq, intent_disc FROM f WHERE n_new > 0)"""
CLASS_REQUEST = "'Class: ' || intent_disc || chr(10) || 'One line, no list.'"
CONDITIONAL = f"""cond AS (SELECT seq, intent_disc, round(m, 6) AS intent_cont, {picked_sql('conditional', '(seq + 1000003)', CLASS_REQUEST)} AS t FROM qr JOIN m USING (intent_disc))"""
register("generated_paraphrases", lambda s, d: gen.generate_from_seeds("paraphrase", _seeds(s, d), gen.rule_based,
                                                                       stats.prompt_score_lookup(views.prompts(s, d))), f"""
WITH {SEEDS}, l AS (SELECT prompt, max_by(intent_cont, row_id) AS x FROM prompts GROUP BY 1)
SELECT {place_sql('paraphrase', 'seed_id')}, 'paraphrase' AS stage, {cleaned_sql(turned_sql('prompt', '1'))} AS prompt, intent_disc, round(x, 6) AS intent_cont, prompt AS seed_prompt
FROM seeds LEFT JOIN l USING (prompt)""")
register("generated_syntax", lambda s, d: gen.generate_from_seeds("syntax", _seeds(s, d), gen.rule_based), f"""
WITH {SEEDS} SELECT {place_sql('syntax', 'seed_id')}, 'syntax' AS stage, {cleaned_sql(turned_sql('prompt', 'greatest(1, len(l) // 2)'))} AS prompt, intent_disc,
 NULL::DOUBLE AS intent_cont, prompt AS seed_prompt FROM seeds""")
register("generated_conditional", lambda s, d: gen.generate_conditional(
    _quotas(s, d), stats.class_mean_score(views.prompts(s, d)), gen.rule_based), f"""
WITH {QUOTAS}, {MEANS}, {QUOTA_ROWS}, {CONDITIONAL}
SELECT {place_sql('conditional', 'seq')}, 'conditional' AS stage, t AS prompt, intent_disc, intent_cont FROM cond""")
register("generated_novel", lambda s, d: gen.generate_novel(
    balance.weighted_class_draw(_quotas(s, d), 50), stats.class_mean_score(views.prompts(s, d)), gen.rule_based), f"""
WITH {QUOTAS}, {MEANS}, w AS (SELECT intent_disc, greatest(n_new, 1) AS w FROM q),
st AS (SELECT intent_disc, sum(w) OVER (ORDER BY intent_disc) AS upto, sum(w) OVER (ORDER BY intent_disc) - w AS low, sum(w) OVER () AS total FROM w),
dr AS (SELECT unnest(range(50)) AS draw), u AS (SELECT draw, {unit_draw("'class'", "'42'", "'1'", "draw::VARCHAR")} AS u FROM dr),
p AS (SELECT draw, intent_disc FROM u JOIN st ON u * total >= low AND u * total < upto)
SELECT {place_sql('brainstorm', 'draw')}, 'brainstorm' AS stage, {picked_sql('brainstorm', '(draw + 1000003)', "'One line, no list.'")} AS prompt, intent_disc, round(m, 6) AS intent_cont
FROM p JOIN m USING (intent_disc)""")
register("generated_two_stage", lambda s, d: gen.generate_two_stage(
    _quotas(s, d), stats.class_mean_score(views.prompts(s, d)), gen.rule_based), f"""
WITH {QUOTAS}, {MEANS}, {QUOTA_ROWS}, {CONDITIONAL}
SELECT {place_sql('conditional', 'seq')}, 'conditional' AS stage, {cleaned_sql(turned_sql('t', 'greatest(1, len(l) // 2)'))} AS prompt, intent_disc, intent_cont FROM cond""")


ORACLES["keyword_rerank"] = f"""WITH kw AS ({ORACLES['topic_keywords'].replace('r <= 10', 'r <= 30')}), kp AS (SELECT intent_disc, prompt FROM ({PROMPT_ROWS})),
pb AS (SELECT intent_disc, {digest_bytes('prompt')} AS b FROM kp), pe AS (SELECT intent_disc, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS e FROM pb),
pu AS (SELECT intent_disc, unnest(e) AS x, unnest(range(32)) AS i FROM pe), pm AS (SELECT intent_disc, i, avg(x) AS x FROM pu GROUP BY 1, 2), pc AS (SELECT intent_disc, list(x ORDER BY i) AS c FROM pm GROUP BY 1),
tb AS (SELECT intent_disc, term, rank, {digest_bytes('term')} AS b FROM kw),
tc AS (SELECT intent_disc, term, rank, list_dot_product(b, c) / (sqrt(list_dot_product(b, b)) * sqrt(list_dot_product(c, c))) AS cosine FROM tb JOIN pc USING (intent_disc))
SELECT intent_disc, term, rank, CAST(n AS INTEGER) AS new_rank, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY intent_disc ORDER BY round(cosine, 9) DESC, term) AS n FROM tc) WHERE n <= 10"""
ORACLES["topic_labels"] = f"""WITH kw AS ({ORACLES['topic_keywords']}), w AS (SELECT intent_disc, string_agg(term, ', ' ORDER BY rank) AS words FROM kw WHERE rank <= 5 GROUP BY 1)
SELECT intent_disc, words, {picked_sql('label', "'None'", "'Name the topic described by these keywords in at most four words: ' || words")} AS label FROM w"""


def _failing(messages, params):
    """Generator that refuses long requests."""
    if len(messages[-1]["content"]) > 500:
        raise ValueError("too long")
    return messages[-1]["content"]


register("failed_generations", lambda s, d: (lambda made: gen.drop_failed(made)[1])(gen.run_generator(
    views.prompts(s, d).select("row_id", gen.build_request("classify", F.col("prompt")).alias("messages")), _failing, {"stage": "classify"},
    ["row_id"])).select("row_id", F.col("error").contains("too long").alias("too_long")),
    f"WITH {PROMPTS} SELECT row_id, true AS too_long FROM prompts WHERE length('Text: ' || prompt) > 500")


def _candidates(spark, folder):
    """Three candidates per question: the answer, and both texts turned round."""
    pairs = views.qa_text(spark, folder)
    made = F.array(F.col("answer"), F.reverse("answer"), F.reverse("questions"))
    return pairs.select(F.col("qa_id").alias("seed_id"), F.col("questions").alias("seed_prompt"), F.posexplode(made).alias("candidate", "prompt"))


register("best_of_k", lambda s, d: gen.best_of_k(_candidates(s, d), 0.72, 0.95).select("seed_id", "candidate", "rank"), f"""
WITH {QA_TEXT}, c AS (SELECT qa_id, questions, unnest([0, 1, 2]) AS candidate, unnest([answer, reverse(answer), reverse(questions)]) AS p FROM qa_text),
v AS (SELECT qa_id, candidate, {digest_bytes('questions')} AS a, {digest_bytes('p')} AS b FROM c),
x AS (SELECT qa_id, candidate, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS cosine FROM v)
SELECT qa_id AS seed_id, CAST(candidate AS INTEGER) AS candidate, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY cosine, candidate) AS r FROM x
 WHERE cosine BETWEEN 0.72 AND 0.95) WHERE r <= 2""")
register("attach_first_attributes", lambda s, d: balance.attach_first_attributes(
    views.prompts(s, d).select("prompt").distinct(), views.prompts(s, d).withColumn("item", F.col("row_id"))).withColumn("prompt", F.md5("prompt")), f"""
WITH {PROMPTS} SELECT md5(prompt) AS prompt, min_by(intent_disc, row_id) AS intent_disc, round(min_by(intent_cont, row_id), 6) AS intent_cont FROM prompts GROUP BY prompt""")
register("score_fallback", lambda s, d: balance.score_fallback(
    views.prompts(s, d).withColumn("intent_cont", F.when(F.col("row_id") % 3 > 0, F.col("intent_cont"))).select("row_id", "intent_disc", "intent_cont"),
    stats.class_mean_score(views.prompts(s, d))), f"""
WITH {PROMPTS}, m AS (SELECT intent_disc, avg(intent_cont) AS m FROM prompts GROUP BY 1)
SELECT row_id, intent_disc, round(CASE WHEN row_id % 3 > 0 THEN intent_cont ELSE m END, 6) AS intent_cont FROM prompts JOIN m USING (intent_disc)""")


def _facts(spark, folder):
    """Run figures of a finished table: the prompts against what the plan asks for."""
    rows = views.prompts(spark, folder)
    kept = dedup.dedup_exact_normalised(rows, "prompt", "row_id")
    base, new = sides(spark, folder)
    planned = _quotas(spark, folder).agg(F.sum("n_new").alias("n")).scalar()
    n, k, fresh, beyond = (t.agg(F.count("*").alias("n")).scalar() for t in (
        rows, kept, dedup.dedup_exact_normalised(new, "prompt", "row_id"), dedup.dedup_against(new, base, "prompt", "row_id")))
    pairs = semantic.pair_similarity(views.qa_text(spark, folder), "questions", "answer")
    return rows.sparkSession.range(1).select(
        balance.coverage_percent(k, planned).alias("coverage_percent"),
        semantic.mean_pair_similarity(semantic.similarity_band(pairs, 0.72, 0.95), pairs).scalar().alias("paraphrase_mean_similarity"),
        dedup.duplicate_ratio(rows, kept).scalar().alias("duplicate_ratio"),
        stats.class_cv_percent(rows).scalar().alias("class_histogram_cv_percent"), planned.alias("planned_new"), n.alias("generated_total"),
        k.alias("generated_unique"), n.alias("original_rows"), F.lit(50).alias("target_coverage"),
        (1 - beyond / fresh).alias("duplicate_ratio_vs_source"),
        balance.format_counts(stats.class_counts(rows)).scalar().alias("class_counts"))


FACTS = f"""{QUOTAS}, {QA_TEXT}, qv AS (SELECT {digest_bytes('questions')} AS a, {digest_bytes('answer')} AS b FROM qa_text),
qc AS (SELECT list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS cosine FROM qv),
nk AS (SELECT row_id % 2 AS side, {norm('prompt')} AS k FROM prompts), odd AS (SELECT DISTINCT k FROM nk WHERE side = 1),
m AS (SELECT (SELECT count(DISTINCT {norm('prompt')}) FROM prompts) AS k, (SELECT count(*) FROM prompts) AS n,
 (SELECT CAST(sum(n_new) AS BIGINT) FROM q) AS planned, (SELECT stddev_pop(n) * 100 / avg(n) FROM c) AS cv,
 (SELECT coalesce((SELECT avg(cosine) FROM qc WHERE cosine BETWEEN 0.72 AND 0.95), (SELECT avg(cosine) FROM qc), 1.0)) AS sim,
 1 - (SELECT count(*) FROM odd WHERE k NOT IN (SELECT k FROM nk WHERE side = 0)) / (SELECT count(*) FROM odd) AS against),
x AS (SELECT *, 100.0::DOUBLE * k / planned AS coverage, 1 - k / n AS dup FROM m)"""
register("run_metrics", lambda s, d: _facts(s, d).select(*balance.METRICS), f"""
WITH {FACTS} SELECT round(coverage, 6) AS coverage_percent, round(sim, 6) AS paraphrase_mean_similarity, round(dup, 6) AS duplicate_ratio, round(cv, 6) AS class_histogram_cv_percent FROM x""")
register("quality_gates", lambda s, d: balance.quality_gates(_facts(s, d).select(*balance.METRICS)).drop(*balance.METRICS), f"""
WITH {FACTS}, g AS (SELECT coverage >= 90 AS a, cv <= 5 AS b, sim BETWEEN 0.82 AND 0.95 AS c, dup <= 0.01 AS d FROM x)
SELECT a AS coverage_ok, b AS class_cv_ok, c AS similarity_ok, d AS duplicates_ok, a AND b AND c AND d AS all_pass,
 array_to_string(list_filter([CASE WHEN NOT a THEN 'coverage_ok' END, CASE WHEN NOT b THEN 'class_cv_ok' END, CASE WHEN NOT c THEN 'similarity_ok' END, CASE WHEN NOT d THEN 'duplicates_ok' END], lambda v: v IS NOT NULL), ',') AS failed_gates FROM g""")
register("report_lines", lambda s, d: balance.report_lines(_facts(s, d)), f"""
WITH {FACTS}, v AS (SELECT [ '50%', n::VARCHAR, planned::VARCHAR, n || ' (unique ' || k || ')', format('{{:.2f}}%', coverage), format('{{:.3f}}', sim), format('{{:.3f}}', dup), format('{{:.3f}}', against), format('{{:.2f}}', cv),
 (SELECT '{{' || string_agg(intent_disc || ': ' || n, ', ' ORDER BY n DESC, intent_disc) || '}}' FROM c)] AS v FROM x)
SELECT CAST(unnest(range(10)) AS INTEGER) AS line, unnest([{', '.join(f"'{l}'" for l in fv.REPORT_LABELS)}]) AS label, unnest(v) AS value FROM v""")


def _balanced(spark, folder):
    return balance.balance_dataset(views.dealt_prompts(spark, folder), target_coverage=50, min_similarity=0.72)


register("balanced_rows", lambda s, d: _balanced(s, d).augmented.select("prompt", "dataset", "intent_disc", "intent_cont"))
register("balanced_metrics", lambda s, d: balance.quality_gates(_balanced(s, d).metrics))
register("balanced_report", lambda s, d: _balanced(s, d).report)
register("balanced_runs", lambda s, d: balance.repeat_runs(views.prompts(s, d), 2, target_coverage=50)[0].augmented.groupBy("run", "intent_disc").agg(
    F.count("*").alias("n")))
register("balanced_attempts", lambda s, d: balance.balance_until_gates(views.prompts(s, d), 2, target_coverage=50)[1])
register("combined_rows", lambda s, d: balance.combined_dataset(views.prompts(s, d), _balanced(s, d).augmented).select(
    F.md5("prompt").alias("prompt"), "dataset", "intent_disc", "intent_cont"))

# --- files ------------------------------------------------------------------------------------------


def _path(spark, ext=""):
    return f"{scratch_root(spark)}/files/{uuid.uuid4().hex}{ext}"


def jsonl_round_trip(spark, folder):
    path = _path(spark)
    writers.write_jsonl(views.prompts(spark, folder).drop("row_id"), path)
    return readers.read_prompts(spark, path).groupBy("dataset", "intent_disc").agg(
        F.count("*").alias("n"), F.sum(F.length("prompt")).alias("chars"))


def csv_round_trip(spark, folder):
    path = _path(spark)
    writers.write_csv(views.prompts(spark, folder), path)
    return readers.read_any(spark, path, multi_line=True).groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.length("prompt")).cast("bigint").alias("chars"))


def tolerant_read(spark, folder):
    """One line of every seven is cut short, so that it is no JSON; others carry the class as text, with a fraction, as a word or
    under another key, have keys of their own, or are followed by a blank line. All rows are compared, both kinds."""
    path = _path(spark)
    c, k = F.col("intent_disc"), F.col("row_id") % 7
    classes = F.when(k == 1, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).when(k == 2, F.concat(c.cast("string"), F.lit(".0"))) \
        .when(k == 3, F.lit('"none"')).when(k == 4, F.lit("[1, 2]")).otherwise(c.cast("string"))
    line = F.concat(F.lit('{"prompt": '), F.to_json(F.array("prompt")), F.lit(', "dataset": "'), F.col("dataset"), F.lit('", "intent_disc": '), classes,
                    F.lit(', "id": '), F.col("row_id").cast("string"), F.when(k == 5, F.lit(', "language": "xx"')).otherwise(F.lit("")), F.lit("}"))
    text = F.when(k == 0, F.substring(line, 1, 25)).when(k == 6, F.concat(line, F.lit("\n   \n"))).otherwise(line)
    views.prompts(spark, folder).select(text.alias("value")).write.text(path)
    good, bad = readers.read_prompts_tolerant(spark, path, "mapped", with_lines=True)
    return good.select(F.col("id").cast("bigint").alias("id"), "dataset", "intent_disc", "intent_cont", "language", "source", F.md5("prompt").alias("text"),
                       F.lit(True).alias("valid")).unionByName(bad.select(F.md5("line").alias("text"), F.lit(False).alias("valid")), allowMissingColumns=True)


SIZES = f"WITH {PROMPTS} SELECT dataset, intent_disc::BIGINT AS intent_disc, count(*) AS n, CAST(sum(length(prompt)) AS BIGINT) AS chars FROM prompts GROUP BY 1, 2"
register("jsonl_round_trip", jsonl_round_trip, SIZES)
register("csv_round_trip", csv_round_trip, f"WITH {PROMPTS} SELECT dataset, count(*) AS n, CAST(sum(length(prompt)) AS BIGINT) AS chars FROM prompts GROUP BY 1")
register("tolerant_read", tolerant_read, f"""
WITH {PROMPTS}, j AS (SELECT *, '["' || replace(replace(replace(replace(prompt, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '"]' AS q FROM prompts)
SELECT CASE WHEN k > 0 THEN row_id END AS id, CASE WHEN k > 0 THEN dataset END AS dataset, CASE WHEN k > 0 AND k NOT IN (3, 4) THEN intent_disc END AS intent_disc,
 NULL::DOUBLE AS intent_cont, CASE WHEN k = 5 THEN 'xx' END AS language, CASE WHEN k > 0 THEN 'mapped' END AS source,
 CASE WHEN k > 0 THEN md5(q) ELSE md5(substr('{{"prompt": ' || q, 1, 25)) END AS text, k > 0 AS valid FROM (SELECT *, row_id % 7 AS k FROM j)""")
