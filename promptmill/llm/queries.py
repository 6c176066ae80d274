"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import heap_kmeans, id_store, lattice_lm, path_dedup, suffix_dedup
from .bpe_codec import BytePairCoder, digests
from .decontaminate import contaminated, find_overlaps
from .kd_topk import top_k
from .minhash_bbit import near_duplicates
from .periodic_runs import find_runs
from .quality import fit_quality, score_quality
from .token_counts import TokenCounter
from .toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return run(spark, folder)
    QUERIES[run.__name__] = shipped
    return shipped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_earlier_strings(table(spark, folder, "documents")))


@query
def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op2_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(find_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query
def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=4, percent=80)


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op4_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.y FROM reach JOIN e ON e.x = reach.b),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON a = d.doc_id"""


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_quality(docs.select("doc_id", "text"), fit_quality(docs)).select("doc_id", "quality_score", "keep")


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    network = fit_toxicity(docs, table(spark, folder, "labels"), held_out)
    return score_toxicity(docs, network).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


@query
def op7_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    model = lattice_lm.learn(docs, held_out, public_tokenizers.path("piece_bpe_32k.model"), classes="lang")
    return lattice_lm.with_base(lattice_lm.score(docs, held_out, model), model)


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return path_dedup.digests(path_dedup.remove_repeated_spans(table(spark, folder, "documents"), forms=("kept",)))


WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
ORACLES["op8_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35), h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM x),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
t AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS k FROM d), n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY 1),
s AS (SELECT t.doc_id, string_agg(t, ' ' ORDER BY t.k) AS s FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.k = t.k WHERE g.k IS NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id"""


@query
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coder = BytePairCoder(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return digests(coder.decode(coder.encode(table(spark, folder, "documents"))))


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counter = TokenCounter(spark, public_tokenizers.path("word_bpe_49k.json"))
    counted = counter.count(table(spark, folder, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by their ids' hashes, the words from some place on repeat the first of them."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).select(
        "*", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    placed = hashed.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    planted = F.expr("array_join(transform(sequence(0L, n - 1L), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(planted).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(with_planted_periods(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_id_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    encoder = id_store.WordEncoder(spark, public_tokenizers.path("word_bpe_49k.json"))
    store = id_store.write(docs, encoder, end=2)
    return store.read(id_store.keys_of(docs)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_heap_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return heap_kmeans.with_inertia(*heap_kmeans.cluster_vectors(table(spark, folder, "embeddings")))


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds as one common table expression each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (SELECT row_no, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT row_no, j, CAST(list_sum(list_transform(list_zip(v, c),
  lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{r}) GROUP BY row_no)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT j, pos, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM a{r} JOIN v USING (row_no)) GROUP BY j, pos),
m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM s{r} GROUP BY j),
c{r + 1} AS (SELECT j, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} m USING (j))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS j, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v) ORDER BY h, v LIMIT {k}),{",".join(steps).replace(" AS (", " AS MATERIALIZED (")},
i AS (SELECT j, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY j)
SELECT vec_id, j AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row_no) JOIN i USING (j) JOIN c{rounds} USING (j)"""


ORACLES["op13_heap_kmeans"] = _lloyd_sql()
