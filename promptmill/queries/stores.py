"""Tables that grow: kept vectors of texts, and de-duplication of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_root
from ..sources import views
from ..sources.versioned import StreamDedup, VectorStore, files_for
from .registry import PROMPTS, norm, register
from .tables import sides
from .texts import digest_bytes


def _path(spark) -> str:
    return f"{scratch_root(spark).rstrip('/')}/promptmill/store-{uuid.uuid4().hex}"


def stored_embeddings(spark, folder):
    """Vectors of all rows from a store that has those of one side; the texts that it lacked are counted."""
    store = VectorStore(spark, _path(spark))
    store.embed(sides(spark, folder)[0], "prompt")
    rows, new = store.embed(views.dealt_prompts(spark, folder), "prompt")
    return rows.select("row_id", F.lit(new).cast("bigint").alias("n_new"), *[
        F.round(F.col("embedding")[i].cast("double"), 5).alias(f"x{i}") for i in (0, 100, 383)])


register("stored_embeddings", stored_embeddings, f"""
WITH {PROMPTS}, v AS (SELECT row_id, {digest_bytes('prompt')} AS b FROM prompts),
n AS (SELECT count(DISTINCT prompt) - count(DISTINCT prompt) FILTER (row_id % 2 = 0) AS n FROM prompts)
SELECT row_id, (SELECT n FROM n) AS n_new, {', '.join(f"round(CAST(b[{i % 32 + 1}] / sqrt(12 * list_dot_product(b, b)) AS FLOAT)::DOUBLE, 5) AS x{i}" for i in (0, 100, 383))} FROM v""")


def stream_dedup(spark, folder):
    """The table as a stream of files in three batches, and the texts that are left of it."""
    path, prompts = _path(spark), views.prompts(spark, folder).select("row_id", "prompt")
    each = -(-files_for(prompts) // 3)
    prompts.repartition(3 * each, "row_id").write.parquet(f"{path}/source")
    source = spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", each).parquet(f"{path}/source")
    dedup = StreamDedup(spark, f"{path}/state", "row_id bigint, prompt string", "row_id", "prompt")
    dedup.run(source)
    return dedup.kept.read().select(F.md5("prompt").alias("text_md5"), F.lit(1).alias("n")).groupBy("text_md5").agg(F.sum("n").alias("n")).select(
        F.count("*").alias("n_texts"), F.max("n").alias("most"))


register("stream_dedup", stream_dedup, f"""
WITH {PROMPTS} SELECT count(DISTINCT {norm('prompt')}) AS n_texts, 1::BIGINT AS most FROM prompts""")
