"""Topics: clusters of embedded texts with their words, sizes, content and relations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..session import lookup, materialize
from .sampling import examples_per_group
from .semantic import cluster_embeddings, embed, project, squared_distance


def topic_model(df: DataFrame, text: str, n_topics: int = 16, min_topic_size: int = 15, vector: str | None = None,
                dims: int = 5, seed: int = 42, out: str = "topic") -> DataFrame:
    """Embed (unless a vector column is given), reduce to ``dims`` components, cluster."""
    data = df if vector else embed(df, text, "_embedding")
    reduced = materialize(project(data, vector or "_embedding", dims, "_reduced"))
    labelled = cluster_embeddings(reduced, "_reduced", n_topics, min_topic_size, seed=seed, out=out)
    return labelled.drop("_reduced", "_embedding")


def _terms(df: DataFrame, groups: list[str], text: str, stopwords: list[str], sizes: tuple[int, ...]) -> DataFrame:
    words = tx.word_tokens(text)
    kept = F.filter(words, lambda w: ~w.isin(stopwords)) if stopwords else words
    data = df.select(*groups, kept.alias("w"))
    return data.select(*groups, F.explode(F.concat(*[tx.windows_of(F.col("w"), n) for n in sizes])).alias("term"))


def topic_keywords(df: DataFrame, groups: list[str], text: str, stopwords: list[str] = (), top: int = 10,
                   sizes: tuple[int, ...] = (1, 2), min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """Top terms of every topic by class-based TF-IDF: the share of the term in the topic times
    ln(1 + A / f), with A the mean number of terms per topic (whole part) and f the frequency of the term
    in all topics. Terms of fewer than ``min_df`` topics are left out; with ``max_features`` only that many
    of the most frequent are kept.

    A term's counts in all topics are one row, so its total and number of topics need no second shuffle, and only the terms
    that are kept are written."""
    per_topic = (_terms(df, groups, text, list(stopwords), tuple(sizes)).groupBy(*groups, "term").agg(F.count("*").alias("n")))
    # One entry per topic: as long as the list of topics.
    together = per_topic.groupBy("term").agg(F.sum("n").alias("f"), F.count("*").alias("df"),
                                             F.collect_list(F.struct(*groups, "n")).alias("_in"))
    kept = together.where(F.col("df") >= min_df)
    if max_features is not None:
        kept = kept.orderBy(F.desc("f"), "term").limit(max_features)
    kept = materialize(kept.select("term", "f", F.inline("_in")))
    totals = kept.groupBy(*groups).agg(F.sum("n").alias("size"))
    mean_size = totals.agg(F.floor(F.avg("size")).alias("a")).scalar()
    scored = lookup(kept, totals, groups, "inner").select(
        *groups, "term", "n", (F.col("n") / F.col("size") * F.ln(1 + mean_size / F.col("f"))).alias("score"))
    # Ranked on rounded scores, so that ties do not hang on the last bits.
    w = Window.partitionBy(*groups).orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def topic_sizes(df: DataFrame, topic: str, top: int = 20) -> DataFrame:
    """Rows and share per topic, largest first; the outlier topic -1 is left out of the ranking."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return (df.where(F.col(topic) != -1).groupBy(topic).agg(F.count("*").alias("n"))
            .withColumn("share_pct", 100.0 * F.col("n") / total).orderBy(F.desc("n"), topic).limit(top))


def topic_summary(df: DataFrame, topic: str) -> DataFrame:
    """Number of topics and share of outliers."""
    sizes = df.groupBy(topic).agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col(topic) != -1).alias("n_topics"), F.sum("n").alias("n_rows"),
                     (F.lit(100.0) * F.coalesce(F.sum(F.when(F.col(topic) == -1, F.col("n"))), F.lit(0)) / F.sum("n"))
                     .alias("outlier_pct"))


def topics_per_class(df: DataFrame, topic: str, by: str) -> DataFrame:
    return df.groupBy(topic, by).agg(F.count("*").alias("n"))


def topic_examples(df: DataFrame, topic: str, key: str, text: str, m: int = 3, width: int = 80, seed: int = 42) -> DataFrame:
    """Up to m drawn texts per topic, outliers included."""
    return examples_per_group(df, topic, key, m, seed).select(topic, key, tx.ellipsize(text, width).alias("shown"))


def topic_answers(df: DataFrame, topic: str, answer: str, k: int = 3) -> DataFrame:
    """The k most frequent answers of every topic."""
    counts = df.where(F.col(answer).isNotNull()).groupBy(topic, answer).agg(F.count("*").alias("n"))
    w = Window.partitionBy(topic).orderBy(F.desc("n"), answer)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topic_vectors(df: DataFrame, topic: str, vector: str, dim: int) -> DataFrame:
    """Mean vector per topic: one sum per dimension, combined on the map side."""
    means = df.groupBy(topic).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_m{i}") for i in range(dim)])
    return means.select(topic, F.array(*[f"_m{i}" for i in range(dim)]).alias("centre"))


def topic_similarity(centres: DataFrame, topic: str) -> DataFrame:
    """Cosine of every two topics. There are as many rows as topics, so all centres travel as one array."""
    centres = materialize(centres)
    packed = centres.agg(F.sort_array(F.collect_list(F.struct(F.col(topic).alias("t"), F.col("centre").alias("c"))))
                         .alias("a")).scalar()
    return (centres.withColumn("_all", packed).select(topic, "centre", F.explode("_all").alias("o"))
            .select(F.col(topic).alias("topic_a"), F.col("o.t").alias("topic_b"),
                    vec.cosine("centre", "o.c").alias("cosine")))


def topic_hierarchy(centres: DataFrame, topic: str, levels: tuple[int, ...] = (2, 4, 8), seed: int = 42) -> DataFrame:
    """Topics grouped top-down: ``level, topic, node`` for each number of groups."""
    data = materialize(centres).withColumn("_v", array_to_vector("centre"))
    rows = None
    for level in levels:
        fitted = BisectingKMeans(k=level, seed=seed, featuresCol="_v", predictionCol="node", minDivisibleClusterSize=1.0).fit(data)
        part = fitted.transform(data).select(F.lit(level).alias("level"), F.col(topic).alias("topic"), "node")
        rows = part if rows is None else rows.unionByName(part)
    return rows


TREE = "step bigint, left_node bigint, right_node bigint, node bigint, height double, size bigint"


def _chain_merges(ids: list[int], centres: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """Ward merges by nearest-neighbour chains: follow nearest neighbours until two name each other, and merge them. Heights never
    fall along a chain, so the merges are those of always joining the nearest two; they are put in that order at the end."""
    name = {k: i for k, i in enumerate(ids)}
    centre, size = dict(enumerate(centres)), dict(enumerate(sizes.tolist()))

    def gap(a: int, b: int) -> float:
        return math.sqrt(2.0 * size[a] * size[b] / (size[a] + size[b])) * float(np.sqrt(((centre[a] - centre[b]) ** 2).sum()))
    merges, chain, following = [], [], len(ids)
    while len(centre) > 1:
        if not chain:
            chain.append(min(centre))
        while True:
            last, before = chain[-1], chain[-2] if len(chain) > 1 else None
            near = min((gap(last, other), other != before, other) for other in centre if other != last)
            if near[2] == before:
                break
            chain.append(near[2])
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((gap(a, b), a, b, following))
        centre[following] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[following] = size[a] + size[b]
        for one in (a, b):
            del centre[one]
        following += 1
    # numbered in the order of their heights, parts before wholes
    out, number = [], {k: i for k, i in name.items()}
    for step, (height, a, b, new) in enumerate(sorted(merges, key=lambda m: (m[0], m[3]))):
        number[new] = max(ids) + 1 + step
        left, right = sorted((number[a], number[b]))
        out.append({"step": step, "left_node": left, "right_node": right, "node": number[new], "height": height, "size": size[new]})
    return out


def topic_tree(centres: DataFrame, topic: str, size: str = "n") -> DataFrame:
    """Merges of topics from the bottom up, ``step, left_node, right_node, node, height, size``: at each step the two whose merging adds least to
    the squared distances of rows to their centre (Ward; height: the square root of twice that). ``centres`` has one row per topic
    with ``centre`` and its number of rows; topics are compared in one task, as many as there are."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["topic"])
        merges = _chain_merges([r["topic"] for r in rows], np.array([r["centre"] for r in rows]), np.array([r["n"] for r in rows]))
        names = ("step", "left_node", "right_node", "node", "height", "size")
        return pa.table([pa.array([m[k] for m in merges], pa.float64() if k == "height" else pa.int64()) for k in names], names=list(names))
    data = centres.where(F.col(topic).isNotNull()).select(
        F.col(topic).cast("bigint").alias("topic"), F.col("centre").cast("array<double>").alias("centre"), F.col(size).cast("bigint").alias("n"))
    return data.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(lambda t: run(t), TREE)


def topics_at(tree: DataFrame, centres: DataFrame, topic: str, groups: int) -> DataFrame:
    """``topic, node``: which node of the tree holds each topic once ``groups`` nodes are left (both tables have one row per topic)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        merges = sorted(left.to_pylist(), key=lambda r: r["step"])
        at = {i: i for i in right["topic"].to_pylist()}
        for m in merges[:max(0, len(at) - groups)]:
            at = {i: m["node"] if n in (m["left_node"], m["right_node"]) else n for i, n in at.items()}
        return pa.table([pa.array(list(at), pa.int64()), pa.array(list(at.values()), pa.int64())], names=["topic", "node"])
    topics = centres.where(F.col(topic).isNotNull()).select(F.lit(0).alias("_all"), F.col(topic).cast("bigint").alias("topic"))
    return tree.withColumn("_all", F.lit(0)).groupBy("_all").cogroup(topics.groupBy("_all")).applyInArrow(run, "topic bigint, node bigint")


def keyword_rerank(df: DataFrame, topic: str, text: str, key: str, stopwords: list[str] = (), candidates: int = 30,
                   top: int = 10) -> DataFrame:
    """Candidate words of every topic ordered by the cosine of the word with the topic's mean text vector."""
    words = topic_keywords(df, [topic], text, stopwords, candidates)
    embedded = df.select(topic, vec.hash_unit(text).alias("v"))
    centres = topic_vectors(embedded, topic, "v", 32)
    scored = words.join(materialize(centres), topic).withColumn("cosine", vec.cosine(vec.hash_unit("term"), F.col("centre")))
    w = Window.partitionBy(topic).orderBy(F.desc(F.round("cosine", 9)), "term")
    return (scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top)
            .select(topic, "term", "rank", "new_rank", "cosine"))


def label_requests(keywords: DataFrame, topic: str, top: int = 5) -> DataFrame:
    """One naming request per topic from its top words."""
    listed = keywords.where(F.col("rank") <= top).groupBy(topic).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda e: e.getField("term")), ", ").alias("words"))
    content = F.concat(F.lit("Name the topic described by these keywords in at most four words: "), F.col("words"))
    return listed.select(topic, "words", F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"))


def label_topics(keywords: DataFrame, topic: str, generator, top: int = 5) -> DataFrame:
    """Topic labels from a text generator."""
    from ..plans.generate import run_generator
    requests = label_requests(keywords, topic, top)
    return run_generator(requests, generator, {"stage": "label"}, [topic, "words"]).where("error is null").select(
        topic, "words", F.col("text").alias("label"))


def assign_topics(df: DataFrame, vector: str, model, out: str = "topic") -> DataFrame:
    """Topic of new rows with membership probabilities: softmax of the negative distances to the centres (of a fitted model, or
    given as a list)."""
    centres = [[float(x) for x in c] for c in (model if isinstance(model, list) else model.clusterCenters())]
    table = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    distances = F.transform(table, lambda c: F.sqrt(squared_distance(F.col(vector), c)))
    weights = tx.let(F.array_min("_d"), lambda low: F.transform("_d", lambda d: F.exp(low - d)))
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    shares = tx.let(total, lambda t: F.transform("_w", lambda x: x / t))
    return (df.withColumn("_d", distances).withColumn("_w", weights).withColumn("probabilities", shares)
            .withColumn(out, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d", "_w"))


def topic_map(df: DataFrame, topic: str, vector: str, dim: int) -> DataFrame:
    """Two coordinates and the size of every topic."""
    centres = topic_vectors(df, topic, vector, dim).join(df.groupBy(topic).agg(F.count("*").alias("n")), topic)
    placed = project(materialize(centres), "centre", 2)
    return placed.select(topic, "n", F.col("projection")[0].alias("x"), F.col("projection")[1].alias("y"))


def document_map(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Two coordinates of every row."""
    return project(df, vector, 2).select(key, F.col("projection")[0].alias("x"), F.col("projection")[1].alias("y"))


def gini_of_sizes(sizes: Column) -> Column:
    """Gini index of topic sizes given as a sorted array."""
    n = F.size(sizes)
    ranked = F.transform(sizes, lambda x, i: (i + 1) * x)
    weighted = F.aggregate(ranked, F.lit(0).cast("bigint"), lambda a, x: a + x)
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return 2.0 * weighted / (n * total) - (n + 1) / n


def topic_gini(df: DataFrame, topic: str) -> DataFrame:
    """How unevenly rows are spread over the topics (one row per topic is aggregated)."""
    sizes = df.where(F.col(topic) != -1).groupBy(topic).agg(F.count("*").alias("n"))
    return sizes.agg(F.sort_array(F.collect_list("n")).alias("s")).select(gini_of_sizes(F.col("s")).alias("gini"))
