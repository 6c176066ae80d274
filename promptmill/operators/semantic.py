"""Embeddings, similarities, projection and clustering of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..session import lookup, materialize
from .running import dense_index
from .sampling import uniform


def embed(df: DataFrame, text: str, out: str = "embedding",
          model: Callable[[], Callable[[list[str]], object]] | None = None, dim: int = 384) -> DataFrame:
    """Add a unit vector per text. Without a model the hash embedding is used, natively. ``model`` is a
    loader run once per Python worker that returns a function from texts to vectors."""
    if model is None:
        return df.withColumn(out, vec.hash_embedding(text, dim))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = model()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in predict(batch.fillna("").tolist())])
    return df.withColumn(out, encode(F.col(text)))


def embed_with_cache(df: DataFrame, text: str, cache: DataFrame | None, model=None, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """Vectors for all rows, embedding only texts the cache (``sig, embedding``) does not have. Returns
    the table with vectors and the grown cache."""
    keyed = df.withColumn("sig", F.sha2(text, 256))
    wanted = keyed.groupBy("sig").agg(F.any_value(text).alias("_text"))
    if cache is not None:
        wanted = wanted.join(cache, "sig", "left_anti")
    fresh = materialize(embed(wanted, "_text", model=model, dim=dim).select("sig", "embedding"))
    grown = fresh if cache is None else cache.select("sig", "embedding").unionByName(fresh)
    return keyed.join(grown, "sig", "left").drop("sig"), grown


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine of every pair of texts under the hash embedding."""
    return pairs.withColumn("cosine", vec.dot(vec.hash_unit(a), vec.hash_unit(b)))


def similarity_band(pairs: DataFrame, low: float, high: float) -> DataFrame:
    return pairs.where(F.col("cosine").between(low, high))


def mean_pair_similarity(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean cosine of the kept pairs, else of all pairs, else 1."""
    of_all = pairs.agg(F.avg("cosine").alias("m")).scalar()
    return kept.agg(F.avg("cosine").alias("m")).select(F.coalesce("m", of_all, F.lit(1.0)).alias("mean_similarity"))


def mean_pairwise(df: DataFrame, vector: str, dim: int, by: list[str] = ()) -> DataFrame:
    """Exact mean cosine over all pairs of unit vectors, from their sum: (|sum|^2 - n) / (n (n - 1)).
    Linear: each map task sends one vector per group."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), *[
        F.sum(F.col(vector)[i].cast("double")).alias(f"_s{i}") for i in range(dim)])
    square = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(dim)), F.lit(0.0))
    return sums.select(*by, "n", F.try_divide(square - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"))


def mean_cross(df: DataFrame, vector: str, dim: int, by: str, left: str, right: str) -> DataFrame:
    """Exact mean cosine between the vectors of two groups."""
    cells = []
    for side, name in (("l", left), ("r", right)):
        hit = F.col(by) == name
        cells += [F.avg(F.when(hit, F.col(vector)[i].cast("double"))).alias(f"_{side}{i}") for i in range(dim)]
    return df.agg(*cells).select(
        sum((F.col(f"_l{i}") * F.col(f"_r{i}") for i in range(dim)), F.lit(0.0)).alias("mean_cosine"))


def random_pairs(df: DataFrame, vector: str, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` pairs drawn with replacement, pairs of a row with itself left out, with cosine.
    Only keys are numbered; the vectors of the drawn rows, at most 2n, are looked up afterwards."""
    places = materialize(dense_index(df.select(key), [key]))
    rows = places.count()
    draws = df.sparkSession.range(min(n, rows) if rows > 1 else 0).select(F.col("id").alias("draw"), F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.floor(uniform([F.lit("pair"), F.lit(seed), F.lit(side), F.col("id")]) * rows).alias("pos"))
        for side in ("i", "j")])).alias("p")).select("draw", "p.side", "p.pos")
    drawn = materialize(places.join(F.broadcast(draws), "pos"))
    ends = df.select(key, vector).join(F.broadcast(drawn), key)
    both = ends.groupBy("draw").agg(*[
        F.max(F.when(F.col("side") == side, F.col(out))).alias(f"{name}_{side}")
        for side in ("i", "j") for name, out in (("pos", "pos"), ("v", vector))])
    return both.where("pos_i <> pos_j").select("draw", vec.dot("v_i", "v_j").alias("cosine"))


def _first_rows(df: DataFrame, vector: str, key: str, n: int, pos: str, out: str) -> DataFrame:
    """The first n rows in key order, numbered (a window over n rows)."""
    head = df.select(key, vector).orderBy(key).limit(n)
    return head.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1).alias(pos), F.col(vector).alias(out))


def modulo_pairs(left: DataFrame, right: DataFrame, vector: str, key: str, n: int = 1000) -> DataFrame:
    """The first ``min(n, rows)`` left rows, the i-th with right row ``i mod m``. With m of at least n
    that is row i, so neither side needs more than its first n rows."""
    a = _first_rows(left, vector, key, n, "pos", "va")
    b = materialize(_first_rows(right, vector, key, n, "j", "vb"))
    return (a.withColumn("j", F.col("pos") % max(b.count(), 1)).join(b, "j")
            .select(F.col("pos").cast("bigint").alias("pos"), vec.dot("va", "vb").alias("cosine")))


def semantic_summary(df: DataFrame, vector: str, dim: int, by: str, left: str, right: str) -> DataFrame:
    """Exact mean cosine over all pairs inside each dataset and over all pairs between the two (unit vectors), with the number
    of pairs: everything follows from the sums of the vectors, so nothing is sampled and no pair is formed."""
    inside = mean_pairwise(df.where(F.col(by).isin(left, right)), vector, dim, [by]).select(
        F.when(F.col(by) == left, "mean_intra_left").otherwise("mean_intra_right").alias("metric"), "mean_cosine",
        (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs"))
    pairs = df.agg((F.count_if(F.col(by) == left) * F.count_if(F.col(by) == right)).alias("n")).scalar()
    across = mean_cross(df, vector, dim, by, left, right).select(F.lit("mean_inter").alias("metric"), "mean_cosine", pairs.alias("n_pairs"))
    return inside.unionByName(across)


def project(df: DataFrame, vector: str, dims: int = 2, out: str = "projection") -> DataFrame:
    """Principal components of a vector column."""
    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return (PCA(k=dims, inputCol="_v", outputCol="_p").fit(data).transform(data)
            .withColumn(out, vector_to_array("_p")).drop("_v", "_p"))


def fit_clusters(df: DataFrame, vector: str, k: int, seed: int = 42):
    data = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data)


def centres_table(df: DataFrame, model, label: str = "cluster") -> DataFrame:
    """The k centres as rows."""
    return df.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        f"{label} int, centre array<double>")


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, x: acc + x)


def cluster_embeddings(df: DataFrame, vector: str, k: int, min_size: int = 10, far: float = 2.0,
                       seed: int = 42, out: str = "cluster", model=None) -> DataFrame:
    """k-means labels; -1 for rows that lie farther from their centre than the mean distance of their cluster plus ``far``
    standard deviations, and for clusters with fewer than ``min_size`` rows. How many rows that are depends on the data."""
    model = model or fit_clusters(df, vector, k, seed)
    labelled = (model.transform(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))).drop("_v"))
    # The centres are k rows that the driver already holds.
    placed = (labelled.join(F.broadcast(centres_table(df, model)), "cluster")
              .withColumn("_d", F.sqrt(squared_distance(F.col(vector), F.col("centre")))).drop("centre"))
    limits = placed.groupBy("cluster").agg((F.avg("_d") + F.lit(far) * F.coalesce(F.stddev_pop("_d"), F.lit(0.0))).alias("_limit"))
    near = lookup(placed, limits, "cluster", "inner").withColumn(
        "cluster", F.when(F.col("_d") > F.col("_limit"), F.lit(-1)).otherwise(F.col("cluster")))
    sizes = near.groupBy("cluster").agg(F.count("*").alias("_n"))
    return (lookup(near, sizes, "cluster", "inner")
            .withColumn("cluster", F.when(F.col("_n") < min_size, F.lit(-1)).otherwise(F.col("cluster")))
            .drop("_d", "_limit", "_n").withColumnRenamed("cluster", out))


def novelty_score(df: DataFrame, vector: str, key: str, model) -> DataFrame:
    """1 - the best cosine to any centre (of a fitted model, or given as a list). The k centres are one array literal per row."""
    given = model if isinstance(model, list) else model.clusterCenters()
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in given])
    best = F.array_max(F.transform(centres, lambda c: vec.cosine(F.col(vector), c)))
    return df.select(key, (1 - best).alias("novelty"))


