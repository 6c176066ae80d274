"""Batch score inference with a pluggable regressor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .profile import pick_target_column
from .stats import label_params


def fit_regressor(df: DataFrame, text: str, target: str | None = None, features: int = 256) -> PipelineModel:
    """Linear regression of the standardised score on hashed TF-IDF features."""
    target = target or pick_target_column(df)
    params = label_params(df, target).agg(F.struct(F.first("label_mean").alias("m"), F.first("label_std").alias("s")).alias("p"))
    z = (F.col(target).cast("double") - params.scalar().getField("m")) / params.scalar().getField("s")
    data = df.where(F.col(target).isNotNull()).select(tx.word_tokens(text).alias("_words"), z.alias("_z"))
    stages = [HashingTF(numFeatures=features, inputCol="_words", outputCol="_tf"), IDF(inputCol="_tf", outputCol="_idf"),
              LinearRegression(featuresCol="_idf", labelCol="_z", predictionCol="intent_predicted_normalized", regParam=0.1)]
    return Pipeline(stages=stages).fit(data)


def score_rows(df: DataFrame, text: str, params: DataFrame, model: PipelineModel | None = None,
               predictor: Callable[[], Callable[[list[str]], list[float]]] | None = None) -> DataFrame:
    """Add ``intent_predicted_normalized`` and ``intent_predicted_denormalized``. Either a fitted model or
    a loader (run once per Python worker) of a function from texts to numbers."""
    if predictor is not None:
        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = predictor()
            for batch in batches:
                yield pd.Series([float(x) for x in score(batch.fillna("").tolist())])
        scored = df.withColumn("intent_predicted_normalized", predict(F.col(text)))
    else:
        scored = (model.transform(df.withColumn("_words", tx.word_tokens(text)))
                  .drop("_words", "_tf", "_idf"))
    packed = params.agg(F.struct(F.first("label_mean").alias("m"), F.first("label_std").alias("s")).alias("p"))
    return scored.withColumn("intent_predicted_denormalized", tx.denormalise(
        "intent_predicted_normalized", packed.scalar().getField("m"), packed.scalar().getField("s")))
