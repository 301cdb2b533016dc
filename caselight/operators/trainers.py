"""Cumulative models of ordinal grades over feature vectors, fitted by Spark, and scores out of fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.functions.columns import hash_uniform


def fit_ordinal(df: DataFrame, features: str, grade: str, k: int = 5, decision: int = 1, weight: float = 2.0) -> list[LogisticRegressionModel]:
    """One model for each grade > i; positives weigh as negatives over positives, the decision's threshold weighs more."""
    data = df.select(array_to_vector(F.col(features)).alias("features"), F.col(grade).alias("grade")).cache()
    counts = data.agg(*[F.count_if(F.col("grade") > i).alias(f"p{i}") for i in range(k - 1)], F.count("*").alias("n")).first()
    models = []
    for i in range(k - 1):
        pos = max(counts[f"p{i}"], 1)
        w = F.when(F.col("grade") > i, (counts["n"] - counts[f"p{i}"]) / pos).otherwise(1.0) * (weight if i == decision else 1.0)
        rows = data.withColumn("label", (F.col("grade") > i).cast("double")).withColumn("w", w)
        models.append(LogisticRegression(maxIter=20, regParam=0.01, weightCol="w").fit(rows))
    data.unpersist()
    return models


def score_ordinal(df: DataFrame, features: str, models: list[LogisticRegressionModel], name: str = "cumulative") -> DataFrame:
    """Adds the array of probabilities of grade > i."""
    out = df.withColumn("_f", array_to_vector(F.col(features)))
    for i, m in enumerate(models):
        m = m.copy().setFeaturesCol("_f").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
        out = m.transform(out)
    probabilities = F.array(*[vector_to_array(F.col(f"_p{i}"))[1] for i in range(len(models))])
    return out.withColumn(name, probabilities).drop("_f", *[f"_{c}{i}" for c in "pry" for i in range(len(models))])


def oof_scores(df: DataFrame, key: str, features: str, y: str, k: int = 5, seed: str = "oof") -> DataFrame:
    """(key, y, fold, score): each row scored by a model that was fitted on the other folds."""
    data = df.select(key, y, features).withColumn("fold", F.floor(hash_uniform(seed, F.col(key)) * k).cast("int"))
    out = None
    for fold in range(k):
        rows = data.where(F.col("fold") != fold).select(array_to_vector(F.col(features)).alias("features"), F.col(y).cast("double").alias("label"))
        model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows)
        scored = score_ordinal(data.where(F.col("fold") == fold), features, [model], "s").select(key, y, "fold", F.element_at("s", 1).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def score_batches(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], name: str = "score") -> DataFrame:
    """Adds a user's score. load() is called once in each task and returns a function of a batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for part in parts:
            yield part.assign(**{name: score(part).astype("float64")})

    return df.mapInPandas(run, df.select("*", F.lit(0.0).alias(name)).schema)
