"""A linear softmax tagger over fixed vectors, over several seeds and across languages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.hashing import uniform
from lexmesh.operators.metrics import accuracy, trial_summary


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("vector"))


def fit_probe(train: DataFrame, max_iter: int = 30, regularisation: float = 1e-3, weight: str | None = None) -> LogisticRegressionModel:
    """Multinomial logistic regression; each iteration is one distributed gradient aggregation."""
    probe = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=regularisation, labelCol="label_id")
    if weight:
        probe = probe.setWeightCol(weight)
    return probe.fit(_features(train))


def apply_probe(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(_features(rows))
    return scored.drop("features", "rawPrediction", "probability").withColumn("prediction", F.col("prediction").cast("int"))


def train_probe(rows: DataFrame, key: str, seeds: Sequence[int] = (1, 2, 3, 4), train_share: float = 0.8, **options) -> DataFrame:
    """Accuracy per seed; the seed decides the hash split. ``rows`` is ``(key, vector, label_id)``."""
    results = []
    for seed in seeds:
        marked = rows.withColumn("_u", uniform(seed, F.lit("probe"), key))
        model = fit_probe(marked.filter(F.col("_u") < train_share), **options)
        tested = apply_probe(model, marked.filter(F.col("_u") >= train_share))
        results.append(accuracy(tested).select(F.lit(seed).alias("seed"), "words", "accuracy"))
    return reduce(DataFrame.unionByName, results)


def zero_shot_evaluation(rows: DataFrame, source: str, key: str, seeds: Sequence[int] = (1, 2, 3, 4), train_share: float = 0.8, **options) -> DataFrame:
    """Fit on the source language once per seed, score every other language, summarise per language."""
    trials = []
    for seed in seeds:
        own = rows.filter(F.col("lang") == source)
        model = fit_probe(own.filter(uniform(seed, F.lit("probe"), key) < train_share), **options)
        scored = accuracy(apply_probe(model, rows.filter(F.col("lang") != source)), ["lang"])
        trials.append(scored.select("lang", F.lit(seed).alias("seed"), (F.col("accuracy") * 100).alias("score"),
                                    F.lit(float(model.summary.totalIterations)).alias("epochs")))
    return trial_summary(reduce(DataFrame.unionByName, trials), ["lang"])
