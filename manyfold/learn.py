"""Learning from votes: labels that keep the share of each class, and what vectors' dimensions explain."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.functions.measures import dot, normalized

TARGETS = ("hard", "smooth", "soft")
SMOOTH = 0.1
FOLDS, SEEDS = 5, 5
#: Models fitted at the same time.
AT_ONCE = 2


def expanded(df: DataFrame, dist: str, target: str, classes: int, smooth: float = SMOOTH) -> DataFrame:
    """A row a class with weight: fitting weighted rows is fitting cross-entropy to the distribution.

    hard puts all on the largest share (the first of equal ones), smooth takes ``smooth`` off it for all, soft keeps the shares.
    """
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}, not {target!r}")
    top = F.array_position(F.col(dist), F.array_max(dist)) - 1
    rows = df.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    share = F.element_at(F.col(dist), F.col("label") + 1)
    is_top = (F.col("label") == top).cast("double")
    weight = {"hard": is_top, "smooth": is_top * (1 - smooth) + smooth / classes, "soft": share}[target]
    return rows.withColumn("weight", weight).where("weight > 0").withColumn("label", F.col("label").cast("double"))


def fold(df: DataFrame, key: str, seed: int | Column, folds: int = FOLDS) -> DataFrame:
    """``df`` with fold, by hash of its key."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)))


def fitted(train: DataFrame, features: str, dist: str, target: str, classes: int):
    """Logistic regression on the expanded training rows."""
    rows = expanded(train, dist, target, classes).withColumn("_x", array_to_vector(F.col(features)))
    return LogisticRegression(featuresCol="_x", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=40).fit(rows)


def predict(train: DataFrame, test: DataFrame, features: str, dist: str, target: str, classes: int) -> DataFrame:
    """``test`` with p, the predicted shares, by logistic regression on the expanded training rows."""
    out = fitted(train, features, dist, target, classes).transform(test.withColumn("_x", array_to_vector(F.col(features))))
    return out.withColumn("p", vector_to_array("probability")).drop("_x", "probability", "rawPrediction", "prediction")


def out_of_fold(df: DataFrame, key: str, features: str, dist: str, classes: int, targets: tuple[str, ...] = TARGETS, seeds: int = SEEDS, folds: int = FOLDS) -> DataFrame:
    """``df`` with seed, fold, target and p: each row once a seed and target, predicted by the model fitted on the other folds of that seed.

    ``df`` is read for every model, so settle it first. The models are a table of seeds x folds x targets rows.
    """
    spark = df.sparkSession

    def model(at: tuple[int, int, str]) -> tuple:
        seed, k, target = at
        m = fitted(fold(df, key, seed, folds).where(F.col("fold") != k), features, dist, target, classes)
        coef, bias = m.coefficientMatrix.toArray().tolist(), m.interceptVector.toArray().tolist()
        if math.inf in bias:  # one class only
            bias = [0.0 if b == math.inf else -math.inf for b in bias]
        lacking = classes - len(bias)  # the last classes do not occur in these folds
        return (seed, k, target, coef + [[0.0] * len(coef[0])] * lacking, bias + [-math.inf] * lacking)

    every = [(s, k, t) for s in range(seeds) for k in range(folds) for t in targets]
    with ThreadPool(AT_ONCE) as pool:
        # a wrapper carries its own copy of the job properties, so each model gets one
        found = pool.map(lambda run: run(), [inheritable_thread_target(spark)(lambda at=at: model(at)) for at in every], chunksize=1)
    models = spark.createDataFrame(found, "seed int, fold long, target string, _coef array<array<double>>, _bias array<double>")
    rows = fold(df.crossJoin(F.broadcast(spark.range(seeds).select(F.col("id").cast("int").alias("seed")))), key, F.col("seed"), folds)
    z = rows.join(F.broadcast(models), ["seed", "fold"]).withColumn("_z", F.zip_with("_coef", "_bias", lambda c, b: dot(c, F.col(features)) + b))
    return z.withColumn("p", normalized(F.transform("_z", lambda v: F.exp(v - F.array_max("_z"))))).drop("_coef", "_bias", "_z")


def explained(df: DataFrame, vector: str, k: int) -> list[float]:
    """Cumulative share of variance that the first 1, 2, ... k principal components explain."""
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_x")))
    out, s = [], 0.0
    for x in model.explainedVariance.toArray():
        s += float(x)
        out.append(s)
    return out


def dimensions(cumulative: list[float], shares: tuple[float, ...] = (0.8, 0.9, 0.95, 0.99)) -> dict[float, int | None]:
    """How many components reach each share; none if they don't."""
    return {s: next((i + 1 for i, c in enumerate(cumulative) if c >= s - 1e-12), None) for s in shares}
