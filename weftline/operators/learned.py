"""Learned pieces on MLlib: item embeddings from sequences, matrix factors, propensities and calibration."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_embeddings(tx: DataFrame, size: int = 64, window: int = 10, min_count: int = 2, epochs: int = 5, seed: int = 1) -> DataFrame:
    """(article_id, vector): skip-gram vectors of items over customers' day-ordered sequences."""
    sequences = tx.select("customer_id", "t_dat", "article_id").distinct().groupBy("customer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_dat", "article_id"))), lambda x: x["article_id"].cast("string")).alias("items")).where(F.size("items") > 1)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, inputCol="items", outputCol="v").fit(sequences)
    return model.getVectors().select(F.col("word").cast("long").alias("article_id"), vector_to_array("vector", "float32").alias("vector"))


def matrix_factors(tx: DataFrame, rank: int = 32, iterations: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors) of implicit feedback over distinct purchases."""
    pairs = tx.groupBy("customer_id", "article_id").agg(F.lit(1.0).alias("bought"))
    model = ALS(rank=rank, maxIter=iterations, seed=seed, implicitPrefs=True, userCol="customer_id", itemCol="article_id", ratingCol="bought").fit(pairs)
    return model.userFactors.select(F.col("id").alias("customer_id"), F.col("features").alias("vector")), model.itemFactors.select(F.col("id").alias("article_id"), F.col("features").alias("vector"))


def propensity(rows: DataFrame, features: list[str], target: str = "target", reg: float = 0.01):
    """Standardised L2 logistic regression with a missing flag per feature; returns a fitted pipeline."""
    model = Pipeline(stages=[VectorAssembler(inputCols=[x for f in features for x in (f"{f}_v", f"{f}_m")], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=target, regParam=reg)])
    return model.fit(with_missing_flags(rows, features))


def with_missing_flags(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.withColumns({f"{f}_v": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features} | {f"{f}_m": F.col(f).isNull().cast("double") for f in features})


def pointwise_ranker(rows: DataFrame, features: list[str], target: str = "target", rounds: int = 20, depth: int = 4, seed: int = 1):
    """Gradient-boosted trees on the pointwise target; importances are in the last stage of the fitted pipeline."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep"), GBTClassifier(featuresCol="x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)]).fit(rows)


def score(model, rows: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "x", "raw")


def platt(rows: DataFrame, score_column: str, target: str = "target"):
    """Logistic map of a score to a probability, with a slope of zero or more."""
    return Pipeline(stages=[VectorAssembler(inputCols=[score_column], outputCol="x"), LogisticRegression(featuresCol="x", labelCol=target, lowerBoundsOnCoefficients=_zero())]).fit(rows)


def _zero():
    from pyspark.ml.linalg import Matrices

    return Matrices.dense(1, 1, [0.0])


def ridge(rows: DataFrame, features: list[str], target: str, strength: float = 1.0) -> list[float]:
    """Closed-form ridge coefficients from one aggregate of the normal equations; the driver solves a features-by-features system."""
    import numpy as np

    n = len(features)
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features)], *[F.sum(F.col(a) * F.col(target)).alias(f"v{i}") for i, a in enumerate(features)]).first()
    m = np.array([[sums[f"m{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)])
    return np.linalg.solve(m + strength * np.eye(n), np.array([sums[f"v{i}"] or 0.0 for i in range(n)])).tolist()
