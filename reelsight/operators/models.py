"""Rating models: factorisation (ALS) and content-based linear regression (L-01 .. L-07, S-10).

Training inputs are persisted (memory and disk) before iterative fits and
released afterwards; ALS checkpoints its factor lineage into the session's
checkpoint folder every few iterations, so a lost executor re-reads
checkpointed blocks instead of replaying every iteration.  Cross-validation
folds come from a key hash (``foldCol``), not from random splits, so they
do not depend on partition layout.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.functions.lookups import (ALS_ITERS, ALS_RANKS, ALS_REGS, CV_FOLDS, LR_ELASTIC_NET,
                                         LR_MAX_ITER, LR_REG)
from reelsight.operators.features import FeatureModel
from reelsight.operators.sampling import hash_bucket
from reelsight.session import checkpoint_dir

SEED = 42
# Fits of a grid that run at the same time, and iterations that a fit may make without a checkpoint.
FITS_AT_ONCE, UNCHECKED_ITERS = 8, 15


def als_estimator(rank: int = 10, reg: float = 0.1, iters: int = 10, seed: int = SEED,
                  user: str = "UserID", item: str = "MovieID", rating: str = "NormUserRating",
                  cold_start: str = "drop") -> ALS:
    """L-01 estimator: explicit feedback, NaN predictions for unknown ids dropped by default."""
    return ALS(rank=rank, regParam=reg, maxIter=iters, seed=seed, userCol=user, itemCol=item,
               ratingCol=rating, coldStartStrategy=cold_start, checkpointInterval=5,
               intermediateStorageLevel="MEMORY_AND_DISK", finalStorageLevel="MEMORY_AND_DISK")


def train_als(df: DataFrame, rank: int = 10, reg: float = 0.1, iters: int = 10, seed: int = SEED,
              **cols) -> ALSModel:
    """L-01: fit ALS on ``df`` (UserID, MovieID, NormUserRating by default)."""
    checkpoint_dir(df.sparkSession)
    return als_estimator(rank, reg, iters, seed, **cols).fit(df)


def rmse_evaluator(label: str = "NormUserRating", prediction: str = "prediction") -> RegressionEvaluator:
    return RegressionEvaluator(metricName="rmse", labelCol=label, predictionCol=prediction)


@dataclass
class Tuned:
    model: ALSModel
    best: dict
    results: DataFrame


def tune_als(df: DataFrame, ranks: Sequence[int] = ALS_RANKS, regs: Sequence[float] = ALS_REGS,
             iters: Sequence[int] = ALS_ITERS, folds: int = CV_FOLDS, seed: int = SEED,
             parallelism: int | None = None, label: str = "NormUserRating",
             keys: Sequence[str] = ("UserID", "MovieID")) -> Tuned:
    """L-02: grid search with k-fold cross-validation; lowest mean RMSE wins.

    Returns the refitted best model, its parameters and a results table
    ``(rank, regParam, maxIter, avg_rmse)``, one row per grid point.  A fit's
    stages are short, so ``parallelism`` fits run at once (default: as many
    as ``FITS_AT_ONCE`` and the cores allow).  Fits of the grid write no
    checkpoints, each of which computes a half-iteration again: up to
    15 iterations, a lost executor's blocks come back from shuffle files.
    """
    checkpoint_dir(df.sparkSession)
    if parallelism is None:
        parallelism = max(4, min(FITS_AT_ONCE, df.sparkSession.sparkContext.defaultParallelism))
    als = als_estimator(seed=seed, rating=label)
    if max(iters) <= UNCHECKED_ITERS:
        als.setCheckpointInterval(-1)
    grid = (ParamGridBuilder().addGrid(als.rank, list(ranks)).addGrid(als.regParam, list(regs))
            .addGrid(als.maxIter, list(iters)).build())
    data = df.withColumn("_fold", hash_bucket(keys, salt="fold", buckets=folds)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cv = CrossValidator(estimator=als, estimatorParamMaps=grid, evaluator=rmse_evaluator(label),
                            numFolds=folds, foldCol="_fold", parallelism=parallelism, seed=seed)
        cvm: CrossValidatorModel = cv.fit(data)
    finally:
        data.unpersist()
    rows = []
    for pm, metric in zip(grid, cvm.avgMetrics):
        named = {p.name: v for p, v in pm.items()}
        rows.append((int(named["rank"]), float(named["regParam"]), int(named["maxIter"]), float(metric)))
    spark = df.sparkSession
    results = spark.createDataFrame(rows, "rank int, regParam double, maxIter int, avg_rmse double")
    best_i = min(range(len(rows)), key=lambda i: rows[i][3])
    best = {"rank": rows[best_i][0], "regParam": rows[best_i][1], "maxIter": rows[best_i][2],
            "avg_rmse": rows[best_i][3]}
    return Tuned(cvm.bestModel, best, results)


def save_tuning(tuned: Tuned, path: str) -> None:
    """S-10 + L-02: the best model and, next to it, the results table of the whole grid
    (so the chosen rank, regularisation and iterations are on record with the model)."""
    tuned.model.write().overwrite().save(f"{path}/model")
    tuned.results.write.mode("overwrite").parquet(f"{path}/tuning_results")


def predict_als(model: ALSModel, df: DataFrame, out: str = "als_prediction") -> DataFrame:
    """L-04: predicted rating per (user, item); pairs with an unknown id are dropped."""
    return model.transform(df).withColumnRenamed("prediction", out)


def evaluate_rmse(df: DataFrame, label: str, prediction: str) -> float:
    """L-05: holdout RMSE (one distributed aggregate, one number back)."""
    return rmse_evaluator(label, prediction).evaluate(df)


def linear_estimator(features: str = "content_features", label: str = "NormUserRating") -> LinearRegression:
    """L-06 estimator: elastic net, maxIter 20, reg 0.1, elasticNet 0.8."""
    return LinearRegression(featuresCol=features, labelCol=label, maxIter=LR_MAX_ITER, regParam=LR_REG,
                            elasticNetParam=LR_ELASTIC_NET)


def train_linear(train: DataFrame, features: str = "content_features",
                 label: str = "NormUserRating", cache_input: bool = True) -> LinearRegressionModel:
    """L-06: fit the content model.

    The solver makes one pass per iteration.  With ``cache_input`` the
    (vector, label) rows are persisted (memory, spilling to disk) for those
    passes.  One content vector per rating row can outgrow the cluster's
    memory and local disks at the largest scales; ``cache_input=False`` then
    recomputes the rows on each pass from their sources (ratings joined with
    the per-title text vectors) instead.
    """
    data = train.select(features, label)
    if not cache_input:
        return linear_estimator(features, label).fit(data)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return linear_estimator(features, label).fit(data)
    finally:
        data.unpersist()


def predict_linear(model: LinearRegressionModel, df: DataFrame, out: str = "lr_prediction",
                   features: FeatureModel | None = None) -> DataFrame:
    """L-07: content-based prediction per row.

    With ``features``, ``df`` has the rows before the feature stages, and no row carries its title's text vector.
    """
    scored = features.predict(model, df) if features is not None else model.transform(df)
    return scored.withColumnRenamed("prediction", out)


# ---------------------------------------------------------------- S-10

def save_model(model, path: str) -> None:
    """S-10: overwrite-save any Spark ML model (ALS, LR, PipelineModel)."""
    model.write().overwrite().save(path)


def load_als(path: str) -> ALSModel:
    return ALSModel.load(path)


def load_linear(path: str) -> LinearRegressionModel:
    return LinearRegressionModel.load(path)


def known_ids(model: ALSModel) -> tuple[DataFrame, DataFrame]:
    """Ids the factor model can score: (users, items) as one-column frames."""
    return (model.userFactors.select(F.col("id").alias("UserID")),
            model.itemFactors.select(F.col("id").alias("MovieID")))
