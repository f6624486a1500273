"""Batch jobs: training and final evaluation."""

from __future__ import annotations

import time
from functools import partial

from pyspark.sql import DataFrame

from tastegrid.operators import prepare, profile
from tastegrid.operators.factor import FactorModel
from tastegrid.operators.tuning import cross_validate, cv_summary
from tastegrid.sources.session import materialize
from tastegrid.sources.sinks import append_metrics, read_tuned
from tastegrid.sources.tables import sample_pairs

# Solver of the jobs' models.
SOLVER = "sgd"


def train_job(
    ratings: DataFrame,
    movies: DataFrame,
    save_dir: str,
    sample_percent: int | None = None,
    params_path: str | None = None,
    overrides: dict | None = None,
    sample_user: int = 1,
    solver: str = SOLVER,
) -> tuple[FactorModel, dict, DataFrame]:
    """Filter users, read parameters, fit, save model and metrics, and list five items for one user.

    The parameters have a learning rate, so the model is fitted by gradient descent unless ``solver`` says otherwise.
    """
    spark = ratings.sparkSession
    rows = sample_pairs(ratings, sample_percent) if sample_percent else ratings
    kept = materialize(prepare.filter_cold_users(rows), "train-input")
    params = {**read_tuned(spark, params_path), **(overrides or {})}
    model = FactorModel(**params, solver=solver)
    metrics = model.train(kept, save_path=f"{save_dir}/model")
    append_metrics(spark, {**params, **metrics}, f"{save_dir}/metrics")
    user = spark.range(sample_user, sample_user + 1).withColumnRenamed("id", "userId")
    return model, metrics, model.recommend(user, movies, 5)


def evaluation_job(
    ratings: DataFrame,
    movies: DataFrame,
    results_path: str | None = None,
    params_path: str | None = None,
    overrides: dict | None = None,
    folds: int | None = None,
    solver: str = SOLVER,
) -> dict:
    """Nested result of one full evaluation, appended at ``results_path`` when given."""
    spark = ratings.sparkSession
    kept = materialize(prepare.filter_cold_users(ratings), "evaluation-input")
    cold = profile.cold_start_percentage(ratings).first()
    params = {**read_tuned(spark, params_path), **(overrides or {})}
    train, test = prepare.hash_split(kept)
    start = time.monotonic()
    model = FactorModel(**params, solver=solver).fit(train)
    spent = time.monotonic() - start
    scores = model.evaluate(test).first()
    result = {
        "dataset": {
            "total_ratings": ratings.count(),
            "filtered_ratings": kept.count(),
            "total_users": cold.total_users,
            "cold_start_users": cold.cold_start_users,
            "cold_start_percentage": cold.cold_start_percentage,
            "num_movies": movies.count(),
        },
        "training": {
            "train_size": train.count(),
            "test_size": scores.n_test,
            "training_time_seconds": spent,
        },
        "hyperparameters": params,
        "performance": {"test_rmse": scores.rmse, "test_mae": scores.mae},
    }
    if folds:
        cv = cv_summary(cross_validate(kept, params, folds, model=partial(FactorModel, solver=solver))).first()
        result["cross_validation"] = {
            "rmse": cv.rmse,
            "rmse_std": cv.rmse_std,
            "mae": cv.mae,
            "mae_std": cv.mae_std,
        }
    if results_path:
        append_metrics(spark, result, results_path)
    return result
