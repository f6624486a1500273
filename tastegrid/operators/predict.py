"""Average-based predictors with one ``fit`` / ``predict(pairs)`` interface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import clip_rating
from tastegrid.operators.metrics import error_metrics
from tastegrid.sources.session import materialize

NOT_TRAINED = "Model not trained. Call fit() first."


def global_mean(ratings: DataFrame) -> float | None:
    """The mean rating: one number for the driver."""
    return ratings.agg(F.avg("rating")).first()[0]


class AveragePredictor:
    """Predicts the mean rating of a key, or the global mean where the key is unknown.

    ``key`` is None (always the global mean), ``movieId`` or ``userId``. The fitted averages
    are a written table, so a hot key among the pairs is split by AQE.
    """

    def __init__(self, key: str | None = None):
        if key not in (None, "movieId", "userId"):
            raise ValueError(f"unknown key {key}")
        self.key = key
        self.mean: float | None = None
        self.averages: DataFrame | None = None
        self.trained = False

    def fit(self, ratings: DataFrame) -> AveragePredictor:
        self.mean = global_mean(ratings)
        if self.key:
            averages = ratings.groupBy(self.key).agg(F.avg("rating").alias("__avg"))
            self.averages = materialize(averages, f"averages-{self.key}")
        self.trained = True
        return self

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with a ``prediction`` column."""
        if not self.trained:
            raise ValueError(NOT_TRAINED)
        mean = F.lit(self.mean).cast("double")
        if not self.key:
            return pairs.withColumn("prediction", mean)
        scored = pairs.join(self.averages, self.key, "left")
        return scored.withColumn("prediction", F.coalesce("__avg", mean)).drop("__avg")


class BiasPredictor:
    """Global mean plus damped item and user offsets, clipped to the rating scale.

    Item offset: sum(r - mu) / (n + item_damping). User offset: sum(r - mu - item) /
    (n + user_damping). Unknown keys have offset 0.
    """

    def __init__(self, item_damping: float = 10.0, user_damping: float = 5.0):
        self.item_damping = item_damping
        self.user_damping = user_damping
        self.mean: float | None = None
        self.item_bias: DataFrame | None = None
        self.user_bias: DataFrame | None = None
        self.trained = False

    def fit(self, ratings: DataFrame) -> BiasPredictor:
        self.mean = global_mean(ratings)
        mean = F.lit(self.mean).cast("double")
        items = ratings.groupBy("movieId").agg(F.sum("rating").alias("s"), F.count("rating").alias("n"))
        self.item_bias = materialize(
            items.select(
                "movieId",
                ((F.col("s") - F.col("n") * mean) / (F.col("n") + self.item_damping)).alias("item_bias"),
            ),
            "item-bias",
        )
        users = (
            ratings.join(self.item_bias, "movieId")
            .groupBy("userId")
            .agg(F.sum(F.col("rating") - F.col("item_bias")).alias("s"), F.count("rating").alias("n"))
        )
        self.user_bias = materialize(
            users.select(
                "userId",
                ((F.col("s") - F.col("n") * mean) / (F.col("n") + self.user_damping)).alias("user_bias"),
            ),
            "user-bias",
        )
        self.trained = True
        return self

    def offsets(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``base`` = mean + item offset + user offset, not clipped."""
        if not self.trained:
            raise ValueError(NOT_TRAINED)
        return (
            pairs.join(self.item_bias, "movieId", "left")
            .join(self.user_bias, "userId", "left")
            .withColumn(
                "base",
                F.lit(self.mean).cast("double")
                + F.coalesce("item_bias", F.lit(0.0))
                + F.coalesce("user_bias", F.lit(0.0)),
            )
            .drop("item_bias", "user_bias")
        )

    def predict(self, pairs: DataFrame) -> DataFrame:
        return self.offsets(pairs).withColumn("prediction", clip_rating(F.col("base"))).drop("base")


def compare_predictors(models: dict[str, object], test: DataFrame) -> DataFrame:
    """RMSE and MAE of fitted predictors on one test table, a row per model."""
    parts = [
        error_metrics(model.predict(test)).select(F.lit(name).alias("model"), "rmse", "mae", "n_test")
        for name, model in models.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
