"""Preparation for modelling: types, splits, activity filters, genre and time features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions import day_index, genre_tokens, pair_bucket, utc_datetime
from tastegrid.functions.columns import COLD_START_RATINGS, pair_hash
from tastegrid.operators.profile import ratings_per
from tastegrid.plans.skew import hot_keys, salted_join
from tastegrid.sources.session import materialize

_PRECISION = 1000
# Genre columns that a plan can carry; free text would make as many as there are texts.
MOST_COLUMNS = 2000


def model_types(ratings: DataFrame) -> DataFrame:
    """The three model columns in the types the predictors use."""
    return ratings.select(
        F.col("userId").cast("bigint").alias("userId"),
        F.col("movieId").cast("bigint").alias("movieId"),
        F.col("rating").cast("double").alias("rating"),
    )


def hash_split(ratings: DataFrame, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the pair: no shuffle, and the same split after any retry.

    The share is a multiple of 1/1000. Repeated ratings of one pair stay on one side.
    """
    if not 0 <= test_size <= 1:
        raise ValueError("test_size must lie between 0 and 1")
    cut = round(test_size * _PRECISION)
    bucket = pair_bucket("userId", "movieId", seed, _PRECISION)
    return ratings.where(bucket >= cut), ratings.where(bucket < cut)


def stratified_split(ratings: DataFrame, test_size: float = 0.2, seed: int = 42, slices: int = 256) -> DataFrame:
    """Distinct (user, item) pairs with their copies and ``fold`` = train or test.

    Each user gives ``floor(test_size * pairs + 0.5)`` pairs to the test side, lowest hash
    first. A hot user's pairs are cut into hash-ordered slices that are ranked separately
    and then shifted by the sizes of the earlier slices, so no task ranks one whole user. The
    pairs are written once, because sizes, slices and ranks all read them.
    """
    counted = ratings.groupBy("userId", "movieId").agg(F.count(F.lit(1)).alias("copies"))
    pairs = materialize(counted.withColumn("h", pair_hash("userId", "movieId", seed)), "pairs")
    sizes = pairs.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(sizes, "userId", "n").select("userId", F.lit(True).alias("hot"))
    width = (1 << 31) // slices
    sliced = pairs.join(F.broadcast(hot), "userId", "left").withColumn(
        "slice", F.when(F.col("hot"), F.floor(F.col("h") / width)).otherwise(F.lit(0)).cast("int")
    )
    per_slice = sliced.groupBy("userId", "slice").agg(F.count(F.lit(1)).alias("m"))
    by_user = Window.partitionBy("userId")
    shifts = per_slice.select(
        "userId",
        "slice",
        F.sum("m").over(by_user).alias("n"),
        (
            F.sum("m").over(by_user.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
        ).alias("shift"),
    )
    in_slice = Window.partitionBy("userId", "slice").orderBy("h", "movieId")
    return (
        sliced.withColumn("place", F.row_number().over(in_slice))
        .join(shifts, ["userId", "slice"])
        .select(
            "userId",
            "movieId",
            "copies",
            F.when(
                F.col("place") + F.col("shift") <= F.floor(F.col("n") * F.lit(test_size) + 0.5), "test"
            )
            .otherwise("train")
            .alias("fold"),
        )
    )


def _keep_supported(ratings: DataFrame, key: str, min_ratings: int) -> DataFrame:
    # Written once: the total, the hot keys and the qualified keys all read it.
    counts = materialize(ratings_per(ratings, key), "support")
    qualified = counts.where(F.col("num_ratings") >= min_ratings).select(key)
    return salted_join(ratings, qualified, key, counts, "num_ratings", "left_semi")


def filter_cold_users(ratings: DataFrame, min_ratings: int = COLD_START_RATINGS) -> DataFrame:
    """Ratings of users with at least ``min_ratings`` ratings."""
    return _keep_supported(ratings, "userId", min_ratings)


def filter_cold_items(ratings: DataFrame, min_ratings: int = COLD_START_RATINGS) -> DataFrame:
    """Ratings of items with at least ``min_ratings`` ratings."""
    return _keep_supported(ratings, "movieId", min_ratings)


def genre_onehot(movies: DataFrame, exact: bool = False, genres: list[str] | None = None) -> DataFrame:
    """``movieId`` and one 0/1 column ``genre_<G>`` per genre.

    The default tests for the genre as a substring of the genre text; ``exact`` tests list
    membership. The columns must be known to build the plan, so the genre names (not the
    items) are read first unless they are given.
    """
    if genres is None:
        names = movies.select(F.explode(genre_tokens("genres")).alias("g")).distinct()
        rows = names.limit(MOST_COLUMNS + 1).collect()
        if len(rows) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} genres: pass the ones to make columns of")
        genres = sorted(r.g for r in rows)
    tokens = genre_tokens("genres")

    def flag(g: str):
        hit = F.array_contains(tokens, g) if exact else F.contains("genres", F.lit(g))
        return F.coalesce(hit.cast("int"), F.lit(0)).alias(f"genre_{g}")

    return movies.select("movieId", *[flag(g) for g in genres])


def temporal_features(ratings: DataFrame) -> DataFrame:
    """Adds datetime (UTC), year, month and day_of_week (Monday = 0)."""
    return ratings.withColumn("datetime", utc_datetime("timestamp")).select(
        "*",
        F.year("datetime").alias("year"),
        F.month("datetime").alias("month"),
        day_index("datetime").alias("day_of_week"),
    )
