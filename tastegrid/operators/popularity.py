"""Popularity by Bayesian average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import bayesian_average
from tastegrid.operators.search import genre_filter
from tastegrid.plans.ranking import check_n, exact_percentile
from tastegrid.sources.session import materialize


def popular_order():
    """Best score first, then lowest id."""
    return [F.desc("popularity_score"), F.asc("movieId")]


def item_sums(ratings: DataFrame) -> DataFrame:
    """(movieId, num_ratings, stars): count and sum per item, which add up over parts of the ratings."""
    return ratings.groupBy("movieId").agg(F.count("rating").alias("num_ratings"), F.sum("rating").alias("stars"))


def _with_means(sums: DataFrame) -> tuple[DataFrame, Column]:
    """Count and mean per item, and the mean of all ratings from the same (written) table: one pass over the ratings."""
    prior = sums.agg(F.sum("stars") / F.nullif(F.sum("num_ratings"), F.lit(0))).scalar()
    mean = F.col("stars") / F.nullif(F.col("num_ratings"), F.lit(0))
    return sums.select("movieId", "num_ratings", mean.alias("avg_rating")), prior


def _item_sums(ratings: DataFrame) -> tuple[DataFrame, Column]:
    return _with_means(materialize(item_sums(ratings), "item-sums"))


def popularity_fixed(ratings: DataFrame, movies: DataFrame, min_ratings: int = 10) -> DataFrame:
    """Catalogue items with at least ``min_ratings`` ratings, scored with m = ``min_ratings``."""
    stats, prior = _item_sums(ratings)
    n = F.col("num_ratings")
    return (
        stats.where(n >= min_ratings)
        .withColumn(
            "popularity_score", bayesian_average(n, F.col("avg_rating"), F.lit(min_ratings), prior)
        )
        .join(movies.select("movieId", "title", "genres"), "movieId")
        .select("movieId", "title", "genres", "popularity_score", "num_ratings", "avg_rating")
    )


def popularity_quantile(ratings: DataFrame, movies: DataFrame, quantile: float = 0.25) -> DataFrame:
    """All rated items, scored with m = the quantile of ratings per item.

    Items missing from the catalogue stay, with null title and genres.
    """
    return popularity_of_sums(materialize(item_sums(ratings), "item-sums"), movies, quantile)


def popularity_of_sums(sums: DataFrame, movies: DataFrame, quantile: float = 0.25) -> DataFrame:
    """:func:`popularity_quantile` from a written table of :func:`item_sums`."""
    stats, prior = _with_means(sums)
    m = exact_percentile(stats, "num_ratings", quantile).scalar()
    score = bayesian_average(F.col("num_ratings"), F.col("avg_rating"), m, prior)
    return (
        stats.withColumn("popularity_score", score)
        .join(movies.select("movieId", "title", "genres"), "movieId", "left")
        .select("movieId", "title", "genres", "popularity_score", "num_ratings", "avg_rating")
    )


def top_popular(
    popularity: DataFrame,
    n: int = 10,
    genre: str | None = None,
    ignore_case: bool = False,
    exact: bool = False,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Top items of a popularity table, with a genre filter and a table of ids to leave out."""
    check_n(n)
    rows = genre_filter(popularity, genre, ignore_case, exact) if genre else popularity
    if exclude is not None:
        rows = rows.join(exclude.select("movieId").distinct(), "movieId", "left_anti")
    return rows.orderBy(*popular_order()).limit(n)
