"""Catalogue lookups and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import genre_tokens, is_valid_rating
from tastegrid.plans.ranking import check_n


def search_title(movies: DataFrame, query: str, limit: int = 10, literal: bool = False) -> DataFrame:
    """First items by id whose title matches, ignoring case; a regex unless ``literal``."""
    check_n(limit)
    title = F.col("title")
    hit = F.contains(F.lower(title), F.lit(query.lower())) if literal else title.rlike(f"(?i){query}")
    return movies.where(hit).orderBy("movieId").limit(limit)


def genre_filter(movies: DataFrame, genre: str, ignore_case: bool = False, exact: bool = False) -> DataFrame:
    """Items whose genre text matches a regex, or with ``exact`` whose genre list has the genre.

    Null genres never match.
    """
    if exact:
        tokens = genre_tokens("genres")
        if ignore_case:
            return movies.where(F.exists(tokens, lambda t: F.lower(t) == genre.lower()))
        return movies.where(F.array_contains(tokens, genre))
    return movies.where(F.col("genres").rlike(f"(?i){genre}" if ignore_case else genre))


def lookup_items(movies: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalogue rows for a table of ids, with ``found`` false where the id is unknown."""
    hits = movies.withColumn("found", F.lit(True))
    return wanted.select("movieId").join(hits, "movieId", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def user_history(ratings: DataFrame, user_id: int) -> DataFrame:
    """Rows of one user; the predicate reaches the scan."""
    return ratings.where(F.col("userId") == user_id)


def split_valid(submissions: DataFrame, min_movie_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rating rows."""
    marked = submissions.withColumn("__ok", is_valid_rating("rating", "movieId", min_movie_id))
    return marked.where("__ok").drop("__ok"), marked.where(~F.col("__ok")).drop("__ok")
