"""Catalogue and rating statistics.

Every count per user or item is a map-side combined aggregate, so a key with most of
the rows costs no more than any other. Item text is joined after the aggregation, when
one row per item is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import activity_class, genre_tokens, is_valid_rating, utc_datetime
from tastegrid.functions.columns import COLD_START_RATINGS
from tastegrid.plans.ranking import check_n, exact_percentile, value_counts


def rows() -> Column:
    return F.count(F.lit(1))


def ratings_per(ratings: DataFrame, key: str) -> DataFrame:
    """Number of ratings per user or per item."""
    return ratings.groupBy(key).agg(rows().alias("num_ratings"))


def item_stats(ratings: DataFrame) -> DataFrame:
    """Count and mean per item."""
    return ratings.groupBy("movieId").agg(
        F.count("rating").alias("num_ratings"), F.avg("rating").alias("avg_rating")
    )


def rating_stats(ratings: DataFrame) -> DataFrame:
    """Totals, distinct users and items, mean and range.

    Users are counted as the rows of a grouped table: two distinct counts in one aggregate would
    copy every rating. The table also carries the other figures.
    """
    per_user = ratings.groupBy("userId").agg(
        rows().alias("n"),
        F.sum("rating").alias("s"),
        F.count("rating").alias("c"),
        F.min("rating").alias("low"),
        F.max("rating").alias("high"),
    )
    items = ratings.select("movieId").distinct().agg(F.count("movieId")).scalar()
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_ratings"),
        F.count("userId").alias("num_users"),
        items.alias("num_movies"),
        (F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("avg_rating"),
        F.min("low").alias("min_rating"),
        F.max("high").alias("max_rating"),
    )


def catalogue_stats(movies: DataFrame) -> DataFrame:
    return movies.agg(
        rows().alias("total_movies"), F.countDistinct("genres").alias("unique_genre_combinations")
    )


def dataset_statistics(ratings: DataFrame) -> DataFrame:
    """:func:`rating_stats` plus sparsity; an empty table has sparsity null."""
    stats = rating_stats(ratings).withColumnRenamed("total_ratings", "num_ratings")
    cells = F.col("num_users") * F.col("num_movies")
    return stats.withColumn("sparsity", F.when(cells > 0, 1 - F.col("num_ratings") / cells))


def popular_items(
    ratings: DataFrame, movies: DataFrame, min_ratings: int = 50, limit: int = 100
) -> DataFrame:
    """Items with at least ``min_ratings`` ratings, most rated first.

    Ratings are reduced to one row per item before the join. Repeated catalogue rows
    multiply the count, as a join of the raw tables would.
    """
    check_n(limit)
    catalogue = movies.groupBy("movieId", "title", "genres").agg(rows().alias("__copies"))
    return (
        catalogue.join(item_stats(ratings), "movieId")
        .withColumn("num_ratings", F.col("num_ratings") * F.col("__copies"))
        .where(F.col("num_ratings") >= min_ratings)
        .select("movieId", "title", "genres", "num_ratings", "avg_rating")
        .orderBy(F.desc("num_ratings"), "movieId")
        .limit(limit)
    )


def most_rated(ratings: DataFrame, movies: DataFrame, n: int = 10) -> DataFrame:
    """Top items by number of ratings, with mean."""
    check_n(n)
    return (
        item_stats(ratings)
        .join(movies, "movieId")
        .select("movieId", "title", "num_ratings", "avg_rating")
        .orderBy(F.desc("num_ratings"), "movieId")
        .limit(n)
    )


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """Count and share per rating value, in value order."""
    counts = value_counts(ratings, "rating", "num_ratings")
    total = ratings.agg(F.count("rating")).scalar()
    return (
        counts.where(F.col("rating").isNotNull())
        .withColumn("share", F.col("num_ratings") / total)
        .orderBy("rating")
    )


def rating_moments(ratings: DataFrame) -> DataFrame:
    """Mean, median, sample deviation and mode, from the counts per value."""
    counts = value_counts(ratings.where(F.col("rating").isNotNull()), "rating", "n")
    r, n = F.col("rating"), F.col("n")
    sums = counts.agg(
        F.sum(n).alias("n"),
        F.sum(r * n).alias("s"),
        F.sum(r * r * n).alias("q"),
        F.percentile(r, F.lit(0.5), n).alias("median_rating"),
        F.max_by(r, F.struct(n, -r)).alias("mode_rating"),
    )
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    return sums.select(
        (s / n).alias("mean_rating"),
        "median_rating",
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))).alias("std_rating"),
        "mode_rating",
    )


def activity_summary(ratings: DataFrame) -> DataFrame:
    """Users, and mean, median, max and min of ratings per user."""
    users = value_counts(ratings_per(ratings, "userId"), "num_ratings", "users")
    n, w = F.col("num_ratings"), F.col("users")
    return users.agg(
        F.sum(w).alias("num_users"),
        (F.sum(n * w) / F.sum(w)).alias("mean_ratings"),
        F.percentile(n, F.lit(0.5), w).alias("median_ratings"),
        F.max(n).alias("max_ratings"),
        F.min(n).alias("min_ratings"),
    )


def activity_classes(ratings: DataFrame) -> DataFrame:
    """Users per activity class with percentage."""
    users = ratings_per(ratings, "userId")
    total = users.agg(rows()).scalar()
    return (
        users.groupBy(activity_class("num_ratings").alias("category"))
        .agg(rows().alias("num_users"))
        .withColumn("percentage", F.col("num_users") * 100.0 / total)
    )


def with_history_size(ratings: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Ratings per user; users of the optional table without ratings count 0."""
    counts = ratings_per(ratings, "userId")
    if users is None:
        return counts
    return (
        users.select("userId")
        .distinct()
        .join(counts, "userId", "left")
        .select("userId", F.coalesce("num_ratings", F.lit(0)).alias("num_ratings"))
    )


def cold_start_distribution(ratings: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """User count and history size per activity class."""
    return (
        with_history_size(ratings, users)
        .groupBy(activity_class("num_ratings").alias("category"))
        .agg(
            rows().alias("user_count"),
            F.avg("num_ratings").alias("avg_ratings"),
            F.min("num_ratings").alias("min_ratings"),
            F.max("num_ratings").alias("max_ratings"),
        )
    )


def cold_start_percentage(ratings: DataFrame, min_ratings: int = COLD_START_RATINGS) -> DataFrame:
    """Users, users with fewer than ``min_ratings`` ratings, and their percentage."""
    cold = F.when(F.col("num_ratings") < min_ratings, 1).otherwise(0)
    return ratings_per(ratings, "userId").agg(
        rows().alias("total_users"),
        F.sum(cold).alias("cold_start_users"),
        (F.avg(cold) * 100).alias("cold_start_percentage"),
    )


def genre_frequency(movies: DataFrame, n: int | None = None) -> DataFrame:
    """Items per genre, most frequent first."""
    counts = (
        movies.select(F.explode(genre_tokens("genres")).alias("genre"))
        .groupBy("genre")
        .agg(rows().alias("num_movies"))
        .orderBy(F.desc("num_movies"), "genre")
    )
    return counts.limit(check_n(n)) if n is not None else counts


def genre_combinations(movies: DataFrame, n: int = 10) -> DataFrame:
    """Most common genre strings."""
    return (
        movies.where(F.col("genres").isNotNull())
        .groupBy("genres")
        .agg(rows().alias("num_movies"))
        .orderBy(F.desc("num_movies"), "genres")
        .limit(check_n(n))
    )


def genre_list(movies: DataFrame) -> DataFrame:
    """Distinct genres in order."""
    return movies.select(F.explode(genre_tokens("genres")).alias("genre")).distinct().orderBy("genre")


def genre_bridge(movies: DataFrame) -> DataFrame:
    """(movieId, genre) rows; null genres give none."""
    return movies.select("movieId", F.explode(genre_tokens("genres")).alias("genre"))


def genre_stats(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Mean and count of ratings per genre.

    The many-to-many join runs on one row per item: sums and counts add up, so the
    ratings themselves are never repeated per genre.
    """
    sums = ratings.groupBy("movieId").agg(F.sum("rating").alias("s"), F.count("rating").alias("c"))
    return (
        genre_bridge(movies)
        .join(sums, "movieId")
        .groupBy("genre")
        .agg((F.sum("s") / F.sum("c")).alias("avg_rating"), F.sum("c").alias("num_ratings"))
    )


def ratings_by_year(ratings: DataFrame) -> DataFrame:
    return (
        ratings.groupBy(F.year(utc_datetime("timestamp")).alias("year"))
        .agg(rows().alias("num_ratings"))
        .orderBy("year")
    )


def rating_period(ratings: DataFrame) -> DataFrame:
    """First and last rating time."""
    return ratings.agg(
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp")
    ).select(
        utc_datetime("first_timestamp").alias("first_rating"),
        utc_datetime("last_timestamp").alias("last_rating"),
    )


def count_histogram(ratings: DataFrame, key: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram of ratings per ``key``; the last bin includes the maximum.

    Counts of counts are binned, so the scan is reduced twice before the last step.
    All bins are returned, empty ones with 0.
    """
    check_n(bins)
    sizes = value_counts(ratings_per(ratings, key), "num_ratings", "keys")
    span = sizes.agg(F.struct(F.min("num_ratings").alias("lo"), F.max("num_ratings").alias("hi"))).scalar()
    binned = (
        sizes.withColumn("__s", span)
        .withColumn("lo", F.col("__s.lo"))
        .withColumn("width", F.col("__s.hi") - F.col("__s.lo"))
        .withColumn(
            "bin",
            # equal values: the range is widened by a half to both sides, as usual for histograms
            F.when(F.col("width") == 0, F.lit(bins // 2 + 1)).otherwise(
                F.least(
                    F.floor((F.col("num_ratings") - F.col("lo")) * bins / F.col("width")) + 1, F.lit(bins)
                )
            ).cast("int"),
        )
        .groupBy("bin")
        .agg(F.sum("keys").alias("num_keys"))
    )
    edges = (
        sizes.agg(F.min("num_ratings").alias("lo"), F.max("num_ratings").alias("hi"))
        .where(F.col("lo").isNotNull())
        .select(
            F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
            F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"),
        )
    )
    step = (F.col("hi") - F.col("lo")) / bins
    return (
        edges.join(binned, "bin", "left")
        .select(
            "bin",
            (F.col("lo") + step * (F.col("bin") - 1)).alias("lower"),
            (F.col("lo") + step * F.col("bin")).alias("upper"),
            F.coalesce("num_keys", F.lit(0)).alias("num_keys"),
        )
        .orderBy("bin")
    )


def count_boxplot(ratings: DataFrame, key: str) -> DataFrame:
    """Quartiles of ratings per ``key``, whiskers at 1.5 IQR and the number of outliers."""
    sizes = value_counts(ratings_per(ratings, key), "num_ratings", "keys")
    n, w = F.col("num_ratings"), F.col("keys")
    quartiles = sizes.agg(
        F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), w).alias("q")
    ).scalar()
    marked = (
        sizes.withColumn("q", quartiles)
        .withColumn("iqr", F.col("q")[2] - F.col("q")[0])
        .withColumn(
            "inside",
            n.between(F.col("q")[0] - 1.5 * F.col("iqr"), F.col("q")[2] + 1.5 * F.col("iqr")),
        )
    )
    return marked.agg(
        F.first(F.col("q")[0]).alias("q1"),
        F.first(F.col("q")[1]).alias("median"),
        F.first(F.col("q")[2]).alias("q3"),
        F.min(F.when(F.col("inside"), n)).alias("whisker_low"),
        F.max(F.when(F.col("inside"), n)).alias("whisker_high"),
        F.sum(F.when(F.col("inside"), 0).otherwise(w)).alias("num_outliers"),
    )


def _nulls(name: str):
    return F.count_if(F.col(name).isNull())


def data_quality(ratings: DataFrame, movies: DataFrame, min_movie_id: int = 1) -> DataFrame:
    """One row per check with its count."""
    items = movies.agg(
        rows().alias("movies_rows"),
        _nulls("movieId").alias("movies_null_movieId"),
        _nulls("title").alias("movies_null_title"),
        _nulls("genres").alias("movies_null_genres"),
        (
            rows() - F.countDistinct("movieId") - F.max(F.col("movieId").isNull().cast("int"))
        ).alias("movies_duplicate_movieId"),
    )
    facts = ratings.agg(
        rows().alias("ratings_rows"),
        _nulls("userId").alias("ratings_null_userId"),
        _nulls("movieId").alias("ratings_null_movieId"),
        _nulls("rating").alias("ratings_null_rating"),
        _nulls("timestamp").alias("ratings_null_timestamp"),
        F.count_if(~is_valid_rating("rating", F.lit(min_movie_id), min_movie_id)).alias(
            "ratings_invalid_value"
        ),
    )

    def long_form(df: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n")) for c in df.columns]
        return df.select(F.inline(F.array(*pairs)))

    return long_form(items).unionByName(long_form(facts)).select(
        "check", F.coalesce("n", F.lit(0)).alias("n")
    )


def referential_integrity(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Ratings without a catalogue item and catalogue items without a rating.

    Ratings are counted per item first; the anti joins run on one row per item.
    """
    per_item = ratings_per(ratings, "movieId")
    orphans = per_item.join(movies, "movieId", "left_anti").agg(
        F.coalesce(F.sum("num_ratings"), F.lit(0)).alias("orphan_ratings"),
        rows().alias("orphan_movies"),
    )
    unrated = movies.join(per_item, "movieId", "left_anti").agg(rows())
    return orphans.withColumn("unrated_movies", unrated.scalar())


def catalogue_facts(ratings: DataFrame, movies: DataFrame, top: int = 10) -> DataFrame:
    """Share of items rated, share of ratings on the top items, mean genres per item."""
    per_item = ratings_per(ratings, "movieId")
    leading = per_item.orderBy(F.desc("num_ratings"), "movieId").limit(top).agg(F.sum("num_ratings"))
    rated = movies.join(per_item, "movieId", "left_semi").agg(rows())
    return (
        movies.agg(rows().alias("n"), F.avg(F.size(genre_tokens("genres"))).alias("mean_genres"))
        .withColumn("share_rated", F.try_divide(rated.scalar(), F.col("n")))
        .withColumn("top_share", F.try_divide(leading.scalar(), per_item.agg(F.sum("num_ratings")).scalar()))
        .select("share_rated", "top_share", "mean_genres")
    )


def count_percentile(ratings: DataFrame, key: str, p: float) -> DataFrame:
    """Exact percentile of ratings per ``key``."""
    return exact_percentile(ratings_per(ratings, key), "num_ratings", p)
