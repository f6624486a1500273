"""Recommendations for users with no or short histories, for all users in one job.

A user's list depends only on a preference set and on the items to leave out. So the
catalogue is ranked once per distinct set, users take as many rows of their set's list
as they could lose plus n, and one anti join on (user, item) removes what they rated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import genre_tokens
from tastegrid.functions.columns import COLD_START_RATINGS, LIKED_RATING, LONGEST_LIST
from tastegrid.operators.overlap import leading_items, numbered_sets, rank_for_sets
from tastegrid.operators.popularity import popular_order, popularity_quantile
from tastegrid.operators.profile import with_history_size
from tastegrid.plans.ranking import check_n, top_n_per_key
from tastegrid.plans.skew import row_counts, salted_join
from tastegrid.sources.session import materialize

# List depths are computed in steps, so that one long history does not lengthen every list.
DEPTH_STEPS = (128, 1024, 16384)

NO_GENRES: list[str] = []
# The number of the empty set, beside the dense ones of the others.
NO_SET = -1

LIST_COLUMNS = ["userId", "rank", "movieId", "title", "genres", "score", "num_ratings", "recommendation_type"]


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """One row per (user, item): the latest rating, the higher one at equal times.

    A rating without a time comes before all others; rows without a rating are left out.
    """
    order = [F.col("timestamp"), F.col("rating")] if "timestamp" in ratings.columns else [F.col("rating")]
    last = F.max(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).alias("last")
    return (
        ratings.where(F.col("rating").isNotNull())
        .groupBy("userId", "movieId")
        .agg(last)
        .select("userId", "movieId", F.col(f"last.k{len(order) - 1}").alias("rating"))
    )


def liked_genres(ratings: DataFrame, movies: DataFrame, liked: float = LIKED_RATING) -> DataFrame:
    """(userId, genre, n) over the items a user liked."""
    chosen = latest_ratings(ratings).where(F.col("rating") >= liked).select("userId", "movieId")
    tokens = movies.where(F.col("genres").isNotNull()).select(
        "movieId", genre_tokens("genres").alias("tokens")
    )
    return (
        chosen.join(tokens, "movieId")
        .select("userId", F.explode("tokens").alias("genre"))
        .groupBy("userId", "genre")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def preference_sets(
    ratings: DataFrame, movies: DataFrame, top: int | None = 3, liked: float = LIKED_RATING
) -> DataFrame:
    """(userId, set_key): the ``top`` most frequent liked genres, or all with ``top`` None.

    At equal counts the genre that comes first in the alphabet wins. Users who like
    nothing have no row.
    """
    counts = liked_genres(ratings, movies, liked)
    if top is not None:
        counts = top_n_per_key(counts, "userId", [F.desc("n"), F.asc("genre")], top, "place")
    return counts.groupBy("userId").agg(F.array_sort(F.collect_set("genre")).alias("set_key"))


def ranked_lists(sets: DataFrame, popularity: DataFrame, depth: int, matching: bool = True) -> DataFrame:
    """(set_key, rank, movieId, score) to ``depth`` rows; the empty set stands for pure popularity.

    Sets that come with a ``set_id`` have that in the place of the key (see ``rank_for_sets``); the empty set's is ``NO_SET``.
    """
    key = "set_id" if "set_id" in sets.columns else "set_key"
    none = F.lit(NO_SET) if key == "set_id" else F.lit(NO_GENRES).cast("array<string>")
    leading = (
        popularity.select("movieId", "popularity_score")
        .orderBy(*popular_order())
        .limit(depth)
        .withColumn(key, none)
    )
    by_popularity = top_n_per_key(leading, key, popular_order(), depth).select(
        key, "rank", "movieId", F.col("popularity_score").alias("score")
    )
    if not matching:
        return by_popularity
    return rank_for_sets(sets.where(F.size("set_key") > 0), popularity, depth).select(
        key, "rank", "movieId", "score"
    ).unionByName(by_popularity)


def first_unseen(
    users: DataFrame,
    popularity: DataFrame,
    seen: DataFrame,
    n: int,
    longest: int,
    matching: bool = True,
) -> DataFrame:
    """First ``n`` items per user from the list of the user's ``set_key`` that are not in ``seen``.

    ``users`` has userId, set_key and history (an upper bound of the user's rows in ``seen``).
    A user reads n + history list rows, which leaves n whatever the exclusions are; all
    users together read no more than n per user plus one per rating. ``longest`` is the
    largest history. Sets are numbered first: neither users nor list rows carry their genres along.
    """
    deepest = n + longest
    bounds = [*[d for d in DEPTH_STEPS if d < deepest], deepest]
    want = (F.lit(n) + F.col("history")).cast("bigint")
    wanted = users.select("userId", "set_key", want.alias("want"))
    number = F.lit(NO_SET).alias("set_id")
    if matching:
        keys = numbered_sets(wanted.where(F.size("set_key") > 0).select("set_key"), "set_key", "set_id")
        wanted = wanted.join(keys, "set_key", "left")
        number = F.coalesce("set_id", F.lit(NO_SET)).alias("set_id")
    wanted = materialize(wanted.select("userId", number, "want"), "wanted")
    parts, low = [], 0
    for high in bounds:
        group = wanted.where((F.col("want") > low) & (F.col("want") <= high))
        sets = group.select("set_id").distinct()
        if matching:
            sets = keys if len(bounds) == 1 else materialize(keys.join(sets, "set_id", "left_semi"), "sets")
        lists = ranked_lists(sets, popularity, high, matching).withColumnRenamed("rank", "list_rank")
        weights = group.groupBy("set_id").agg(F.sum("want").alias("rows"))
        parts.append(
            salted_join(
                group,
                lists,
                "set_id",
                weights,
                "rows",
                "inner",
                condition=lambda u, r: r["list_rank"] <= u["want"],
            ).select("userId", "list_rank", "movieId", "score")
        )
        low = high
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    left = candidates.join(seen.select("userId", "movieId"), ["userId", "movieId"], "left_anti")
    return top_n_per_key(left, "userId", [F.asc("list_rank")], n).drop("list_rank")


def longest_history(users: DataFrame, catalogue: DataFrame) -> int:
    """Largest ``num_ratings`` of the users, at most the number of rated items: one number for the driver."""
    row = users.agg(F.max("num_ratings").alias("h")).collect()[0]
    if not row.h or row.h <= DEPTH_STEPS[0]:
        return int(row.h or 0)
    return int(min(row.h, catalogue.count()))


def with_item_text(recs: DataFrame, popularity: DataFrame, decimals: int = 2) -> DataFrame:
    """Adds title, genres, popularity_score (rounded) and num_ratings of the item."""
    text = popularity.select(
        "movieId",
        "title",
        "genres",
        F.round("popularity_score", decimals).alias("popularity_score"),
        F.col("num_ratings").alias("item_ratings"),
    )
    return recs.join(text, "movieId", "left")


def genre_based(preferences: DataFrame, popularity: DataFrame, n: int = 10, exclude: DataFrame | None = None) -> DataFrame:
    """Top items per preference list; ``preferences`` has a key ``userId`` and ``genres`` array.

    Rows are (userId, rank, movieId, score, title, genres, popularity_score, num_ratings), the last four of the
    item. ``exclude`` has (userId, movieId) rows to leave out. Repeated genres in a list count once.
    """
    check_n(n)
    lists = _genre_lists(preferences, popularity, n, exclude)
    named = with_item_text(lists.select("userId", "rank", "movieId", "score"), popularity)
    return named.withColumnRenamed("item_ratings", "num_ratings")


def _genre_lists(preferences: DataFrame, popularity: DataFrame, n: int, exclude: DataFrame | None) -> DataFrame:
    keyed = preferences.select(
        "userId", F.array_sort(F.array_distinct("genres")).alias("set_key")
    ).where(F.size("set_key") > 0)
    if exclude is None:
        lists = ranked_lists(keyed.select("set_key").distinct(), popularity, n)
        weights = row_counts(keyed, "set_key")
        return salted_join(keyed, lists, "set_key", weights, "__rows", "inner").drop("set_key")
    keyed = materialize(keyed, "preferences")
    seen = materialize(exclude.select("userId", "movieId").distinct(), "rated")
    sizes = materialize(with_history_size(seen, keyed), "histories")
    longest = longest_history(sizes, popularity)
    users = keyed.join(sizes, "userId").withColumn("history", F.col("num_ratings"))
    return first_unseen(users, popularity, seen, n, longest)


def hybrid(
    ratings: DataFrame,
    popularity: DataFrame,
    movies: DataFrame,
    users: DataFrame,
    n: int = 10,
    top_genres: int | None = 3,
) -> DataFrame:
    """Lists for ``users`` (userId, num_ratings) by their liked genres, popular items for the rest.

    Rated items are left out. ``ratings`` must hold at least the rows of the users. The
    result keeps ``num_ratings``. The preference of each user is written as a table first:
    it is small beside the ratings and used several times.
    """
    check_n(n)
    sets = preference_sets(ratings, movies, top_genres)
    profile = materialize(
        users.join(sets, "userId", "left").select(
            "userId",
            "num_ratings",
            F.coalesce("set_key", F.lit(NO_GENRES).cast("array<string>")).alias("set_key"),
        ),
        "preferences",
    )
    longest = longest_history(profile, popularity)
    keyed = profile.withColumn("history", F.least(F.col("num_ratings"), F.lit(longest)))
    lists = first_unseen(keyed, popularity, ratings.where(F.col("rating").isNotNull()), n, longest)
    return lists.join(profile.select("userId", "num_ratings", "set_key"), "userId")


def popular_for_users(ratings: DataFrame, popularity: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """Most popular items each user has not rated.

    There is one list, so only ratings of its first n + longest items can remove anything: these are stored, and a user reads as
    many rows more than n as the user has of them.
    """
    check_n(n)
    sized = materialize(with_history_size(ratings, users), "histories")
    depth = n + longest_history(sized, popularity)
    leading = popularity.orderBy(*popular_order()).limit(depth).select("movieId")
    rated = ratings.select("userId", "movieId").join(leading_items(leading, depth), "movieId", "left_semi")
    seen = materialize(rated.select("userId", "movieId").distinct(), "rated-leading")
    keyed = sized.join(row_counts(seen, "userId", "history"), "userId", "left").select(
        "userId",
        F.lit(NO_GENRES).cast("array<string>").alias("set_key"),
        F.coalesce("history", F.lit(0)).alias("history"),
    )
    longest = keyed.agg(F.max("history")).first()[0] or 0
    return first_unseen(keyed, popularity, seen, n, longest, matching=False)


def stored_popularity(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """The popularity table, computed once and written: every later step reads it several times."""
    return materialize(popularity_quantile(ratings, movies), "popularity")


def _labelled(lists: DataFrame, popularity: DataFrame, label: Column) -> DataFrame:
    return with_item_text(lists, popularity).select(
        "userId",
        "rank",
        "movieId",
        "title",
        "genres",
        "score",
        "num_ratings",
        label.alias("recommendation_type"),
    )


def route_cold_start(
    ratings: DataFrame,
    movies: DataFrame,
    users: DataFrame,
    n: int = 10,
    min_ratings: int = COLD_START_RATINGS,
    popularity: DataFrame | None = None,
) -> DataFrame:
    """Hybrid lists for all users, labelled by the size of the history."""
    popularity = popularity or stored_popularity(ratings, movies)
    lists = hybrid(ratings, popularity, movies, with_history_size(ratings, users), n)
    label = (
        F.when(F.col("num_ratings") == 0, "cold_start_popular")
        .when(F.col("num_ratings") < min_ratings, "cold_start_hybrid")
        .otherwise("collaborative_filtering_ready")
    )
    return _labelled(lists, popularity, label)


def short_histories(ratings: DataFrame, min_ratings: int = COLD_START_RATINGS) -> DataFrame:
    """Ratings of users below ``min_ratings``; hot users are dropped before any shuffle of rows."""
    counts = row_counts(ratings, "userId")
    short = counts.where(F.col("__rows") < min_ratings).select("userId")
    return salted_join(ratings, short, "userId", counts, "__rows", "left_semi")


def route_service_cold(
    ratings: DataFrame,
    movies: DataFrame,
    users: DataFrame,
    n: int = 10,
    min_ratings: int = COLD_START_RATINGS,
    popularity: DataFrame | None = None,
) -> DataFrame:
    """Service routing for users below ``min_ratings``: popular, or all liked genres; ``n`` is at most 50."""
    check_n(n, LONGEST_LIST)
    popularity = popularity or stored_popularity(ratings, movies)
    sized = with_history_size(ratings, users).where(F.col("num_ratings") < min_ratings)
    short = materialize(short_histories(ratings, min_ratings), "short-histories")
    lists = hybrid(short, popularity, movies, sized, n, top_genres=None)
    label = F.when(F.col("num_ratings") == 0, "cold_start").otherwise("genre_based")
    return _labelled(lists, popularity, label)
