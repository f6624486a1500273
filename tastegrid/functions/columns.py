"""Column expressions: everything here stays on the JVM side.

Arguments named ``*_col`` may be column names or ``Column`` objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rating data model.
MIN_RATING = 0.5
MAX_RATING = 5.0
RATING_STEP = 0.5
LIKED_RATING = 3.5
RELEVANT_RATING = 4.0
COLD_START_RATINGS = 5
# Fixed upper bound of a served list.
LONGEST_LIST = 50
ACTIVE_RATINGS = 20
POPULARITY_WEIGHT = 0.6
GENRE_WEIGHT = 0.4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def genre_tokens(genres_col: Column | str) -> Column:
    """``"A|B"`` to ``["A", "B"]``; null stays null."""
    return F.split(_col(genres_col), "[|]")


def genre_set(genres_col: Column | str) -> Column:
    """Distinct genres in sorted order, so equal sets compare equal as keys."""
    return F.array_sort(F.array_distinct(genre_tokens(genres_col)))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays read as sets; 0 for an empty union or a null side."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(left.isNull() | right.isNull(), 0.0).when(union > 0, shared / union).otherwise(0.0)


def genre_match(preferred: Column, genres: Column) -> Column:
    """Share of the preferred list that the genres cover."""
    return F.size(F.array_intersect(preferred, genres)) / F.size(preferred)


def bayesian_average(n: Column, avg: Column, m: Column, prior: Column) -> Column:
    """``n/(n+m)*avg + m/(n+m)*prior``."""
    return (n / (n + m)) * avg + (m / (n + m)) * prior


def blend_score(popularity: Column, match: Column) -> Column:
    """Popularity on a 0..1 scale blended with the genre match."""
    return F.lit(POPULARITY_WEIGHT) * popularity / F.lit(MAX_RATING) + F.lit(GENRE_WEIGHT) * match


def clip_rating(c: Column) -> Column:
    return F.greatest(F.lit(MIN_RATING), F.least(F.lit(MAX_RATING), c))


def is_valid_rating(rating: Column | str, movie_id: Column | str, min_movie_id: int = 1) -> Column:
    """Half-star value inside the scale and an item id that is at least ``min_movie_id``.

    Never null: a missing value is invalid.
    """
    r = _col(rating)
    ok = (
        r.between(MIN_RATING, MAX_RATING)
        & (r / RATING_STEP == F.floor(r / RATING_STEP))
        & (_col(movie_id) >= min_movie_id)
    )
    return F.coalesce(ok, F.lit(False))


def epoch_seconds(ntz: Column | str) -> Column:
    """Seconds since 1970 of a zone-free timestamp, whatever the session time zone is."""
    t = _col(ntz)
    days = F.unix_date(F.to_date(t)).cast("bigint")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def utc_datetime(epoch: Column | str) -> Column:
    """Zone-free UTC timestamp of epoch seconds, whatever the session time zone is."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(secs=_col(epoch).cast("decimal(18,6)"))


def day_index(ts: Column | str) -> Column:
    """Day of week, Monday = 0."""
    return F.weekday(_col(ts))


# A prime below 2**31 and two multipliers below 2**30: no product leaves the bigint range.
_PRIME = 2147483647
_USER_FACTOR = 1000003
_ITEM_FACTOR = 998244353
_SEED_FACTOR = 7919


def pair_hash(user: Column | str, movie: Column | str, seed: int = 42) -> Column:
    """Hash of a (user, item) pair in 0 .. 2**31 - 2.

    Integer arithmetic only, so it runs inside generated code and any SQL engine can repeat
    it: a linear mix of the keys, raised to the fifth power modulo the prime (a permutation,
    because 5 does not divide the prime minus 1).
    """
    p = F.lit(_PRIME).cast("bigint")
    x = F.pmod(
        F.pmod(_col(user), p) * _USER_FACTOR + F.pmod(_col(movie), p) * _ITEM_FACTOR + seed * _SEED_FACTOR, p
    )
    square = F.pmod(x * x, p)
    return F.pmod(F.pmod(square * square, p) * x, p)


def pair_bucket(user: Column | str, movie: Column | str, seed: int = 42, buckets: int = 10) -> Column:
    """Stable bucket of a (user, item) pair.

    The bucket depends on the key and the seed only, so it survives retries and
    repartitioning and keeps repeated ratings of one pair together.
    """
    return F.pmod(pair_hash(user, movie, seed), F.lit(buckets)).cast("int")


def activity_class(n: Column | str) -> Column:
    """Activity class of a user by number of ratings."""
    n = _col(n)
    return (
        F.when(n == 0, "new_user")
        .when(n < COLD_START_RATINGS, "cold_start")
        .when(n < ACTIVE_RATINGS, "moderate")
        .otherwise("active")
    )


def service_tier(n: Column | str) -> Column:
    """Recommendation type by number of ratings."""
    n = _col(n)
    return (
        F.when(n == 0, "cold_start").when(n < COLD_START_RATINGS, "genre_based").otherwise("personalized")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)
