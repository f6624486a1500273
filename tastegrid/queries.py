"""The registered queries: name, Spark form and SQL twin side by side.

Each callable takes (spark, sf_dir) and reads the given tables whole. Fractions are rounded
to six places, because sums of doubles depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid import jobs
from tastegrid import oracle as O
from tastegrid.functions import is_valid_rating
from tastegrid.operators import (
    coldstart,
    factor,
    metrics,
    popularity,
    predict,
    prepare,
    profile,
    route,
    search,
    similar,
    tuning,
)
from tastegrid.oracle import sql
from tastegrid.sources import sinks, tables
from tastegrid.sources.session import materialize, work_folder
from tastegrid.streaming import ratings as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    return df.select(
        *[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def query(twin: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Inputs(spark, sf_dir)))

        QUERIES[fn.__name__] = run
        if twin is not None:
            ORACLES[fn.__name__] = twin
        return fn

    return register


class Inputs:
    """The canonical views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def ratings(self) -> DataFrame:
        return tables.star_ratings(self.spark, self.sf_dir)

    @property
    def split(self) -> tuple[DataFrame, DataFrame]:
        """(train, test) of the ratings view, which is joined once and stored for several passes."""
        return prepare.hash_split(materialize(self.ratings, "ratings"))

    @property
    def movies(self) -> DataFrame:
        return tables.star_movies(self.spark, self.sf_dir)

    @property
    def baskets(self) -> DataFrame:
        return tables.star_baskets(self.spark, self.sf_dir)

    @property
    def basket_users(self) -> DataFrame:
        return tables.star_basket_users(self.spark, self.sf_dir)

    @property
    def users(self) -> DataFrame:
        return tables.star_users(self.spark, self.sf_dir)

    @property
    def submissions(self) -> DataFrame:
        return tables.star_submissions(self.spark, self.sf_dir)

    @property
    def vectors(self) -> DataFrame:
        return tables.star_vectors(self.spark, self.sf_dir)


# ---------------------------------------------------------------- statistics


@query(
    sql(
        """SELECT movieId, title, genres, count(*) AS num_ratings, round(avg(rating), 6) AS avg_rating
        FROM movies JOIN ratings USING (movieId) GROUP BY movieId, title, genres
        HAVING count(*) >= 20 ORDER BY num_ratings DESC, movieId LIMIT 100""",
        "movies",
        "ratings",
    )
)
def popular_items(t: Inputs) -> DataFrame:
    return profile.popular_items(t.ratings, t.movies, min_ratings=20, limit=100)


@query(
    sql(
        """SELECT count(*) AS total_ratings, count(DISTINCT userId) AS num_users,
        count(DISTINCT movieId) AS num_movies, round(avg(rating), 6) AS avg_rating,
        min(rating) AS min_rating, max(rating) AS max_rating FROM ratings""",
        "ratings",
    )
)
def rating_stats(t: Inputs) -> DataFrame:
    return profile.rating_stats(t.ratings)


@query(
    sql(
        """SELECT count(*) AS total_movies, count(DISTINCT genres) AS unique_genre_combinations
        FROM movies""",
        "movies",
    )
)
def item_stats(t: Inputs) -> DataFrame:
    return profile.catalogue_stats(t.movies)


@query(
    sql(
        """SELECT count(*) AS num_ratings, count(DISTINCT userId) AS num_users,
        count(DISTINCT movieId) AS num_movies, round(avg(rating), 6) AS avg_rating,
        min(rating) AS min_rating, max(rating) AS max_rating,
        round(1 - count(*) / (count(DISTINCT userId) * count(DISTINCT movieId)), 6) AS sparsity
        FROM ratings""",
        "ratings",
    )
)
def dataset_statistics(t: Inputs) -> DataFrame:
    return profile.dataset_statistics(t.ratings)


@query(sql("SELECT movieId, title, genres FROM movies", "movies"))
def scan_movies(t: Inputs) -> DataFrame:
    return t.movies


@query(sql('SELECT userId, movieId, rating, "timestamp" FROM ratings', "ratings"))
def scan_ratings(t: Inputs) -> DataFrame:
    return t.ratings


@query(
    sql(
        'SELECT * FROM ratings ORDER BY userId, movieId, "timestamp", rating LIMIT 500', "ratings"
    )
)
def limited_ratings(t: Inputs) -> DataFrame:
    return t.ratings.orderBy("userId", "movieId", "timestamp", "rating").limit(500)


@query(
    sql(
        f"""SELECT * FROM ratings
        WHERE {O.PAIR_HASH} % 100 < 5""",
        "ratings",
    )
)
def sampled_ratings(t: Inputs) -> DataFrame:
    return tables.sample_pairs(t.ratings, 5)


@query(
    sql(
        """SELECT rating, count(*) AS num_ratings,
        round(count(*) / (SELECT count(*) FROM ratings), 6) AS share
        FROM ratings GROUP BY rating ORDER BY rating""",
        "ratings",
    )
)
def rating_distribution(t: Inputs) -> DataFrame:
    return profile.rating_distribution(t.ratings)


@query(
    sql(
        """SELECT round(avg(rating), 6) AS mean_rating, quantile_cont(rating, 0.5) AS median_rating,
        round(stddev_samp(rating), 6) AS std_rating,
        (SELECT rating FROM ratings GROUP BY rating ORDER BY count(*) DESC, rating LIMIT 1) AS mode_rating
        FROM ratings""",
        "ratings",
    )
)
def rating_moments(t: Inputs) -> DataFrame:
    return profile.rating_moments(t.ratings)


@query(sql("SELECT userId, num_ratings FROM per_user", "per_user"))
def ratings_per_user(t: Inputs) -> DataFrame:
    return profile.ratings_per(t.ratings, "userId")


@query(
    sql("SELECT movieId, num_ratings, round(avg_rating, 6) AS avg_rating FROM per_item", "per_item")
)
def ratings_per_item(t: Inputs) -> DataFrame:
    return profile.item_stats(t.ratings)


@query(
    sql(
        """SELECT count(*) AS num_users, avg(num_ratings) AS mean_ratings,
        quantile_cont(num_ratings, 0.5) AS median_ratings, max(num_ratings) AS max_ratings,
        min(num_ratings) AS min_ratings
        FROM (SELECT userId, count(*) AS num_ratings FROM ratings GROUP BY userId)""".replace(
            "avg(num_ratings)", "round(avg(num_ratings), 6)"
        ),
        "ratings",
    )
)
def activity_summary(t: Inputs) -> DataFrame:
    return profile.activity_summary(t.ratings).withColumn("num_users", F.col("num_users").cast("bigint"))


CLASS_SQL = """CASE WHEN num_ratings = 0 THEN 'new_user' WHEN num_ratings < 5 THEN 'cold_start'
    WHEN num_ratings < 20 THEN 'moderate' ELSE 'active' END"""
SIZED_SQL = """SELECT u.userId, coalesce(c.n, 0) AS num_ratings FROM basket_users u LEFT JOIN
    (SELECT userId, count(*) AS n FROM baskets GROUP BY userId) c ON c.userId = u.userId"""


@query(
    sql(
        f"""SELECT {CLASS_SQL} AS category, count(*) AS num_users,
        round(count(*) * 100.0 / (SELECT count(*) FROM per_user), 6) AS percentage
        FROM per_user GROUP BY 1""",
        "per_user",
    )
)
def activity_classes(t: Inputs) -> DataFrame:
    return profile.activity_classes(t.ratings)


@query(
    sql(
        f"""SELECT {CLASS_SQL} AS category, count(*) AS user_count,
        round(avg(num_ratings), 6) AS avg_ratings, min(num_ratings) AS min_ratings,
        max(num_ratings) AS max_ratings FROM sized GROUP BY 1""",
        "baskets",
        "basket_users",
        sized=SIZED_SQL,
    )
)
def cold_start_distribution(t: Inputs) -> DataFrame:
    return profile.cold_start_distribution(t.baskets, t.basket_users)


@query(
    sql(
        """SELECT count(*) AS total_users, CAST(count(*) FILTER (num_ratings < 5) AS BIGINT) AS cold_start_users,
        round(count(*) FILTER (num_ratings < 5) / count(*) * 100, 6) AS cold_start_percentage
        FROM (SELECT userId, count(*) AS num_ratings FROM baskets GROUP BY userId)""",
        "baskets",
    )
)
def cold_start_pct(t: Inputs) -> DataFrame:
    return profile.cold_start_percentage(t.baskets)


def _histogram_sql(view: str) -> str:
    return sql(
        f"""SELECT b.bin, round(lo + (hi - lo) / 50.0 * (b.bin - 1), 6) AS lower,
        round(lo + (hi - lo) / 50.0 * b.bin, 6) AS upper, count(s.num_ratings) AS num_keys
        FROM (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS bin) b
        CROSS JOIN (SELECT min(num_ratings) AS lo, max(num_ratings) AS hi FROM {view}) e
        LEFT JOIN {view} s ON b.bin = least((s.num_ratings - lo) * 50 // (hi - lo) + 1, 50)
        GROUP BY b.bin, lo, hi""",
        view,
    )


@query(_histogram_sql("per_user"))
def activity_histogram(t: Inputs) -> DataFrame:
    return profile.count_histogram(t.ratings, "userId")


@query(_histogram_sql("per_item"))
def popularity_histogram(t: Inputs) -> DataFrame:
    return profile.count_histogram(t.ratings, "movieId")


@query(
    sql(
        """SELECT q1, median, q3, min(num_ratings) FILTER (inside) AS whisker_low,
        max(num_ratings) FILTER (inside) AS whisker_high,
        count(*) FILTER (NOT inside) AS num_outliers
        FROM (SELECT *, num_ratings BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
              FROM per_user, (SELECT quantile_cont(num_ratings, 0.25) AS q1,
                quantile_cont(num_ratings, 0.5) AS median, quantile_cont(num_ratings, 0.75) AS q3
                FROM per_user)) GROUP BY q1, median, q3""",
        "per_user",
    )
)
def activity_boxplot(t: Inputs) -> DataFrame:
    return profile.count_boxplot(t.ratings, "userId")


@query(
    sql("SELECT genre, count(*) AS num_movies FROM bridge GROUP BY genre", "bridge")
)
def genre_frequency(t: Inputs) -> DataFrame:
    return profile.genre_frequency(t.movies)


@query(
    sql(
        "SELECT genre, count(*) AS num_movies FROM bridge GROUP BY genre ORDER BY 2 DESC, 1 LIMIT 10",
        "bridge",
    )
)
def genre_frequency_top(t: Inputs) -> DataFrame:
    return profile.genre_frequency(t.movies, 10)


@query(
    sql(
        """SELECT genres, count(*) AS num_movies FROM movies GROUP BY genres
        ORDER BY num_movies DESC, genres LIMIT 10""",
        "movies",
    )
)
def genre_combinations(t: Inputs) -> DataFrame:
    return profile.genre_combinations(t.movies)


@query(sql("SELECT DISTINCT genre FROM bridge ORDER BY genre", "bridge"))
def genre_list(t: Inputs) -> DataFrame:
    return profile.genre_list(t.movies)


@query(sql("SELECT movieId, genre FROM bridge", "bridge"))
def genre_bridge(t: Inputs) -> DataFrame:
    return profile.genre_bridge(t.movies)


@query(
    sql(
        """SELECT genre, round(avg(rating), 6) AS avg_rating, count(rating) AS num_ratings
        FROM bridge JOIN ratings USING (movieId) GROUP BY genre""",
        "bridge",
        "ratings",
    )
)
def genre_stats(t: Inputs) -> DataFrame:
    return profile.genre_stats(t.ratings, t.movies)


def _long_features(wide: DataFrame) -> DataFrame:
    # Column names may differ by case only, so they are turned into values by position.
    flags = wide.columns[1:]
    numbered = wide.toDF("movieId", *[f"f{i}" for i in range(len(flags))])
    entries = [
        F.struct(F.lit(name).alias("feature"), F.col(f"f{i}").alias("flag")) for i, name in enumerate(flags)
    ]
    return numbered.select("movieId", F.inline(F.array(*entries)))


@query(
    sql(
        """SELECT m.movieId, 'genre_' || g.genre AS feature,
        CAST(contains(m.genres, g.genre) AS INTEGER) AS flag
        FROM movies m CROSS JOIN (SELECT DISTINCT genre FROM bridge) g""",
        "movies",
        "bridge",
    )
)
def genre_onehot(t: Inputs) -> DataFrame:
    return _long_features(prepare.genre_onehot(t.movies))


@query(
    sql(
        """SELECT m.movieId, 'genre_' || g.genre AS feature,
        CAST(list_contains(string_split(m.genres, '|'), g.genre) AS INTEGER) AS flag
        FROM movies m CROSS JOIN (SELECT DISTINCT genre FROM bridge) g""",
        "movies",
        "bridge",
    )
)
def genre_onehot_exact(t: Inputs) -> DataFrame:
    return _long_features(prepare.genre_onehot(t.movies, exact=True))


@query(
    sql(
        """SELECT movieId, title, num_ratings, round(avg_rating, 6) AS avg_rating
        FROM per_item JOIN movies USING (movieId) ORDER BY num_ratings DESC, movieId LIMIT 10""",
        "per_item",
        "movies",
    )
)
def most_rated(t: Inputs) -> DataFrame:
    return profile.most_rated(t.ratings, t.movies)


@query(
    sql(
        """SELECT round((SELECT count(*) FROM movies WHERE movieId IN (SELECT movieId FROM per_item))
            / (SELECT count(*) FROM movies), 6) AS share_rated,
        round((SELECT sum(num_ratings) FROM (SELECT num_ratings FROM per_item
            ORDER BY num_ratings DESC, movieId LIMIT 10)) / (SELECT count(*) FROM ratings), 6) AS top_share,
        (SELECT round(avg(len(string_split(genres, '|'))), 6) FROM movies) AS mean_genres""",
        "per_item",
        "movies",
    )
)
def catalog_facts(t: Inputs) -> DataFrame:
    return profile.catalogue_facts(t.ratings, t.movies)


@query(
    sql(
        """SELECT CAST(year(to_timestamp("timestamp") AT TIME ZONE 'UTC') AS INTEGER) AS year,
        count(*) AS num_ratings FROM ratings GROUP BY 1""".replace(
            "to_timestamp(\"timestamp\") AT TIME ZONE 'UTC'", "make_timestamp(\"timestamp\" * 1000000)"
        ),
        "ratings",
    )
)
def ratings_by_year(t: Inputs) -> DataFrame:
    return profile.ratings_by_year(t.ratings)


@query(
    sql(
        """SELECT make_timestamp(min("timestamp") * 1000000) AS first_rating,
        make_timestamp(max("timestamp") * 1000000) AS last_rating FROM ratings""",
        "ratings",
    )
)
def rating_period(t: Inputs) -> DataFrame:
    return profile.rating_period(t.ratings)


@query(
    sql(
        """SELECT userId, movieId, rating, "timestamp", datetime,
        CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month,
        CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week
        FROM (SELECT *, make_timestamp("timestamp" * 1000000) AS datetime FROM ratings)""",
        "ratings",
    )
)
def temporal_features(t: Inputs) -> DataFrame:
    return prepare.temporal_features(t.ratings)


@query(
    sql(
        """SELECT 'movies_rows' AS "check", count(*) AS n FROM movies
        UNION ALL SELECT 'movies_null_movieId', count(*) FILTER (movieId IS NULL) FROM movies
        UNION ALL SELECT 'movies_null_title', count(*) FILTER (title IS NULL) FROM movies
        UNION ALL SELECT 'movies_null_genres', count(*) FILTER (genres IS NULL) FROM movies
        UNION ALL SELECT 'movies_duplicate_movieId', count(*) - count(DISTINCT movieId) FROM movies
        UNION ALL SELECT 'ratings_rows', count(*) FROM ratings
        UNION ALL SELECT 'ratings_null_userId', count(*) FILTER (userId IS NULL) FROM ratings
        UNION ALL SELECT 'ratings_null_movieId', count(*) FILTER (movieId IS NULL) FROM ratings
        UNION ALL SELECT 'ratings_null_rating', count(*) FILTER (rating IS NULL) FROM ratings
        UNION ALL SELECT 'ratings_null_timestamp', count(*) FILTER ("timestamp" IS NULL) FROM ratings
        UNION ALL SELECT 'ratings_invalid_value', count(*) FILTER (NOT (rating BETWEEN 0.5 AND 5.0
            AND rating * 2 = floor(rating * 2))) FROM ratings""",
        "movies",
        "ratings",
    )
)
def data_quality(t: Inputs) -> DataFrame:
    return profile.data_quality(t.ratings, t.movies, min_movie_id=0)


@query(
    sql(
        """SELECT CAST(coalesce((SELECT sum(n) FROM per WHERE movieId NOT IN (SELECT movieId FROM movies)), 0) AS BIGINT) AS orphan_ratings,
        (SELECT count(*) FROM per WHERE movieId NOT IN (SELECT movieId FROM movies)) AS orphan_movies,
        (SELECT count(*) FROM movies WHERE movieId NOT IN (SELECT movieId FROM per)) AS unrated_movies""",
        "movies",
        "submissions",
        per="SELECT movieId, count(*) AS n FROM submissions GROUP BY movieId",
    )
)
def referential_integrity(t: Inputs) -> DataFrame:
    return profile.referential_integrity(t.submissions, t.movies)


# ------------------------------------------------------------- filters, lookups


@query(
    sql(
        """SELECT * FROM movies WHERE regexp_matches(title, 'RED.*#1', 'i') ORDER BY movieId LIMIT 10""",
        "movies",
    )
)
def search_title(t: Inputs) -> DataFrame:
    return search.search_title(t.movies, "RED.*#1", limit=10)


@query(
    sql("SELECT * FROM movies WHERE contains(lower(title), 'bolt #1') ORDER BY movieId LIMIT 20", "movies")
)
def search_title_literal(t: Inputs) -> DataFrame:
    return search.search_title(t.movies, "Bolt #1", limit=20, literal=True)


@query(sql("SELECT * FROM movies WHERE regexp_matches(genres, 'SMALL')", "movies"))
def genre_filter_cs(t: Inputs) -> DataFrame:
    return search.genre_filter(t.movies, "SMALL")


@query(sql("SELECT * FROM movies WHERE regexp_matches(genres, 'small', 'i')", "movies"))
def genre_filter_ci(t: Inputs) -> DataFrame:
    return search.genre_filter(t.movies, "small", ignore_case=True)


@query(
    sql("SELECT * FROM movies WHERE list_contains(string_split(genres, '|'), 'ring')", "movies")
)
def genre_filter_exact(t: Inputs) -> DataFrame:
    return search.genre_filter(t.movies, "ring", exact=True)


@query(
    sql(
        """SELECT w.movieId, m.title, m.genres, m.movieId IS NOT NULL AS found
        FROM (SELECT DISTINCT movieId FROM submissions UNION SELECT -1) w
        LEFT JOIN movies m ON m.movieId = w.movieId""",
        "submissions",
        "movies",
    )
)
def item_lookup(t: Inputs) -> DataFrame:
    wanted = t.submissions.select("movieId").union(t.submissions.select(F.lit(-1).cast("bigint"))).distinct()
    return search.lookup_items(t.movies, wanted)


@query(sql("SELECT * FROM ratings WHERE userId = 7", "ratings"))
def one_user_history(t: Inputs) -> DataFrame:
    return search.user_history(t.ratings, 7)


@query(
    sql(
        """SELECT event_id, userId, movieId, rating, coalesce(rating BETWEEN 0.5 AND 5.0
        AND rating * 2 = floor(rating * 2) AND movieId >= 1, false) AS valid FROM submissions""",
        "submissions",
    )
)
def rating_validity(t: Inputs) -> DataFrame:
    return t.submissions.select(
        "event_id", "userId", "movieId", "rating", is_valid_rating("rating", "movieId").alias("valid")
    )


@query(
    sql(
        "SELECT userId, movieId FROM latest WHERE rating >= 3.5",
        "ratings",
        latest=O.latest("ratings"),
    )
)
def liked_pairs(t: Inputs) -> DataFrame:
    latest = coldstart.latest_ratings(t.ratings)
    return latest.where(F.col("rating") >= 3.5).select("userId", "movieId")


# ---------------------------------------------------------------- preparation


@query(
    sql(
        """SELECT 'train' AS fold, count(*) AS n, round(avg(rating), 6) AS avg_rating FROM train
        UNION ALL SELECT 'test', count(*), round(avg(rating), 6) FROM test""",
        "train",
        "test",
    )
)
def split_sizes(t: Inputs) -> DataFrame:
    train, test = prepare.hash_split(t.ratings)

    def size(df, name):
        return df.agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("avg_rating")).select(
            F.lit(name).alias("fold"), "n", "avg_rating"
        )

    return size(train, "train").unionByName(size(test, "test"))


@query(
    sql(
        """SELECT userId, movieId, copies,
        CASE WHEN row_number() OVER (PARTITION BY userId ORDER BY h, movieId)
            <= floor(count(*) OVER (PARTITION BY userId) * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS fold
        FROM pairs""",
        "ratings",
        pairs=f"""SELECT userId, movieId, count(*) AS copies,
            {O.PAIR_HASH} AS h
            FROM ratings GROUP BY userId, movieId""",
    )
)
def split_stratified(t: Inputs) -> DataFrame:
    return prepare.stratified_split(t.ratings)


@query(
    sql(
        """SELECT * FROM baskets WHERE userId IN
        (SELECT userId FROM baskets GROUP BY userId HAVING count(*) >= 5)""",
        "baskets",
    )
)
def filter_cold_users(t: Inputs) -> DataFrame:
    return prepare.filter_cold_users(t.baskets)


@query(
    sql(
        """SELECT * FROM ratings WHERE movieId IN
        (SELECT movieId FROM ratings GROUP BY movieId HAVING count(*) >= 30)""",
        "ratings",
    )
)
def filter_cold_items(t: Inputs) -> DataFrame:
    return prepare.filter_cold_items(t.ratings, 30)


@query(sql("SELECT userId, movieId, rating FROM ratings", "ratings"))
def model_types(t: Inputs) -> DataFrame:
    return prepare.model_types(t.ratings)


# ----------------------------------------------------------------- predictors

TEST_COLUMNS = 't.userId, t.movieId, t.rating, t."timestamp"'


@query(
    sql(
        f"SELECT {TEST_COLUMNS}, round((SELECT avg(rating) FROM train), 6) AS prediction FROM test t",
        "train",
        "test",
    )
)
def predict_global(t: Inputs) -> DataFrame:
    train, test = prepare.hash_split(t.ratings)
    return predict.AveragePredictor().fit(train).predict(test)


@query(
    sql(
        f"""SELECT {TEST_COLUMNS}, round(coalesce(a.m, (SELECT avg(rating) FROM train)), 6) AS prediction
        FROM test t LEFT JOIN (SELECT movieId, avg(rating) AS m FROM train GROUP BY movieId) a
        ON a.movieId = t.movieId""",
        "train",
        "test",
    )
)
def predict_item_avg(t: Inputs) -> DataFrame:
    train, test = t.split
    return predict.AveragePredictor("movieId").fit(train).predict(test)


@query(
    sql(
        f"""SELECT {TEST_COLUMNS}, round(coalesce(a.m, (SELECT avg(rating) FROM larger)), 6) AS prediction
        FROM smaller t LEFT JOIN (SELECT userId, avg(rating) AS m FROM larger GROUP BY userId) a
        ON a.userId = t.userId""",
        "baskets",
        larger=f"SELECT * FROM baskets WHERE {O.PAIR_HASH} % 1000 >= 200",
        smaller=f"SELECT * FROM baskets WHERE {O.PAIR_HASH} % 1000 < 200",
    )
)
def predict_user_avg(t: Inputs) -> DataFrame:
    # Short histories: some users of the test side are unknown and get the global mean.
    train, test = prepare.hash_split(t.baskets)
    return predict.AveragePredictor("userId").fit(train).predict(test)


BIAS_VIEWS = {
    "mu": "SELECT avg(rating) AS m FROM train",
    "ib": """SELECT movieId, (sum(rating) - count(*) * any_value(m)) / (count(*) + 10) AS b
        FROM train CROSS JOIN mu GROUP BY movieId""",
    "ub": """SELECT userId, sum(rating - m - b) / (count(*) + 5) AS b
        FROM train JOIN ib USING (movieId) CROSS JOIN mu GROUP BY userId""",
    "biased": """SELECT t.*, greatest(0.5, least(5.0, m + coalesce(ib.b, 0) + coalesce(ub.b, 0))) AS prediction
        FROM test t CROSS JOIN mu LEFT JOIN ib ON ib.movieId = t.movieId LEFT JOIN ub ON ub.userId = t.userId""",
}


@query(
    sql(
        'SELECT userId, movieId, rating, "timestamp", round(prediction, 6) AS prediction FROM biased',
        "train",
        "test",
        **BIAS_VIEWS,
    )
)
def bias_predict(t: Inputs) -> DataFrame:
    train, test = t.split
    return predict.BiasPredictor().fit(train).predict(test)


@query(
    sql(
        """SELECT model, round(sqrt(avg((p - rating) ** 2)), 6) AS rmse, round(avg(abs(p - rating)), 6) AS mae,
        count(*) AS n_test FROM (
            SELECT 'global_average' AS model, rating, m AS p FROM test CROSS JOIN mu
            UNION ALL SELECT 'item_average', t.rating, coalesce(a.p, m) FROM test t CROSS JOIN mu
                LEFT JOIN (SELECT movieId, avg(rating) AS p FROM train GROUP BY 1) a ON a.movieId = t.movieId
            UNION ALL SELECT 'user_average', t.rating, coalesce(a.p, m) FROM test t CROSS JOIN mu
                LEFT JOIN (SELECT userId, avg(rating) AS p FROM train GROUP BY 1) a ON a.userId = t.userId
            UNION ALL SELECT 'biases', rating, prediction FROM biased) GROUP BY model""",
        "train",
        "test",
        **BIAS_VIEWS,
    )
)
def baseline_comparison(t: Inputs) -> DataFrame:
    train, test = t.split
    models = {
        "global_average": predict.AveragePredictor().fit(train),
        "item_average": predict.AveragePredictor("movieId").fit(train),
        "user_average": predict.AveragePredictor("userId").fit(train),
        "biases": predict.BiasPredictor().fit(train),
    }
    return predict.compare_predictors(models, test)


# ------------------------------------------------------- popularity, cold start

POP_COLUMNS = """movieId, title, genres, round(popularity_score, 6) AS popularity_score, num_ratings,
    round(avg_rating, 6) AS avg_rating"""

FIXED_POP = """SELECT i.movieId, title, genres, num_ratings, avg_rating,
    (num_ratings / (num_ratings + 25)) * avg_rating
    + (25 / (num_ratings + 25)) * (SELECT avg(rating) FROM ratings) AS popularity_score
    FROM per_item i JOIN movies m ON m.movieId = i.movieId WHERE num_ratings >= 25"""


@query(sql(f"SELECT {POP_COLUMNS} FROM pop", "per_item", "movies", pop=FIXED_POP))
def popularity_fixed(t: Inputs) -> DataFrame:
    return popularity.popularity_fixed(t.ratings, t.movies, min_ratings=25)


@query(
    sql(
        f"""SELECT {POP_COLUMNS} FROM pop WHERE regexp_matches(genres, 'small', 'i')
        ORDER BY pop.popularity_score DESC, movieId LIMIT 15""",
        "per_item",
        "movies",
        pop=FIXED_POP,
    )
)
def popularity_fixed_top(t: Inputs) -> DataFrame:
    table = popularity.popularity_fixed(t.ratings, t.movies, min_ratings=25)
    return popularity.top_popular(table, 15, "small", ignore_case=True)


@query(sql(f"SELECT {POP_COLUMNS} FROM pop", "ratings", "movies", **O.popularity("ratings")))
def popularity_quantile(t: Inputs) -> DataFrame:
    return popularity.popularity_quantile(t.ratings, t.movies)


@query(
    sql(
        f"""SELECT {POP_COLUMNS} FROM pop WHERE regexp_matches(genres, 'SMALL')
        AND movieId NOT IN (SELECT movieId FROM ratings WHERE userId = 7)
        ORDER BY pop.popularity_score DESC, movieId LIMIT 10""",
        "ratings",
        "movies",
        **O.popularity("ratings"),
    )
)
def popular_in_genre(t: Inputs) -> DataFrame:
    table = popularity.popularity_quantile(t.ratings, t.movies)
    return popularity.top_popular(table, 10, "SMALL", exclude=search.user_history(t.ratings, 7))


@query(
    sql(
        "SELECT userId, rank, movieId, round(score, 6) AS score FROM recs",
        "ratings",
        "movies",
        "users",
        **O.popular_lists("ratings"),
    )
)
def popular_for_users(t: Inputs) -> DataFrame:
    table = coldstart.stored_popularity(t.ratings, t.movies)
    return coldstart.popular_for_users(t.ratings, table, t.users)


@query(
    sql(
        """SELECT * FROM (SELECT f.userId, p.movieId, round(0.6 * p.popularity_score / 5.0
            + 0.4 * (len(list_intersect(f.pref, string_split(p.genres, '|'))) / len(f.pref)), 6) AS score,
            p.title, p.genres, round(p.popularity_score, 2) AS popularity_score, p.num_ratings, CAST(row_number() OVER (PARTITION BY f.userId ORDER BY 0.6 * p.popularity_score / 5.0
            + 0.4 * (len(list_intersect(f.pref, string_split(p.genres, '|'))) / len(f.pref)) DESC, p.movieId)
            AS INTEGER) AS rank
            FROM prefs f CROSS JOIN pop p WHERE p.genres IS NOT NULL AND NOT EXISTS
            (SELECT 1 FROM ratings r WHERE r.userId = f.userId AND r.movieId = p.movieId)) WHERE rank <= 10""",
        "ratings",
        "movies",
        "bridge",
        **O.popularity("ratings"),
        latest=O.latest("ratings"),
        prefs="""SELECT r.userId, list(DISTINCT b.genre) AS pref FROM latest r
            JOIN bridge b ON b.movieId = r.movieId WHERE r.rating >= 3.5 GROUP BY r.userId""",
    )
)
def genre_based_topn(t: Inputs) -> DataFrame:
    history = materialize(t.ratings, "ratings")
    table = coldstart.stored_popularity(history, t.movies)
    prefs = coldstart.preference_sets(history, t.movies, top=None)
    prefs = prefs.withColumnRenamed("set_key", "genres")
    return coldstart.genre_based(prefs, table, 10, exclude=history)


REC_COLUMNS = "userId, rank, movieId, title, genres, round(score, 6) AS score, num_ratings"


@query(
    sql(
        f"""SELECT {REC_COLUMNS}, CASE WHEN num_ratings = 0 THEN 'cold_start_popular'
        WHEN num_ratings < 5 THEN 'cold_start_hybrid' ELSE 'collaborative_filtering_ready' END
        AS recommendation_type FROM recs""",
        "baskets",
        "movies",
        "bridge",
        "basket_users",
        **O.hybrid_lists("baskets", "basket_users", 3),
    )
)
def route_cold_start(t: Inputs) -> DataFrame:
    return coldstart.route_cold_start(t.baskets, t.movies, t.basket_users)


@query(
    sql(
        f"""SELECT {REC_COLUMNS}, CASE WHEN num_ratings = 0 THEN 'cold_start' ELSE 'genre_based' END
        AS recommendation_type FROM recs""",
        "baskets",
        "movies",
        "bridge",
        "basket_users",
        **O.hybrid_lists("baskets", "basket_users", None, below=5),
    )
)
def route_service_cold(t: Inputs) -> DataFrame:
    return coldstart.route_service_cold(t.baskets, t.movies, t.basket_users)


@query(
    sql(
        """SELECT userId, rank, movieId, round(score, 6) AS score, CAST(num_ratings AS BIGINT) AS num_ratings
        FROM recs""",
        "ratings",
        "movies",
        "bridge",
        "users",
        **O.hybrid_lists("ratings", "users", 3),
    )
)
def hybrid_topn(t: Inputs) -> DataFrame:
    history = materialize(t.ratings, "ratings")
    table = coldstart.stored_popularity(history, t.movies)
    sized = profile.with_history_size(history, t.users)
    return coldstart.hybrid(history, table, t.movies, sized).drop("set_key")


# -------------------------------------------------------------------- ranking


def _train_lists(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """Popular lists from the training side and the relevant items of the test side, as tables."""
    train, test = t.split
    table = coldstart.stored_popularity(train, t.movies)
    recs = coldstart.popular_for_users(train, table, t.users, 10)
    return materialize(recs, "lists"), materialize(metrics.relevant_items(test), "relevant")


def _ranking_sql(body: str, k: int) -> str:
    return sql(
        body,
        "train",
        "test",
        "movies",
        "users",
        **O.popular_lists("train"),
        rel="""SELECT userId, movieId, max(rating) AS gain FROM test WHERE rating >= 4.0
            GROUP BY userId, movieId""",
        hits=f"""SELECT c.userId, c.rank, r.gain, row_number() OVER (PARTITION BY c.userId ORDER BY c.rank) AS nth
            FROM recs c JOIN rel r ON r.userId = c.userId AND r.movieId = c.movieId WHERE c.rank <= {k}""",
        ideal=f"""SELECT userId, sum(1 / log2(place + 1)) AS idcg, sum(gain / log2(place + 1)) AS idcg_graded
            FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY gain DESC, movieId) AS place FROM rel)
            WHERE place <= {k} GROUP BY userId""",
        per=f"""SELECT u.userId, coalesce(h.n, 0) / {k} AS precision, coalesce(h.n, 0) / u.n AS recall,
            coalesce(h.ap, 0) / least(u.n, {k}) AS average_precision, coalesce(h.dcg, 0) / i.idcg AS ndcg,
            coalesce(h.graded, 0) / i.idcg_graded AS ndcg_graded
            FROM (SELECT userId, count(*) AS n FROM rel GROUP BY userId) u
            JOIN ideal i ON i.userId = u.userId
            LEFT JOIN (SELECT userId, count(*) AS n, sum(nth / rank) AS ap, sum(1 / log2(rank + 1)) AS dcg,
                sum(gain / log2(rank + 1)) AS graded FROM hits GROUP BY userId) h ON h.userId = u.userId""",
    )


def _per_user_metric(name: str, column: str, k: int) -> None:
    def run(t: Inputs) -> DataFrame:
        recs, relevant = _train_lists(t)
        return metrics.ranking_metrics(recs, relevant, k).select("userId", column)

    run.__name__ = name
    query(_ranking_sql(f"SELECT userId, round({column}, 6) AS {column} FROM per", k))(run)


_per_user_metric("precision_at_k", "precision", 5)
_per_user_metric("recall_at_k", "recall", 10)
_per_user_metric("map_at_k", "average_precision", 10)
_per_user_metric("ndcg_binary", "ndcg", 10)
_per_user_metric("ndcg_graded", "ndcg_graded", 10)


@query(
    _ranking_sql(
        """SELECT count(*) AS num_users, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
        round(avg(average_precision), 6) AS map, round(avg(ndcg), 6) AS ndcg,
        round(avg(ndcg_graded), 6) AS ndcg_graded FROM per""",
        10,
    )
)
def ranking_report(t: Inputs) -> DataFrame:
    recs, relevant = _train_lists(t)
    return metrics.ranking_report(recs, relevant, 10)


def _hybrid_recs(t: Inputs) -> DataFrame:
    history = materialize(t.ratings, "ratings")
    return materialize(coldstart.route_cold_start(history, t.movies, t.users), "lists")


@query(
    sql(
        "SELECT round(count(DISTINCT movieId) / (SELECT count(*) FROM movies), 6) AS coverage FROM recs",
        "ratings",
        "movies",
        "bridge",
        "users",
        **O.hybrid_lists("ratings", "users", 3),
    )
)
def coverage(t: Inputs) -> DataFrame:
    return metrics.coverage(_hybrid_recs(t), t.movies)


@query(
    sql(
        """SELECT round(1 - (SELECT sum(c / (20 - c)) FROM pairs)
            / ((SELECT count(*) FROM users) * ((SELECT count(*) FROM users) - 1) / 2), 6) AS diversity""",
        "ratings",
        "movies",
        "bridge",
        "users",
        **O.hybrid_lists("ratings", "users", 3),
        pairs="""SELECT a.userId AS u, b.userId AS v, count(*) AS c FROM recs a
            JOIN recs b ON a.movieId = b.movieId AND a.userId < b.userId GROUP BY u, v""",
    )
)
def diversity(t: Inputs) -> DataFrame:
    return metrics.diversity(_hybrid_recs(t), t.users)


@query(
    sql(
        """SELECT round(sqrt(avg((p - rating) ** 2)), 6) AS rmse, round(avg(abs(p - rating)), 6) AS mae,
        count(*) AS n_test FROM (SELECT t.rating, coalesce(a.p, (SELECT avg(rating) FROM train)) AS p FROM test t
        LEFT JOIN (SELECT movieId, avg(rating) AS p FROM train GROUP BY 1) a ON a.movieId = t.movieId)""",
        "train",
        "test",
    )
)
def prediction_errors(t: Inputs) -> DataFrame:
    train, test = t.split
    return metrics.error_metrics(predict.AveragePredictor("movieId").fit(train).predict(test))


# ----------------------------------------------------------------- similarity


@query(
    sql(
        """SELECT r.movieId, CAST(rank AS INTEGER) AS rank, similarId, round(similarity, 6) AS similarity, m.title, m.genres
        FROM (SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY similarity DESC, similarId) AS rank
            FROM (SELECT a.movieId, b.movieId AS similarId, len(list_intersect(a.s, b.s))
                / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS similarity
                FROM sets a JOIN sets b ON a.movieId <> b.movieId)) r JOIN movies m ON m.movieId = similarId
        WHERE rank <= 10""",
        "movies",
        sets="SELECT movieId, list_distinct(string_split(genres, '|')) AS s FROM movies",
    )
)
def similar_by_genre(t: Inputs) -> DataFrame:
    return similar.similar_by_genre(t.movies)


@query(
    sql(
        """SELECT vec_id, CAST(rank AS INTEGER) AS rank, similarId, round(similarity, 3) AS similarity
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, similarId) AS rank
            FROM (SELECT a.vec_id, b.vec_id AS similarId, round(list_cosine_similarity(
                a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
                FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 10""",
    )
)
def similar_by_vector(t: Inputs) -> DataFrame:
    found = similar.similar_by_vector(t.vectors, 10, "vec_id", "embedding")
    return found.withColumn("similarity", F.round("similarity", 3))


# --------------------------------------------------------------- factor model

def _model(t: Inputs, rows: str) -> factor.FactorModel:
    """A model with the default parameters (100 factors, 20 epochs), fitted by gradient descent for the query that asks."""
    return factor.FactorModel(solver="sgd").fit(t.split[0] if rows == "train" else getattr(t, rows))


@query()
def factor_metrics(t: Inputs) -> DataFrame:
    return _model(t, "train").evaluate(t.split[1])


@query()
def factor_predict(t: Inputs) -> DataFrame:
    return _model(t, "train").predict(t.split[1])


@query()
def factor_recommend(t: Inputs) -> DataFrame:
    return _model(t, "ratings").recommend(t.users, t.movies, 10)


@query()
def factor_similar(t: Inputs) -> DataFrame:
    return _model(t, "ratings").similar(t.movies, 10)


@query()
def route_service(t: Inputs) -> DataFrame:
    return route.route_service(_model(t, "baskets"), t.baskets, t.movies, t.basket_users)


@query()
def route_integrated(t: Inputs) -> DataFrame:
    return route.route_integrated(_model(t, "baskets"), t.baskets, t.movies, t.basket_users)


# A grid of alternating least squares, of 4 fits; ``grid_coarse`` runs the whole coarse grid by gradient descent.
CV_GRID = {"n_factors": [50, 100], "n_epochs": [10], "reg_all": [0.05]}


@query()
def cv_report(t: Inputs) -> DataFrame:
    ratings = materialize(prepare.filter_cold_users(t.ratings), "ratings")
    return tuning.cv_summary(tuning.grid_search(ratings, CV_GRID, folds=2), list(CV_GRID))


@query()
def als_metrics(t: Inputs) -> DataFrame:
    """Errors of a model with the default parameters, fitted by alternating least squares."""
    train, test = t.split
    return factor.FactorModel().fit(train).evaluate(test)


@query()
def grid_coarse(t: Inputs) -> DataFrame:
    """All 81 configurations of the coarse grid on 5 folds, side by side."""
    ratings = materialize(prepare.filter_cold_users(t.ratings), "ratings")
    return tuning.cv_summary(tuning.descent_search(ratings, tuning.COARSE_GRID), list(tuning.COARSE_GRID))


@query()
def grid_fine_halved(t: Inputs) -> DataFrame:
    """The fine grid, of which a third of the models goes on after each number of epochs."""
    ratings = materialize(prepare.filter_cold_users(t.ratings), "ratings")
    found = tuning.descent_search(ratings, tuning.FINE_GRID, survivors=1 / 3)
    return tuning.best_configs(found, list(tuning.FINE_GRID))


# A model with one factor has normal equations of one number, which SQL solves as well: its errors and estimates
# are compared in value.
ONE = {"n_factors": 1, "n_epochs": 3, "reg_all": 0.05}
ONE_GRID = {"n_factors": [1], "n_epochs": [2], "reg_all": [0.02, 0.2]}
_ONE = O.rank_one("train", ONE["reg_all"], ONE["n_epochs"])
_ONE_ERRORS = """round(sqrt(avg((e - rating) ** 2)), 6) AS rmse, round(avg(abs(e - rating)), 6) AS mae, count(*) AS n_test"""


@query(sql(f"SELECT {_ONE_ERRORS} FROM scored", "train", "test", **_ONE, scored=O.rank_one_scores("test")))
def one_factor_metrics(t: Inputs) -> DataFrame:
    train, test = t.split
    return factor.FactorModel(**ONE).fit(train).evaluate(test)


@query(
    sql(
        """SELECT userId, movieId, rating, "timestamp", round(e, 6) AS prediction FROM scored""",
        "train",
        "test",
        **_ONE,
        scored=O.rank_one_scores("test"),
    )
)
def one_factor_predict(t: Inputs) -> DataFrame:
    train, test = t.split
    return factor.FactorModel(**ONE).fit(train).predict(test)


def _compared(name: str, estimate: str, joins: str = "") -> str:
    return f"""SELECT '{name}' AS model, round(sqrt(avg(({estimate} - t.rating) ** 2)), 6) AS rmse,
        round(avg(abs({estimate} - t.rating)), 6) AS mae, count(*) AS n_test FROM test t CROSS JOIN m {joins}"""


@query(
    sql(
        " UNION ALL ".join(
            [
                _compared("global", "m"),
                _compared("item", "coalesce(a, m)", "LEFT JOIN (SELECT movieId, avg(rating) AS a FROM train GROUP BY 1) x USING (movieId)"),
                _compared("user", "coalesce(a, m)", "LEFT JOIN (SELECT userId, avg(rating) AS a FROM train GROUP BY 1) x USING (userId)"),
                _compared(
                    "bias",
                    "greatest(0.5, least(5.0, m + coalesce(bi, 0) + coalesce(bu, 0)))",
                    "LEFT JOIN ib USING (movieId) LEFT JOIN ub USING (userId)",
                ),
                "SELECT 'factor' AS model, " + _ONE_ERRORS + " FROM scored",
            ]
        ),
        "train",
        "test",
        **_ONE,
        scored=O.rank_one_scores("test"),
    )
)
def one_factor_comparison(t: Inputs) -> DataFrame:
    """The comparison of all predictors, in value."""
    return _comparison(t, factor.FactorModel(**ONE))


def _one_grid(train: str) -> dict[str, str]:
    """Scores of two weights on two folds, each with views of its own."""
    views, parts = {}, []
    for config, reg in enumerate(ONE_GRID["reg_all"]):
        for fold in range(2):
            name = f"c{config}f{fold}"
            views[f"{name}train"] = f"SELECT * FROM folded WHERE bucket <> {fold}"
            views[f"{name}test"] = f"SELECT * FROM folded WHERE bucket = {fold}"
            views |= O.rank_one(f"{name}train", reg, 2, name)
            views[f"{name}scored"] = O.rank_one_scores(f"{name}test", name)
            parts.append(f"""SELECT {config} AS config, {reg} AS reg_all, sqrt(avg((e - rating) ** 2)) AS rmse,
                avg(abs(e - rating)) AS mae, count(*) AS n_test FROM {name}scored""")
    return {"folded": f"SELECT *, {O.PAIR_HASH} % 2 AS bucket FROM {train}", **views, "scores": " UNION ALL ".join(parts)}


@query(
    sql(
        """SELECT config, 1.0::DOUBLE AS n_factors, 2.0::DOUBLE AS n_epochs, reg_all::DOUBLE AS reg_all, round(avg(rmse), 6) AS rmse,
        round(stddev_pop(rmse), 6) AS rmse_std, round(avg(mae), 6) AS mae, round(stddev_pop(mae), 6) AS mae_std,
        CAST(sum(n_test) AS BIGINT) AS n_test FROM scores GROUP BY config, reg_all""",
        "ratings",
        **_one_grid("ratings"),
    )
)
def one_factor_grid(t: Inputs) -> DataFrame:
    """Grid search over the factor model, in value."""
    ratings = materialize(t.ratings, "ratings")
    return tuning.cv_summary(tuning.grid_search(ratings, ONE_GRID, folds=2), list(ONE_GRID))


# A model from given factors: what is asked of a fitted model, compared in value.


def _fixed_model(t: Inputs, users: DataFrame, pairs: DataFrame) -> factor.FactorModel:
    def vector(key: str):
        numbers = [((F.col(key) * (2 * k + 3) + 7 * k) % 65 - 32) / 32.0 for k in range(O.FIXED_WIDTH)]
        return F.array(*numbers).cast("array<float>").alias("features")

    def bias(key: str, name: str):
        return (((F.col(key) * 5) % 33 - 16) / 64.0).alias(name)

    known = users.where("userId % 11 <> 0").select("userId", bias("userId", "user_bias"), vector("userId"))
    items = t.movies.where("movieId % 13 <> 0").select("movieId", bias("movieId", "item_bias"), vector("movieId"))
    tables_ = materialize(known, "fixed-users"), materialize(items, "fixed-items")
    return factor.FactorModel.from_tables(O.FIXED_MEAN, *tables_, pairs, n_factors=O.FIXED_WIDTH)


_FIXED_TEST = f"""SELECT t.*, greatest(0.5, least(5.0, {O.FIXED_MEAN} + coalesce(bu, 0) + coalesce(bi, 0)
    + coalesce(list_inner_product(p, q), 0))) AS e
    FROM test t LEFT JOIN fu USING (userId) LEFT JOIN fi USING (movieId)"""


@query(
    sql(
        """SELECT userId, movieId, rating, "timestamp", round(e, 6) AS prediction FROM scored""",
        "train",
        "test",
        "movies",
        "users",
        **O.fixed_factors("users"),
        scored=_FIXED_TEST,
    )
)
def fixed_predict(t: Inputs) -> DataFrame:
    train, test = t.split
    return _fixed_model(t, t.users, train).predict(test)


@query(sql(f"SELECT {_ONE_ERRORS} FROM scored", "train", "test", "movies", "users", **O.fixed_factors("users"), scored=_FIXED_TEST))
def fixed_metrics(t: Inputs) -> DataFrame:
    train, test = t.split
    return _fixed_model(t, t.users, train).evaluate(test)


@query(sql("SELECT * FROM fixed_recs", "ratings", "movies", "users", **O.fixed_lists("users", "ratings")))
def fixed_recommend(t: Inputs) -> DataFrame:
    """Lists for all users, best products found from the longest item vectors on."""
    return _fixed_model(t, t.users, t.ratings).recommend(t.users, t.movies, 10)


@query(
    sql(
        """SELECT movieId, rank, similarId, title, genres, round(s, 3) AS similarity_score FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY movieId ORDER BY s DESC, similarId) AS INTEGER) AS rank FROM (
                SELECT a.movieId, b.movieId AS similarId, b.title, b.genres, round(list_cosine_similarity(a.q, b.q), 9) AS s
                FROM fi a JOIN fi b ON a.movieId <> b.movieId
                WHERE list_inner_product(a.q, a.q) > 0 AND list_inner_product(b.q, b.q) > 0)) WHERE rank <= 10""",
        "movies",
        "users",
        **O.fixed_factors("users"),
    )
)
def fixed_similar(t: Inputs) -> DataFrame:
    return _fixed_model(t, t.users, t.ratings).similar(t.movies, 10)


def _fixed_route(cold: dict[str, str], cold_label: str) -> str:
    """Lists of the tiers below five ratings by ``cold`` views, of the others by the fixed model."""
    short = sql(f"SELECT {REC_COLUMNS}, {cold_label} AS recommendation_type FROM recs WHERE num_ratings < 5", "baskets", "movies", "bridge", "basket_users", **cold)
    full = sql(
        """SELECT userId, rank, movieId, title, genres, predicted_rating AS score, num_ratings, 'personalized' AS recommendation_type
        FROM fixed_recs JOIN sized USING (userId)""",
        "baskets",
        "movies",
        sized=f"SELECT userId, count(*) AS num_ratings FROM baskets GROUP BY userId HAVING count(*) >= 5",
        **O.fixed_lists("sized", "baskets"),
    )
    return f"SELECT * FROM ({short}) UNION ALL SELECT * FROM ({full})"


@query(
    _fixed_route(
        O.hybrid_lists("baskets", "basket_users", None, below=5),
        "CASE WHEN num_ratings = 0 THEN 'cold_start' ELSE 'genre_based' END",
    )
)
def fixed_route_service(t: Inputs) -> DataFrame:
    model = _fixed_model(t, t.basket_users, t.baskets)
    return route.route_service(model, t.baskets, t.movies, t.basket_users)


@query(
    _fixed_route(
        O.hybrid_lists("baskets", "basket_users", 3, below=5),
        "CASE WHEN num_ratings = 0 THEN 'cold_start_popular' ELSE 'cold_start_hybrid' END",
    )
)
def fixed_route_integrated(t: Inputs) -> DataFrame:
    model = _fixed_model(t, t.basket_users, t.baskets)
    return route.route_integrated(model, t.baskets, t.movies, t.basket_users)


# What is exact about the model's answers: which rows there are, and the rules that they keep.


@query(sql("SELECT count(*) AS n_test, true AS errors_positive, true AS mae_below_rmse FROM test", "train", "test"))
def factor_metrics_rules(t: Inputs) -> DataFrame:
    return factor_metrics(t).select(
        "n_test",
        ((F.col("rmse") > 0) & (F.col("mae") > 0)).alias("errors_positive"),
        (F.col("mae") <= F.col("rmse")).alias("mae_below_rmse"),
    )


@query(
    sql(
        "SELECT userId, movieId, count(*) AS n, true AS in_scale FROM test GROUP BY userId, movieId",
        "train",
        "test",
    )
)
def factor_predict_rules(t: Inputs) -> DataFrame:
    scored = factor_predict(t)
    return scored.groupBy("userId", "movieId").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("prediction").between(0.5, 5.0)).alias("in_scale")
    )


def _list_rules(lists: DataFrame, score: str, rated: DataFrame, *keys: str) -> DataFrame:
    """Per list: its length, its last rank, rated items in it, and whether scores fall with the rank."""
    order = Window.partitionBy("userId").orderBy("rank")
    rises = F.col(score) > F.lag(score).over(order)
    rated = rated.select("userId", "movieId").distinct().withColumn("rated", F.lit(1))
    marked = lists.withColumn("rises", F.coalesce(rises, F.lit(False))).join(rated, ["userId", "movieId"], "left")
    return marked.groupBy("userId", *keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max("rank").cast("bigint").alias("last_rank"),
        F.count("rated").alias("rated_items"),
        (~F.some("rises")).alias("falling"),
    )


_RATED_KNOWN = """SELECT userId, count(DISTINCT movieId) AS k FROM {source}
    WHERE movieId IN (SELECT movieId FROM movies) GROUP BY userId"""
_RULES = "{n} AS n_items, {n} AS last_rank, CAST(0 AS BIGINT) AS rated_items, true AS falling"
_LENGTH = "least(10, (SELECT count(*) FROM movies) - coalesce(k, 0))"


@query(
    sql(
        f"SELECT u.userId, {_RULES.format(n=_LENGTH)} FROM users u LEFT JOIN known r ON r.userId = u.userId",
        "ratings",
        "movies",
        "users",
        known=_RATED_KNOWN.format(source="ratings"),
    )
)
def factor_recommend_rules(t: Inputs) -> DataFrame:
    return _list_rules(factor_recommend(t), "predicted_rating", t.ratings)


@query(
    sql(
        """SELECT DISTINCT movieId, least(10, (SELECT count(DISTINCT movieId) FROM ratings) - 1) AS n_items,
        CAST(0 AS BIGINT) AS own, true AS in_range FROM ratings""",
        "ratings",
    )
)
def factor_similar_rules(t: Inputs) -> DataFrame:
    return factor_similar(t).groupBy("movieId").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("movieId") == F.col("similarId")).alias("own"),
        F.every(F.col("similarity_score").between(-1.0, 1.0)).alias("in_range"),
    )


def _route_rules(label: str) -> str:
    return sql(
        f"""SELECT u.userId, coalesce(c.n, 0) AS num_ratings, {label} AS recommendation_type,
        {_RULES.format(n=_LENGTH)} FROM basket_users u LEFT JOIN known r ON r.userId = u.userId
        LEFT JOIN (SELECT userId, count(*) AS n FROM baskets GROUP BY userId) c ON c.userId = u.userId""",
        "baskets",
        "movies",
        "basket_users",
        known=_RATED_KNOWN.format(source="baskets"),
    )


@query(
    _route_rules(
        """CASE WHEN c.n IS NULL THEN 'cold_start' WHEN c.n < 5 THEN 'genre_based' ELSE 'personalized' END"""
    )
)
def route_service_rules(t: Inputs) -> DataFrame:
    return _list_rules(route_service(t), "score", t.baskets, "num_ratings", "recommendation_type")


@query(
    _route_rules(
        """CASE WHEN c.n IS NULL THEN 'cold_start_popular' WHEN c.n < 5 THEN 'cold_start_hybrid'
        ELSE 'personalized' END"""
    )
)
def route_integrated_rules(t: Inputs) -> DataFrame:
    return _list_rules(route_integrated(t), "score", t.baskets, "num_ratings", "recommendation_type")


@query(
    sql(
        """SELECT config, n_factors, n_test, true AS errors_positive FROM
        (SELECT count(*) AS n_test FROM ratings JOIN per_user USING (userId) WHERE num_ratings >= 5)
        CROSS JOIN (VALUES (0, 50.0::DOUBLE), (1, 100.0::DOUBLE)) g(config, n_factors)""",
        "ratings",
        "per_user",
    )
)
def cv_report_rules(t: Inputs) -> DataFrame:
    return cv_report(t).select(
        "config", "n_factors", "n_test", ((F.col("rmse") > 0) & (F.col("mae") > 0)).alias("errors_positive")
    )


@query(
    sql(
        "SELECT count(*) AS pairs, true AS same FROM (SELECT DISTINCT userId, movieId FROM test)",
        "train",
        "test",
    )
)
def model_save_load(t: Inputs) -> DataFrame:
    """A saved and loaded model gives the same predictions."""
    model, path = _model(t, "train"), work_folder(t.spark, "model")
    model.save(path)
    pairs = t.split[1].select("userId", "movieId").distinct()
    before = model.predict(pairs)
    after = factor.FactorModel.load(t.spark, path).predict(pairs).withColumnRenamed("prediction", "again")
    both = before.join(after, ["userId", "movieId"])
    close = F.abs(F.col("prediction") - F.col("again")) < 1e-3
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.every(close).alias("same"))


@query(
    sql(
        """SELECT CAST(run AS BIGINT) AS run, count(*) AS total_ratings, count(DISTINCT userId) AS num_users
        FROM ratings CROSS JOIN (VALUES (1), (2)) r(run) GROUP BY run""",
        "ratings",
    )
)
def run_metrics_sink(t: Inputs) -> DataFrame:
    """Two runs' metrics, appended and read back."""
    path = work_folder(t.spark, "run-metrics")
    facts = profile.rating_stats(t.ratings).first()
    for run in (1, 2):
        row = {"run": run, "data": {"total_ratings": facts.total_ratings, "num_users": facts.num_users}}
        sinks.append_metrics(t.spark, row, path)
    return t.spark.read.json(path).select("run", "data.total_ratings", "data.num_users")


@query(
    sql(
        """SELECT 'n_factors' AS name, CAST(count(DISTINCT movieId) AS DOUBLE) AS value FROM ratings
        UNION ALL SELECT 'n_epochs', 20.0 UNION ALL SELECT 'lr_all', 0.006 UNION ALL SELECT 'reg_all', 0.025""",
        "ratings",
    )
)
def tuned_parameters(t: Inputs) -> DataFrame:
    """The latest row of a parameter table wins, defaults fill what it lacks."""
    path = work_folder(t.spark, "tuned")
    for n in (1, profile.rating_stats(t.ratings).first().num_movies):
        sinks.append_metrics(t.spark, {"n_factors": n, "performance": {"rmse": 1.0}}, path)
    found = sinks.read_tuned(t.spark, path)
    return t.spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double")


@query(
    sql(
        """SELECT CASE WHEN num_ratings = 0 THEN 'cold_start_popular' WHEN num_ratings < 5 THEN 'cold_start_hybrid'
        ELSE 'collaborative_filtering_ready' END AS recommendation_type, count(*) AS n, count(DISTINCT userId) AS users
        FROM recs GROUP BY 1""",
        "ratings",
        "movies",
        "bridge",
        "users",
        **O.hybrid_lists("ratings", "users", 3),
    )
)
def recommendation_sink(t: Inputs) -> DataFrame:
    """Lists written by type and read back, nested and flat."""
    path = work_folder(t.spark, "recommendations")
    sinks.write_recommendations(_hybrid_recs(t), path)
    stored = t.spark.read.parquet(path)
    nested = sinks.nested_lists(stored)
    return nested.groupBy("recommendation_type").agg(
        F.sum(F.size("recommendations")).alias("n"), F.count(F.lit(1)).alias("users")
    )


_KEPT = "SELECT r.* FROM ratings r JOIN per_user USING (userId) WHERE num_ratings >= 5"


@query(
    sql(
        f"""SELECT count(*) FILTER (WHERE {O.PAIR_HASH} % 1000 >= 200) AS n_train,
        count(*) FILTER (WHERE {O.PAIR_HASH} % 1000 < 200) AS n_test, true AS errors_positive,
        CAST(5 AS BIGINT) AS n_items FROM kept""",
        "ratings",
        "per_user",
        kept=_KEPT,
    )
)
def training_job(t: Inputs) -> DataFrame:
    """The whole training job: filter, fit with the default parameters, save, metrics row, sample list."""
    folder = work_folder(t.spark, "training")
    _, measured, sample = jobs.train_job(materialize(t.ratings, "ratings"), t.movies, folder)
    stored = t.spark.read.json(f"{folder}/metrics")
    return stored.select(
        "n_train",
        "n_test",
        ((F.col("rmse") > 0) & (F.col("mae") > 0)).alias("errors_positive"),
        F.lit(sample.count()).cast("bigint").alias("n_items"),
    )


@query(
    sql(
        f"""SELECT (SELECT count(*) FROM ratings) AS total_ratings, count(*) AS filtered_ratings,
        (SELECT count(*) FROM per_user) AS total_users,
        (SELECT count(*) FROM per_user WHERE num_ratings < 5) AS cold_start_users,
        (SELECT count(*) FROM movies) AS num_movies,
        count(*) FILTER (WHERE {O.PAIR_HASH} % 1000 >= 200) AS train_size,
        count(*) FILTER (WHERE {O.PAIR_HASH} % 1000 < 200) AS test_size, true AS errors_positive FROM kept""",
        "ratings",
        "per_user",
        "movies",
        kept=_KEPT,
    )
)
def evaluation_job(t: Inputs) -> DataFrame:
    """The whole evaluation job, read back from its results table."""
    path = work_folder(t.spark, "evaluation")
    jobs.evaluation_job(materialize(t.ratings, "ratings"), t.movies, path)
    data = [f"dataset.{c}" for c in ("total_ratings", "filtered_ratings", "total_users", "cold_start_users", "num_movies")]
    positive = (F.col("performance.test_rmse") > 0) & (F.col("performance.test_mae") > 0)
    return t.spark.read.json(path).select(
        *data, "training.train_size", "training.test_size", positive.alias("errors_positive")
    )


_JOB = {
    "kept": _KEPT,
    "jtrain": f"SELECT * FROM kept WHERE {O.PAIR_HASH} % 1000 >= 200",
    "jtest": f"SELECT * FROM kept WHERE {O.PAIR_HASH} % 1000 < 200",
    **O.rank_one("jtrain", ONE["reg_all"], ONE["n_epochs"]),
    "scored": O.rank_one_scores("jtest"),
}


@query(
    sql(
        f"""SELECT (SELECT count(*) FROM jtrain) AS n_train, s.*, l.* FROM (SELECT {_ONE_ERRORS} FROM scored) s CROSS JOIN (
            SELECT rank, movieId, title, round(greatest(0.5, least(5.0, m + coalesce(bu, 0) + score)), 2) AS predicted_rating
            FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, movieId) AS INTEGER) AS rank FROM (
                SELECT movieId, title, bu, m, round(coalesce(p * q, 0) + coalesce(bi, 0)::FLOAT::DOUBLE, 9) AS score
                FROM movies CROSS JOIN m LEFT JOIN ib USING (movieId) LEFT JOIN qi USING (movieId)
                LEFT JOIN ub ON ub.userId = 1 LEFT JOIN pu ON pu.userId = 1
                WHERE movieId NOT IN (SELECT movieId FROM jtrain WHERE userId = 1))) WHERE rank <= 5) l""",
        "ratings",
        "per_user",
        "movies",
        **_JOB,
    )
)
def one_factor_training_job(t: Inputs) -> DataFrame:
    """The training job in value: errors of the metrics row beside the list of user 1 from the model that was saved."""
    folder = work_folder(t.spark, "training")
    jobs.train_job(materialize(t.ratings, "ratings"), t.movies, folder, overrides=ONE, solver="als")
    stored = t.spark.read.json(f"{folder}/metrics").select("n_train", "n_test", "rmse", "mae")
    one = t.users.where("userId = 1")
    lists = factor.FactorModel.load(t.spark, f"{folder}/model").recommend(one, t.movies, 5)
    return stored.crossJoin(lists.select("rank", "movieId", "title", "predicted_rating"))  # one row times five


@query(
    sql(
        f"""SELECT (SELECT count(*) FROM ratings) AS total_ratings, (SELECT count(*) FROM kept) AS filtered_ratings,
        (SELECT count(*) FROM jtrain) AS train_size, rmse AS test_rmse, mae AS test_mae, n_test AS test_size
        FROM (SELECT {_ONE_ERRORS} FROM scored)""",
        "ratings",
        "per_user",
        **_JOB,
    )
)
def one_factor_evaluation_job(t: Inputs) -> DataFrame:
    """The evaluation job in value, read back from its results table."""
    path = work_folder(t.spark, "evaluation")
    jobs.evaluation_job(materialize(t.ratings, "ratings"), t.movies, path, overrides=ONE, solver="als")
    names = ["dataset.total_ratings", "dataset.filtered_ratings", "training.train_size", "training.test_size"]
    return t.spark.read.json(path).select(*names, "performance.test_rmse", "performance.test_mae")


def _comparison(t: Inputs, model: factor.FactorModel) -> DataFrame:
    train, test = t.split
    models = {
        "global": predict.AveragePredictor(),
        "item": predict.AveragePredictor("movieId"),
        "user": predict.AveragePredictor("userId"),
        "bias": predict.BiasPredictor(),
        "factor": model,
    }
    return predict.compare_predictors({name: m.fit(train) for name, m in models.items()}, test)


@query()
def model_comparison(t: Inputs) -> DataFrame:
    """The predictors of ``baseline_comparison`` and the factor model on one test table."""
    return _comparison(t, factor.FactorModel(solver="sgd"))


GRID = {"item_damping": [2.0, 10.0], "user_damping": [5.0]}
# One set of views per configuration and fold, from the same hash buckets.
_FOLD_SQL = " UNION ALL ".join(
    f"""SELECT {c} AS config, {i} AS item_damping, {u} AS user_damping, {f} AS fold,
        sqrt(avg((p - rating) ** 2)) AS rmse, avg(abs(p - rating)) AS mae, count(*) AS n_test
        FROM (SELECT t.rating, greatest(0.5, least(5.0, m + coalesce(ib.b, 0) + coalesce(ub.b, 0))) AS p
            FROM (SELECT * FROM folded WHERE bucket = {f}) t
            CROSS JOIN (SELECT avg(rating) AS m FROM folded WHERE bucket <> {f}) mu
            LEFT JOIN (SELECT movieId, sum(rating - m0) / (count(*) + {i}) AS b FROM folded
                CROSS JOIN (SELECT avg(rating) AS m0 FROM folded WHERE bucket <> {f})
                WHERE bucket <> {f} GROUP BY movieId) ib ON ib.movieId = t.movieId
            LEFT JOIN (SELECT r.userId, sum(r.rating - m0 - x.b) / (count(*) + {u}) AS b FROM folded r
                CROSS JOIN (SELECT avg(rating) AS m0 FROM folded WHERE bucket <> {f})
                JOIN (SELECT movieId, sum(rating - m1) / (count(*) + {i}) AS b FROM folded
                    CROSS JOIN (SELECT avg(rating) AS m1 FROM folded WHERE bucket <> {f})
                    WHERE bucket <> {f} GROUP BY movieId) x ON x.movieId = r.movieId
                WHERE bucket <> {f} GROUP BY r.userId) ub ON ub.userId = t.userId)"""
    for c, (i, u) in enumerate((i, u) for i in GRID["item_damping"] for u in GRID["user_damping"])
    for f in range(3)
)
_FOLDED = f"""SELECT *, {O.PAIR_HASH} % 3 AS bucket
    FROM ratings"""


def _bias_grid(t: Inputs) -> DataFrame:
    ratings = materialize(t.ratings, "ratings")
    return tuning.grid_search(ratings, GRID, folds=3, parallelism=4, model=predict.BiasPredictor)


@query(
    sql(
        """SELECT config, CAST(item_damping AS DOUBLE) AS item_damping, CAST(user_damping AS DOUBLE) AS user_damping,
        round(avg(rmse), 6) AS rmse, round(stddev_pop(rmse), 6) AS rmse_std, round(avg(mae), 6) AS mae,
        round(stddev_pop(mae), 6) AS mae_std, CAST(sum(n_test) AS BIGINT) AS n_test
        FROM scores GROUP BY config, item_damping, user_damping""",
        "ratings",
        folded=_FOLDED,
        scores=_FOLD_SQL,
    )
)
def cv_bias_summary(t: Inputs) -> DataFrame:
    return tuning.cv_summary(_bias_grid(t), list(GRID))


@query(
    sql(
        """SELECT param, value, round(avg(rmse), 6) AS mean_rmse FROM (
            SELECT 'item_damping' AS param, CAST(item_damping AS DOUBLE) AS value, rmse FROM per
            UNION ALL SELECT 'user_damping', CAST(user_damping AS DOUBLE), rmse FROM per) GROUP BY param, value""",
        "ratings",
        folded=_FOLDED,
        scores=_FOLD_SQL,
        per="SELECT config, item_damping, user_damping, avg(rmse) AS rmse FROM scores GROUP BY ALL",
    )
)
def parameter_impact(t: Inputs) -> DataFrame:
    return tuning.parameter_impact(_bias_grid(t), list(GRID))


@query(
    sql(
        """SELECT 'rmse' AS measure, round(rmse, 6) AS score, config, item_damping, user_damping
        FROM (SELECT * FROM per ORDER BY rmse, config LIMIT 1)
        UNION ALL SELECT 'mae', round(mae, 6), config, item_damping, user_damping
        FROM (SELECT * FROM per ORDER BY mae, config LIMIT 1)""",
        "ratings",
        folded=_FOLDED,
        scores=_FOLD_SQL,
        per="""SELECT config, CAST(item_damping AS DOUBLE) AS item_damping, CAST(user_damping AS DOUBLE) AS user_damping,
            avg(rmse) AS rmse, avg(mae) AS mae FROM scores GROUP BY ALL""",
    )
)
def tuning_best(t: Inputs) -> DataFrame:
    return tuning.best_configs(_bias_grid(t), list(GRID))


# ------------------------------------------------------- submissions, streams


@query(
    sql(
        """SELECT n.userId, n.n AS ratings_submitted, n.n + coalesce(o.n, 0) AS total_ratings
        FROM (SELECT userId, count(*) AS n FROM valid GROUP BY userId) n
        LEFT JOIN (SELECT userId, count(*) AS n FROM ratings GROUP BY userId) o ON o.userId = n.userId""",
        "valid",
        "ratings",
    )
)
def rating_append(t: Inputs) -> DataFrame:
    return sinks.append_ratings(t.ratings, t.submissions, min_movie_id=0)


INGEST_SQL = """SELECT event_id, userId, movieId, rating, "timestamp", coalesce(rating BETWEEN 0.5 AND 5.0
    AND rating * 2 = floor(rating * 2) AND movieId >= 1, false) AS valid FROM submissions"""
INGEST_COLUMNS = ["event_id", "userId", "movieId", "rating", "timestamp"]


@query(sql(INGEST_SQL, "submissions"))
def ingest_batch_twin(t: Inputs) -> DataFrame:
    valid, invalid = search.split_valid(t.submissions)
    return (
        valid.select(*INGEST_COLUMNS)
        .withColumn("valid", F.lit(True))
        .unionByName(invalid.select(*INGEST_COLUMNS).withColumn("valid", F.lit(False)))
    )


@query(sql(INGEST_SQL, "submissions"))
def ingest_stream(t: Inputs) -> DataFrame:
    good, bad, state = (work_folder(t.spark, n) for n in ("ratings", "quarantine", "state"))
    stream.ingest(tables.stream_submissions(t.spark, t.sf_dir), good, bad, state).awaitTermination()

    def read(path: str, valid: bool) -> DataFrame:
        return t.spark.read.parquet(path).select(*INGEST_COLUMNS, F.lit(valid).alias("valid"))

    return read(good, True).unionByName(read(bad, False))


TIER_SQL = """SELECT userId, count(*) AS num_ratings, CASE WHEN count(*) < 5 THEN 'genre_based'
    ELSE 'personalized' END AS recommendation_type FROM {view} GROUP BY userId"""


@query(sql(TIER_SQL.format(view="valid"), "valid"))
def tier_counts_stream(t: Inputs) -> DataFrame:
    valid, _ = search.split_valid(tables.stream_submissions(t.spark, t.sf_dir), min_movie_id=0)
    path, state = work_folder(t.spark, "tiers"), work_folder(t.spark, "state")
    stream.count_tiers(valid, path, state).awaitTermination()
    return stream.current_tiers(t.spark, path)


@query(sql(TIER_SQL.format(view="valid"), "valid"))
def tier_counts(t: Inputs) -> DataFrame:
    valid, _ = search.split_valid(t.submissions, min_movie_id=0)
    return stream.tier_counts(valid)


@query(sql("SELECT userId, count(DISTINCT event_id) AS num_ratings FROM submissions GROUP BY userId", "submissions"))
def repeated_events_stream(t: Inputs) -> DataFrame:
    """Every file is read twice, so each event arrives twice; the deduplicated count must not notice."""
    once = tables.stream_submissions(t.spark, t.sf_dir)
    again = tables.stream_submissions(t.spark, t.sf_dir)
    distinct = stream.drop_repeats(once.unionByName(again), "40 days")
    path, state = work_folder(t.spark, "counts"), work_folder(t.spark, "state")
    stream.count_tiers(distinct, path, state).awaitTermination()
    return stream.current_tiers(t.spark, path).select("userId", "num_ratings")


@query(
    sql(
        """SELECT userId, CAST(k AS INTEGER) AS num_ratings, CASE WHEN k < 5 THEN 'genre_based'
        ELSE 'personalized' END AS recommendation_type, "timestamp" AS since
        FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY "timestamp", event_id) AS k FROM valid)
        WHERE k IN (1, 5)""",
        "valid",
    )
)
def tier_replay(t: Inputs) -> DataFrame:
    valid, _ = search.split_valid(t.submissions, min_movie_id=0)
    return stream.tier_changes(valid)


def _refreshed(label: str, where: str, top: int | None) -> str:
    views = O.hybrid_lists("baskets", "basket_users", top)
    return sql(
        f"SELECT {REC_COLUMNS}, '{label}' AS recommendation_type FROM recs WHERE {where}", "baskets", "movies", "bridge", "basket_users", **views
    )


@query(
    f"""SELECT * FROM ({_refreshed("genre_based", "num_ratings BETWEEN 1 AND 4", None)})
    UNION ALL SELECT * FROM ({_refreshed("collaborative_filtering_ready", "num_ratings >= 5", 3)})"""
)
def tier_refresh_stream(t: Inputs) -> DataFrame:
    """All order lines arrive as a stream; every touched user gets a list."""
    ratings, lists, state = (work_folder(t.spark, n) for n in ("ratings", "lists", "state"))
    table = coldstart.stored_popularity(t.baskets, t.movies)
    nothing = t.spark.createDataFrame([], tables.RATINGS_SCHEMA)
    # The one file of order lines is laid out as four, so that users are touched by several micro-batches.
    files = work_folder(t.spark, "baskets")
    t.baskets.repartition(4, "movieId").write.option("maxRecordsPerFile", 0).parquet(files)
    source = t.spark.readStream.schema(t.baskets.schema).option("maxFilesPerTrigger", 1).parquet(files)
    stream.refresh_lists(
        source, nothing, t.movies, ratings, lists, state, min_movie_id=0, popularity=table
    ).awaitTermination()
    return stream.current_lists(t.spark, lists)


@query(
    sql(
        """SELECT userId, rank, movieId, title, genres, predicted_rating AS score, num_ratings, 'personalized' AS recommendation_type
        FROM fixed_recs JOIN sized USING (userId)""",
        "ratings",
        "movies",
        "valid",
        every="SELECT userId, movieId FROM ratings UNION ALL SELECT userId, movieId FROM valid",
        sized="""SELECT userId, count(*) AS num_ratings FROM every WHERE userId IN (SELECT userId FROM valid)
            GROUP BY userId HAVING count(*) >= 5""",
        **O.fixed_lists("sized", "every"),
    )
)
def fixed_refresh_personalized(t: Inputs) -> DataFrame:
    """Event submissions refresh the lists of the users they touch; those with five or more ratings get the model's."""
    ratings, lists, state = (work_folder(t.spark, n) for n in ("ratings", "lists", "state"))
    history = materialize(t.ratings, "ratings")
    everyone = t.users.unionByName(t.submissions.select("userId").distinct()).distinct()
    model = _fixed_model(t, everyone, history)
    stream.refresh_lists(
        tables.stream_submissions(t.spark, t.sf_dir), history, t.movies, ratings, lists, state, min_movie_id=0,
        personalized=lambda rows, users: route.personalized_lists(model, rows, t.movies, users),
    ).awaitTermination()
    return stream.current_lists(t.spark, lists).where("recommendation_type = 'personalized'")


@query()
def tier_refresh_personalized(t: Inputs) -> DataFrame:
    """Event submissions refresh the factor-model lists of the users they touch."""
    ratings, lists, state = (work_folder(t.spark, n) for n in ("ratings", "lists", "state"))
    history = materialize(t.ratings, "ratings")
    model = _model(t, "ratings")
    stream.refresh_lists(
        tables.stream_submissions(t.spark, t.sf_dir),
        history,
        t.movies,
        ratings,
        lists,
        state,
        min_movie_id=0,
        personalized=lambda rows, users: route.personalized_lists(model, rows, t.movies, users),
    ).awaitTermination()
    return stream.current_lists(t.spark, lists)


@query(
    sql(
        f"""SELECT t.userId, c.n AS num_ratings, CASE WHEN c.n < 5 THEN 'genre_based' ELSE 'personalized' END
        AS recommendation_type, {_RULES.format(n=_LENGTH)}
        FROM (SELECT DISTINCT userId FROM valid) t JOIN (SELECT userId, count(*) AS n FROM every GROUP BY userId) c
        ON c.userId = t.userId LEFT JOIN known r ON r.userId = t.userId""",
        "ratings",
        "movies",
        "valid",
        every="""SELECT userId, movieId FROM ratings UNION ALL SELECT userId, movieId FROM valid""",
        known=_RATED_KNOWN.format(source="every"),
    )
)
def tier_refresh_personalized_rules(t: Inputs) -> DataFrame:
    valid, _ = search.split_valid(t.submissions, min_movie_id=0)
    rated = t.ratings.select("userId", "movieId").unionByName(valid.select("userId", "movieId"))
    return _list_rules(tier_refresh_personalized(t), "score", rated, "num_ratings", "recommendation_type")


@query(
    sql(
        """SELECT round(1 - coalesce((SELECT sum(c / (100 - c)) FROM pairs), 0)
            / ((SELECT count(*) FROM users) * ((SELECT count(*) FROM users) - 1) / 2), 6) AS diversity""",
        "ratings",
        "movies",
        "users",
        **O.popular_lists("ratings", 50),
        pairs="""SELECT a.userId AS u, b.userId AS v, count(*) AS c FROM recs a
            JOIN recs b ON a.movieId = b.movieId AND a.userId < b.userId GROUP BY u, v""",
    )
)
def diversity_long(t: Inputs) -> DataFrame:
    """Diversity of lists of 50."""
    history = materialize(t.ratings, "ratings")
    table = coldstart.stored_popularity(history, t.movies)
    return metrics.diversity(materialize(coldstart.popular_for_users(history, table, t.users, 50), "lists"), t.users)
