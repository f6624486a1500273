import datetime as dt

import pytest
from pyspark.sql import functions as F

from tastegrid.functions import cosine, epoch_seconds, is_valid_rating, jaccard, utc_datetime
from tastegrid.operators import prepare, profile, search
from tastegrid.sources import sinks, tables


@pytest.fixture(scope="module")
def odd(spark):
    """Null genres, null title, empty text and a genre that is a regex."""
    return spark.createDataFrame(
        [
            (1, "Alpha (1999)", "Action|Drama"),
            (2, None, "action"),
            (3, "alphabet", None),
            (4, "Beta", ""),
            (5, "Gamma", "(no genres listed)"),
            (6, "ALPHA two", "Dra"),
        ],
        "movieId long, title string, genres string",
    )


def ids(df):
    return [r.movieId for r in df.collect()]


def test_search(odd):
    assert ids(search.search_title(odd, "alpha")) == [1, 3, 6]
    assert ids(search.search_title(odd, "alpha", limit=2)) == [1, 3]
    assert ids(search.search_title(odd, "^alpha ")) == [1, 6]
    assert ids(search.search_title(odd, "(1999)", literal=True)) == [1]
    with pytest.raises(ValueError):
        search.search_title(odd, "a", limit=0)


def test_genre_filters(odd):
    assert ids(search.genre_filter(odd, "Action")) == [1]
    assert ids(search.genre_filter(odd, "Action", ignore_case=True)) == [1, 2]
    assert ids(search.genre_filter(odd, "Dra")) == [1, 6]
    assert ids(search.genre_filter(odd, "Dra", exact=True)) == [6]
    assert ids(search.genre_filter(odd, "(no genres listed)")) == [5]
    assert ids(search.genre_filter(odd, "(no genres listed)", exact=True)) == [5]


def test_lookup(spark, odd):
    wanted = spark.createDataFrame([(1,), (77,)], "movieId long")
    assert {r.movieId: r.found for r in search.lookup_items(odd, wanted).collect()} == {1: True, 77: False}


def test_genre_tables(odd):
    assert [r.genre for r in profile.genre_list(odd).collect()] == [
        "", "(no genres listed)", "Action", "Dra", "Drama", "action",
    ]
    loose = {r.movieId: r for r in prepare.genre_onehot(odd, genres=["Dra", "Drama"]).collect()}
    assert (loose[1].genre_Dra, loose[1].genre_Drama, loose[6].genre_Drama, loose[3].genre_Dra) == (1, 1, 0, 0)
    exact = {r.movieId: r for r in prepare.genre_onehot(odd, exact=True, genres=["Dra"]).collect()}
    assert (exact[1].genre_Dra, exact[6].genre_Dra) == (0, 1)


def test_quality(spark, odd):
    ratings = spark.createDataFrame(
        [(1, 1, 5.0, 1), (1, 1, 3.7, None), (2, None, 6.0, 1), (None, 9, None, 1)],
        "userId long, movieId long, rating double, timestamp long",
    )
    movies = odd.union(odd.where("movieId = 1"))
    got = {r.check: r.n for r in profile.data_quality(ratings, movies).collect()}
    assert got["movies_rows"] == 7 and got["movies_duplicate_movieId"] == 1
    assert got["movies_null_title"] == 1 and got["movies_null_genres"] == 1
    assert got["ratings_null_userId"] == 1 and got["ratings_null_timestamp"] == 1
    assert got["ratings_invalid_value"] == 3
    facts = profile.referential_integrity(ratings.where("movieId is not null"), odd).first()
    assert (facts.orphan_ratings, facts.orphan_movies, facts.unrated_movies) == (1, 1, 5)


def test_repeated_catalogue_rows_multiply_counts(spark, cold):
    ratings, movies = cold
    twice = movies.union(movies.where("movieId = 105"))
    top = profile.popular_items(ratings, twice, 1, 2).collect()
    assert [(r.movieId, r.num_ratings) for r in top] == [(105, 4), (102, 3)]


def test_empty_tables(spark):
    ratings = spark.createDataFrame([], tables.RATINGS_SCHEMA)
    movies = spark.createDataFrame([], tables.MOVIES_SCHEMA)
    stats = profile.dataset_statistics(ratings).first()
    assert stats.num_ratings == 0 and stats.sparsity is None
    assert profile.popular_items(ratings, movies).count() == 0
    assert profile.count_histogram(ratings, "userId").count() == 0
    assert profile.activity_classes(ratings).count() == 0
    assert prepare.filter_cold_users(ratings).count() == 0
    assert profile.catalogue_facts(ratings, movies).first().share_rated is None
    assert profile.rating_moments(ratings).first().mean_rating is None
    assert profile.count_boxplot(ratings, "userId").first().q1 is None
    assert {r.n for r in profile.data_quality(ratings, movies).collect()} == {0}


def test_activity_classes(spark):
    sizes = {1: 4, 2: 5, 3: 19, 4: 20}
    ratings = spark.createDataFrame(
        [(u, i) for u, n in sizes.items() for i in range(n)], "userId long, movieId long"
    )
    got = {r.category: r.num_users for r in profile.activity_classes(ratings).collect()}
    assert got == {"cold_start": 1, "moderate": 2, "active": 1}
    users = spark.range(1, 7).withColumnRenamed("id", "userId")
    rows = {r.category: r for r in profile.cold_start_distribution(ratings, users).collect()}
    assert rows["new_user"].user_count == 2 and rows["moderate"].avg_ratings == 12


def test_validity(spark):
    df = spark.createDataFrame(
        [(5.0, 1), (0.5, 1), (6.0, 1), (3.7, 1), (0.0, 1), (4.0, 0), (None, 1)], "rating double, movieId long"
    )
    assert [r[0] for r in df.select(is_valid_rating("rating", "movieId")).collect()] == [
        True, True, False, False, False, False, False,
    ]
    good, bad = search.split_valid(df)
    assert (good.count(), bad.count()) == (2, 5)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(1583650800 + 5,)], "timestamp long").select(
            utc_datetime("timestamp").alias("t"), "timestamp"
        )
        row = df.select("t", epoch_seconds("t").alias("back")).first()
        assert row.t == dt.datetime(2020, 3, 8, 7, 0, 5) and row.back == 1583650805
        full = prepare.temporal_features(df.select("timestamp")).first()
        assert (full.year, full.month, full.day_of_week) == (2020, 3, 6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_array_measures(spark):
    df = spark.createDataFrame(
        [(["a", "b"], ["b", "c"], [1.0, 0.0], [0.0, 0.0]), ([], [], [3.0, 4.0], [4.0, 3.0]), (None, ["a"], [1.0], [2.0])],
        "x array<string>, y array<string>, p array<double>, q array<double>",
    )
    rows = df.select(jaccard(F.col("x"), F.col("y")).alias("j"), cosine(F.col("p"), F.col("q")).alias("c")).collect()
    assert [r.j for r in rows] == [pytest.approx(1 / 3), 0.0, 0.0]
    assert rows[0].c is None and rows[1].c == pytest.approx(0.96) and rows[2].c == pytest.approx(1.0)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_scans(spark, cold, tmp_path, fmt):
    ratings, movies = cold
    ratings.write.format(fmt).option("header", True).save(str(tmp_path / "r"))
    movies.write.format(fmt).option("header", True).save(str(tmp_path / "m"))
    r = tables.load_ratings(spark, str(tmp_path / "r"), fmt=fmt)
    assert r.schema == tables.RATINGS_SCHEMA and r.count() == 23
    assert tables.load_ratings(spark, str(tmp_path / "r"), limit=0, fmt=fmt).count() == 23
    first = tables.load_movies(spark, str(tmp_path / "m"), limit=3, fmt=fmt)
    assert ids(first) == [101, 102, 103]


def test_scan_checks_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="missing columns"):
        tables.load_movies(spark, str(tmp_path / "x"))


def test_predicates_and_columns_reach_the_scan(spark, cold, tmp_path):
    cold[0].write.parquet(str(tmp_path / "r"))
    rows = search.user_history(tables.load_ratings(spark, str(tmp_path / "r")), 3).select("movieId")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(userId,3)" in plan and "rating" not in plan.split("ReadSchema")[1]


def test_append_ratings(spark, cold, tmp_path):
    ratings, _ = cold
    new = spark.createDataFrame(
        [(11, 101, 1.5, 1), (11, 103, 2.0, 2), (11, 103, 6.5, 3), (77, 101, 3.7, 4), (78, 102, 0.5, 5)],
        "userId long, movieId long, rating double, timestamp long",
    )
    got = {r.userId: (r.ratings_submitted, r.total_ratings) for r in sinks.append_ratings(ratings, new, str(tmp_path / "h")).collect()}
    assert got == {11: (2, 8), 78: (1, 1)}
    assert spark.read.parquet(str(tmp_path / "h")).count() == 3


def test_recommendation_sink(spark, tmp_path):
    recs = spark.createDataFrame(
        [(1, 2, 20, "b", "g", 1.0, 0, "cold_start"), (1, 1, 10, "a", "g", 2.0, 0, "cold_start"), (2, 1, 10, "a", "g", 2.0, 3, "genre_based")],
        "userId long, rank int, movieId long, title string, genres string, score double, num_ratings long, recommendation_type string",
    )
    sinks.write_recommendations(recs, str(tmp_path / "recs"))
    back = spark.read.parquet(str(tmp_path / "recs"))
    assert back.where("recommendation_type = 'cold_start'").count() == 2
    nested = {r.userId: [x.movieId for x in r.recommendations] for r in sinks.nested_lists(back).collect()}
    assert nested == {1: [10, 20], 2: [10]}
