from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import coldstart, popularity, similar


def brute_popularity(ratings, movies):
    stars = {}
    for _, i, r, _ in ratings:
        stars.setdefault(i, []).append(r)
    m = float(np.percentile([len(v) for v in stars.values()], 25))
    c = sum(r for _, _, r, _ in ratings) / len(ratings)
    genres = {i: g for i, _, g in movies}
    rows = []
    for i, v in stars.items():
        n = len(v)
        rows.append((i, genres.get(i), (n / (n + m)) * (sum(v) / n) + (m / (n + m)) * c))
    return sorted(rows, key=lambda x: (-x[2], x[0]))


def brute_hybrid(ratings, movies, user, n, top):
    pop = brute_popularity(ratings, movies)
    mine = {}
    for u, i, r, _ in ratings:
        if u == user:
            mine[i] = r
    genres = {i: g for i, _, g in movies}
    liked = [g for i, r in mine.items() if r >= 3.5 and genres.get(i) for g in genres[i].split("|")]
    if not liked:
        return [i for i, _, _ in pop if i not in mine][:n]
    counts = sorted(Counter(liked).items(), key=lambda x: (-x[1], x[0]))
    pref = [g for g, _ in (counts[:top] if top else counts)]
    scored = [
        (i, 0.6 * s / 5.0 + 0.4 * (len(set(pref) & set(g.split("|"))) / len(pref)))
        for i, g, s in pop
        if g is not None
    ]
    scored.sort(key=lambda x: (-x[1], x[0]))
    return [i for i, _ in scored if i not in mine][:n]


def as_lists(df):
    out = {}
    for r in df.orderBy("userId", "rank").collect():
        out.setdefault(r.userId, []).append(r.movieId)
    return out


@pytest.mark.parametrize("steps", [(64, 1024), (8, 16), (1, 2)])
@pytest.mark.parametrize("top", [3, None])
def test_hybrid_equals_brute_force_for_every_history_length(spark, world, monkeypatch, steps, top):
    ratings, movies, rdf, mdf = world
    monkeypatch.setattr(coldstart, "DEPTH_STEPS", steps)
    table = coldstart.stored_popularity(rdf, mdf)
    users = spark.range(1, 43).withColumnRenamed("id", "userId")
    sized = coldstart.with_history_size(rdf, users)
    got = as_lists(coldstart.hybrid(rdf, table, mdf, sized, 5, top))
    for u in range(1, 43):
        assert got.get(u, []) == brute_hybrid(ratings, movies, u, 5, top), u
    assert 40 not in got  # rated the whole catalogue


def test_popular_for_users_equals_brute_force(spark, world):
    ratings, movies, rdf, mdf = world
    table = coldstart.stored_popularity(rdf, mdf)
    order = [i for i, _, _ in brute_popularity(ratings, movies)]
    users = spark.range(1, 43).withColumnRenamed("id", "userId")
    got = as_lists(coldstart.popular_for_users(rdf, table, users, 7))
    for u in range(1, 43):
        mine = {i for v, i, _, _ in ratings if v == u}
        assert got.get(u, []) == [i for i in order if i not in mine][:7]


def test_popular_list_filter_and_exclusion(spark, cold):
    ratings, movies = cold
    table = popularity.popularity_quantile(ratings, movies)
    top = popularity.top_popular(table, 5).collect()
    scores = [r.popularity_score for r in top]
    assert len(top) == 5 and scores == sorted(scores, reverse=True)
    assert all("Noir" in r.genres for r in popularity.top_popular(table, 5, "Noir").collect())
    gone = spark.createDataFrame([(101,), (102,)], "movieId long")
    left = {r.movieId for r in popularity.top_popular(table, 20, exclude=gone).collect()}
    assert left == set(range(103, 113))


def test_fixed_popularity_drops_rare_and_unknown_items(spark, cold):
    ratings, movies = cold
    rows = popularity.popularity_fixed(ratings, movies.where("movieId <> 104"), min_ratings=3).collect()
    assert {r.movieId for r in rows} == {102, 109}
    mean = ratings.agg(F.avg("rating")).first()[0]
    one = next(r for r in rows if r.movieId == 109)
    assert one.popularity_score == pytest.approx(3 / 6 * 3.5 + 3 / 6 * mean)


def test_unknown_items_stay_in_the_quantile_table(spark, cold):
    ratings, movies = cold
    rows = popularity.popularity_quantile(ratings, movies.where("movieId <> 101")).collect()
    assert len(rows) == 12
    assert next(r for r in rows if r.movieId == 101).title is None


def test_tiers(spark, cold):
    ratings, movies = cold
    users = spark.createDataFrame([(11,), (12,), (13,), (14,), (999,)], "userId long")
    rows = coldstart.route_cold_start(ratings, movies, users, 5).collect()
    kind = {r.userId: (r.num_ratings, r.recommendation_type) for r in rows}
    assert kind[999] == (0, "cold_start_popular")
    assert kind[14] == (2, "cold_start_hybrid")
    assert kind[11] == (6, "collaborative_filtering_ready")
    assert 13 not in kind  # all items rated: nothing is left
    seen = {(r.userId, r.movieId) for r in ratings.collect()}
    assert not any((r.userId, r.movieId) in seen for r in rows)
    service = coldstart.route_service_cold(ratings, movies, users, 5).collect()
    assert {r.userId: r.recommendation_type for r in service} == {
        12: "genre_based",
        14: "genre_based",
        999: "cold_start",
    }


def test_genre_based_prefers_the_genre(spark, cold):
    ratings, movies = cold
    table = popularity.popularity_quantile(ratings, movies)
    wanted = spark.createDataFrame([(1, ["Noir"]), (2, ["Musical", "Musical"])], "userId long, genres array<string>")
    rows = coldstart.genre_based(wanted, table, 3).collect()
    assert {r.rank for r in rows if r.userId == 1} == {1, 2, 3}
    noir = {102, 104, 106, 109, 112}
    assert all(r.movieId in noir for r in rows if r.userId == 1)
    counts = {r.movieId: r.num_ratings for r in table.collect()}
    assert all(r.title == f"Reel {r.movieId}" and r.num_ratings == counts[r.movieId] for r in rows)


def test_last_rating_of_an_item_counts(spark, cold):
    _, movies = cold
    twice = spark.createDataFrame(
        [(1, 104, 5.0, 10), (1, 104, 1.0, 20), (2, 104, 1.0, 10), (2, 104, 5.0, 20)],
        "userId long, movieId long, rating double, timestamp long",
    )
    sets = {r.userId: r.set_key for r in coldstart.preference_sets(twice, movies).collect()}
    assert sets == {2: ["Noir"]}


def test_ratings_without_time_and_on_wider_scales(spark, cold):
    _, movies = cold
    rows = spark.createDataFrame(
        [(1, 104, 4.5, None), (2, 104, 10.0, 5), (3, 104, 5.0, None), (3, 104, 1.0, -7), (4, 104, None, 9), (4, 104, 4.0, 1),
         (5, 104, 3.75, None), (5, 104, 3.25, None)],
        "userId long, movieId long, rating double, timestamp long",
    )
    last = {r.userId: r.rating for r in coldstart.latest_ratings(rows).collect()}
    assert last == {1: 4.5, 2: 10.0, 3: 1.0, 4: 4.0, 5: 3.75}
    liked = {r.userId for r in coldstart.preference_sets(rows, movies).collect()}
    assert liked == {1, 2, 4, 5}


def test_null_genres_and_missing_items(spark, cold):
    ratings, _ = cold
    movies = spark.createDataFrame(
        [(101, "x", None), (102, None, "Noir"), (103, "z", "")], "movieId long, title string, genres string"
    )
    users = spark.createDataFrame([(11,), (999,)], "userId long")
    rows = coldstart.route_cold_start(ratings, movies, users, 20).collect()
    assert len([r for r in rows if r.userId == 999]) == 12


def test_bad_n(spark, cold):
    ratings, movies = cold
    table = popularity.popularity_quantile(ratings, movies)
    with pytest.raises(ValueError):
        popularity.top_popular(table, 0)
    with pytest.raises(ValueError, match="at most 50"):
        coldstart.route_service_cold(ratings, movies, ratings.select("userId").distinct(), 51)


def test_similar_by_genre_equals_brute_force(spark, world):
    _, movies, _, mdf = world
    got = {}
    for r in similar.similar_by_genre(mdf, 6).orderBy("movieId", "rank").collect():
        got.setdefault(r.movieId, []).append((r.similarId, r.similarity))
    sets = {i: set(g.split("|")) if g else set() for i, _, g in movies}
    for i in sets:
        want = []
        for j in sets:
            if j != i:
                union = sets[i] | sets[j]
                want.append((j, len(sets[i] & sets[j]) / len(union) if union else 0.0))
        want.sort(key=lambda x: (-x[1], x[0]))
        assert got[i] == want[:6], i
    one = similar.similar_by_genre(mdf, 6, spark.createDataFrame([(7,), (-1,)], "movieId long")).collect()
    assert {r.movieId for r in one} == {7} and len(one) == 6
    everything = similar.similar_by_genre(mdf, 500).groupBy("movieId").count().collect()
    assert all(r["count"] == len(sets) - 1 for r in everything)


def test_similar_lists_are_taken_without_sorting_items(spark):
    """The item's part of its class list; ids that come twice rank the lists of both rows together."""
    rows = [(i, "a|b" if i % 2 else "a") for i in range(1, 9)] + [(3, "a")]
    movies = spark.createDataFrame(rows, "movieId long, genres string")
    found = {}
    for r in similar.similar_by_genre(movies, 3).orderBy("movieId", "rank").collect():
        found.setdefault(r.movieId, []).append((r.rank, r.similarId, round(r.similarity, 3)))
    assert found[1] == [(1, 3, 1.0), (2, 5, 1.0), (3, 7, 1.0)]
    assert found[4] == [(1, 2, 1.0), (2, 3, 1.0), (3, 6, 1.0)]
    assert [r[0] for r in found[3]] == [1, 2, 3] and {r[1] for r in found[3]} <= {1, 2, 4, 5} and len(found) == 8
    sized = spark.createDataFrame([(i, f"g{i % 5}") for i in range(4000)], "movieId long, genres string")
    plan = similar.similar_by_genre(sized, 3)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and "item-classes" in plan
    assert similar.similar_by_genre(sized, 3).count() == 12_000



def test_popular_lists_read_the_leading_items_only(world, monkeypatch):
    """What is stored of the histories are the rated items that a list can reach; lists are those of a plain search."""
    rows, _, ratings, movies = world
    table = coldstart.stored_popularity(ratings, movies)
    stored, plain = {}, coldstart.materialize

    def noted(df, name, **k):
        stored[name] = plain(df, name, **k)
        return stored[name]

    monkeypatch.setattr(coldstart, "materialize", noted)
    some = ratings.where("userId <> 40")
    users = some.select("userId").distinct()
    found = {}
    for r in coldstart.popular_for_users(some, table, users, 3).orderBy("userId", "rank").collect():
        found.setdefault(r.userId, []).append(r.movieId)
    order = [r.movieId for r in table.orderBy(F.desc("popularity_score"), "movieId").collect()]
    rated = {}
    for u, i, *_ in rows:
        rated.setdefault(u, set()).add(i)
    del rated[40]
    assert found == {u: [i for i in order if i not in rated[u]][:3] for u in rated}
    kept, reach = stored["rated-leading"].collect(), set(order[: 3 + max(map(len, rated.values()))])
    assert {r.movieId for r in kept} <= reach and len(kept) < sum(map(len, rated.values()))


@pytest.mark.parametrize("steps", [(64, 1024), (2, 4)])
def test_list_rows_carry_no_genre_sets(spark, world, monkeypatch, steps):
    """Users meet lists by the number of their set; the genres of a set travel once per set and user, not per list row."""
    rows, movies, ratings, items = world
    monkeypatch.setattr(coldstart, "DEPTH_STEPS", steps)
    met, plain = [], coldstart.salted_join

    def watched(facts, lookup, *a, **k):
        met.append({t for side in (facts, lookup) for _, t in side.dtypes})
        return plain(facts, lookup, *a, **k)

    monkeypatch.setattr(coldstart, "salted_join", watched)
    table = coldstart.stored_popularity(ratings, items)
    prefs = coldstart.preference_sets(ratings, items, top=None).withColumnRenamed("set_key", "genres")
    got = as_lists(coldstart.genre_based(prefs, table, 5, exclude=ratings))
    assert met and not any(t.startswith("array") for types in met for t in types)
    liked = {r.userId for r in prefs.collect()}
    assert liked and all(got.get(u, []) == brute_hybrid(rows, movies, u, 5, None) for u in liked)
