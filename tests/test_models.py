import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid import jobs
from tastegrid.operators import predict, prepare, route, tuning
from tastegrid.operators.factor import FactorModel
from tastegrid.sources import sinks


@pytest.fixture(scope="module")
def small(spark):
    """Three users, seven items, nine pairs of eight ratings each."""
    stars = {21: {1: 4.0, 2: 2.5, 5: 3.0}, 22: {2: 1.5, 3: 4.5}, 23: {1: 5.0, 4: 3.5, 6: 2.0, 7: 4.0}}
    rows = [(u, i, s, 0) for u, mine in stars.items() for i, s in mine.items()] * 8
    ratings = spark.createDataFrame(rows, "userId long, movieId long, rating double, timestamp long")
    genres = ["Noir", "Heist|Noir", "Musical", "Western", "Heist", "Noir|Western", "Musical|Heist"]
    movies = spark.createDataFrame(
        [(i + 1, f"Reel {i + 1}", g) for i, g in enumerate(genres)], "movieId long, title string, genres string"
    )
    return ratings, movies


@pytest.fixture(scope="module")
def fitted(small):
    return FactorModel(n_factors=4, n_epochs=3, reg_all=0.1).fit(small[0])


@pytest.fixture(scope="module")
def planted(spark):
    """Rank 3 plus offsets and noise, rounded to half stars."""
    rng = np.random.default_rng(7)
    p, q = rng.normal(0, 0.55, (400, 3)), rng.normal(0, 0.55, (250, 3))
    bu, bi = rng.normal(0, 0.4, 400), rng.normal(0, 0.4, 250)
    r = 3.3 + bu[:, None] + bi[None, :] + p @ q.T + rng.normal(0, 0.25, (400, 250))
    r = np.clip(np.round(r * 2) / 2, 0.5, 5.0)
    u, i = np.nonzero(rng.random((400, 250)) < 0.15)
    rows = [(int(a), int(b), float(r[a, b]), 0) for a, b in zip(u, i)]
    return spark.createDataFrame(rows, "userId long, movieId long, rating double, timestamp long")


def test_untrained_use_raises(spark, small):
    ratings, movies = small
    for call in (
        lambda m: m.predict(ratings),
        lambda m: m.recommend(ratings, movies),
        lambda m: m.similar(movies),
        lambda m: m.save("/nowhere"),
    ):
        with pytest.raises(ValueError, match="Model not trained"):
            call(FactorModel())
    for model in (predict.AveragePredictor(), predict.AveragePredictor("userId"), predict.BiasPredictor()):
        with pytest.raises(ValueError, match="Model not trained"):
            model.predict(ratings)


def test_averages_and_fallback(spark, small):
    ratings, _ = small
    pairs = spark.createDataFrame([(21, 1), (21, 99), (77, 1)], "userId long, movieId long")
    mean = ratings.agg(F.avg("rating")).first()[0]

    def scores(key):
        out = predict.AveragePredictor(key).fit(ratings).predict(pairs).collect()
        return {(r.userId, r.movieId): r.prediction for r in out}

    assert set(scores(None).values()) == {mean}
    assert scores("movieId") == {(21, 1): 4.5, (21, 99): mean, (77, 1): 4.5}
    by_user = scores("userId")
    assert by_user[(21, 99)] == pytest.approx(9.5 / 3) and by_user[(77, 1)] == mean


def test_predictions_in_scale_and_unknown_ids(spark, small, fitted):
    ratings, _ = small
    pairs = ratings.select("userId", "movieId").distinct().union(
        spark.createDataFrame([(999, 1), (21, 999), (999, 999)], "userId long, movieId long")
    )
    rows = fitted.predict(pairs).collect()
    assert len(rows) == 12 and all(0.5 <= r.prediction <= 5.0 for r in rows)
    unknown = next(r for r in rows if (r.userId, r.movieId) == (999, 999))
    assert unknown.prediction == pytest.approx(fitted.mean)


def test_recommendations_leave_out_training_items(spark, small, fitted):
    ratings, movies = small
    users = spark.createDataFrame([(21,), (22,), (999,)], "userId long")
    rows = fitted.recommend(users, movies, 5).collect()
    per = {}
    for r in rows:
        per.setdefault(r.userId, []).append(r.movieId)
        assert 0.5 <= r.predicted_rating <= 5.0 and r.title is not None
    assert set(per[21]) == {3, 4, 6, 7} and set(per[22]) == {1, 4, 5, 6, 7} and len(per[999]) == 5
    everything = fitted.recommend(users, movies, 50, exclude_rated=False)
    assert everything.where("userId = 21").count() == 7
    more = spark.createDataFrame([(21, 4)], "userId long, movieId long")
    assert {r.movieId for r in fitted.recommend(users, movies, 9, exclude=more).where("userId = 21").collect()} == {3, 6, 7}


def test_ranking_agrees_with_predictions(spark, planted):
    model = FactorModel(n_factors=3, n_epochs=4, reg_all=0.05).fit(planted)
    movies = spark.range(250).select(F.col("id").alias("movieId"), F.lit("t").alias("title"), F.lit("g").alias("genres"))
    users = spark.range(40).withColumnRenamed("id", "userId")
    lists = model.recommend(users, movies, 5, rows_per_block=60)
    seen = planted.select("userId", "movieId")
    grid = spark.createDataFrame([(u, i) for u in range(40) for i in range(250)], "userId long, movieId long")
    scored = model.predict(grid.join(seen, ["userId", "movieId"], "left_anti")).toPandas()
    for user, part in lists.toPandas().groupby("userId"):
        mine = scored[scored.userId == user].sort_values("prediction", ascending=False)
        fifth = mine.prediction.iloc[4]
        chosen = mine[mine.movieId.isin(part.movieId)]
        assert len(part) == 5 and len(chosen) == 5
        assert (chosen.prediction >= fifth - 1e-6).all()


def test_similar_items(spark, small, fitted):
    _, movies = small
    rows = fitted.similar(movies, 3).collect()
    assert len(rows) == 21 and all(r.movieId != r.similarId for r in rows)
    assert all(-1.0 <= r.similarity_score <= 1.0 for r in rows)
    assert fitted.similar(movies, 3, spark.createDataFrame([(999,)], "movieId long")).count() == 0


def test_quality_order_on_planted_data(planted):
    train, test = prepare.hash_split(planted)
    models = {
        "global": predict.AveragePredictor(),
        "item": predict.AveragePredictor("movieId"),
        "user": predict.AveragePredictor("userId"),
        "bias": predict.BiasPredictor(),
        "factor": FactorModel(n_factors=3, n_epochs=8, reg_all=0.05),
        "plain": FactorModel(n_factors=3, n_epochs=8, reg_all=0.05, use_bias=False),
    }
    table = predict.compare_predictors({k: m.fit(train) for k, m in models.items()}, test)
    rmse = {r.model: r.rmse for r in table.collect()}
    assert rmse["factor"] < rmse["bias"] < rmse["item"] < rmse["global"]
    assert rmse["bias"] < rmse["user"] < rmse["global"] and rmse["plain"] < rmse["bias"]


def test_train_save_load(spark, small, tmp_path):
    ratings, movies = small
    model = FactorModel(n_factors=4, n_epochs=3, reg_all=0.1)
    measured = model.train(ratings, 0.3, save_path=str(tmp_path / "m"))
    assert measured["rmse"] >= 0 and measured["mae"] >= 0
    assert measured["n_train"] > 0 and measured["n_train"] + measured["n_test"] == 72
    loaded = FactorModel.load(spark, str(tmp_path / "m"))
    assert loaded.params == model.params and loaded.metrics["n_train"] == measured["n_train"]
    pairs = ratings.select("userId", "movieId").distinct()

    def scores(m):
        return {(r.userId, r.movieId): r.prediction for r in m.predict(pairs).collect()}

    before, after = scores(model), scores(loaded)
    assert all(abs(before[k] - after[k]) < 1e-3 for k in before)
    users = spark.createDataFrame([(21,)], "userId long")
    assert loaded.recommend(users, movies, 3).count() == model.recommend(users, movies, 3).count()


def test_ids_beyond_int_range(spark, small):
    ratings, movies = small
    shift = 10**12
    wide = ratings.withColumn("userId", F.col("userId") + shift).withColumn("movieId", F.col("movieId") + shift)
    model = FactorModel(n_factors=4, n_epochs=2, reg_all=0.1).fit(wide)
    assert model.items.where("features is null").count() == 0
    assert {r.movieId - shift for r in model.items.collect()} == {1, 2, 3, 4, 5, 6, 7}
    assert model.evaluate(wide).first().n_test == 72


def test_routes(spark, small, fitted):
    ratings, movies = small
    few = spark.createDataFrame(
        [(50, 1, 5.0, 1), (50, 3, 4.0, 2)], "userId long, movieId long, rating double, timestamp long"
    )
    history = ratings.unionByName(few)
    users = spark.createDataFrame([(21,), (50,), (51,)], "userId long")
    kinds = {
        r.userId: r.recommendation_type
        for r in route.route_integrated(fitted, history, movies, users, 4).collect()
    }
    assert kinds == {21: "personalized", 50: "cold_start_hybrid", 51: "cold_start_popular"}
    rows = route.route_service(fitted, history, movies, users, 4).collect()
    assert {r.userId: r.recommendation_type for r in rows} == {21: "personalized", 50: "genre_based", 51: "cold_start"}
    assert {r.movieId for r in rows if r.userId == 21} == {3, 4, 6, 7}
    assert {r.movieId for r in rows if r.userId == 50}.isdisjoint({1, 3})


def test_tuning_tables(spark, planted):
    grid = {"item_damping": [1.0, 50.0], "user_damping": [2.0, 5.0]}
    results = tuning.grid_search(planted, grid, folds=3, parallelism=4, model=predict.BiasPredictor)
    assert results.count() == 12
    assert results.agg(F.sum("n_test")).first()[0] == 4 * planted.count()
    summary = {r.config: r for r in tuning.cv_summary(results, list(grid)).collect()}
    mine = [r.rmse for r in results.where("config = 0").collect()]
    assert summary[0].rmse == pytest.approx(np.mean(mine)) and summary[0].rmse_std == pytest.approx(np.std(mine))
    best = {r.measure: r for r in tuning.best_configs(results, list(grid)).collect()}
    assert best["rmse"].score == pytest.approx(min(s.rmse for s in summary.values()))
    impact = {(r.param, r.value): r.mean_rmse for r in tuning.parameter_impact(results, list(grid)).collect()}
    assert impact[("item_damping", 1.0)] == pytest.approx((summary[0].rmse + summary[1].rmse) / 2)
    assert len(tuning.grid_points(tuning.COARSE_GRID)) == len(tuning.grid_points(tuning.FINE_GRID)) == 81


def test_factor_cross_validation(planted):
    rows = tuning.cross_validate(planted, {"n_factors": 2, "n_epochs": 2, "reg_all": 0.1}, folds=2).collect()
    assert len(rows) == 2 and all(r.rmse > 0 for r in rows)


def test_jobs(spark, planted, tmp_path):
    movies = spark.range(250).select(F.col("id").alias("movieId"), F.lit("t").alias("title"), F.lit("g").alias("genres"))
    small_model = {"n_factors": 2, "n_epochs": 2, "reg_all": 0.1}
    _, measured, sample = jobs.train_job(planted, movies, str(tmp_path), overrides=small_model)
    assert measured["rmse"] > 0 and sample.count() == 5
    stored = spark.read.json(str(tmp_path / "metrics")).first()
    assert stored.rmse == pytest.approx(measured["rmse"])
    result = jobs.evaluation_job(planted, movies, str(tmp_path / "final"), overrides=small_model)
    assert result["training"]["train_size"] + result["training"]["test_size"] == result["dataset"]["filtered_ratings"]
    again = spark.read.json(str(tmp_path / "final")).first()
    assert again.performance.test_rmse == pytest.approx(result["performance"]["test_rmse"])


def test_tuned_parameters(spark, tmp_path):
    assert sinks.read_tuned(spark, None) == sinks.TUNED_DEFAULTS
    assert sinks.read_tuned(spark, str(tmp_path / "missing")) == sinks.TUNED_DEFAULTS
    path = str(tmp_path / "tuned")
    sinks.append_metrics(spark, {"n_factors": 50, "performance": {"rmse": 0.9}}, path)
    assert sinks.read_tuned(spark, path) == {**sinks.TUNED_DEFAULTS, "n_factors": 50}
    assert sinks.read_tuned(spark, f"file://{path}") == sinks.read_tuned(spark, path)
    sinks.append_metrics(spark, {"n_factors": 70}, path)  # the later row wins, by any form of the path
    assert sinks.read_tuned(spark, path)["n_factors"] == sinks.read_tuned(spark, f"file://{path}")["n_factors"] == 70
    with pytest.raises(Exception):  # a path that can't be read is no missing file
        sinks.read_tuned(spark, "nosuchscheme://x/y")
    single = tmp_path / "one.json"
    single.write_text('{\n "n_epochs": 7,\n "reg_all": 0.5\n}')
    assert sinks.read_tuned(spark, f"file://{single}") == sinks.read_tuned(spark, str(single))
    assert sinks.read_tuned(spark, str(single)) == {**sinks.TUNED_DEFAULTS, "n_epochs": 7, "reg_all": 0.5}
