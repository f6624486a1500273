"""The two solvers of the factor model against plain numpy versions."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import als, prepare, sgd, tuning
from tastegrid.operators.factor import FactorModel
from tastegrid.plans.spread import hashed_bits, hashed_normals, slot_labels

KIND = "userId long, movieId long, rating double, timestamp long"


def planted_rows(users=400, items=250, share=0.15):
    """Rank 3 plus offsets and noise, rounded to half stars."""
    rng = np.random.default_rng(7)
    p, q = rng.normal(0, 0.55, (users, 3)), rng.normal(0, 0.55, (items, 3))
    r = 3.3 + rng.normal(0, 0.4, users)[:, None] + rng.normal(0, 0.4, items)[None, :] + p @ q.T
    r = np.clip(np.round((r + rng.normal(0, 0.25, r.shape)) * 2) / 2, 0.5, 5.0)
    u, i = np.nonzero(rng.random(r.shape) < share)
    return [(int(a), int(b), float(r[a, b]), 0) for a, b in zip(u, i)]


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(planted_rows(), KIND)


def plain_sgd(rows, order, width, epochs, lr, reg, seed=42):
    """Rating by rating, in the given order."""
    users, items = (sorted({r[k] for r in rows}) for k in (0, 1))
    p, q = (0.1 * hashed_normals(np.array(x), width, 2 * seed + s).astype(float) for s, x in enumerate((users, items)))
    bu, bi = np.zeros(len(users)), np.zeros(len(items))
    at_u, at_i = {x: k for k, x in enumerate(users)}, {x: k for k, x in enumerate(items)}
    mean = float(np.mean([r[2] for r in rows]))
    for _ in range(epochs):
        for k in order:
            u, i, r = at_u[rows[k][0]], at_i[rows[k][1]], rows[k][2]
            e = r - mean - bu[u] - bi[i] - p[u] @ q[i]
            bu[u], bi[i] = bu[u] + lr * (e - reg * bu[u]), bi[i] + lr * (e - reg * bi[i])
            p[u], q[i] = p[u] + lr * (e * q[i] - reg * p[u]), q[i] + lr * (e * p[u] - reg * q[i])
    return mean, dict(zip(users, zip(bu, p))), dict(zip(items, zip(bi, q)))


def tables(model):
    users = {r.userId: (r.user_bias, np.array(r.features)) for r in model.users.collect()}
    return users, {r.movieId: (r.item_bias, np.array(r.features)) for r in model.items.collect()}


def test_levels_keep_the_order():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 9, 300), rng.integers(0, 7, 300)
    level = sgd.update_levels(u, v)
    for key in (u, v):
        for k in set(key.tolist()):
            assert (np.diff(level[key == k]) > 0).all()
    assert sgd.update_levels(np.array([1, 2, 3]), np.array([1, 2, 3])).tolist() == [1, 1, 1]


def test_descent_equals_rating_by_rating(spark):
    """One block, where the order is that of the hashed ids; repeated pairs and one user with most ratings."""
    rows = planted_rows(30, 20, 0.3)
    rows += [(7, i, 3.5, 0) for i in range(20)] + rows[:15]
    u, v, r = (np.array([x[k] for x in rows]) for k in range(3))
    order = np.lexsort((r, v, u, hashed_bits(u, 42) ^ hashed_bits(v, 43)))
    mean, users, items = plain_sgd(rows, order, 4, 6, 0.02, 0.05)
    model = FactorModel(n_factors=4, n_epochs=6, lr_all=0.02, reg_all=0.05, solver="sgd")
    found = tables(model.fit(spark.createDataFrame(rows, KIND)))
    assert model.mean == pytest.approx(mean)
    for mine, plain in zip(found, (users, items)):
        assert mine.keys() == plain.keys()
        for k in plain:
            assert mine[k][0] == pytest.approx(plain[k][0], abs=1e-5)
            assert np.allclose(mine[k][1], plain[k][1], atol=1e-5)


def test_error_of_blocks_is_that_of_plain_descent(planted):
    train, test = prepare.hash_split(planted)
    params = {"n_factors": 8, "n_epochs": 25, "lr_all": 0.02, "reg_all": 0.05}
    rows = [tuple(r) for r in train.collect()]
    mean, users, items = plain_sgd(rows, np.random.default_rng(1).permutation(len(rows)), 8, 25, 0.02, 0.05)
    miss = []
    for r in test.collect():
        (bu, p), (bi, q) = users.get(r.userId, (0, np.zeros(8))), items.get(r.movieId, (0, np.zeros(8)))
        miss.append(np.clip(mean + bu + bi + p @ q, 0.5, 5) - r.rating)
    plain = float(np.sqrt(np.mean(np.square(miss))))
    for blocks in (1, 4):
        scores = FactorModel(**params, solver="sgd", blocks=blocks).fit(train).evaluate(test).first()
        assert scores.rmse == pytest.approx(plain, rel=0.02)


def test_seeded_runs_do_not_depend_on_partitions(planted):
    params = {"n_factors": 3, "n_epochs": 2, "blocks": 3, "solver": "sgd"}
    first = tables(FactorModel(**params).fit(planted.repartition(2)))
    again = tables(FactorModel(**params).fit(planted.repartition(7, "movieId").sortWithinPartitions("rating")))
    other = tables(FactorModel(**params, random_state=1).fit(planted))
    for a, b, c in zip(first, again, other):
        assert all(a[k][0] == b[k][0] and (a[k][1] == b[k][1]).all() for k in a)
        assert any((a[k][1] != c[k][1]).any() for k in a)


def test_learning_rate_counts(planted):
    slow, fast = (
        FactorModel(n_factors=3, n_epochs=3, lr_all=lr, solver="sgd").fit(planted).evaluate(planted).first().rmse
        for lr in (0.0005, 0.02)
    )
    assert fast < slow - 0.05


def test_descent_without_offsets_and_unknown_solver(planted):
    model = FactorModel(n_factors=3, n_epochs=2, use_bias=False, solver="sgd").fit(planted)
    assert model.users.where("user_bias <> 0").isEmpty() and model.items.where("item_bias <> 0").isEmpty()
    with pytest.raises(ValueError, match="unknown solver"):
        FactorModel(solver="magic")


# ---------------------------------------------------------------- least squares


def plain_als(rows, width, epochs, reg, seed):
    users, items = (sorted({r[k] for r in rows}) for k in (0, 1))
    vec = {"u": dict(zip(users, als.first_vectors(np.array(users), width, seed))), "v": {}}
    for _ in range(epochs):
        for key, other, k, o in (("v", "u", 1, 0), ("u", "v", 0, 1)):
            for x in items if key == "v" else users:
                mine = [r for r in rows if r[k] == x]
                m = np.array([vec[other][r[o]] for r in mine], float)
                gram = m.T @ m + reg * len(mine) * np.eye(width)
                vec[key][x] = np.linalg.solve(gram, m.T @ np.array([r[2] for r in mine])).astype(np.float32)
    return vec["u"], vec["v"]


@pytest.mark.parametrize("share", [1 / 8, 10.0])
def test_least_squares_equal_plain_solves(spark, share, monkeypatch):
    """With and without divided keys: an item that all users rate has half of all ratings."""
    monkeypatch.setattr(als, "PART_SHARE", share)
    rng = np.random.default_rng(5)
    rows = [(u, 99, float(rng.normal())) for u in range(60)]
    rows += [(u, int(i), float(rng.normal())) for u in range(60) for i in rng.choice(12, 1)]
    pairs = spark.createDataFrame(rows, "userId long, movieId long, rest double")
    found = als.fit_als(pairs, 5, 3, 0.1, 42)
    for mine, plain in zip(found, plain_als(rows, 5, 3, 0.1, 42)):
        have = {r.id: np.array(r.features) for r in mine.collect()}
        assert have.keys() == plain.keys()
        assert all(np.allclose(have[k], plain[k], atol=1e-6) for k in plain)


@pytest.mark.parametrize("share", [1 / 8, 10.0])
def test_one_factor_equals_plain_solves(spark, share, monkeypatch):
    """Systems of one number, summed and solved together."""
    monkeypatch.setattr(als, "PART_SHARE", share)
    rng = np.random.default_rng(6)
    rows = [(u, 99, float(rng.normal())) for u in range(60)]
    rows += [(u, int(i), float(rng.normal())) for u in range(60) for i in rng.choice(12, 2, replace=False)]
    found = als.fit_als(spark.createDataFrame(rows, "userId long, movieId long, rest double"), 1, 3, 0.1, 42)
    for mine, plain in zip(found, plain_als(rows, 1, 3, 0.1, 42)):
        have = {r.id: np.array(r.features) for r in mine.collect()}
        assert have.keys() == plain.keys()
        assert all(np.allclose(have[k], plain[k], atol=1e-6) for k in plain)


def test_a_solved_vector_is_written_once_per_half_step(spark, monkeypatch):
    """However many blocks rate its key; and a half-step that nothing reads any more is gone."""
    rng = np.random.default_rng(4)
    rows = [(u, int(i), float(rng.normal())) for u in range(80) for i in rng.choice(50, 12, replace=False)]
    pairs = spark.createDataFrame(rows, "userId long, movieId long, rest double")
    monkeypatch.setattr(als, "PART_SHARE", 10.0)
    tables, plain = [], als.materialize

    def watched(df, name, **k):
        table = plain(df, name, **k)
        if name == "vectors":
            tables.append((table, [np.frombuffer(r.vecs, np.float32).size for r in table.collect()]))
        return table

    monkeypatch.setattr(als, "materialize", watched)
    found = als.fit_als(pairs, 5, 3, 0.1, 42, blocks=8)
    assert [sum(sizes) for _, sizes in tables] == [50 * 5, 80 * 5] * 3
    folders = [file.removeprefix("file://") for table, _ in tables for file in table.inputFiles()[:1]]
    assert [os.path.exists(f) for f in folders] == [False] * 4 + [True] * 2
    assert [t.count() for t in found] == [80, 50]


def test_small_and_large_systems_agree():
    rng = np.random.default_rng(1)
    for n in (1, 3, 6, 7, 40):
        vecs, values = rng.normal(size=(n, 7)), rng.normal(size=n)
        full = np.linalg.solve(vecs.T @ vecs + 0.2 * n * np.eye(7), vecs.T @ values)
        assert np.allclose(als.solve_key(vecs, values, 0.2), full)


def test_an_item_with_half_of_all_ratings_fills_no_block(spark):
    rows = spark.range(40_000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")).unionByName(
        spark.range(40_000).select(F.col("id").alias("u"), (1 + F.pmod(F.xxhash64("id"), F.lit(3000))).alias("v"))
    )
    parts = als.parts_of_keys(rows, "v", 8, 80_000)
    sizes = [r["count"] for r in als.placed(rows, "v", "u", parts, 8).groupBy("v_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * np.median(sizes)


# ---------------------------------------------------------------- many models at once


def test_many_models_equal_single_ones(planted):
    grid = {"n_factors": [2, 3], "n_epochs": [2, 4], "lr_all": [0.01, 0.03], "reg_all": [0.02]}
    rows = tuning.descent_search(planted, grid, folds=3, blocks=2).collect()
    assert len(rows) == 8 * 3 and sum(r.n_test for r in rows if r.config == 0) == planted.count()
    single = tuning.grid_search(planted, {**grid, "n_factors": [3], "lr_all": [0.03]}, folds=3, model=lambda **p: FactorModel(**p, solver="sgd", blocks=2))
    mine = {(r.n_epochs, r.fold): (r.rmse, r.mae) for r in rows if (r.n_factors, r.lr_all) == (3, 0.03)}
    for r in single.collect():
        assert mine[r.n_epochs, r.fold] == pytest.approx((r.rmse, r.mae), rel=1e-4)


def test_elimination_keeps_the_best(planted):
    grid = {"n_factors": [2], "n_epochs": [1, 2, 6], "lr_all": [0.0001, 0.01, 0.03], "reg_all": [0.02]}
    full = {(r.lr_all, r.n_epochs, r.fold): r.rmse for r in tuning.descent_search(planted, grid, folds=2).collect()}
    some = {(r.lr_all, r.n_epochs, r.fold): r.rmse for r in tuning.descent_search(planted, grid, folds=2, survivors=1 / 3).collect()}
    assert len(full) == 18 and len(some) == 6 + 2 + 2
    assert all(full[k] == pytest.approx(v) for k, v in some.items())
    assert {k[0] for k in some if k[1] == 6} == {0.03}


def test_labels_fill_all_partitions(spark):
    labels = slot_labels(spark, 13)
    rows = spark.createDataFrame([(x,) for x in labels], "slot long").repartition(13, "slot")
    assert sorted(r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) == [1] * 13


def test_states_travel_about_twice_per_epoch():
    for blocks in (1, 2, 3, 4, 5, 8, 21, 48):
        for epochs in (1, 2, 20, 30):
            each = sgd.visits(epochs, blocks)
            assert sum(each) == epochs and min(each) > 0
            assert len(each) * blocks <= max(3 * epochs, 2 * epochs + 2 * blocks)


def test_blocks_of_many_models_hold_more_ratings():
    assert sgd.block_count(3_600_000, 120_000, 150, models=135) == 1
    assert sgd.block_count(3_600_000, 120_000, 150) == 2


def test_eight_blocks_learn_as_well(planted):
    train, test = prepare.hash_split(planted)
    params = {"n_factors": 6, "n_epochs": 12, "lr_all": 0.02, "reg_all": 0.05, "solver": "sgd"}
    one, eight = (FactorModel(**params, blocks=b).fit(train).evaluate(test).first().rmse for b in (1, 8))
    assert eight == pytest.approx(one, rel=0.02)


def test_grid_of_one_block_writes_no_states(planted, monkeypatch):
    grid = {"n_factors": [2, 3], "n_epochs": [2, 3], "lr_all": [0.01], "reg_all": [0.02]}
    by_steps = tuning.descent_search(planted, grid, folds=2, survivors=1.0).collect()
    written = []
    plain = sgd.materialize
    monkeypatch.setattr(sgd, "materialize", lambda df, name, **k: written.append(name) or plain(df, name, **k))
    at_once = {(r.config, r.fold): r for r in tuning.descent_search(planted, grid, folds=2).collect()}
    assert "states" not in written and len(at_once) == len(by_steps) == 8
    for r in by_steps:
        assert (at_once[r.config, r.fold].rmse, at_once[r.config, r.fold].mae) == pytest.approx((r.rmse, r.mae), rel=1e-6)
        assert at_once[r.config, r.fold].n_test == r.n_test


def test_a_step_shuffles_nothing_and_leaves_one_set_of_states(planted, monkeypatch):
    """Tasks read states and ratings from their folders; states that nothing reads any more are gone."""
    tables, plain = [], sgd.materialize

    def watched(df, name, **k):
        if name == "states":
            tables.append([df._jdf.queryExecution().executedPlan().toString(), None])
        table = plain(df, name, **k)
        if name == "states":
            tables[-1][1] = table.inputFiles()
        return table

    monkeypatch.setattr(sgd, "materialize", watched)
    work = sgd.Descent(planted, [sgd.Fit(3)], blocks=3)
    work.run(20)
    assert len(tables) == 1 + 4 * 3 and work.epoch == 20  # four visits of five epochs
    assert all("Exchange" not in plan for plan, _ in tables[1:])
    assert [len(files) for _, files in tables] == [6] * 13
    left = [{os.path.exists(f.removeprefix("file://")) for f in files} for _, files in tables]
    assert left == [{False}] * 12 + [{True}]


def test_long_visits_at_a_low_rate_only():
    assert sgd.visits(20, 4, 0.005) == sgd.visits(20, 2, 0.005) == [5] * 4
    assert sgd.visits(20, 4, 0.02) == sgd.visits(20, 4) == [2] * 10
    assert sgd.visits(3, 2, 0.0001) == [1] * 3 and sgd.visits(2, 3, 0.0) == [1] * 2


def test_long_visits_learn_as_well(planted):
    train, test = prepare.hash_split(planted)
    params = {"n_factors": 20, "n_epochs": 20, "solver": "sgd"}
    one, four = (FactorModel(**params, blocks=b).fit(train).evaluate(test).first().rmse for b in (1, 4))
    assert four == pytest.approx(one, rel=0.01)


def test_predictions_send_no_vectors_and_equal_the_join(planted):
    """Unknown and missing ids, repeated pairs and more columns; the same model without its written blocks joins."""
    spark = planted.sparkSession
    model = FactorModel(n_factors=5, n_epochs=2, blocks=3, solver="sgd").fit(planted)
    pairs = planted.select("userId", "movieId", "rating").limit(200)
    odd = spark.createDataFrame([(None, 1, 1.0), (1, None, 2.0), (10**9, 1, 3.0), (1, 10**9, 4.0), (None, None, 5.0)], pairs.schema)
    pairs = pairs.unionByName(odd).unionByName(odd).withColumn("note", F.array(F.lit("x")))
    mine = model.predict(pairs)
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "features" not in plan
    plain = FactorModel.from_tables(model.mean, model.users, model.items, model.train_pairs, n_factors=5).predict(pairs)
    assert mine.columns == plain.columns
    both = [sorted(((str(r[:-1]), r.prediction) for r in df.collect())) for df in (mine, plain)]
    assert len(both[0]) == len(both[1]) == 210
    for (a, x), (b, y) in zip(*both):
        assert a == b and x == pytest.approx(y, abs=1e-9)


def test_a_state_in_pieces_is_read_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(sgd, "PIECE_BYTES", 500)
    group, ids = sgd.Group(0, [0], [sgd.Fit(4)], [3.0]), np.arange(0, 150, 3)
    side = sgd.first_side(group, 0, ids)
    pieces = list(sgd._pieces(0, 0, 1, ids, *side))
    assert len(pieces) > 1 and max(len(x["vecs"]) for x in pieces) <= 500
    path = str(tmp_path / "state.parquet")
    pq.write_table(pa.Table.from_pylist(pieces[::-1], sgd.STATE_ARROW), path)
    met = sgd.Meeting(group, (1, 0), [[path], []], [])
    assert (met.ids[0] == ids).all() and all((a == b).all() and a.flags.writeable for a, b in zip(met.sides[0], side))


def test_a_long_side_has_the_room_of_a_short_one(spark):
    """A task holds a block of both sides; a short one leaves its room to the other."""
    rows = spark.range(200_000).select(F.col("id").alias("userId"), (F.col("id") % 100).alias("movieId"), F.lit(3.0).alias("rating"))
    assert sgd.Descent(rows, [sgd.Fit(250)]).blocks == 1


def test_states_lie_in_files_that_tasks_write(planted):
    """A step's rows are addresses of files, read piece by piece into place; the files of the step before are gone."""
    work = sgd.Descent(planted, [sgd.Fit(3)], blocks=2)
    before = [f.removeprefix("file:") for files in work.states.values() for f in files]
    assert len(before) == 4 and all(os.path.exists(f) for f in before)
    assert set(work._drawn.columns) == set(sgd.FILES.names)
    work.run(2)
    after = [f.removeprefix("file:") for files in work.states.values() for f in files]
    assert len(after) == 4 and all(os.path.exists(f) for f in after) and not any(os.path.exists(f) for f in before)
    assert len({os.path.dirname(f) for f in after}) == 1


def test_models_side_by_side_leave_out_the_same_fold(planted):
    """Ratings of the fold that a group leaves out change nothing and cost nothing."""
    rows = planted.withColumn("fold", (F.col("movieId") % 3).cast("int"))
    fits = [sgd.Fit(2, lr, 0.02, 42, fold) for lr in (0.01, 0.02, 0.03) for fold in range(3)]
    work = sgd.Descent(rows, fits)
    assert sorted(m for g in work.groups for m in g.members) == list(range(9))
    assert all(len(set(g.folds.tolist())) == 1 for g in work.groups)
    work.run(1)
    seen = {r.movieId % 3 for r in work.table(0, 1, "movieId", "item_bias").collect()}
    assert seen == {1, 2}  # fold 0 is left out
