"""Exact top lists of products and cosines that skip what cannot be among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators.similar import similar_by_vector
from tastegrid.plans import blocks, cells
from tastegrid.plans.blocks import best_products, block_top_n
from tastegrid.sources.session import files_by_folder

KIND = "id long, vec array<float>"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], KIND)


def nearest(vectors, n):
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    out = {}
    for i, row in enumerate(scores):
        order = sorted((j for j in range(len(vectors)) if j != i), key=lambda j: (-row[j], j))
        out[i] = [(j, row[j]) for j in order[:n]]
    return out


def clustered(rng, centres=12, each=60, width=16, spread=0.05):
    middle = rng.normal(size=(centres, width))
    return (np.repeat(middle, each, axis=0) + spread * rng.normal(size=(centres * each, width))).astype(np.float32)


def lists(df, key="movieId"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append((r.similarId, r.similarity))
    return out


def equal(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert [j for j, _ in got[k]] == [j for j, _ in want[k]], k
        assert np.allclose([s for _, s in got[k]], [s for _, s in want[k]])


def test_long_vectors_first_skip_products():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.pareto(2.0, 6000) + 0.1)[::-1]
    b = rng.normal(size=(6000, 8))
    b *= (lengths / np.linalg.norm(b, axis=1))[:, None]
    a, ids = rng.normal(size=(50, 8)), rng.permutation(6000)
    found, taken = best_products(a, b, ids, 10, 9)
    scores = np.round(a @ b.T, 9)
    for i in range(50):
        order = sorted(range(6000), key=lambda j: (-scores[i, j], ids[j]))[:10]
        assert found.ids[i].tolist() == ids[order].tolist()
    assert taken < 0.3 * scores.size


def test_floors_keep_all_ties():
    """Equal scores everywhere: the lowest ids, also when a floor equals the score."""
    b = np.ones((1500, 2))
    found, _ = best_products(np.ones((3, 2)), b, np.arange(1500)[::-1].copy(), 4, 9, floor=np.full(3, 2.0))
    assert found.ids.tolist() == [[0, 1, 2, 3]] * 3


def test_lists_go_on_over_blocks_and_close_scores():
    """Scores that single precision cannot tell apart, in blocks one after the other."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(40, 30)).astype(np.float32).astype(float)
    b = np.repeat(rng.normal(size=(20, 30)), 200, axis=0) * (1 + 1e-8 * rng.integers(-3, 4, (4000, 1)))
    b, ids = b[np.argsort(-np.linalg.norm(b, axis=1))], rng.permutation(4000)
    scores, lists = np.round(a @ b.T, 9), blocks.Lists(40, 10)
    for lo in range(0, 4000, 1100):
        best_products(a, b[lo : lo + 1100], ids[lo : lo + 1100], 10, 9, lists=lists)
    for i in range(40):
        order = sorted(range(4000), key=lambda j: (-scores[i, j], ids[j]))[:10]
        assert lists.ids[i].tolist() == ids[order].tolist()


def test_right_rows_are_written_once_and_not_sent(spark, monkeypatch):
    """Tasks read the blocks from their folders, so the right side is not copied for every part of the left one."""
    tables, plain = {}, blocks.materialize

    def watched(df, name, **k):
        tables[name] = df
        return plain(df, name, **k)

    monkeypatch.setattr(blocks, "materialize", watched)
    rng = np.random.default_rng(7)
    rows = frame(spark, rng.normal(size=(90, 4)))
    assert block_top_n(rows, rows.where("id < 50"), 3, rows_per_block=20).count() == 270
    plan = tables["best-products"]._jdf.queryExecution().executedPlan().toString()
    assert "right" not in "".join(tables["best-products"].inputFiles()) and plan.count("explode") == 2


@pytest.mark.parametrize("size", [40, 300])
def test_blocks_of_many_lengths_and_equal_lengths(spark, size, monkeypatch):
    monkeypatch.setattr(blocks, "TILE_ROWS", 16)
    rng = np.random.default_rng(2)
    a = rng.integers(-3, 4, (60, 4)).astype(float)
    b = np.concatenate([rng.integers(-9, 10, (150, 4)), np.tile([3, 4, 0, 0], (150, 1))]).astype(float)
    banned = {(i, j) for i in range(60) for j in range(300) if (i + j) % 7 == 0}
    gone = spark.createDataFrame(sorted(banned), "left_id long, right_id long")
    got = {}
    for r in block_top_n(frame(spark, a), frame(spark, b), 5, gone, rows_per_block=size).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append((r.right_id, r.score))
    for i in range(60):
        want = sorted(((j, float(a[i] @ b[j])) for j in range(300) if (i, j) not in banned), key=lambda x: (-x[1], x[0]))
        assert got[i] == want[:5]


def test_only_near_cells_meet(spark):
    rng = np.random.default_rng(4)
    vectors = clustered(rng)
    counter = spark.sparkContext.accumulator(0)
    got = lists(similar_by_vector(frame(spark, vectors), 10, "id", "vec", cells=24, counter=counter), "id")
    equal(got, nearest(vectors, 10))
    assert 0 < counter.value < 0.5 * len(vectors) ** 2


@pytest.mark.parametrize("few", [3, 9000])
def test_neighbours_of_copies_ties_and_opposites(spark, few, monkeypatch):
    """A third of the rows is one vector; scaled copies; small cells cut into pieces; more neighbours than rows."""
    monkeypatch.setattr(cells, "CELL_ROWS", few)
    monkeypatch.setattr(cells, "QUERY_ROWS", few)
    rng = np.random.default_rng(5)
    grid = rng.integers(-1, 2, (80, 3)).astype(np.float32)
    grid = grid[np.abs(grid).sum(axis=1) > 0]
    vectors = np.concatenate([np.tile([1, 2, 3], (40, 1)), grid, 2 * grid[:10], -grid[:10]]).astype(np.float32)
    vectors = vectors[rng.permutation(len(vectors))]
    for n, parts in ((1, 9), (6, 5), (500, None)):
        equal(lists(similar_by_vector(frame(spark, vectors), n, "id", "vec", cells=parts), "id"), nearest(vectors, n))
    some = frame(spark, vectors[:5])
    got = lists(similar_by_vector(frame(spark, vectors), 6, "id", "vec", some), "id")
    equal(got, {k: v for k, v in nearest(vectors, 6).items() if k < 5})


def test_zero_vectors_and_empty_tables(spark):
    rows = frame(spark, np.array([[0, 0], [1, 0], [0, 1]]))
    assert {k for k in lists(similar_by_vector(rows, 3, "id", "vec"), "id")} == {1, 2}
    assert similar_by_vector(rows.where("id < 0"), 3, "id", "vec").count() == 0
    assert similar_by_vector(rows.where("id = 1"), 3, "id", "vec").count() == 0
    assert block_top_n(rows.where("id < 0"), rows, 3).count() == 0
    assert block_top_n(rows, rows.where("id < 0"), 3).count() == 0
    assert block_top_n(rows, rows, 2).where(F.col("left_id") == 1).count() == 2


@pytest.mark.parametrize("kinds", [None, 60])
def test_leaves_give_the_lists_of_all_products(kinds):
    """Vectors on a coarse lattice, with many copies or none, and rows that leave out much."""
    rng = np.random.default_rng(4)
    b = np.round(rng.uniform(-1, 1, (20_000, 3)), 2)
    b = b if kinds is None else b[rng.integers(0, kinds, len(b))]
    a, ids = np.round(rng.uniform(-1, 1, (300, 3)), 2), rng.permutation(len(b)).astype(np.int64)
    gone = np.unique(np.stack([rng.integers(0, 300, 9000), rng.integers(0, len(b), 9000)]), axis=1)
    gone = np.concatenate([gone, np.stack([np.zeros(700, int), np.argsort(-(b @ a[0]))[:700]])], axis=1)
    gone = np.unique(gone, axis=1)

    def ordered(order):
        place = np.argsort(order)
        by = np.argsort(place[gone[1]], kind="stable")
        return b[order], ids[order], (gone[0][by], place[gone[1]][by])

    falling, close = np.lexsort((ids, -np.linalg.norm(b, axis=1))), blocks.leaf_order(b)
    x, y, out = ordered(falling)
    plain, all_taken = best_products(a, x, y, 10, 9, gone=out)
    x, y, out = ordered(close)
    leaves = blocks.Leaves(x)
    found, taken = blocks.best_in_leaves(a, x, y, leaves, 10, 9, gone=out)
    assert leaves.tight and (found.ids == plain.ids).all() and (found.scores == plain.scores).all()
    if kinds:
        assert taken < all_taken / 2


def test_no_row_is_sent_to_the_cells_it_looks_into(spark, monkeypatch):
    """Vectors without clusters: every row looks into every cell, but rows and cells are written once each and read by the tasks."""
    written, plain = {}, cells.materialize

    def watched(df, name, **k):
        table = written[name] = plain(df, name, **k)
        return table

    monkeypatch.setattr(cells, "materialize", watched)
    vectors = np.random.default_rng(8).normal(size=(300, 12)).astype(np.float32)
    counter = spark.sparkContext.accumulator(0)
    sizes = {}
    monkeypatch.setattr(cells, "files_by_folder", lambda t, names: sizes.update({tuple(names): t.count()}) or files_by_folder(t, names))
    got = lists(similar_by_vector(frame(spark, vectors), 5, "id", "vec", cells=12, counter=counter), "id")
    equal(got, nearest(vectors, 5))
    assert counter.value > 0.5 * 300**2
    assert sizes == {("cell", "piece"): 300, ("part",): 300}
    assert "own-cells" not in written


def test_few_rows_share_the_cells_among_tasks(spark):
    vectors = np.random.default_rng(9).normal(size=(200, 6)).astype(np.float32)
    vectors[50:80] = vectors[0]
    some = frame(spark, vectors[:3])
    got = lists(similar_by_vector(frame(spark, vectors), 7, "id", "vec", some, cells=9), "id")
    equal(got, {k: v for k, v in nearest(vectors, 7).items() if k < 3})


def test_single_products_are_taken_again(monkeypatch):
    """Pairs that single precision picks give the lists that all products of their rows give; ties, excluded pairs, few and many pairs."""
    rng = np.random.default_rng(11)
    a, b = np.round(rng.normal(size=(50, 5)), 2), np.round(rng.normal(size=(4000, 5)), 2)
    b = np.concatenate([b, b[:200]])
    order = np.argsort(-np.linalg.norm(b, axis=1), kind="stable")
    b, ids = b[order], rng.permutation(len(b)).astype(np.int64)
    gone = np.unique(np.stack([rng.integers(0, len(b), 3000), rng.integers(0, 50, 3000)]), axis=1)[::-1]
    found = {}
    for most in (-1, 30, 1 << 14):
        monkeypatch.setattr(blocks, "PAIRS_AT_ONCE", most)
        got, _ = best_products(a, b, ids, 7, 9, gone=tuple(gone))
        found[most] = got
    masked = np.round(a @ b.T, 9)
    masked[gone[0], gone[1]] = -np.inf
    for i in range(50):
        want = sorted(zip(-masked[i], ids))[:7]
        for got in found.values():
            assert got.ids[i].tolist() == [j for _, j in want] and np.allclose(got.scores[i], [-x for x, _ in want])
