from itertools import combinations
from math import log2, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import metrics


def recs(spark, lists):
    rows = [(u, k + 1, m) for u, items in lists.items() for k, m in enumerate(items)]
    return spark.createDataFrame(rows, "userId long, rank int, movieId long")


def relevant(spark, sets):
    rows = [(u, m, float(g)) for u, items in sets.items() for m, g in items.items()]
    return spark.createDataFrame(rows, "userId long, movieId long, gain double")


def test_errors(spark):
    df = spark.createDataFrame([(2.0, 2.0), (3.5, 3.5), (4.5, 4.5), (1.0, 1.0)], "prediction double, rating double")
    row = metrics.error_metrics(df).first()
    assert (row.rmse, row.mae, row.n_test) == (0.0, 0.0, 4)
    row = metrics.error_metrics(df.withColumn("rating", F.col("rating") + 0.25)).first()
    assert (row.rmse, row.mae) == (0.25, 0.25)


def test_precision_recall_fixture(spark):
    row = metrics.ranking_metrics(recs(spark, {1: [10, 20, 30, 40]}), relevant(spark, {1: {20: 4, 40: 4, 50: 4, 60: 4, 70: 4}}), 4).first()
    assert row.precision == pytest.approx(0.5)
    assert row.recall == pytest.approx(0.4)


def test_hand_computed_average_precision_and_ndcg(spark):
    lists = recs(spark, {1: list(range(11, 19))})
    row = metrics.ranking_metrics(lists, relevant(spark, {1: {i: 1 for i in (11, 14, 17)}}), 5).first()
    ideal = sum(1 / log2(i + 1) for i in range(1, 4))
    assert row.precision == pytest.approx(0.4)
    assert row.recall == pytest.approx(2 / 3)
    assert row.average_precision == pytest.approx((1 + 2 / 4) / 3)
    assert row.ndcg == pytest.approx((1 + 1 / log2(5)) / ideal)
    assert row.ndcg_graded == pytest.approx(row.ndcg)


def test_graded_ndcg(spark):
    row = metrics.ranking_metrics(recs(spark, {1: [7, 8, 9]}), relevant(spark, {1: {9: 5, 7: 4, 1: 4.5}}), 2).first()
    assert row.ndcg_graded == pytest.approx((4 / log2(2)) / (5 / log2(2) + 4.5 / log2(3)))


def test_edges(spark):
    lists = recs(spark, {1: [1, 2], 2: [3]})
    rel = relevant(spark, {1: {1: 4}, 5: {9: 4}})
    zero = metrics.ranking_metrics(lists, rel, 0).collect()
    assert len(zero) == 2
    for r in zero:
        assert (r.precision, r.recall, r.average_precision, r.ndcg) == (0.0, 0.0, 0.0, 0.0)
    rows = {r.userId: r for r in metrics.ranking_metrics(lists, rel, 10).collect()}
    assert set(rows) == {1, 5}  # user 2 has nothing relevant
    assert rows[1].precision == pytest.approx(0.1) and rows[5].ndcg == 0.0
    assert metrics.ranking_report(lists, rel, 10).first().num_users == 2


def test_coverage(spark):
    lists = recs(spark, {1: [1, 2], 2: [2, 8], 3: [5]})
    catalogue = spark.range(1, 9).withColumnRenamed("id", "movieId")
    assert metrics.coverage(lists, catalogue).first()[0] == pytest.approx(0.5)
    assert metrics.coverage(lists, catalogue.limit(0)).first()[0] == 0.0


def brute_diversity(lists):
    pairs = list(combinations(lists, 2))
    if not pairs:
        return 1.0
    total = 0.0
    for a, b in pairs:
        total += len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    return 1 - total / len(pairs)


@pytest.mark.parametrize(
    "lists",
    [
        {1: [4, 9], 2: [9, 4]},
        {1: [4, 9], 2: [7]},
        {1: [6, 5, 4, 3]},
        {u: [(u * k * 7) % 97 for k in range(1, 40)] for u in range(1, 12)},
        {u: list(range(u, u + 5 + u % 4 * 15)) for u in range(40)},
        {u: list(range(30)) if u % 2 else [u] for u in range(12)},
        {1: [1], 2: [1, 2], 3: [2, 1, 3], 4: [1, 2, 3, 4, 5], 5: [9], 6: [1], 7: [5, 4, 3, 2, 1]},
        {u: [(u * k) % 13 for k in range(1, 2 + u % 7)] for u in range(1, 30)},
        {u: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10 + u] for u in range(25)},
    ],
)
def test_diversity_equals_all_pairs(spark, lists):
    got = metrics.diversity(recs(spark, lists)).first()[0]
    assert got == pytest.approx(brute_diversity([list(dict.fromkeys(v)) for v in lists.values()]), abs=1e-9)


def test_diversity_counts_empty_lists(spark):
    lists = {1: [1, 2], 2: [2, 3], 3: [], 4: [], 5: []}
    users = spark.range(1, 6).withColumnRenamed("id", "userId")
    got = metrics.diversity(recs(spark, lists), users).first()[0]
    assert got == pytest.approx(brute_diversity(list(lists.values())))


@pytest.mark.parametrize("size", [3, 4096])
def test_long_lists_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(metrics, "LISTS_PER_BLOCK", size)
    lists = {u: [(u * k + k * k) % 61 for k in range(20)] for u in range(25)} | {u: [1, 2] for u in range(100, 104)}
    users = spark.createDataFrame([(u,) for u in [*lists, 500, 501]], "userId long")
    got = metrics.diversity(recs(spark, lists), users).first()[0]
    assert got == pytest.approx(brute_diversity([list(dict.fromkeys(v)) for v in lists.values()] + [[], []]), abs=1e-9)


@pytest.mark.parametrize("portion", [1, 1 << 22])
def test_overlaps_of_common_and_rare_items(monkeypatch, portion):
    """Items of most lists go through a product, the others pair by pair; both add up to the plain counts."""
    monkeypatch.setattr(metrics, "ADDED_AT_ONCE", portion)
    monkeypatch.setattr(metrics, "ITEMS_AT_ONCE", 3)
    rng = np.random.default_rng(2)
    shares = np.concatenate([rng.uniform(0.5, 1, 8), rng.uniform(0, 0.1, 60)])
    a, b = (rng.random((n, 68)) < shares for n in (30, 21))
    places = [pa.array([np.flatnonzero(m[:, k]).astype(np.int32) for k in range(68)]) for m in (a, b)]
    assert (metrics.overlap_counts(*places, (30, 21)) == a.astype(int) @ b.T.astype(int)).all()


def test_newton_weights_give_jaccard():
    from math import comb

    for total in range(2, 61):
        for c in range(total // 2 + 1):
            value = sum(metrics._newton_weight(total, j) * comb(c, j) for j in range(1, c + 1))
            assert value == pytest.approx(c / (total - c) if total > c else 0.0, abs=1e-9)


def test_sqrt_of_mean(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "prediction double, rating double")
    assert metrics.error_metrics(df).first().rmse == pytest.approx(sqrt(5))
