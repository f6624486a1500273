import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import prepare, profile
from tastegrid.plans.blocks import block_top_n
from tastegrid.plans.indexing import dense_index, fits_int
from tastegrid.plans.ranking import exact_percentile
from tastegrid.plans.skew import hot_keys, row_counts, salted_join
from tastegrid.sources.session import materialize, scratch_tables


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belongs to key 0; half of those rows are identical."""
    return (
        spark.range(0, 30000, numPartitions=12)
        .select(
            F.when(F.col("id") < 10000, 0).otherwise(F.col("id") % 5000).alias("k"),
            F.when(F.col("id") < 5000, 0).otherwise(F.col("id")).alias("v"),
        )
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    lookup = skewed.select("k").distinct().where("k % 3 <> 1").withColumn("w", F.col("k") * 2)
    counts = row_counts(skewed, "k")
    assert [r.k for r in hot_keys(counts, "k", "__rows").collect()] == [0]
    got = salted_join(skewed, lookup, "k", counts, "__rows", how)
    want = skewed.join(lookup, "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_rows_spread_over_tasks(spark, skewed):
    hot = hot_keys(row_counts(skewed, "k"), "k", "__rows")
    assert hot.count() < 1000
    shuffled = skewed.withColumn("v", F.col("v") + F.col("k")).repartition(6, "k")  # all rows of the key in one task
    for facts in (skewed, shuffled):
        spread = salted_join(facts, facts.select("k").distinct(), "k", row_counts(facts, "k"), "__rows", "left_semi")
        plan = spread._jdf.queryExecution().analyzed().toString()
        assert "xxhash64" in plan and "SPARK_PARTITION_ID" in plan.upper()
    salt = F.pmod(F.xxhash64("k", "v", F.spark_partition_id()), F.lit(16))
    for facts in (skewed, shuffled):
        sizes = [r["count"] for r in facts.where("k = 0").groupBy(salt).count().collect()]
        assert len(sizes) == 16 or facts is skewed and len(sizes) >= 4
        assert max(sizes) < 6000


def test_more_keys_are_hot_on_more_partitions(spark):
    counts = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    assert hot_keys(counts, "k", "n").count() == 0  # each holds a 3000th; the least share is a 1000th
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        assert hot_keys(counts, "k", "n").count() == 3000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_salted_join_with_condition(spark, skewed):
    lookup = spark.createDataFrame([(0, 1), (0, 2), (7, 1), (7, 5)], "k long, place int")
    got = salted_join(
        skewed,
        lookup,
        "k",
        row_counts(skewed, "k"),
        "__rows",
        "inner",
        condition=lambda left, right: right["place"] <= 2,
    )
    assert got.columns == ["k", "v", "place"]
    per = {(r.k, r.place): r["count"] for r in got.groupBy("k", "place").count().collect()}
    sizes = {r.k: r["count"] for r in skewed.groupBy("k").count().collect()}
    assert per == {(0, 1): sizes[0], (0, 2): sizes[0], (7, 1): sizes[7]}


def test_activity_filter_keeps_whole_users(spark, cold):
    ratings, _ = cold
    kept = prepare.filter_cold_users(ratings, 5)
    assert {r.userId: r["count"] for r in kept.groupBy("userId").count().collect()} == {11: 6, 13: 12}
    items = prepare.filter_cold_items(ratings, 3)
    assert {r.movieId for r in items.select("movieId").collect()} == {102, 104, 109}


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9])
def test_exact_percentile(spark, p):
    values = [1, 1, 2, 5, 9, 9, 9, 40]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    assert exact_percentile(df, "n", p).first()[0] == pytest.approx(float(np.percentile(values, p * 100)))


def test_hash_split_is_stable_and_complete(spark, world):
    *_, rdf, _ = world
    train, test = prepare.hash_split(rdf, 0.2)
    assert train.count() + test.count() == rdf.count()
    again = prepare.hash_split(rdf.repartition(7), 0.2)[1]
    assert test.exceptAll(again).count() == 0
    big = spark.range(200000).select(F.col("id").alias("userId"), (F.col("id") % 977).alias("movieId"))
    assert prepare.hash_split(big, 0.2)[1].count() == pytest.approx(40000, rel=0.03)
    for size in (0.0, 1.0):
        train, test = prepare.hash_split(rdf, size)
        assert test.count() == round(size * rdf.count())


def test_stratified_split_sizes_with_a_hot_user(spark):
    rows = spark.range(0, 6000, numPartitions=6).select(
        F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 400 + 2).alias("userId"),
        F.col("id").alias("movieId"),
    )
    out = prepare.stratified_split(rows, 0.2)
    per = out.groupBy("userId").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("fold") == "test").alias("t")
    ).collect()
    assert sum(r.n for r in per) == 6000
    assert all(r.t == int(r.n * 0.2 + 0.5) for r in per)
    # the slices of the hot user are cut exactly where one ranking of the whole user is cut
    same = prepare.stratified_split(rows.where("userId = 1"), 0.2, slices=1)
    assert out.where("userId = 1").exceptAll(same).count() == 0


def test_dense_index(spark):
    df = spark.createDataFrame([(10**12 + i % 50,) for i in range(500)], "k long")
    assert not fits_int(df, "k")
    rows = dense_index(df, "k", buckets=7).collect()
    assert sorted(r.idx for r in rows) == list(range(50))


@pytest.mark.parametrize("size", [7, 1000, None])
def test_block_products_equal_brute_force(spark, size):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-3, 4, (40, 5)).astype(float), rng.integers(-3, 4, (55, 5)).astype(float)
    left = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(a)], "id long, vec array<double>")
    right = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(b)], "id long, vec array<double>")
    banned = {(i, j) for i in range(40) for j in range(55) if (i * j) % 3 == 1 or i == 5}
    exclude = spark.createDataFrame(sorted(banned), "left_id long, right_id long")
    got = {}
    for r in block_top_n(left, right, 4, exclude, rows_per_block=size).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append((r.right_id, r.score))
    for i in range(40):
        want = sorted(((j, float(a[i] @ b[j])) for j in range(55) if (i, j) not in banned), key=lambda x: (-x[1], x[0]))
        assert got.get(i, []) == want[:4]


def test_histogram_of_equal_counts(spark):
    df = spark.createDataFrame([(u, i) for u in range(4) for i in range(3)], "userId long, movieId long")
    rows = profile.count_histogram(df, "userId", 10).collect()
    heights, edges = np.histogram([3, 3, 3, 3], bins=10)
    assert [r.num_keys for r in rows] == list(heights)
    assert rows[0].lower == pytest.approx(edges[0]) and rows[-1].upper == pytest.approx(edges[-1])


def test_scratch_tables_are_deleted(spark):
    folder = lambda df: os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    with scratch_tables(spark):
        outer = folder(materialize(spark.range(3), "t"))
        with scratch_tables(spark):
            inner = folder(materialize(spark.range(4), "t"))
            kept = folder(materialize(spark.range(5), "t", keep=True))
            assert os.path.isdir(inner)
        assert os.path.isdir(outer) and os.path.isdir(kept) and not os.path.isdir(inner)
    free = folder(materialize(spark.range(6), "t", keep=True))
    assert os.path.isdir(free) and not os.path.isdir(outer) and not os.path.isdir(kept)
