"""Prediction and ranking metrics over whole tables.

Recommendation tables have the columns userId, rank (from 1) and movieId.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.columns import RELEVANT_RATING
from tastegrid.plans.ranking import top_n_per_key
from tastegrid.plans.skew import row_counts, salted_join
from tastegrid.sources.session import materialize


def error_metrics(scored: DataFrame, prediction: str = "prediction", actual: str = "rating") -> DataFrame:
    """One row: rmse, mae, n_test."""
    err = F.col(prediction) - F.col(actual)
    return scored.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.count(err).alias("n_test"),
    )


def relevant_items(ratings: DataFrame, threshold: float = RELEVANT_RATING) -> DataFrame:
    """Distinct (user, item) pairs with a rating at or over the threshold; ``gain`` is the best rating."""
    return (
        ratings.where(F.col("rating") >= threshold)
        .groupBy("userId", "movieId")
        .agg(F.max("rating").alias("gain"))
    )


def ranking_metrics(recs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per user with a relevant set: precision, recall, average precision and NDCG at ``k``.

    ``ndcg`` has gain 1 per relevant item, ``ndcg_graded`` uses the ``gain`` column. Users
    with relevant items and no list score 0; ``k`` = 0 gives 0 throughout.
    """
    w = Window.partitionBy("userId").orderBy("rank")
    hit = F.when(F.col("gain").isNotNull(), 1).otherwise(0)
    discount = F.log2(F.col("rank") + 1)
    marked = (
        recs.where(F.col("rank") <= k)
        .select("userId", "rank", "movieId")
        .join(relevant, ["userId", "movieId"], "left")
        .withColumn("hit", hit)
        .withColumn("hits_so_far", F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    per_list = marked.groupBy("userId").agg(
        F.sum("hit").alias("hits"),
        F.sum(F.col("hit") * F.col("hits_so_far") / F.col("rank")).alias("precision_sum"),
        F.sum(F.col("hit") / discount).alias("dcg"),
        F.sum(F.coalesce("gain", F.lit(0.0)) / discount).alias("dcg_graded"),
    )
    num_relevant = relevant.groupBy("userId").agg(F.count(F.lit(1)).alias("num_relevant"))
    ideal = (
        top_n_per_key(relevant, "userId", [F.desc("gain"), F.asc("movieId")], max(k, 1), "place")
        .where(F.col("place") <= k)
        .groupBy("userId")
        .agg(
            F.sum(1 / F.log2(F.col("place") + 1)).alias("idcg"),
            F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("idcg_graded"),
        )
    )
    joined = num_relevant.join(ideal, "userId", "left").join(per_list, "userId", "left")

    def ratio(top: str, bottom):
        value = F.when(bottom > 0, F.coalesce(F.col(top), F.lit(0)) / bottom)
        return F.coalesce(value, F.lit(0.0))

    return joined.select(
        "userId",
        ratio("hits", F.lit(k)).alias("precision"),
        ratio("hits", F.col("num_relevant")).alias("recall"),
        ratio("precision_sum", F.least(F.col("num_relevant"), F.lit(k))).alias("average_precision"),
        ratio("dcg", F.col("idcg")).alias("ndcg"),
        ratio("dcg_graded", F.col("idcg_graded")).alias("ndcg_graded"),
    )


def ranking_report(recs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Means over users with a relevant set."""
    return ranking_metrics(recs, relevant, k).agg(
        F.count(F.lit(1)).alias("num_users"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("average_precision").alias("map"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("ndcg_graded").alias("ndcg_graded"),
    )


def coverage(recs: DataFrame, movies: DataFrame) -> DataFrame:
    """Distinct recommended items over catalogue size; 0 for an empty catalogue."""
    size = movies.agg(F.count(F.lit(1))).scalar()
    return recs.agg(F.countDistinct("movieId").alias("n")).select(
        F.when(size > 0, F.col("n") / size).otherwise(0.0).alias("coverage")
    )


# Lists up to this length are compared by their shared subsets, longer ones block by block.
SUBSET_LIMIT = 12
# Distinct lists per block of the comparison of longer ones.
LISTS_PER_BLOCK = 4096


def diversity(recs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """1 - mean Jaccard similarity over all pairs of lists, for lists of any length.

    Equal lists are collapsed first and counted by their number. Both ways to sum the similarities of
    different lists are exact: see :func:`_overlap_by_subsets` (lists of up to ``SUBSET_LIMIT`` items, work linear
    in the number of lists) and :func:`_overlap_by_items` (longer lists, work in
    proportion to the pairs that share an item). The longest list
    decides, one number for the driver.

    ``users`` adds lists of users without recommendations: two empty lists count as equal.
    Fewer than two lists give 1.
    """
    lists = recs.groupBy("userId").agg(F.array_sort(F.collect_set("movieId")).alias("items"))
    distinct = materialize(
        lists.groupBy("items").agg(F.count(F.lit(1)).alias("mult")).withColumn("len", F.size("items")),
        "distinct-lists",
    )
    longest = distinct.agg(F.max("len")).first()[0] or 0
    overlap = _overlap_by_subsets(distinct, longest) if longest <= SUBSET_LIMIT else _overlap_by_items(distinct)
    equal = distinct.agg(F.sum(F.col("mult") * (F.col("mult") - 1) / 2)).scalar()
    listed = distinct.agg(F.coalesce(F.sum("mult"), F.lit(0)).alias("u"))
    if users is None:
        counted = listed.withColumn("e", F.lit(0))
    else:
        empty = users.select("userId").distinct().join(lists, "userId", "left_anti").agg(F.count(F.lit(1)))
        counted = listed.withColumn("e", empty.scalar()).withColumn("u", F.col("u") + F.col("e"))
    u, e = F.col("u"), F.col("e")
    similar = F.coalesce(overlap, F.lit(0.0)) + F.coalesce(equal, F.lit(0.0)) + e * (e - 1) / 2
    return counted.select(
        F.when(u < 2, 1.0).otherwise(1 - similar / (u * (u - 1) / 2)).alias("diversity")
    )


def _shared_entries(distinct: DataFrame) -> DataFrame:
    """(items, len, mult, movieId) of the items that more than one distinct list has."""
    entries = distinct.select("items", "len", "mult", F.explode("items").alias("movieId"))
    per_item = row_counts(entries, "movieId", "lists")
    shared = per_item.where(F.col("lists") > 1).select("movieId")
    return salted_join(entries, shared, "movieId", per_item, "lists", "left_semi")


def _overlap_by_items(distinct: DataFrame) -> Column:
    """Sum of c / (a + b - c) over the pairs of different lists, weighted by their numbers.

    Lists are numbered in the order of their items, so that similar ones lie in the same block of ``LISTS_PER_BLOCK``. An item
    has a sorted list of places per block, and two blocks meet only in items that both have. A task adds up the overlaps of
    one pair of blocks, portion by portion of the shared items, and visits the pairs that have any: an item that few
    lists have costs a step per pair of them, many that most lists have a matrix product. It returns one number.
    """
    order = distinct.repartitionByRange("items").sortWithinPartitions("items")
    # Numbers rise by one within a partition, whose own number is in their upper bits; a block is a stretch of them.
    number = F.monotonically_increasing_id()
    lists = materialize(order.select(number.alias("n"), "len", "mult", "items"), "long-lists")
    inside = F.col("n").bitwiseAND((1 << 33) - 1)
    block = (F.shiftright("n", 33) * (1 << 33) + F.floor(inside / LISTS_PER_BLOCK)).alias("block")
    place = (inside % LISTS_PER_BLOCK).cast("int").alias("place")
    entries = lists.select(block, place, F.explode("items").alias("movieId"))
    per_item = row_counts(entries, "movieId", "lists")
    shared = per_item.where(F.col("lists") > 1).select("movieId")
    kept = salted_join(entries, shared, "movieId", per_item, "lists", "left_semi")
    # At most a block's lists in a group.
    places = materialize(kept.groupBy("movieId", "block").agg(F.array_sort(F.collect_list("place")).alias("places")), "item-places")
    left = places.select("movieId", F.col("block").alias("x"), F.col("places").alias("px"))
    right = places.select("movieId", F.col("block").alias("y"), F.col("places").alias("py"))
    met = left.join(right, "movieId").where("x <= y").select("x", "y", "px", "py")
    fact = F.struct(place, F.col("len").cast("int").alias("len"), F.col("mult").cast("double").alias("mult"))
    facts = materialize(lists.groupBy(block).agg(F.array_sort(F.collect_list(fact)).alias("facts")), "list-facts")
    pairs = met.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
    known = pairs.join(facts.select(F.col("block").alias("u"), F.col("facts").alias("fu")), "u").join(
        facts.select(F.col("block").alias("v"), F.col("facts").alias("fv")), "v"
    )
    sums = met.groupBy("x", "y").cogroup(known.groupBy("u", "v")).applyInArrow(_shared_items, "overlap double")
    return sums.agg(F.sum("overlap")).scalar()


# Overlaps that a task adds up at a time, and items in a matrix product.
ADDED_AT_ONCE, ITEMS_AT_ONCE = 1 << 22, 512


def overlap_counts(px: pa.ListArray, py: pa.ListArray, shape: tuple[int, int]) -> np.ndarray:
    """How many items the lists of two blocks share, from the places of each item on both sides."""
    counts = np.zeros(shape, np.float32)
    sizes = [p.value_lengths().to_numpy() for p in (px, py)]
    starts = [np.append(0, n.cumsum()) for n in sizes]
    values = [p.flatten().to_numpy() for p in (px, py)]
    product = sizes[0].astype(np.int64) * sizes[1]
    many = product > shape[0] * shape[1] / 8  # cheaper as part of a matrix product
    few = np.flatnonzero(~many)
    total = product[few].cumsum()
    lo = 0
    while lo < len(few):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + ADDED_AT_ONCE, "right")))
        codes = [
            (values[0][starts[0][k] : starts[0][k + 1]].astype(np.int64)[:, None] * shape[1] + values[1][starts[1][k] : starts[1][k + 1]]).ravel()
            for k in few[lo:hi]
        ]
        np.add.at(counts.reshape(-1), np.concatenate(codes), 1)
        lo = hi
    dense = np.flatnonzero(many)
    for i in range(0, len(dense), ITEMS_AT_ONCE):
        sides = []
        for side in (0, 1):
            flags = np.zeros((shape[side], min(ITEMS_AT_ONCE, len(dense) - i)), np.float32)
            for j, k in enumerate(dense[i : i + ITEMS_AT_ONCE]):
                flags[values[side][starts[side][k] : starts[side][k + 1]], j] = 1
            sides.append(flags)
        counts += sides[0] @ sides[1].T
    return counts


def _shared_items(met: pa.Table, known: pa.Table) -> pa.Table:
    """The weighted sum over one pair of blocks; within a block a pair of lists counts once."""
    facts = [known[c][0].as_py() for c in ("fu", "fv")]
    (a, wa), (b, wb) = ((np.array([f["len"] for f in fs], float), np.array([f["mult"] for f in fs])) for fs in facts)
    counts = overlap_counts(*(met[c].combine_chunks() for c in ("px", "py")), (len(a), len(b)))
    if met["x"][0].as_py() == met["y"][0].as_py():
        counts = np.triu(counts, 1)
    total = 0.0
    for i in range(0, len(a), 256):
        at, to = np.nonzero(counts[i : i + 256])
        c = counts[i : i + 256][at, to].astype(float)
        total += float((wa[i + at] * wb[to] * c / (a[i + at] + b[to] - c)).sum())
    return pa.table({"overlap": [total]})


def _overlap_by_subsets(distinct: DataFrame, longest: int) -> Column:
    """The same sum without meeting any pair.

    With list lengths a and b and overlap c the similarity c / (a + b - c) is a fixed
    function of c, and every function of c is a weighted sum of the binomials C(c, j).
    Summed over all pairs, C(c, j) counts the j-subsets that two lists share. So each list
    emits its subsets, equal subsets are counted (map-side combined, so an item in every
    list costs nothing extra), and the counts give the exact sum of similarities. The
    work is linear in the number of distinct lists, with ``2**longest`` subsets per list at most.
    """
    max_length = max(1, longest)
    # At most max_length different lengths; each gets its own column of counts.
    lengths = sorted(r.len for r in distinct.select("len").distinct().collect())
    kept = (
        _shared_entries(distinct)
        .groupBy("items", "len", "mult")
        .agg(F.array_sort(F.collect_set(F.col("movieId").cast("string"))).alias("core"))
    )
    mask = F.col("mask")
    chosen = [F.when(mask.bitwiseAND(1 << i) != 0, F.get("core", F.lit(i))) for i in range(max_length)]
    subsets = (
        kept.select("len", "mult", "core", F.explode(F.expr("sequence(1, shiftleft(1, size(core)) - 1)")).alias("mask"))
        .select("len", "mult", F.bit_count("mask").alias("j"), F.concat_ws(",", *chosen).alias("subset"))
        .groupBy("subset", "j")
        .agg(
            *[F.sum(F.when(F.col("len") == n, F.col("mult")).otherwise(0)).alias(f"w{n}") for n in lengths],
            *[
                F.sum(F.when(F.col("len") == n, F.col("mult") * F.col("mult")).otherwise(0)).alias(f"s{n}")
                for n in lengths
            ],
        )
    )

    def pairs(a: int, b: int):
        if a < b:
            return F.col(f"w{a}") * F.col(f"w{b}")
        # Pairs of users with equal lists are left out here: they are counted by multiplicity.
        return (F.col(f"w{a}") * F.col(f"w{a}") - F.col(f"s{a}")) / 2

    by_size = subsets.groupBy("j").agg(
        *[
            F.sum(pairs(a, b).cast("double")).alias(f"p{a}_{b}")
            for a in lengths
            for b in lengths
            if a <= b
        ]
    )

    def weighted(a: int, b: int):
        weight = F.array(*[F.lit(_newton_weight(a + b, j)) for j in range(1, max_length + 1)])
        return F.col(f"p{a}_{b}") * F.element_at(weight, F.col("j"))

    terms = [weighted(a, b) for a in lengths for b in lengths if a <= b]
    return by_size.agg(F.sum(sum(terms[1:], terms[0]) if terms else F.lit(0.0))).scalar()


def _newton_weight(total: int, j: int) -> float:
    """j-th difference at 0 of c -> c / (total - c), which is 1 / C(total - 1, j)."""
    ways = comb(total - 1, j)
    return 1.0 / ways if ways else 0.0
