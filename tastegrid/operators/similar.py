"""Similar items by genre overlap and by vectors, for all items at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.operators.overlap import best_classes, class_overlaps, leading_items, numbered_sets, with_classes
from tastegrid.plans.cells import cosine_top_n
from tastegrid.plans.ranking import check_n, top_n_per_key
from tastegrid.plans.skew import row_counts, salted_join
from tastegrid.sources.session import materialize


def _jaccard(overlap, set_size, class_size, popularity):
    return overlap / (set_size + class_size - overlap)


def similar_by_genre(movies: DataFrame, n: int = 10, targets: DataFrame | None = None) -> DataFrame:
    """(movieId, rank, similarId, similarity): top ``n`` other items by genre Jaccard, lower id first.

    With a ``title`` in ``movies``, the title and genres of the similar item follow.

    Items with equal genre sets have equal similarities to everything, so lists of n + 1 are
    ranked per distinct genre set and an item drops itself from its set's list. Each set
    needs the n + 1 lowest ids of n + 1 sets, plus the n + 1 lowest ids overall for
    similarity 0. Items without genres have similarity 0 to all.
    """
    check_n(n)
    depth = n + 1
    keyed = with_classes(movies.select("movieId", "genres")).select(
        "movieId", F.coalesce("class_key", F.lit([]).cast("array<string>")).alias("class_key")
    )
    # A catalogue may be one small file: the rows are dealt, so that no task sorts all of them.
    keyed = materialize(keyed.repartition("movieId"), "item-classes")
    wanted = keyed if targets is None else keyed.join(targets.select("movieId"), "movieId", "left_semi")
    class_keys = numbered_sets(keyed, "class_key", "class_id")
    short = materialize(
        top_n_per_key(keyed, "class_key", [F.asc("movieId")], depth, "class_rank")
        .join(class_keys, "class_key")
        .select("class_id", "movieId", "class_rank"),
        "class-items",
    )
    leaders = short.where(F.col("class_rank") == 1).join(class_keys, "class_id")
    sets = class_keys.select(F.col("class_id").alias("set_id"), F.col("class_key").alias("set_key"))
    if targets is not None:
        sets = sets.join(wanted.select(F.col("class_key").alias("set_key")), "set_key", "left_semi")
    union = F.col("set_size") + F.size("class_key") - F.col("overlap")
    scored = materialize(
        leaders.select("class_id", "class_key", "movieId", F.lit(0.0).alias("popularity_score")), "leaders"
    )
    pairs = class_overlaps(sets, scored, _jaccard, depth).withColumn("similarity", F.col("overlap") / union)
    best = best_classes(pairs, "similarity", depth).select("set_id", "class_id", "similarity")
    matching = materialize(best, "best-classes").join(short, "class_id").select("set_id", "movieId", "similarity")
    lowest = keyed.orderBy("movieId").limit(depth)
    other = (
        sets.crossJoin(leading_items(lowest, depth))
        .where(~F.arrays_overlap("set_key", "class_key"))
        .select("set_id", "movieId", F.lit(0.0).alias("similarity"))
    )
    lists = (
        top_n_per_key(
            matching.unionByName(other), "set_id", [F.desc("similarity"), F.asc("movieId")], depth, "list_rank"
        )
        .join(class_keys, F.col("set_id") == class_keys.class_id)
        .select("class_key", "list_rank", F.col("movieId").alias("similarId"), "similarity")
    )
    lists = materialize(lists, "class-lists")
    best = _without_self(wanted, lists, row_counts(keyed, "class_key"), n)
    if "title" not in movies.columns:
        return best.select("movieId", "rank", "similarId", "similarity")
    text = movies.select(F.col("movieId").alias("similarId"), "title", "genres")
    return best.join(text, "similarId", "left").select("movieId", "rank", "similarId", "similarity", "title", "genres")


def _without_self(wanted: DataFrame, lists: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """(movieId, rank, similarId, similarity): the first ``n`` of the item's class list, without the item.

    A list is one row for its class, and an item takes its part of it, so no row per item and place is sorted. Ids
    that come more than once rank the lists of all their rows together.
    """
    entry = F.struct("list_rank", "similarId", "similarity")
    arrays = lists.groupBy("class_key").agg(F.sort_array(F.collect_list(entry)).alias("list"))
    copies = wanted.groupBy("movieId").agg(F.count(F.lit(1)).alias("copies"))
    again = materialize(copies.where(F.col("copies") > 1).select("movieId"), "repeated-items")
    taken = salted_join(wanted.join(again, "movieId", "left_anti"), arrays, "class_key", weights, "__rows", "inner")
    others = F.slice(F.filter("list", lambda x: x["similarId"] != F.col("movieId")), 1, n)
    single = taken.select("movieId", F.posexplode(others).alias("place", "entry")).select(
        "movieId", (F.col("place") + 1).alias("rank"), "entry.similarId", "entry.similarity"
    )
    rows = salted_join(wanted.join(again, "movieId", "left_semi"), lists, "class_key", weights, "__rows", "inner")
    ranked = top_n_per_key(rows.where(F.col("movieId") != F.col("similarId")), "movieId", [F.asc("list_rank")], n)
    return single.unionByName(ranked.select("movieId", "rank", "similarId", "similarity"))


def similar_by_vector(
    vectors: DataFrame,
    n: int = 10,
    id_column: str = "movieId",
    vector_column: str = "features",
    targets: DataFrame | None = None,
    cells: int | None = None,
    counter=None,
) -> DataFrame:
    """(id, rank, similarId, similarity): top ``n`` other rows by cosine; zero vectors take no part.

    Exact, by cells around pivots (see ``plans/cells.py``, also for ``cells`` and ``counter``).

    ``targets`` limits the rows that get a list (one row is a single lookup); an unknown id
    gets none.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vec")).where(
        F.exists("vec", lambda x: x != 0)
    )
    left = rows
    if targets is not None:
        left = rows.join(targets.select(F.col(id_column).alias("id")).distinct(), "id", "left_semi")
    best = cosine_top_n(left, rows, n, cells=cells, counter=counter)
    return best.select(
        F.col("left_id").alias(id_column),
        "rank",
        F.col("right_id").alias("similarId"),
        F.col("score").alias("similarity"),
    )
