"""Ranking the catalogue for many genre sets at once.

Items with the same set of genres match every preference equally, so matching is done
between *distinct* preference sets and *distinct* genre sets ("classes"). The number of
both depends on the genre vocabulary, not on the number of users or items.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions import blend_score, genre_set
from tastegrid.operators.popularity import popular_order
from tastegrid.plans.blocks import Lists, ordered_blocks
from tastegrid.plans.indexing import dense_index
from tastegrid.plans.ranking import top_n_per_key
from tastegrid.sources.session import materialize


# Rows of a block of sets and of classes, and scores that a task holds at a time.
SETS_PER_BLOCK, CLASSES_PER_BLOCK = 1024, 16384
SCORES_AT_ONCE = 1 << 22
# A list of leading items up to this length is broadcast (some 10 MB); it has no more rows than a list is deep.
BROADCAST_ITEMS = 100_000


def leading_items(items: DataFrame, depth: int) -> DataFrame:
    """``items``, which are ``depth`` rows at most, for a join with every set."""
    return F.broadcast(items) if depth <= BROADCAST_ITEMS else items


# Classes that a task scores together, and room for rounding in a bound.
TILE_CLASSES, SLACK = 512, 1e-9


def blend_in_numpy(overlap, set_size, popularity):
    """The arithmetic of ``blend_score`` in the same order, so that both round alike."""
    return 0.6 * popularity / 5.0 + 0.4 * (overlap / set_size)


def blend_bound(popularity, set_size, longest: int):
    """No class of at most this popularity and of at most ``longest`` genres scores higher."""
    return blend_in_numpy(np.minimum(set_size, longest), set_size, popularity) + SLACK


def best_blends(left: pd.DataFrame, right: pd.DataFrame, depth: int, longest: int) -> tuple[pd.DataFrame, int]:
    """The ``depth`` classes of the highest blend per set, and the number of scores taken.

    Classes come by falling popularity, tile by tile. A set takes part as long as the tile's first class could still reach its
    ``depth``-th score if it had as many of the set's genres as any class has; where no set does, the rest is left unread.
    """
    right = right.sort_values(["popularity_score", "movieId"], ascending=[False, True])
    popularity, ids = right["popularity_score"].to_numpy(float), right["movieId"].to_numpy()
    keys = [*left["set_key"], *right["class_key"]]
    lengths = np.array([len(k) for k in keys])
    codes, words = pd.factorize(np.concatenate(keys)) if lengths.sum() else (np.empty(0, np.int64), [])
    places = np.append(0, lengths.cumsum())
    set_size, taken, parts = lengths[: len(left)], 0, []
    step = max(1, SCORES_AT_ONCE // max(TILE_CLASSES, depth))
    for i in range(0, len(left), step):
        mine = left.iloc[i : i + step]
        size = set_size[i : i + step].astype(float)
        rows = np.repeat(np.arange(len(mine)), set_size[i : i + step])
        entries = codes[places[i] : places[i + len(mine)]]
        lists = Lists(len(mine), depth, mine["floor"].fillna(-np.inf).to_numpy(float))
        column = np.full(len(words), -1)
        for t in range(0, len(right), TILE_CLASSES):
            active = np.flatnonzero(blend_bound(popularity[t], size, longest) >= lists.least)
            if not len(active):
                break
            upto = min(t + TILE_CLASSES, len(right))
            of_class = codes[places[len(left) + t] : places[len(left) + upto]]
            class_rows = np.repeat(np.arange(upto - t), lengths[len(left) + t : len(left) + upto])
            known = np.unique(of_class)
            column[:] = -1
            column[known] = np.arange(len(known))
            classes = np.zeros((upto - t, max(1, len(known))), np.float32)
            classes[class_rows, column[of_class]] = 1
            place = np.full(len(mine), -1)
            place[active] = np.arange(len(active))
            shared = (column[entries] >= 0) & (place[rows] >= 0)
            sets = np.zeros((len(active), max(1, len(known))), np.float32)
            sets[place[rows[shared]], column[entries[shared]]] = 1
            overlap = (sets @ classes.T).astype(float)
            scores = blend_in_numpy(overlap, size[active][:, None], popularity[None, t:upto])
            taken += scores.size
            lists.add(active, scores, ids[t:upto])
        found = lists.frame(np.arange(len(mine)))
        at = found["left_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        which = order[np.searchsorted(ids[order], found["right_id"].to_numpy())]
        overlap = np.rint((found["score"].to_numpy() - 0.6 * popularity[which] / 5.0) / 0.4 * size[at])
        parts.append(
            pd.DataFrame(
                {
                    "set_id": mine["set_id"].to_numpy()[at],
                    "set_size": size[at].astype("int64"),
                    "class_id": right["class_id"].to_numpy()[which],
                    "overlap": overlap.astype("int64"),
                    "score": found["score"].to_numpy(),
                }
            )
        )
    return pd.concat(parts), taken


def ranked_classes(sets: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """(set_id, set_size, class_id, overlap, movieId, popularity_score): the ``depth`` classes of the highest blend per set, at least.

    ``sets`` has set_id and set_key; ``classes`` class_id, class_key, movieId and popularity_score, written. Classes lie in
    blocks by falling popularity. Every set meets the first block, and goes on to those whose most popular class could
    reach its ``depth``-th score there. Classes that share no genre with a set take part with their popularity.
    """
    set_blocks = max(1, ceil(sets.count() / SETS_PER_BLOCK))
    longest = classes.agg(F.max(F.size("class_key"))).first()[0] or 0
    table = classes.withColumn("popularity_score", F.col("popularity_score").cast("double"))
    table, tops = ordered_blocks(table, "popularity_score", "class_id", CLASSES_PER_BLOCK, max(1, classes.count()))
    x = lambda c: F.pmod(F.xxhash64(c), F.lit(set_blocks)).cast("int").alias("x")
    every = F.explode(F.sequence(F.lit(0), F.lit(set_blocks - 1))).alias("x")
    kind = "set_id bigint, set_size bigint, class_id bigint, overlap bigint, score double"
    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("set_id", "set_size", "class_id", "overlap")} | {"score": pd.Series(dtype=float)})

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return empty if left.empty or right.empty else best_blends(left, right, depth, longest)[0]

    def meet(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        rows = rows.select(x("set_id"), "block", "set_id", "set_key", "floor")
        blocks = blocks.select(every, "block", "class_id", "class_key", "movieId", "popularity_score")
        return rows.groupBy("x", "block").cogroup(blocks.groupBy("x", "block")).applyInPandas(work, kind)

    text = classes.select("class_id", "movieId", "popularity_score")
    first = F.col("block") == 0
    begun = meet(sets.select("*", F.lit(None).cast("double").alias("floor"), F.lit(0).alias("block")), table.where(first))
    if len(tops) == 1:
        return begun.drop("score").join(text, "class_id")
    begun = materialize(begun, "first-classes")
    floors = begun.groupBy("set_id").agg(F.when(F.count(F.lit(1)) >= depth, F.min("score")).alias("floor"))
    most = F.least(F.size("set_key"), F.lit(longest)) / F.size("set_key")
    later = [F.struct(F.lit(k).alias("block"), F.lit(float(t)).alias("top")) for k, t in enumerate(tops) if k]
    reached = F.filter(
        F.array(*later), lambda b: F.col("floor").isNull() | (blend_score(b["top"], most) + SLACK >= F.col("floor"))
    )
    onward = sets.join(floors, "set_id", "left").withColumn("open", F.explode(reached)).withColumn("block", F.col("open.block"))
    rest = meet(onward, table.where(~first))
    return begun.unionByName(rest).drop("score").join(text, "class_id")


def with_classes(items: DataFrame) -> DataFrame:
    """Adds ``class_key``, the sorted distinct genres; null genres have none."""
    return items.withColumn("class_key", genre_set("genres"))


def numbered_sets(keys: DataFrame, key: str, number: str) -> DataFrame:
    """Distinct arrays with a dense integer, written once: the joins below move integers, not arrays."""
    return materialize(dense_index(keys, key).withColumnRenamed("idx", number), number)


def _best_in_block(score: Callable, depth: int):
    """Overlaps of a block of sets and a block of classes as a product of 0/1 matrices over their genres."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("set_id", "set_size", "class_id", "overlap")})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("movieId")  # columns in the order that breaks ties
        keys = [*left["set_key"], *right["class_key"]]
        sizes = np.array([len(k) for k in keys])
        words, codes = np.unique(np.concatenate(keys).astype(str), return_inverse=True)
        if not len(words):
            return empty
        flags = np.zeros((len(keys), len(words)), np.float32)
        flags[np.repeat(np.arange(len(keys)), sizes), codes] = 1
        sets, classes = flags[: len(left)], flags[len(left) :]
        set_sizes, class_sizes = sizes[: len(left)], sizes[len(left) :]
        popularity = right["popularity_score"].to_numpy(float)
        step = max(1, SCORES_AT_ONCE // len(right))
        parts = [empty]
        for i in range(0, len(left), step):
            overlap = (sets[i : i + step] @ classes.T).astype(float)
            value = score(overlap, set_sizes[i : i + step, None], class_sizes[None, :], popularity[None, :])
            value[overlap == 0] = -np.inf
            width = min(depth, value.shape[1])
            bound = -np.partition(-value, width - 1, axis=1)[:, width - 1 : width]
            at, col = np.nonzero((value >= bound) & (value > -np.inf))
            order = np.lexsort((col, -value[at, col], at))
            at, col = at[order], col[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < depth
            at, col = at[keep], col[keep]
            parts.append(
                pd.DataFrame(
                    {
                        "set_id": left["set_id"].to_numpy()[at + i],
                        "set_size": set_sizes[at + i],
                        "class_id": right["class_id"].to_numpy()[col],
                        "overlap": overlap[at, col].astype("int64"),
                    }
                )
            )
        return pd.concat(parts)

    return run


def class_overlaps(sets: DataFrame, classes: DataFrame, score: Callable, depth: int) -> DataFrame:
    """(set_id, set_size, class_id, overlap) and the other class columns: classes that share a genre with a set.

    ``sets`` has set_id and set_key; ``classes`` class_id, class_key, movieId and popularity_score. Of each set at
    least the ``depth`` classes of the highest ``score`` (overlap, set size, class size, popularity; ties by movieId)
    are there. Sets and classes meet block by block as matrix products: no row per shared genre is formed,
    and a task returns ``depth`` rows per set.
    """
    set_blocks = max(1, ceil(sets.count() / SETS_PER_BLOCK))
    class_blocks = max(1, ceil(classes.count() / CLASSES_PER_BLOCK))

    def block(column: str, blocks: int):
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = sets.select(block("set_id", set_blocks).alias("x"), every(class_blocks).alias("y"), "set_id", "set_key")
    right = classes.select(
        every(set_blocks).alias("x"),
        block("class_id", class_blocks).alias("y"),
        "class_id",
        "class_key",
        "movieId",
        F.col("popularity_score").cast("double").alias("popularity_score"),
    )
    kind = "set_id bigint, set_size bigint, class_id bigint, overlap bigint"
    best = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(_best_in_block(score, depth), kind)
    return best.join(classes, "class_id")


def best_classes(pairs: DataFrame, score: str, depth: int) -> DataFrame:
    """The ``depth`` classes per set whose first item scores highest, with ``bound``.

    With ``depth`` classes the lowest of these scores is reached by ``depth`` items, so no item
    below it can be among the first ``depth``. With fewer classes there is no bound (null).
    """
    best = top_n_per_key(pairs, "set_id", [F.desc(score), F.asc("movieId")], depth, "place")
    whole = Window.partitionBy("set_id")
    full = F.count(F.lit(1)).over(whole) == depth
    return best.withColumn("bound", F.when(full, F.min(score).over(whole)))


def rank_for_sets(sets: DataFrame, items: DataFrame, depth: int) -> DataFrame:
    """First ``depth`` items per preference set by 0.6 * popularity / 5 + 0.4 * match.

    ``sets`` has ``set_key`` (distinct, sorted, not empty), and may have its number as ``set_id``, a written table then: the
    result has the number instead of the key, so that list rows carry no arrays. ``items`` is a popularity table.
    Exact, because a list of ``depth`` items needs at most the ``depth`` most popular items of a class, and the
    ``depth`` classes whose best item scores highest. Whatever is left out has ``depth`` better items before it.
    """
    known = with_classes(
        items.where(F.col("genres").isNotNull()).select("movieId", "genres", "popularity_score")
    )
    numbered = "set_id" in sets.columns
    keys = sets if numbered else numbered_sets(sets, "set_key", "set_id")
    class_keys = numbered_sets(known, "class_key", "class_id")
    short = materialize(
        top_n_per_key(known, "class_key", popular_order(), depth, "class_rank")
        .join(class_keys, "class_key")
        .select("class_id", "movieId", "popularity_score", "class_rank"),
        "class-items",
    )
    leaders = short.where(F.col("class_rank") == 1).join(class_keys, "class_id")
    match = F.col("overlap") / F.col("set_size")
    pairs = ranked_classes(keys, materialize(leaders.drop("class_rank"), "leaders"), depth)
    pairs = pairs.withColumn("score", blend_score(F.col("popularity_score"), match))
    best = best_classes(pairs, "score", depth).select("set_id", "set_size", "class_id", "overlap", "bound")
    # Both sides are written tables: a class that most sets want is split by AQE.
    matching = (
        materialize(best, "best-classes")
        .join(short, "class_id")
        .withColumn("score", blend_score(F.col("popularity_score"), match))
        .where(F.col("bound").isNull() | (F.col("score") >= F.col("bound")))
        .select("set_id", "movieId", "popularity_score", "score")
    )
    ranked = top_n_per_key(matching, "set_id", [F.desc("score"), F.asc("movieId")], depth)
    if not numbered:
        ranked = ranked.join(keys, "set_id")
    return ranked.select("set_id" if numbered else "set_key", "rank", "movieId", "popularity_score", "score")
