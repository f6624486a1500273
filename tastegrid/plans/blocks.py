"""Top-n of a vector product between two large tables, longest vectors first."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import norm
from tastegrid.plans.ranking import check_n, top_n_per_key
from tastegrid.plans.spread import label_of, slot_labels
from tastegrid.sources.session import drop_table, files_by_folder, materialize, read_files, scratch_tables

# Bytes of single-precision vectors in a block, and the fewest left rows that are worth a task of their own.
BLOCK_BYTES = 32 << 20
SMALLEST_BLOCK = 512
# Right rows that are multiplied together, and scores that a task holds at a time.
TILE_ROWS = 512
SCORES_AT_ONCE = 1 << 21
# Most single products that are taken again at a time.
PAIRS_AT_ONCE = 1 << 14
# Most left rows of a block; what they leave out comes with them.
LONGEST_LEFT = 1 << 17
# Leaves are used where their radius is below this share of their longest vector.
TIGHT = 0.5
# Room for the rounding of lengths and products in a bound.
SLACK = 1e-6
# Error of a product in single precision, per place and unit of length, and the longest product that it holds.
ROUGH, ROUGH_MOST = 1.2e-7, 1e30

BEST = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("score", pa.float64())])


class Lists:
    """The n best (score, id) of some rows, by falling score and then rising id."""

    def __init__(self, rows: int, n: int, floor: np.ndarray | None = None):
        self.n = n
        self.scores = np.full((rows, n), -np.inf)
        self.ids = np.full((rows, n), np.iinfo(np.int64).max)
        self.least = np.full(rows, -np.inf) if floor is None else floor.astype(float)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ``ids`` for ``rows``; -inf stands for no candidate."""
        better = scores.max(axis=1, initial=-np.inf) >= self.least[rows]
        rows, scores = rows[better], scores[better]
        if not len(rows):
            return
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        bound = -np.partition(-scores, self.n - 1, axis=1)[:, self.n - 1 : self.n]
        at, col = np.nonzero((scores >= bound) & (scores > -np.inf))
        value, who = scores[at, col], ids[at, col]
        order = np.lexsort((who, -value, at))
        at, value, who = at[order], value[order], who[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.n
        at, place = at[keep], place[keep]
        self.scores[rows], self.ids[rows] = -np.inf, np.iinfo(np.int64).max
        self.scores[rows[at], place], self.ids[rows[at], place] = value[keep], who[keep]
        self.least[rows] = np.maximum(self.least[rows], self.scores[rows, -1])

    def add_pairs(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A score of one of ``ids`` for one of ``rows`` each."""
        mine = np.unique(rows)
        at = np.concatenate([np.repeat(mine, self.n), rows])
        value, who = np.concatenate([self.scores[mine].ravel(), scores]), np.concatenate([self.ids[mine].ravel(), ids])
        order = np.lexsort((who, -value, at))
        at, value, who = at[order], value[order], who[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.n
        self.scores[at[keep], place[keep]], self.ids[at[keep], place[keep]] = value[keep], who[keep]
        self.least[mine] = np.maximum(self.least[mine], self.scores[mine, -1])

    def frame(self, left_ids: np.ndarray) -> pd.DataFrame:
        at, place = np.nonzero(self.scores > -np.inf)
        return pd.DataFrame({"left_id": left_ids[at], "right_id": self.ids[at, place], "score": self.scores[at, place]})


def _take_tile(lists: Lists, a, a32, active, reach, tile, ids, decimals: int, gone_row, gone_col) -> None:
    """Adds the products of ``active`` rows of ``a`` (``a32`` in single precision) with a tile; ``reach`` bounds them, ``gone`` pairs are by column of the tile.

    Products in single precision, which are twice as fast, pick the pairs that can be among the best; these are taken again, or, if they
    are many, all products of their rows.
    """
    if np.isfinite(lists.least[active]).all() and reach.max() < ROUGH_MOST:
        some = a32 if len(active) == len(a) else a32[active]
        rough = some @ tile.astype(np.float32).T
        room = ROUGH * (a.shape[1] + 4) * reach + 10.0**-decimals
        some = np.flatnonzero(rough.max(axis=1) + room >= lists.least[active])
        if not len(some):
            return
        rough, floor, active = rough[some], lists.least[active[some]] - room[some], active[some]
        row, col = np.nonzero(rough >= floor[:, None])
        if len(row) <= PAIRS_AT_ONCE:
            row = active[row]
            if len(gone_row):
                free = ~np.isin(row * len(tile) + col, gone_row * len(tile) + gone_col)
                row, col = row[free], col[free]
            lists.add_pairs(row, np.round(np.einsum("lk,lk->l", a[row], tile[col]), decimals), ids[col])
            return
    scores = np.round(a[active] @ tile.T, decimals)
    at = np.searchsorted(active, gone_row)
    known = active[np.minimum(at, len(active) - 1)] == gone_row
    scores[at[known], gone_col[known]] = -np.inf
    lists.add(active, scores, ids)


def best_products(
    a: np.ndarray, b: np.ndarray, ids: np.ndarray, n: int, decimals: int, floor=None, gone=None, lists: Lists | None = None
) -> tuple[Lists, int]:
    """The n best rows of ``b`` per row of ``a``, and the number of products taken.

    ``b`` comes by falling length. A tile whose length times a row's length is below the row's n-th score so far (at
    first its ``floor``) holds none of its best, and neither do the tiles behind it. ``gone`` (row, column) pairs, by
    column, are left out. With ``lists`` these go on, which hold the best of other rows.
    """
    lengths, tops = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    lists, taken, a32 = lists or Lists(len(a), n, floor), 0, a.astype(np.float32)
    gone_row, gone_col = gone if gone is not None else (np.empty(0, np.int64),) * 2
    for lo in range(0, len(b), TILE_ROWS):
        reach = lengths * tops[lo]
        active = np.flatnonzero(reach + SLACK * (1 + reach) >= lists.least)
        if not len(active):
            break
        tile = b[lo : lo + TILE_ROWS]
        taken += len(active) * len(tile)
        first, last = np.searchsorted(gone_col, [lo, lo + len(tile)])
        masked = gone_row[first:last], gone_col[first:last] - lo
        _take_tile(lists, a, a32, active, reach[active], tile, ids[lo : lo + TILE_ROWS], decimals, *masked)
    return lists, taken


def leaf_order(b: np.ndarray) -> np.ndarray:
    """An order in which every ``TILE_ROWS`` rows lie close together: halves along the widest coordinate, again and again."""
    order, parts = np.arange(len(b)), [(0, len(b))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo <= TILE_ROWS:
            continue
        mine = b[order[lo:hi]]
        column = mine[:, np.argmax(mine.max(axis=0) - mine.min(axis=0))]
        half = (ceil((hi - lo) / TILE_ROWS) // 2) * TILE_ROWS
        order[lo:hi] = order[lo:hi][np.argpartition(column, half)]
        parts += [(lo, lo + half), (lo + half, hi)]
    return order


class Leaves:
    """Rows in tiles of close vectors, each tile with its centre, its radius and its longest vector."""

    def __init__(self, b: np.ndarray):
        starts = range(0, len(b), TILE_ROWS)
        self.sizes = np.array([min(TILE_ROWS, len(b) - lo) for lo in starts])
        self.centres = np.stack([b[lo : lo + TILE_ROWS].mean(axis=0) for lo in starts])
        self.radii = np.array([np.linalg.norm(b[lo : lo + TILE_ROWS] - c, axis=1).max() for lo, c in zip(starts, self.centres)])
        self.tops = np.array([np.linalg.norm(b[lo : lo + TILE_ROWS], axis=1).max() for lo in starts])

    @property
    def tight(self) -> bool:
        return self.radii.mean() < TIGHT * self.tops.mean()


def best_in_leaves(
    a: np.ndarray, b: np.ndarray, ids: np.ndarray, leaves: Leaves, n: int, decimals: int, floor=None, gone=None, lists: Lists | None = None
) -> tuple[Lists, int]:
    """As ``best_products``, for ``b`` in the tiles of ``leaves``.

    A row's product with a tile lies within its length times the radius of the product with the centre. The highest of these
    lower ends, among the tiles that have ``n`` rows besides all that the row leaves out, is a floor; tiles whose upper end is
    below it are not read.
    """
    lengths, lists, taken = np.linalg.norm(a, axis=1), lists or Lists(len(a), n, floor), 0
    a32 = a.astype(np.float32)
    gone_row, gone_col = gone if gone is not None else (np.empty(0, np.int64),) * 2
    middle, spread = a @ leaves.centres.T, lengths[:, None] * leaves.radii
    room = SLACK * (1 + lengths[:, None] * leaves.tops)
    enough = leaves.sizes >= n + np.bincount(gone_row, minlength=len(a))[:, None]
    sure = np.where(enough, middle - spread - room, -np.inf).max(axis=1, initial=-np.inf)
    lists.least = np.maximum(lists.least, sure)
    upper = np.minimum(middle + spread, lengths[:, None] * leaves.tops) + room
    for t in np.argsort(-upper.max(axis=0), kind="stable"):
        active = np.flatnonzero(upper[:, t] >= lists.least)
        if not len(active):
            continue
        lo = t * TILE_ROWS
        tile = b[lo : lo + TILE_ROWS]
        taken += len(active) * len(tile)
        first, last = np.searchsorted(gone_col, [lo, lo + len(tile)])
        masked = gone_row[first:last], gone_col[first:last] - lo
        _take_tile(lists, a, a32, active, lengths[active] * leaves.tops[t], tile, ids[lo : lo + TILE_ROWS], decimals, *masked)
    return lists, taken


def _vectors(rows: pa.Table) -> np.ndarray:
    flat = rows["vec"].combine_chunks().flatten().to_numpy().astype("float64")
    return flat.reshape(len(rows), -1)


def _best_of_blocks(n: int, decimals: int, blocks: list[list[str]], tops: list[float], spans: int):
    """The n best of every ``spans``-th block for a part of the left rows; blocks are read one after the other."""

    def run(left: pa.Table, gone: pa.Table) -> pa.Table:
        if not len(left):
            return BEST.empty_table()
        span, a = left["span"][0].as_py(), _vectors(left)
        lengths, step = np.linalg.norm(a, axis=1), max(1, SCORES_AT_ONCE // TILE_ROWS)
        slices = [slice(i, min(i + step, len(a))) for i in range(0, len(a), step)]
        lists = [Lists(s.stop - s.start, n) for s in slices]
        if len(gone):
            ids = pc.fill_null(left["id"], np.iinfo(np.int64).min).to_numpy()
            gone_at, gone_id = pd.Index(ids).get_indexer(gone["left_id"].to_numpy()), gone["right_id"].to_numpy()
            gone_at, gone_id = gone_at[gone_at >= 0], gone_id[gone_at >= 0]
        for files, top in list(zip(blocks, tops))[span::spans]:
            reach = lengths * top
            least = np.concatenate([x.least for x in lists])
            if not (reach + SLACK * (1 + reach) >= least).any():
                break
            if not files:
                continue
            right = read_files(files, ["id", "vec"])
            b, right_ids = _vectors(right), right["id"].to_numpy()
            close = leaf_order(b)
            leaves = Leaves(b[close])
            tight = leaves.tight
            order = close if tight else np.lexsort((right_ids, -np.linalg.norm(b, axis=1)))
            b, right_ids = b[order], right_ids[order]
            at = col = np.empty(0, np.int64)
            if len(gone):
                col = pd.Index(right_ids).get_indexer(gone_id)
                at, col = gone_at[col >= 0], col[col >= 0]
                at, col = np.divmod(np.unique(at.astype(np.int64) * len(b) + col), len(b))
            for s, mine in zip(slices, lists):
                lo, hi = np.searchsorted(at, [s.start, s.stop])
                by_col = np.argsort(col[lo:hi], kind="stable")
                masked = at[lo:hi][by_col] - s.start, col[lo:hi][by_col]
                if tight:
                    best_in_leaves(a[s], b, right_ids, leaves, n, decimals, gone=masked, lists=mine)
                else:
                    best_products(a[s], b, right_ids, n, decimals, gone=masked, lists=mine)
        scores, ids = np.concatenate([x.scores for x in lists]), np.concatenate([x.ids for x in lists])
        at, place = np.nonzero(scores > -np.inf)
        found = [left["id"].combine_chunks().take(pa.array(at)), pa.array(ids[at, place]), pa.array(scores[at, place])]
        return pa.table(found, schema=BEST)

    return run


def ordered_blocks(right: DataFrame, value: str, key: str, fit: int, rows: int) -> tuple[DataFrame, list[float]]:
    """``right`` with a ``block`` of about ``fit`` rows by falling ``value``, and the largest value in each block.

    Cuts at quantiles make the blocks; where many values are equal, hashing the key divides them. The driver sees two
    numbers per block.
    """
    parts = ceil(rows / fit)
    if parts == 1:
        top = right.agg(F.max(value)).first()[0]
        return right.withColumn("block", F.lit(0)), [top or 0.0]
    quantiles = [1 - (k + 1) / parts for k in range(parts - 1)]
    cuts = right.agg(F.percentile_approx(value, quantiles, 100 * parts)).first()[0]
    cuts = sorted(set(cuts), reverse=True)
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col(value)))
    cut = right.withColumn("bucket", bucket)
    stats = {r.bucket: r for r in cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top")).collect()}
    first, split, tops = [], [], []
    for k in range(len(cuts) + 1):
        pieces = ceil(stats[k].n / fit) if k in stats else 1
        first.append(len(tops))
        split.append(pieces)
        tops += [stats[k].top if k in stats else 0.0] * pieces
    of_bucket = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    block = of_bucket(first) + F.pmod(F.xxhash64(key), of_bucket(split)).cast("int")
    return cut.withColumn("block", block).drop("bucket"), tops


def block_top_n(
    left: DataFrame,
    right: DataFrame,
    n: int,
    exclude: DataFrame | None = None,
    rows_per_block: int | None = None,
    decimals: int = 9,
) -> DataFrame:
    """(left_id, right_id, score, rank): the ``n`` best right rows per left row by dot product.

    Both sides have ``id`` (bigint) and ``vec`` (array). Right rows are cut into blocks of ``BLOCK_BYTES`` in single
    precision (or of ``rows_per_block``) by falling length, and written once, a folder per block; left rows are dealt to
    parts by a hash and sent once. A part's task reads one block after the other, keeps the n best of its rows, and stops
    where the largest length of a block times a row's own reaches no row's n-th score so far; in a block it goes tile by
    tile, or, where vectors lie close together, reads the tiles only that can hold one. The left side has at
    least a part per core, as long as ``SMALLEST_BLOCK`` rows are in it; shorter ones are sent to as many tasks as cores, which
    share the blocks. ``exclude`` (left_id, right_id) is dealt like the left rows and masked there, however many pairs a row
    has. Score order, then lower id; ``decimals`` absorbs the summation order. The result is exact.
    """
    check_n(n)
    spark = left.sparkSession

    def sized(side: DataFrame) -> DataFrame:
        vec = F.col("vec").cast("array<float>")
        return side.select("id", vec.alias("vec"), norm(vec).alias("length"))

    with scratch_tables(spark):
        right = materialize(sized(right), "right-rows")
        left_rows_n, right_rows_n = left.select("id").count(), right.count()
        width = right.agg(F.max(F.size("vec"))).first()[0] or 1
        fit = rows_per_block or max(1, BLOCK_BYTES // (4 * width))
        cores = spark.sparkContext.defaultParallelism
        left_blocks = max(1, ceil(left_rows_n / min(fit, LONGEST_LEFT)))
        if rows_per_block is None:
            left_blocks = max(left_blocks, min(2 * cores, ceil(left_rows_n / SMALLEST_BLOCK)))
        ordered, tops = ordered_blocks(right, "length", "id", fit, max(1, right_rows_n))
        ordered = ordered.select("id", "vec", "block").repartition(len(tops), "block")
        found = files_by_folder(materialize(ordered, "right-blocks", folders=["block"]), ["block"])
        drop_table(right)
        spans = min(len(tops), ceil(cores / left_blocks))
        slots = left_blocks * spans
        labels = slot_labels(spark, slots)

        def dealt(rows: DataFrame, key: str) -> DataFrame:
            part = F.pmod(F.xxhash64(key), F.lit(left_blocks)).cast("int")
            rows = rows.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
            slot = label_of(part * spans + F.col("span"), labels)
            return rows.withColumn("slot", slot).repartition(slots, "slot").groupBy("slot")

        if exclude is None:
            exclude = spark.createDataFrame([], "left_id bigint, right_id bigint")
        gone = exclude.select(F.col("left_id").cast("bigint"), F.col("right_id").cast("bigint")).dropna()
        blocks = [found.get((k,), []) for k in range(len(tops))]
        work = _best_of_blocks(n, decimals, blocks, tops, spans)
        left = left.select("id", F.col("vec").cast("array<float>").alias("vec"))
        best = dealt(left, "id").cogroup(dealt(gone, "left_id")).applyInArrow(work, "left_id bigint, right_id bigint, score double")
        best = top_n_per_key(best, "left_id", [F.desc("score"), F.asc("right_id")], n)
        return materialize(best, "best-products", keep=True)
