"""Exact nearest neighbours by angle: only cells that can hold a neighbour meet.

Each vector belongs to the cell of its nearest pivot. A row first meets its own cell, which gives a floor for the similarity
of its n-th neighbour, that is, a largest angle. By the triangle inequality a cell can hold a nearer one only if the row's angle
to the cell's pivot, less the cell's radius, is within that angle; and in such a cell only vectors whose angle to
the pivot differs from the row's by no more. Equal vectors are one vector with a list of ids.

Cells and rows are written once. A task holds a part of the rows and reads one piece of a cell after the other, those only that a row of
it is open to; so no row is sent to the cells that it looks into, however many these are, and a task's memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.plans.blocks import BEST as FOUND
from tastegrid.plans.blocks import BLOCK_BYTES, SCORES_AT_ONCE, TILE_ROWS, Lists, _take_tile
from tastegrid.plans.ranking import check_n, top_n_per_key
from tastegrid.plans.skew import row_counts, salted_join
from tastegrid.sources.session import files_by_folder, materialize, read_files, scratch_tables

# Pivots at most, and vectors among which they are chosen per pivot: both bound what the driver and a task hold.
MOST_PIVOTS, DRAWN_PER_PIVOT = 1024, 4
# Fewer vectors than this are not worth a cell of their own on average: a row that looks into many small cells travels more.
LEAST_CELL = 2048
# Vectors of a piece of a cell, and rows of a part that looks into cells: at most, and as many as ``BLOCK_BYTES`` hold in single precision.
CELL_ROWS, QUERY_ROWS = 16_384, 32_768
# Fewer rows than this are not dealt to several parts, as each reads the cells.
LEAST_PART = 64
# Vectors whose angles to all pivots are taken at a time.
ANGLES_AT_ONCE = 1 << 20
# Room for the rounding of angles.
SLACK = 1e-6

PLACED = "id long, vec array<float>, cell int, angle double"
BEST = "left_id long, right_id long, score double"


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy() if isinstance(column, pd.Series) else column)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def choose_pivots(units: np.ndarray, wanted: int) -> np.ndarray:
    """Vectors far from each other: each is the farthest from those before it."""
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(wanted, len(units)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-12:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, units @ units[far])
    return units[chosen]


def _read_units(files: list[str], *columns: str) -> list[np.ndarray]:
    """Unit vectors of written rows, and these columns."""
    rows = read_files(files, ["vec", *columns])
    flat = rows["vec"].combine_chunks().flatten().to_numpy()
    return [_unit(flat.reshape(len(rows), -1)), *(rows[c].to_numpy() for c in columns)]


class Part:
    """Rows that look into cells, and their best so far."""

    def __init__(self, files: list[str], depth: int, decimals: int):
        self.units, self.ids, self.cells = _read_units(files, "id", "cell")
        self.single, self.lists = self.units.astype(np.float32), Lists(len(self.ids), depth)
        self.depth, self.decimals, self.compared = depth, decimals, 0

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """The largest angle at which a vector can be one of a row's best."""
        return np.arccos(np.clip(self.lists.least[rows], -1.0, 1.0)) + SLACK

    def look(self, rows: np.ndarray, angle: np.ndarray, files: list[str]) -> None:
        """Compares ``rows``, at these angles to the pivot, with a piece of its cell: ring by ring, those only that can hold one."""
        b, ids, rings = _read_units(files, "id", "angle")
        order = np.lexsort((ids, rings))
        b, ids, rings = b[order], ids[order], rings[order]
        step = max(1, SCORES_AT_ONCE // TILE_ROWS)
        for lo in range(0, len(rows), step):
            mine, mine_angle = rows[lo : lo + step], angle[lo : lo + step]
            # Nearest rings first, so that the floors rise early.
            middle = np.median(mine_angle)
            for t in sorted(range(0, len(b), TILE_ROWS), key=lambda t: abs(rings[t] - middle)):
                low, high = rings[t], rings[min(t + TILE_ROWS, len(b)) - 1]
                reach = self.reach(mine)
                active = mine[(mine_angle - reach <= high) & (mine_angle + reach >= low)]
                if len(active):
                    tile, none = b[t : t + TILE_ROWS], np.empty(0, np.int64)
                    self.compared += len(active) * len(tile)
                    _take_tile(self.lists, self.units, self.single, active, np.ones(len(active)), tile, ids[t : t + TILE_ROWS], self.decimals, none, none)

    def look_around(self, pivots: np.ndarray, radii: np.ndarray, pieces: list[list[list[str]]], span: int, spans: int) -> None:
        """All rows into their own cells, and then into every ``spans``-th of the pieces that they are open to."""
        angles = lambda rows, cell: _angles(self.units[rows], pivots[cell : cell + 1])[:, 0]
        for cell in np.unique(self.cells).tolist():
            rows = np.flatnonzero(self.cells == cell)
            for files in pieces[cell]:
                self.look(rows, angles(rows, cell), files)
        if spans > 1:  # the floors stay; every piece is some span's
            self.lists = Lists(len(self.ids), self.depth, self.lists.least)
        every, number = np.arange(len(self.ids)), 0
        for cell in range(len(pivots)):
            mine = [files for k, files in enumerate(pieces[cell], number) if k % spans == span]
            number += len(pieces[cell])
            if not mine:
                continue
            angle = angles(every, cell)
            rows = np.flatnonzero((angle - radii[cell] <= self.reach(every)) & ((self.cells != cell) | (spans > 1)))
            for files in mine if len(rows) else ():
                self.look(rows, angle[rows], files)


def cosine_top_n(left: DataFrame, right: DataFrame, n: int, decimals: int = 9, cells: int | None = None, counter=None) -> DataFrame:
    """(left_id, right_id, score, rank): the ``n`` other right rows of the highest cosine per left row, lower id first.

    Both sides have ``id`` (bigint) and ``vec`` (array, not all zeros); left rows are right rows as well. The number of
    pivots is the square root of that of the distinct vectors, with ``LEAST_CELL`` vectors to each and ``MOST_PIVOTS`` at most; they and the cells' radii go to
    all tasks. Larger cells are cut by hashing. Rows are dealt to parts in the order of their cells; if there are fewer parts than cores,
    several tasks share the cells of a part. Tasks read cells and rows with pyarrow from ``spark.checkpoint.dir``. The result is exact for any pivots; how much they save depends on how
    the vectors cluster. ``counter`` is an accumulator for the pairs compared.
    """
    check_n(n)
    spark, depth = right.sparkSession, n + 1
    sides = [s.select("id", F.col("vec").cast("array<float>").alias("vec")) for s in (left, right)]
    with scratch_tables(spark):
        rows = materialize(sides[1], "vectors")
        classes = materialize(rows.groupBy("vec").agg(F.min("id").alias("class")), "classes")
        counts = row_counts(rows, "vec")
        named = materialize(salted_join(rows, classes, "vec", counts, "__rows", "inner").select("id", "class"), "named")
        asked = materialize(named.join(sides[0].select("id").distinct(), "id", "left_semi"), "asked")
        total = classes.count()
        wanted = cells or min(MOST_PIVOTS, ceil(sqrt(total)), ceil(total / LEAST_CELL))
        drawn = classes.orderBy(F.xxhash64("class"), "class").limit(DRAWN_PER_PIVOT * wanted).toPandas()
        if drawn.empty:
            return spark.createDataFrame([], f"{BEST}, rank int")
        pivots = choose_pivots(_unit(_stacked(drawn["vec"])), wanted)
        shared = spark.sparkContext.broadcast(pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, ANGLES_AT_ONCE // len(shared.value))
                for rows in (batch.slice(lo, step) for lo in range(0, batch.num_rows, step)):
                    angles = _angles(_unit(rows.column(1).flatten().to_numpy().reshape(len(rows), -1)), shared.value)
                    cell = angles.argmin(axis=1)
                    columns = [*rows.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "cell", "angle"])

        named_classes = classes.where("class IS NOT NULL").select(F.col("class").alias("id"), "vec")
        placed = materialize(named_classes.mapInArrow(assign, PLACED), "placed")
        fit = max(1, BLOCK_BYTES // (4 * pivots.shape[1]))
        stats = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()}
        counted = [ceil(stats[c].n / min(fit, CELL_ROWS)) if c in stats else 1 for c in range(len(pivots))]
        radii = np.array([stats[c].r if c in stats else -4.0 for c in range(len(pivots))])
        of_cell = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
        piece = F.pmod(F.xxhash64("id"), of_cell(counted)).cast("int")
        blocks = materialize(placed.withColumn("piece", piece).repartition("cell", "piece"), "cells", folders=["cell", "piece"])
        found = files_by_folder(blocks, ["cell", "piece"])
        pieces = [[found[c, k] for k in range(counted[c]) if (c, k) in found] for c in range(len(pivots))]

        queries = placed.join(asked.select(F.col("class").alias("id")).distinct(), "id", "left_semi").select("id", "vec", "cell")
        queries = materialize(queries, "queries")
        sizes = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        wanted_n, cores = sum(sizes.values()), spark.sparkContext.defaultParallelism
        if not wanted_n:
            return spark.createDataFrame([], f"{BEST}, rank int")
        # As many parts as fill the cores evenly, unless these would be very small.
        most = min(fit, QUERY_ROWS)
        parts = max(ceil(wanted_n / most), min(cores * ceil(wanted_n / (cores * most)), ceil(wanted_n / LEAST_PART)))
        in_part, before = ceil(wanted_n / parts), 0
        starts = []
        for c in range(len(pivots)):
            starts.append(before)
            before += sizes.get(c, 0)
        place = of_cell(starts) + F.pmod(F.xxhash64("id", F.lit(1)), of_cell([sizes.get(c, 1) for c in range(len(pivots))]))
        dealt = queries.withColumn("part", F.floor(place / in_part).cast("int")).repartition("part")
        dealt = files_by_folder(materialize(dealt, "query-parts", folders=["part"]), ["part"])
        spans = min(sum(map(len, pieces)), ceil(cores / len(dealt)))
        tasks = [(files, span) for _, files in sorted(dealt.items()) for span in range(spans)]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    files, span = tasks[k]
                    rows = Part(files, depth, decimals)
                    rows.look_around(shared.value, radii, pieces, span, spans)
                    if counter is not None:
                        counter.add(rows.compared)
                    yield pa.RecordBatch.from_pandas(rows.lists.frame(rows.ids), FOUND, preserve_index=False)

        near = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(work, BEST)
        if spans > 1:
            near = top_n_per_key(near, "left_id", [F.desc("score"), F.asc("right_id")], depth).drop("rank")
        near = materialize(near, "near-classes")
        # A class stands for its members; of each, the lowest ids suffice.
        members = top_n_per_key(named, "class", [F.asc("id")], depth, "place").select(F.col("class").alias("right_id"), F.col("id").alias("member"))
        lists = near.join(members, "right_id").select("left_id", "member", "score")
        lists = materialize(top_n_per_key(lists, "left_id", [F.desc("score"), F.asc("member")], depth).drop("rank"), "class-lists")
        weights = row_counts(asked, "class")
        rows = salted_join(asked, lists.withColumnRenamed("left_id", "class"), "class", weights, "__rows", "inner")
        rows = rows.where(F.col("member") != F.col("id")).select(F.col("id").alias("left_id"), F.col("member").alias("right_id"), "score")
        result = top_n_per_key(rows, "left_id", [F.desc("score"), F.asc("right_id")], n)
        return materialize(result, "nearest", keep=True)
