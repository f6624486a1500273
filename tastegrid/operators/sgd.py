"""Biased matrix factorisation by stratified stochastic gradient descent, for many models in one pass.

Users and items are hashed into as many blocks each. A stratum is a set of blocks of ratings that share no user block and no
item block, so its blocks are worked on in parallel, each with the parameters of its users and items at hand; an epoch runs
through all strata, in an order drawn per epoch. Within a block the ratings have an order drawn from their ids. Ratings that
follow each other without a user or an item in common commute, so each gets a level, one more than the last level of its
user and its item, and a level is one step of array arithmetic. The result is that of plain descent, rating by rating.

Several models with the same number of factors lie side by side in a block's state, so one pass over a block's ratings serves
all of them; a model that leaves out a fold skips its ratings. Models that differ in the number of epochs only are one
model, looked at after each of these numbers.

A step's tasks read their two states and their ratings with pyarrow, and write each state to a file of its own, piece by piece; the
addresses of these files are the step's result, and the files of the step before are deleted. So nothing is shuffled between
steps, no state passes through Spark's rows, and a task holds its two states once. As the states are the larger part, a block's ratings are gone through several epochs in a row (see ``visits``), more of them at a low learning rate: every rating
is used once per epoch as before, in another order. Grids whose models fill the cores keep all ratings
of a model in one block as long as these are few enough; their states then start, learn and are judged in one task. Models side
by side leave out the same fold, so its ratings cost them nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.columns import MAX_RATING, MIN_RATING
from tastegrid.plans.spread import hashed_bits, hashed_normals
from tastegrid.sources.session import drop_folder, drop_table, files_by_folder, materialize, read_files, scratch_folder

# Ratings of a block when all blocks are alike (about as much work as starting a step), and bytes of the parameters that a task holds for one
# side of it, of one model or of several side by side.
RATINGS_PER_BLOCK, STATE_BYTES, MODELS_BYTES = 2_400_000, 256 << 20, 160 << 20
# Models that need no blocks to fill the cores, and the factor by which their blocks are longer.
MANY_MODELS, LONGER = 8, 2
# Beyond so many blocks a visit has half as many epochs as there are blocks, at least.
MOST_SINGLE = 3
# A low rate allows longer visits: as many epochs as this sum of rates, but no fewer than so many visits in a run.
RATE_PER_VISIT, LEAST_VISITS = 0.03, 4
# Numbers of a portion of a level that are worked on at a time: few enough to stay in a core's cache.
NUMBERS_AT_ONCE = 1 << 16
# Rows of a written table that leave a task at a time, and bytes of a row of a state.
ROWS_AT_ONCE, PIECE_BYTES = 1 << 14, 16 << 20
# Deviation of the first factors.
FIRST_SCALE = 0.1

STATE_KEYS = ["grp", "side", "block"]
# The files of states, as a step returns them.
FILES = pa.schema([*[(n, pa.int32()) for n in STATE_KEYS], ("file", pa.string())])
FILES_DDL = "grp int, side int, block int, file string"


@dataclass(frozen=True)
class Fit:
    """One model: its parameters, and the fold that it leaves out (None: it learns from all ratings)."""

    n_factors: int = 100
    lr_all: float = 0.005
    reg_all: float = 0.02
    random_state: int = 42
    fold: int | None = None
    use_bias: bool = True


@dataclass
class Group:
    """Models of one width that leave out the same fold, as arrays over the models."""

    number: int
    members: list[int]
    fits: list[Fit]
    means: list[float]

    def column(self, name: str) -> np.ndarray:
        return np.array([getattr(f, name) for f in self.fits], np.float32)

    @property
    def folds(self) -> np.ndarray:
        return np.array([-2 if f.fold is None else f.fold for f in self.fits], np.int64)  # rows without folds have -1


def block_count(ratings: int, largest_side: int, width: int, models: int = 1) -> int:
    """Blocks of a side: about ``RATINGS_PER_BLOCK`` ratings in each pair of blocks, states within ``STATE_BYTES``.

    ``MANY_MODELS`` are parallel without blocks, so theirs are longer.
    """
    most = RATINGS_PER_BLOCK * (LONGER if models >= MANY_MODELS else 1)
    return max(1, ceil(sqrt(ratings / most)), ceil(largest_side * 4 * (width + 2) / STATE_BYTES))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def visits(epochs: int, blocks: int, rate: float = 1.0) -> list[int]:
    """Epochs of each visit to a block, for models that learn at most at ``rate``."""
    most = 1 if blocks <= MOST_SINGLE else ceil(blocks / 2)
    if rate > 0:
        most = max(most, min(ceil(epochs / LEAST_VISITS), int(RATE_PER_VISIT / rate)))
    return [min(most, epochs - k) for k in range(0, epochs, most)]


def update_levels(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    """One more than the highest earlier level of the same user or item, along the given order."""
    a, b = (np.unique(x, return_inverse=True)[1].tolist() for x in (users, items))
    last_a, last_b = [0] * (max(a, default=0) + 1), [0] * (max(b, default=0) + 1)
    out = []
    for x, y in zip(a, b):
        level = max(last_a[x], last_b[y]) + 1
        last_a[x] = last_b[y] = level
        out.append(level)
    return np.array(out, np.int32)


def _levelled(seed: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        u, v, r = (rows[c].to_numpy() for c in ("u", "v", "r"))
        drawn = hashed_bits(u, seed) ^ hashed_bits(v, seed + 1)
        order = np.lexsort((r, v, u, drawn))
        rows = rows.select(["ub", "vb", "u", "v", "r", "fold"]).take(pa.array(order))
        return rows.append_column("level", pa.array(update_levels(u[order], v[order])))

    return run


def _arrays(state: dict, models: int, width: int) -> list[np.ndarray]:
    """Ids, offsets, factors and what has been seen, to be read only."""
    ids = np.frombuffer(state["ids"], np.int64)
    shapes = (("bias", np.float32, (len(ids), models)), ("vecs", np.float32, (len(ids), models, width)))
    floats = [np.frombuffer(state[n], t).reshape(s) for n, t, s in shapes]
    return [ids, *floats, np.frombuffer(state["seen"], np.bool_).reshape(len(ids), models)]


def _state(group: int, side: int, block: int, ids, bias, vecs, seen) -> dict:
    return {
        "grp": group, "side": side, "block": block, "ids": ids.astype(np.int64).tobytes(), "bias": bias.tobytes(),
        "vecs": vecs.tobytes(), "seen": seen.tobytes(),
    }


def _pieces(group: int, side: int, block: int, ids: np.ndarray, *arrays: np.ndarray) -> Iterator[dict]:
    """A state in rows of ``PIECE_BYTES``, so that nothing holds a whole one beside its arrays."""
    step = max(1, PIECE_BYTES * len(ids) // max(1, sum(x.nbytes for x in arrays)))
    for lo in range(0, len(ids), step):
        yield _state(group, side, block, ids[lo : lo + step], *(x[lo : lo + step] for x in arrays))


STATE_ARROW = pa.schema(
    [(n, pa.int32()) for n in ("grp", "side", "block")] + [(n, pa.binary()) for n in ("ids", "bias", "vecs", "seen")]
)


def write_state(folder: str, pieces: Iterator[dict], group: int, side: int, block: int) -> pa.RecordBatch:
    """Writes the pieces of a state to a new file in ``folder``; its address, as a row of ``FILES``."""
    name = f"{group}-{side}-{block}-{uuid.uuid4().hex}.parquet"  # an attempt of a task has a file of its own
    system, path = fs.FileSystem.from_uri(folder)
    options = {"compression": "none", "use_dictionary": False, "write_statistics": False}
    with system.open_output_stream(f"{path}/{name}") as out, pq.ParquetWriter(out, STATE_ARROW, **options) as writer:
        for piece in pieces:
            writer.write_table(pa.Table.from_pylist([piece], STATE_ARROW))
    return pa.RecordBatch.from_pylist([{"grp": group, "side": side, "block": block, "file": f"{folder}/{name}"}], FILES)


def _read_pieces(files: Sequence[str], names: Sequence[str]) -> Iterator[dict]:
    """The pieces of written states, a row group at a time; their bytes stay where Arrow holds them."""
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            table = pq.ParquetFile(file)
            for k in range(table.num_row_groups):
                rows = table.read_row_group(k, columns=list(names))
                for row in range(rows.num_rows):
                    yield {n: rows[n][row].as_buffer() for n in names}


def read_state(files: Sequence[str], models: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rising ids of a state, and its offsets, factors and what has been seen: every piece is read into its place."""
    ids = [np.frombuffer(piece["ids"], np.int64) for piece in _read_pieces(files, ["ids"])]
    order = sorted(range(len(ids)), key=lambda k: ids[k][0])
    starts = dict(zip(order, np.cumsum([0, *[len(ids[k]) for k in order]]).tolist()))
    every = np.concatenate([ids[k] for k in order]) if ids else np.empty(0, np.int64)
    shape = len(every), models
    out = [np.empty(shape, np.float32), np.empty((*shape, width), np.float32), np.empty(shape, np.bool_)]
    for k, piece in enumerate(_read_pieces(files, ["bias", "vecs", "seen"])):
        for name, array in zip(("bias", "vecs", "seen"), out):
            place = array[starts[k] : starts[k] + len(ids[k])]
            place[:] = np.frombuffer(piece[name], array.dtype).reshape(place.shape)
    return every, out


def _records(rows: np.ndarray) -> np.ndarray:
    """Rows as single values, which are fetched and put back faster than rows of numbers."""
    flat = rows.reshape(len(rows), -1)
    return flat.view(np.dtype((np.void, flat.itemsize * flat.shape[1]))).reshape(-1) if flat.shape[1] else flat


def descend(group: Group, sides: list, a, b, r, fold, level, repeat: int = 1) -> None:
    """Updates the two sides' arrays (bias, vecs, seen) in place, level by level, ``repeat`` times."""
    (pb, p, ps), (qb, q, qs) = sides
    models, width = p.shape[1:]
    mean = np.array(group.means, np.float32)
    lr, biased = group.column("lr_all"), group.column("use_bias")
    some_plain = not biased.all()
    use = fold != group.folds[0]
    if not use.all():
        a, b, r, level = a[use], b[use], r[use], level[use]
    # In a level any order gives the same; rising users are near each other in memory.
    order = np.lexsort((a, level))
    a, b, r = a[order].astype(np.intp), b[order].astype(np.intp), r[order].astype(np.float32)[:, None]
    ends = np.flatnonzero(np.diff(level[order], append=-1)) + 1
    step = max(1, NUMBERS_AT_ONCE // (models * max(1, width)))
    parts = [(i, min(i + step, hi)) for lo, hi in zip(np.append(0, ends[:-1]), ends) for i in range(lo, hi, step)]
    ps[a], qs[b] = True, True
    keep = (1.0 - lr * group.column("reg_all")).astype(np.float32)
    shrink = np.repeat(keep, width).reshape(models, width)
    # Room for a part, used again by the next one.
    room = [np.empty((step, models, width), np.float32) for _ in range(4)] + [np.empty((step, models), np.float32) for _ in range(2)]
    stored = [_records(x) for x in (p, q, pb, qb)]
    taken = [_records(room[k]) for k in (0, 1, 4, 5)]
    for _ in range(repeat):
        for lo, hi in parts:  # no user or item comes twice in a part
            places = a[lo:hi], b[lo:hi]
            for k in range(4):
                np.take(stored[k], places[k % 2], axis=0, out=taken[k][: hi - lo], mode="clip")
            pu, qi, to_q, to_p, bu, bi = (x[: hi - lo] for x in room)
            gain = r[lo:hi] - mean
            gain -= bu
            gain -= bi
            gain -= np.einsum("lmk,lmk->lm", pu, qi)
            gain *= lr
            for bias in (bu, bi):
                bias *= keep
                bias += gain
                if some_plain:
                    bias *= biased
            gain = gain[..., None]
            np.multiply(pu, gain, out=to_q)
            np.multiply(qi, gain, out=to_p)
            pu *= shrink
            pu += to_p
            qi *= shrink
            qi += to_q
            for k in range(4):
                stored[k][places[k % 2]] = taken[k][: hi - lo]


class Meeting:
    """The states of a user block and an item block, and their ratings, read where they were written.

    Without ``states`` these are the first ones, of all users and items that the ratings have.
    """

    def __init__(self, group: Group, blocks: tuple[int, int], states: list[list[str]] | None, ratings: list[str]):
        self.group, self.blocks = group, blocks
        shape = len(group.fits), group.fits[0].n_factors
        self.ids, self.sides = [None, None], [None, None]
        met = ratings and (states is None or all(states))
        self.rows = read_files(ratings, ["u", "v", "r", "fold", "level"]) if met else None
        for side in (0, 1):
            if states is None and met:
                self.ids[side] = np.unique(self.rows["uv"[side]].to_numpy())
                self.sides[side] = first_side(group, side, self.ids[side])
            elif states and states[side]:
                self.ids[side], self.sides[side] = read_state(states[side], *shape)

    def ratings(self) -> tuple:
        """Places of the users and items, ratings, folds and levels."""
        u, v, r, fold, level = (self.rows[c].to_numpy() for c in ("u", "v", "r", "fold", "level"))
        a, b = np.searchsorted(self.ids[0], u), np.searchsorted(self.ids[1], v)
        return a.astype(np.int32), b.astype(np.int32), r, fold, level


def _learn(repeat: int, folder: str) -> Callable:
    def run(met: Meeting) -> Iterator[pa.RecordBatch]:
        if met.rows is not None:
            descend(met.group, met.sides, *met.ratings(), repeat)
        for side in (0, 1):
            if met.ids[side] is not None:
                place = met.group.number, side, met.blocks[side]
                yield write_state(folder, _pieces(*place, met.ids[side], *met.sides[side]), *place)
                met.sides[side] = None

    return run


def judge(group: Group, sides: list, a, b, r, fold) -> list[tuple]:
    """(fit, squared errors, absolute errors, ratings) over the ratings of a model's own fold."""
    (pb, p, ps), (qb, q, qs) = sides
    out = []
    for f in np.unique(group.folds):
        mine, at = np.flatnonzero(group.folds == f), np.flatnonzero(fold == f)
        mean = np.array(group.means, np.float64)[mine]
        step = max(1, NUMBERS_AT_ONCE // (len(mine) * max(1, p.shape[2])))
        sums = np.zeros((2, len(mine)))
        for i in range(0, len(at), step):
            k = at[i : i + step]
            x, y = a[k], b[k]
            known = ps[x][:, mine] & qs[y][:, mine]
            dots = np.einsum("lmk,lmk->lm", p[x][:, mine], q[y][:, mine]) * known
            guess = mean + pb[x][:, mine] + qb[y][:, mine] + dots
            miss = np.clip(guess, MIN_RATING, MAX_RATING) - r[k, None]
            sums += (miss**2).sum(0), np.abs(miss).sum(0)
        out += [(group.members[m], *sums[:, j], len(at)) for j, m in enumerate(mine)]
    return out


def first_side(group: Group, side: int, ids: np.ndarray) -> list[np.ndarray]:
    """Offsets, factors and what has been seen, before the first epoch."""
    fits, width = group.fits, group.fits[0].n_factors
    shape = (len(ids), len(fits))
    out = np.empty((*shape, width), np.float32)
    step = max(1, NUMBERS_AT_ONCE // max(1, width))
    for lo in range(0, len(ids), step):
        some = slice(lo, lo + step)
        vecs = {s: FIRST_SCALE * hashed_normals(ids[some], width, 2 * s + side) for s in {f.random_state for f in fits}}
        for k, f in enumerate(fits):
            out[some, k] = vecs[f.random_state]
    return [np.zeros(shape, np.float32), out, np.zeros(shape, np.bool_)]


LEARNED = pa.schema([("epochs", pa.int32()), ("fit", pa.int32()), ("se", pa.float64()), ("ae", pa.float64()), ("n", pa.int64())])


def _learn_judged(numbers: Sequence[int]) -> Callable:
    """The errors of a group after each of these numbers of epochs, from its first state on."""

    def run(met: Meeting) -> Iterator[pa.RecordBatch]:
        if met.rows is None:
            return
        done, (*places, level) = 0, met.ratings()
        met.rows = None
        for number in numbers:
            descend(met.group, met.sides, *places, level, number - done)
            done = number
            for found in judge(met.group, met.sides, *places):
                yield pa.RecordBatch.from_pylist([dict(zip(LEARNED.names, (number, *found)))], LEARNED)

    return run


SCORES = pa.schema([("fit", pa.int32()), ("se", pa.float64()), ("ae", pa.float64()), ("n", pa.int64())])


def _judge(met: Meeting) -> Iterator[pa.RecordBatch]:
    """Sums of errors over the ratings of a model's own fold."""
    if met.rows is not None:
        *places, _ = met.ratings()
        for found in judge(met.group, met.sides, *places):
            yield pa.RecordBatch.from_pylist([dict(zip(SCORES.names, found))], SCORES)


class Descent:
    """The ratings in blocks, the models in groups, and the states of both sides after some epochs.

    ``ratings`` has userId, movieId, rating and, if a fit leaves out a fold, an integer ``fold``; rows that lack one are left
    out. Blocks, orders and first factors depend on ids and seeds only: any partitioning of the input gives the same model.
    """

    def __init__(self, ratings: DataFrame, fits: Sequence[Fit], seed: int = 42, blocks: int | None = None):
        spark = self.spark = ratings.sparkSession
        self.fits, self.seed = list(fits), seed
        fold = F.col("fold").cast("int") if "fold" in ratings.columns else F.lit(-1)
        rows = ratings.select(
            F.col("userId").cast("bigint").alias("u"),
            F.col("movieId").cast("bigint").alias("v"),
            F.col("rating").cast("double").alias("r"),
            fold.alias("fold"),
        ).dropna()
        rows = materialize(rows, "rated")
        ids = [rows.select(F.col(c).alias("id")).distinct() for c in "uv"]
        ids = materialize(ids[0].withColumn("side", F.lit(0)).unionByName(ids[1].withColumn("side", F.lit(1))), "ids")
        sizes = {r.side: r.n for r in ids.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
        # One row per fold: the means of what each model learns from.
        sums = rows.groupBy("fold").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        total = sum(r.n for r in sums)
        self.means = []
        for f in self.fits:
            used = [r for r in sorted(sums, key=lambda r: r.fold) if f.fold is None or r.fold != f.fold]
            self.means.append(sum(r.s for r in used) / n if (n := sum(r.n for r in used)) else 0.0)
        widest = max(f.n_factors for f in self.fits)
        # A task holds a block of either side, so a long side may have more room where the other one is short.
        side = ceil((sum(sizes.values()) or 1) / 2)
        self.blocks = blocks or block_count(total, side, widest, len(self.fits))
        self.groups = self._grouped(ceil(max(sizes.values(), default=1) / self.blocks))
        self.rows = self._blocked(rows)
        self.places = files_by_folder(self.rows, ["ub", "vb"])
        self.ids, self._drawn, self._folder = ids, None, None
        self.epoch = 0

    @property
    def states(self) -> dict[tuple, list[str]]:
        """The files of the states by group, side and block; the first ones are drawn when they are asked for."""
        if self._drawn is None:
            self._store(self._first)
        return {k: read_files(found, ["file"])["file"].to_pylist() for k, found in files_by_folder(self._drawn, STATE_KEYS).items()}

    def _store(self, step: Callable[[str], DataFrame]) -> None:
        """Runs a step, whose tasks write states to the folder it is given, and deletes the states before it."""
        folder = scratch_folder(self.spark, "state-files")
        made = step(folder)  # may store the first states
        before = self._drawn, self._folder
        self._drawn, self._folder = materialize(made, "states", folders=STATE_KEYS), folder
        if before[0] is not None:
            drop_table(before[0])
            drop_folder(self.spark, before[1])

    def _grouped(self, ids_per_block: int) -> list[Group]:
        """Models of equal width that leave out the same fold, as many together as ``MODELS_BYTES`` hold; few models are spread over the cores."""
        cores = self.spark.sparkContext.defaultParallelism
        per_core = ceil(len(self.fits) * self.blocks / (2 * cores))
        kinds: dict[tuple, list[int]] = {}
        for i, f in enumerate(self.fits):
            kinds.setdefault((-f.n_factors, -1 if f.fold is None else f.fold), []).append(i)
        groups: list[Group] = []
        for width, fold in sorted(kinds):  # the longest tasks begin first
            mine = kinds[width, fold]
            most = max(1, min(MODELS_BYTES // (4 * (2 - width) * ids_per_block), per_core))
            each = ceil(len(mine) / ceil(len(mine) / most))
            for k in range(0, len(mine), each):
                members = mine[k : k + each]
                groups.append(
                    Group(len(groups), members, [self.fits[i] for i in members], [self.means[i] for i in members])
                )
        return groups

    def _blocked(self, rows: DataFrame) -> DataFrame:
        """Ratings with the level of their update, in a folder per pair of blocks."""
        block = lambda c: block_of(c, self.blocks)
        rows = rows.select(block("u").alias("ub"), block("v").alias("vb"), "u", "v", "r", "fold")
        schema = "ub int, vb int, u long, v long, r double, fold int, level int"
        levelled = rows.groupBy("ub", "vb").applyInArrow(_levelled(self.seed), schema)
        return materialize(levelled, "blocks", folders=["ub", "vb"])

    def _tasks(self, tasks: list, work: Callable, schema: str) -> DataFrame:
        """What ``work`` yields for each of these, in a Spark task of its own."""

        def run(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from work(*tasks[k])

        return self.spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)

    def _first(self, folder: str) -> DataFrame:
        """The first states, drawn piece by piece."""
        placed = self.ids.select("id", "side", block_of("id", self.blocks).alias("block"))
        placed = materialize(placed.repartition("side", "block"), "block-ids", folders=["side", "block"])
        found = files_by_folder(placed, ["side", "block"])

        def work(group: Group, side: int, block: int, files: list[str]) -> Iterator[pa.RecordBatch]:
            ids, place = np.sort(read_files(files, ["id"])["id"].to_numpy()), (group.number, side, block)
            step = max(1, PIECE_BYTES // (4 * len(group.fits) * (group.fits[0].n_factors + 2)))
            parts = (ids[lo : lo + step] for lo in range(0, len(ids), step))
            yield write_state(folder, (_state(*place, part, *first_side(group, side, part)) for part in parts), *place)

        tasks = [(g, side, block, files) for g in self.groups for (side, block), files in sorted(found.items())]
        return self._tasks(tasks, work, FILES_DDL)

    def scores_after(self, numbers: Sequence[int]) -> dict[int, dict[int, tuple[float, float, int]]]:
        """``scores`` after each of these numbers of epochs, of models whose ratings are one block; no state leaves its task."""
        if self.blocks != 1 or self.epoch:
            raise ValueError("needs one block, before the first epoch")
        found = self._met(0, _learn_judged(numbers), "epochs int, fit int, se double, ae double, n long", first=True)
        out = {n: {} for n in numbers}
        for r in found.where("n > 0").collect():
            out[r.epochs][r.fit] = sqrt(r.se / r.n), r.ae / r.n, r.n
        return out

    def _met(self, stratum: int, work: Callable, schema: str, first: bool = False) -> DataFrame:
        """``work`` over the blocks of a stratum; with ``first`` their states are the first ones, which the task draws itself."""
        states, tasks = None if first else self.states, []
        for g in self.groups:
            for ub in range(self.blocks):
                blocks = ub, (ub + stratum) % self.blocks
                mine = None if first else [states.get((g.number, side, block), []) for side, block in enumerate(blocks)]
                tasks.append((g, blocks, mine, self.places.get(blocks, [])))
        return self._tasks(tasks, lambda *met: work(Meeting(*met)), schema)

    def run(self, epochs: int) -> None:
        """Goes on for ``epochs`` epochs (see ``visits``)."""
        if self.blocks == 1:
            first = self._drawn is None  # one block has all ratings, and so all users and items
            self._store(lambda folder: self._met(0, _learn(epochs, folder), FILES_DDL, first))
            self.epoch += epochs
            return
        rate = max((f.lr_all for g in self.groups for f in g.fits), default=1.0)
        for repeat in visits(epochs, self.blocks, rate):
            for stratum in np.random.default_rng([self.seed, self.epoch]).permutation(self.blocks).tolist():
                self._store(lambda folder: self._met(stratum, _learn(repeat, folder), FILES_DDL))
            self.epoch += repeat

    def scores(self) -> dict[int, tuple[float, float, int]]:
        """(rmse, mae, n) per fit that leaves out a fold, over that fold's ratings: one row per fit for the driver."""
        parts = [self._met(s, _judge, "fit int, se double, ae double, n long") for s in range(self.blocks)]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        sums = every.groupBy("fit").agg(*[F.sum(c).alias(c) for c in ("se", "ae", "n")]).where("n > 0").collect()
        return {r.fit: (sqrt(r.se / r.n), r.ae / r.n, r.n) for r in sums}

    def keep(self, fits: set[int]) -> None:
        """Goes on with some of the models only."""
        chosen = {g.number: [k for k, m in enumerate(g.members) if m in fits] for g in self.groups}

        def kept(folder: str) -> DataFrame:
            def work(group: Group, side: int, block: int, files: list[str]) -> Iterator[pa.RecordBatch]:
                place, shape, take = (group.number, side, block), (len(group.fits), group.fits[0].n_factors), chosen[group.number]
                every = (_arrays(piece, *shape) for piece in _read_pieces(files, ["ids", "bias", "vecs", "seen"]))
                pieces = (_state(*place, ids, *(np.ascontiguousarray(x[:, take]) for x in parts)) for ids, *parts in every)
                yield write_state(folder, pieces, *place)

            groups = {g.number: g for g in self.groups if chosen[g.number]}
            tasks = [(groups[g], side, block, files) for (g, side, block), files in sorted(self.states.items()) if g in groups]
            return self._tasks(tasks, work, FILES_DDL)

        self._store(kept)
        self.groups = [
            Group(g.number, *([x[k] for k in chosen[g.number]] for x in (g.members, g.fits, g.means)))
            for g in self.groups
            if chosen[g.number]
        ]

    def table(self, fit: int, side: int, key: str, bias: str) -> DataFrame:
        """(key, bias, features, block) of one fit and side, for the ids that it learned from; not written yet."""
        group = next(g for g in self.groups if fit in g.members)
        at, shape = group.members.index(fit), (len(group.fits), group.fits[0].n_factors)
        schema = pa.schema([(key, pa.int64()), (bias, pa.float64()), ("features", pa.list_(pa.float32())), ("block", pa.int32())])

        def work(block: int, files: list[str]) -> Iterator[pa.RecordBatch]:
            for piece in _read_pieces(files, ["ids", "bias", "vecs", "seen"]):
                ids, biases, vecs, seen = _arrays(piece, *shape)
                use = np.flatnonzero(seen[:, at])
                for some in (use[lo : lo + ROWS_AT_ONCE] for lo in range(0, len(use), ROWS_AT_ONCE)):
                    flat = pa.array(np.ascontiguousarray(vecs[some, at]).reshape(-1))
                    lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * shape[1], flat)
                    values = [pa.array(ids[some]), pa.array(biases[some, at].astype(np.float64)), lists]
                    blocks = pa.array(np.full(len(some), block, np.int32))
                    yield pa.RecordBatch.from_arrays([*values, blocks], schema=schema)

        mine = [(block, files) for (grp, s, block), files in sorted(self.states.items()) if (grp, s) == (group.number, side)]
        return self._tasks(mine, work, f"{key} long, {bias} double, features array<float>, block int")
