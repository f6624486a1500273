"""Alternating least squares whose normal equations are summed over parts of a key's ratings.

Each side's ratings lie in blocks by their key; those of a key with more than a fair share of a block's ratings are dealt
over further blocks by a hash of the other key, so that all blocks are of one size. A half-step writes each solved vector
once, to a table in the shared folder; the tasks of the next one read that table and keep the vectors that their block
rates, so no vector travels once per block. Of a divided key a block returns the part's Gram matrix and right side; these are
added up per key, and the sum is solved. A key with fewer ratings than factors is solved in the space of its ratings, which
gives the same vector with a smaller matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.plans.spread import hashed_normals, label_of, slot_labels
from tastegrid.sources.session import drop_table, materialize

# Ratings of a block, and the fewest blocks. A task holds the vectors of a block's ratings at most.
RATINGS_PER_BLOCK, LEAST_BLOCKS = 1_500_000, 8
# A key with more ratings than this share of a block is divided into parts of that size.
PART_SHARE = 1 / 8
# Up to this width the systems of all keys of a block are summed and solved together.
NARROW = 2

# A block's ratings: its keys, their numbers of ratings and which are divided; the others' ids, and per rating the place
# of its other id and its value. Solved vectors, and what is known of a divided key.
BLOCK = "keys binary, counts binary, parted binary, others binary, places binary, r binary"
SOLVED = "ids binary, vecs binary, id long, gram binary, right binary, n long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


SOLVED_ARROW = _arrow(SOLVED)


def block_count(ratings: int) -> int:
    return max(LEAST_BLOCKS, ceil(ratings / RATINGS_PER_BLOCK))


def parts_of_keys(rows: DataFrame, key: str, blocks: int, ratings: int) -> DataFrame:
    """(key, parts) of the keys that are divided: at most blocks / PART_SHARE of them, so they may be broadcast."""
    fair = max(1, int(ratings / blocks * PART_SHARE))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fair)
    return counts.select(key, F.least(F.ceil(F.col("n") / fair), F.lit(blocks)).cast("int").alias("parts"))


def placed(rows: DataFrame, key: str, other: str, parts: DataFrame, blocks: int) -> DataFrame:
    """Adds the block of a rating on the side of ``key``, and whether the key is divided."""
    joined = rows.join(F.broadcast(parts), key, "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(other, F.lit(key)), F.col("parts"))).otherwise(0)
    place = F.pmod(F.xxhash64(key) + part, F.lit(blocks)).cast("int")
    return joined.withColumn(f"{key}_block", place).withColumn(f"{key}_parted", F.col("parts").isNotNull()).drop("parts")


def solve_key(vecs: np.ndarray, values: np.ndarray, reg: float) -> np.ndarray:
    """The ridge solution over all ratings of a key; the weight of the ridge grows with their number."""
    n, width = vecs.shape
    if n < width:
        inner = vecs @ vecs.T
        inner.flat[:: n + 1] += reg * n
        return vecs.T @ np.linalg.solve(inner, values)
    gram = vecs.T @ vecs
    gram.flat[:: width + 1] += reg * n
    return np.linalg.solve(gram, vecs.T @ values)


def solve_narrow(vecs: np.ndarray, values: np.ndarray, starts: np.ndarray, counts: np.ndarray, reg: float) -> np.ndarray:
    """``solve_key`` for many keys, whose ratings begin at ``starts``: sums of products, solved together."""
    width = vecs.shape[1]
    gram = np.add.reduceat(vecs[:, :, None] * vecs[:, None, :], starts)
    gram[:, np.arange(width), np.arange(width)] += reg * counts[:, None]
    right = np.add.reduceat(vecs * values[:, None], starts)
    return np.linalg.solve(gram, right[..., None])[..., 0]


def _solved(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SOLVED_ARROW)


def _packed(key: str, other: str):
    def run(rows: pa.Table) -> pa.Table:
        x, y, r, parted = (rows[c].to_numpy() for c in (key, other, "r", f"{key}_parted"))
        order = np.lexsort((r, y, x))
        x, y, r, parted = x[order], y[order], r[order], parted[order]
        starts = np.flatnonzero(np.diff(x, prepend=x[0] - 1))
        others, places = np.unique(y, return_inverse=True)
        arrays = (x[starts], np.diff(np.append(starts, len(x))), parted[starts], others, places.astype(np.int32), r)
        return pa.Table.from_pylist([dict(zip(_arrow(BLOCK).names, (a.tobytes() for a in arrays)))], _arrow(BLOCK))

    return run


def written_vectors(files: Iterable[str], ids: np.ndarray, width: int) -> np.ndarray:
    """The vectors of sorted ``ids`` from a written table of ``SOLVED`` rows, row by row of it."""
    vecs = np.zeros((len(ids), width), np.float32)
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            table = pq.ParquetFile(file)
            for group in range(table.num_row_groups):
                rows = table.read_row_group(group, columns=["ids", "vecs"])
                for k in range(rows.num_rows):
                    if not rows["vecs"][k].is_valid:
                        continue
                    found = np.frombuffer(rows["ids"][k].as_buffer(), np.int64)
                    at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
                    mine = np.flatnonzero(ids[at] == found)
                    vecs[at[mine]] = np.frombuffer(rows["vecs"][k].as_buffer(), np.float32).reshape(-1, width)[mine]
    return vecs


def _half_step(width: int, reg: float, files: list[str], first_seed: int | None) -> Callable:
    """Solves the keys of blocks from the vectors of the others; with ``first_seed`` those are drawn by hashing."""
    kinds = (np.int64, np.int64, np.bool_, np.int64, np.int32, np.float64)

    def solve(block: pa.RecordBatch, row: int) -> pa.RecordBatch:
        keys, counts, parted, others, places, r = (np.frombuffer(block[n][row].as_buffer(), t) for n, t in enumerate(kinds))
        vecs = written_vectors(files, others, width) if first_seed is None else first_vectors(others, width, first_seed)
        bounds = np.append(0, counts.cumsum())
        solved, out = np.zeros((len(keys), width), np.float32), []
        for k in np.flatnonzero(parted).tolist():
            part = slice(bounds[k], bounds[k + 1])
            mine, value = vecs[places[part]].astype(np.float64), r[part]
            gram, right = (mine.T @ mine).tobytes(), (mine.T @ value).tobytes()
            out.append({"id": int(keys[k]), "gram": gram, "right": right, "n": int(counts[k])})
        if width <= NARROW:
            solved[:] = solve_narrow(vecs[places].astype(np.float64), r, bounds[:-1], counts, reg)
        else:
            for k in np.flatnonzero(~parted).tolist():
                part = slice(bounds[k], bounds[k + 1])
                solved[k] = solve_key(vecs[places[part]].astype(np.float64), r[part], reg)
        out.append({"ids": keys[~parted].tobytes(), "vecs": solved[~parted].tobytes()})
        return _solved(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield solve(batch, row)

    return run


def first_vectors(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    vecs = hashed_normals(ids, width, seed).astype(np.float64)
    return (vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _added_up(width: int, reg: float) -> Callable:
    """Solves a divided key from the sums of its parts, in the order of their contents."""

    def run(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.select(["id", "gram", "right", "n"]).to_pylist(), key=lambda p: (p["n"], p["right"]))
        gram = sum(np.frombuffer(p["gram"]).reshape(width, width) for p in rows).copy()
        right = sum(np.frombuffer(p["right"]) for p in rows)
        gram.flat[:: width + 1] += reg * sum(p["n"] for p in rows)
        vec = np.linalg.solve(gram, right).astype(np.float32).tobytes()
        ids = np.array([rows[0]["id"]], np.int64).tobytes()
        return pa.Table.from_pylist([{"ids": ids, "vecs": vec}], SOLVED_ARROW)

    return run


def fit_als(pairs: DataFrame, width: int, epochs: int, reg: float, seed: int, blocks: int | None = None):
    """(user table, item table) of (id, features) from (userId, movieId, rest), a row per pair.

    In every epoch the items are solved first and then the users, as a ridge regression with weight ``reg`` times the number
    of ratings. First user vectors are drawn by hashing ids, so the result depends on the values only, but for the
    order of sums over the parts of divided keys. Tasks read the vectors of the step before from the shared folder, whose
    address must be one that pyarrow knows (a path, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
    """
    spark = pairs.sparkSession
    rows = pairs.select(
        F.col("userId").cast("bigint").alias("u"), F.col("movieId").cast("bigint").alias("v"), F.col("rest").cast("double").alias("r")
    ).dropna()
    rows = materialize(rows, "als-pairs")
    total = rows.count()
    blocks = blocks or block_count(total)
    labels = slot_labels(spark, blocks)
    sides, divided = {}, {}
    for key, other in (("v", "u"), ("u", "v")):
        parts = materialize(parts_of_keys(rows.select("u", "v"), key, blocks, total), "parts")
        divided[key] = not parts.isEmpty()
        side = placed(rows, key, other, parts, blocks)
        side = side.select(label_of(F.col(f"{key}_block"), labels).alias("slot"), "u", "v", "r", f"{key}_parted")
        packed = side.repartition(blocks, "slot").groupBy("slot").applyInArrow(_packed(key, other), BLOCK)
        sides[key] = materialize(packed, f"als-{key}")
    written: dict[str, list[DataFrame]] = {"u": [], "v": []}
    drawn = seed
    for _ in range(epochs):
        for key, other in (("v", "u"), ("u", "v")):
            files = [file for table in written[other] for file in table.inputFiles()]
            step = _half_step(width, reg, files, drawn)
            drawn = None
            for table in written[key]:
                drop_table(table)
            found = materialize(sides[key].mapInArrow(step, SOLVED), "vectors")
            written[key] = [found]
            if divided[key]:
                summed = found.where("gram IS NOT NULL").groupBy("id").applyInArrow(_added_up(width, reg), SOLVED)
                written[key].append(materialize(summed, "summed"))
    return tuple(vectors(written[key], width) for key in "uv")


def vectors(tables: list[DataFrame], width: int) -> DataFrame:
    """(id, features) of all vectors in the tables of a half-step."""
    schema = pa.schema([("id", pa.int64()), ("features", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            for ids, vecs in zip(*(batch.column(k).to_pylist() for k in range(2))):
                flat = np.frombuffer(vecs, np.float32)
                places = np.arange(len(flat) // width + 1, dtype=np.int32) * width
                lists = pa.ListArray.from_arrays(places, pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), lists], schema=schema)

    every = tables[0].select("ids", "vecs")
    for table in tables[1:]:
        every = every.unionByName(table.select("ids", "vecs"))
    return every.where("vecs IS NOT NULL").mapInArrow(run, "id long, features array<float>")
