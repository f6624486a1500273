"""Near-duplicate documents by SimHash fingerprints and tiled exact comparison.

Fingerprints fall into tiles by the population counts of their eight bytes. Two fingerprints that differ in
at most r bits have population counts that differ by at most r in sum, so a tile meets only the tiles within
that distance; all other tile pairs are skipped. Within tile pairs, numpy compares by exclusive-or and bit
count, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import column_values, only_kept, text_of
from tastegrid.llm.components import connected, forest
from tastegrid.sources.session import materialize, scratch_tables

SEED = 42
WORDS = 3
MAX_BITS = 2
# Fingerprints of one tile that are compared in one piece; a larger tile is cut by a hash.
TILE_ROWS = 4096
# Pairs compared at a time, and links held before they are thinned to a forest.
PAIRS_AT_ONCE = 1 << 20
LINKS_HELD = 1 << 19
# Shingle hashes gathered before their bits are counted.
HASHES_AT_ONCE = 1 << 17

# For each byte, its eight bits as the eight bytes of an integer: sums of up to 255 of them count bits.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of all ``words``-word shingles of a text, repeats included; a shorter text is one shingle."""
    w = text.lower().split()
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else []
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(words))))]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``sizes`` hashes: the bits set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes[full])])
    parts = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(parts)])
    piece = np.arange(first[-1]) - np.repeat(first[:-1], parts)
    cuts = np.repeat(starts[:-1], parts) + 255 * piece
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    counts = np.add.reduceat(counts, first[:-1], axis=0)
    bits = (2 * counts > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(texts: Iterator[bytes], words: int) -> Iterator[int]:
    """Fingerprints in the order of the texts, as signed 64-bit integers."""
    hashes: list[int] = []
    sizes: list[int] = []

    def flush():
        made = majority(np.array(hashes, np.uint64), np.array(sizes, np.int64)).view(np.int64).tolist()
        hashes.clear()
        sizes.clear()
        return made

    for text in texts:
        new = shingle_hashes(text, words)
        hashes += new
        sizes.append(len(new))
        if len(hashes) > HASHES_AT_ONCE:
            yield from flush()
    yield from flush()


def fingerprint_table(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp): the id, a hash of the text, and the fingerprint of every row, from whole texts."""
    source = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_of(text_col)).alias("h"),
        text_of(text_col).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(fingerprints(column_values(batch, "text"), words), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["id", "h", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, h long, fp long")


def near_steps(radius: int) -> list[int]:
    """Steps from a tile to the tiles within ``radius``, one of each pair of opposite steps.

    A tile key holds the eight population counts, four bits each, raised by the radius so that no step
    borrows from the next count.
    """
    steps = (d for d in product(range(-radius, radius + 1), repeat=8) if 0 < sum(map(abs, d)) <= radius)
    half = (d for d in steps if next(x for x in d if x) > 0)
    return [sum(x << (4 * i) for i, x in enumerate(d)) for d in half]


def tile_key(fp: Column, radius: int) -> Column:
    counts = (
        F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))).cast("long") + radius, 4 * i)
        for i in range(8)
    )
    return sum(counts, F.lit(0).cast("long"))


def links(fps: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints within ``radius`` bits.

    They join whatever any two close fingerprints join, but dense groups are thinned to a forest inside
    each task: links number at most one per fingerprint and task. ``fps`` has distinct ``fp``.

    A fingerprint is home in its own tile and a guest in the tiles half-way around (72 for two bits), so a
    pair meets once. A tile with more than ``TILE_ROWS`` homes is cut into parts by a hash; its guests visit
    all parts, and its homes are guests of the later parts.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the radius is 0 to 3 bits")
    homes = fps.select(tile_key(F.col("fp"), radius).alias("tile"), "fp")
    parts = F.ceil(F.col("count") / TILE_ROWS).cast("int")
    large = homes.groupBy("tile").count().where(F.col("count") > TILE_ROWS)
    large = materialize(large.select("tile", parts.alias("parts")), "tiles")
    steps = F.array(*[F.lit(s).cast("long") for s in [0, *near_steps(radius)]])
    placed = (
        homes.withColumn("step", F.explode(steps))
        .select((F.col("tile") + F.col("step")).alias("tile"), "fp", (F.col("step") != 0).alias("guest"))
        .join(large, "tile", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.when(F.col("guest"), 0).otherwise(F.col("own")), F.col("parts") - 1)))
        .select("tile", "part", (F.col("guest") | (F.col("part") != F.col("own"))).alias("guest"), "fp")
    )
    dealt = placed.repartition("tile", "part").sortWithinPartitions("tile", "part", "guest")
    return dealt.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Compare each row with the homes before it in its tile part. Rows come sorted, homes first."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    run, homes = None, np.zeros(0, np.int64)  # the open tile part and its homes so far
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, part, guest, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        starts = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (part[1:] != part[:-1])]))
        old = homes if run == (tile[0], part[0]) else homes[:0]
        values = np.concatenate([old, fp])
        base = starts + len(old)
        base[0] = 0
        run_of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(fp)]])))
        home = np.concatenate([np.ones(len(old), np.int64), (~guest).astype(np.int64)])
        before = np.concatenate([[0], np.cumsum(home)])
        mates = before[len(old) : -1] - before[base][run_of]  # homes before each new row in its part
        rows = np.arange(len(fp)) + len(old)
        for left, right in _pairs(base[run_of], mates, rows):
            # unsigned, as numpy counts the bits of absolute values
            near = np.bitwise_count((values[left] ^ values[right]).view(np.uint64)) <= radius
            if near.any():
                found.append((values[left[near]], values[right[near]]))
                held += int(near.sum())
        if held > LINKS_HELD:
            found = [forest(*map(np.concatenate, zip(*found)))]
            held = len(found[0][0])
            if held > LINKS_HELD // 2:
                yield _link_batch(*found[0])
                found, held = [], 0
        run = (tile[-1], part[-1])
        last = values[base[-1] :]
        homes = last[home[base[-1] :] == 1]
    if found:
        yield _link_batch(*forest(*map(np.concatenate, zip(*found))))


def _pairs(first: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(mate, row) for the ``counts`` mates from ``first`` on of each row, some pairs at a time."""
    some = np.flatnonzero(counts)
    first, counts, rows = first[some], counts[some], rows[some]
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        n = counts[at:to]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(first[at:to], n) + inside, np.repeat(rows[at:to], n)
        at = to


def _link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _groups(table: DataFrame, radius: int) -> DataFrame:
    """(fp, least): for each distinct fingerprint the first (id, h) of its component, null ids last."""
    with scratch_tables(table.sparkSession):
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("least")
        own = materialize(table.groupBy("fp").agg(first), "fingerprints")
        roots = connected(links(own.select("fp"), radius), "a", "b")
        linked = roots.join(own, roots["node"] == own["fp"]).select("root", "least")
        least = linked.groupBy("root").agg(F.min("least").alias("least"))
        moved = roots.join(materialize(least, "least"), "root").select(F.col("node").alias("fp"), F.col("least").alias("moved"))
        grouped = own.join(materialize(moved, "moved"), "fp", "left")
        return materialize(grouped.select("fp", F.coalesce("moved", "least").alias("least")), "groups", keep=True)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, radius: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    The component is named by its smallest id. Links are exact: all pairs of fingerprints within ``radius``
    bits. Null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than
    a shingle is one shingle. Repeated rows each get a row. A null id takes part and never names a component
    that has another id; a component of null ids only has a null name. Other columns are not read.
    """
    table = materialize(fingerprint_table(docs, words, id_col, text_col), "simhash")
    return table.join(_groups(table, radius), "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.id").alias("component_id"),
    )


def keep_one(
    docs: DataFrame, words: int = WORDS, radius: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each component: the one of the smallest id.

    Rows that share id and text are one document, of which one row stays. Null ids come last.
    """
    table = materialize(fingerprint_table(docs, words, id_col, text_col), "simhash")
    kept = _groups(table, radius).select("least.id", "least.h").distinct()
    return only_kept(docs, materialize(kept, "kept"), id_col, text_col)
