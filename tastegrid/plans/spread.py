"""Keys that fill a number of partitions alike, and numbers drawn by hashing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Beyond so many slots their hashes fill the partitions well enough.
MOST_LABELS = 4096


def slot_labels(spark: SparkSession, slots: int) -> list[int]:
    """A label per slot; ``repartition(slots, label)`` puts every slot into a partition of its own."""
    if slots > MOST_LABELS:
        return list(range(slots))
    labels = spark.range(0, 64 * slots + 64, 1, 1)
    found = labels.groupBy(F.pmod(F.hash("id"), F.lit(slots)).alias("p")).agg(F.min("id").alias("label")).collect()
    if len(found) < slots:
        return list(range(slots))
    return [r.label for r in sorted(found, key=lambda r: r.p)]


def label_of(slot: Column, labels: Sequence[int]) -> Column:
    """The label of a slot number, as a bigint."""
    if list(labels) == list(range(len(labels))):
        return slot.cast("bigint")
    return F.element_at(F.array(*[F.lit(x).cast("bigint") for x in labels]), (slot + 1).cast("int"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of ``x`` (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_bits(ids: np.ndarray, seed: int) -> np.ndarray:
    """64 bits per id, the same wherever and however often they are drawn."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    return _mixed(_mixed(ids.astype(np.int64).view(np.uint64) + start) + np.uint64(0x9E3779B97F4A7C15))


def hashed_normals(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """(ids, width) standard normals in single precision; a column does not depend on the width."""
    step = (np.arange(width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    bits = _mixed(hashed_bits(ids, seed)[:, None] + step[None, :])
    radius = ((bits >> np.uint64(40)).astype(np.float64) + 1.0) / (1 << 24)
    angle = (bits & np.uint64((1 << 24) - 1)).astype(np.float64) / (1 << 24)
    return (np.sqrt(-2.0 * np.log(radius)) * np.cos(2.0 * np.pi * angle)).astype(np.float32)
