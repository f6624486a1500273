"""Joins that stay balanced when one key holds a large share of the rows.

AQE splits skewed partitions only where a shuffle feeds the join directly. A per-key
aggregate joined back to its own rows reuses the aggregate's partitioning, so AQE never
sees a splittable shuffle there. These helpers salt the hot keys in the plan instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more rows than half a fair shuffle partition, but at least
# 1/MAX_HOT_KEYS of all rows: there are fewer than MAX_HOT_KEYS hot keys however large the data
# and the cluster are. That bound makes the list of hot keys safe to broadcast.
MAX_HOT_KEYS = 50_000
# Salts per shuffle partition that a key would fill on its own.
SALTS_PER_PARTITION = 4


def hot_keys(counts: DataFrame, key: str | Sequence[str], weight: str, share: int | None = None) -> DataFrame:
    """Keys whose weight is more than ``1/share`` of the total: fewer than ``share`` rows.

    ``share`` defaults to twice the shuffle partitions of the session, and is 1000 to ``MAX_HOT_KEYS``.

    ``__salts`` is the number of parts a key is cut into: its share of the total times the
    shuffle partitions of the session times ``SALTS_PER_PARTITION``, and at least 2.
    """
    keys = [key] if isinstance(key, str) else list(key)
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = share or min(MAX_HOT_KEYS, max(1000, 2 * partitions))
    part = F.col(weight) / counts.agg(F.sum(weight)).scalar()
    salts = F.greatest(F.lit(2), F.ceil(part * (partitions * SALTS_PER_PARTITION)).cast("int"))
    return counts.where(part > 1 / share).select(*keys, salts.alias("__salts"))


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str | Sequence[str],
    counts: DataFrame,
    weight: str,
    how: str = "left",
    condition=None,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` on ``key`` with the hot keys spread over many tasks.

    ``counts`` holds one row per key with the number of fact rows in ``weight``.
    Rows of a hot key are salted by a hash of their values and of the map task they come from: a
    retried task repeats its salts, identical rows spread over the tasks that read them, and rows that arrive
    shuffled by the key spread by their values. The lookup rows of hot keys
    are repeated once per salt; all other rows travel once. ``how`` is any join type
    that keeps or drops fact rows: inner, left, left_semi, left_anti. ``condition``
    takes the two frames and returns an extra predicate.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = F.broadcast(hot_keys(counts, keys, weight))
    salts = F.coalesce("__salts", F.lit(1))
    left = (
        facts.join(hot, keys, "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*facts.columns, F.spark_partition_id()), salts).cast("int"))
        .drop("__salts")
    )
    right = (
        lookup.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("__salts")
    )
    on = [*keys, "__salt"]
    if condition is None:
        return left.join(right, on, how).drop("__salt")
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    predicate = condition(left, renamed)
    for c in on:
        predicate = predicate & (left[c] == renamed[f"__r_{c}"])
    return left.join(renamed, predicate, how).drop("__salt", *[f"__r_{c}" for c in on])


def row_counts(facts: DataFrame, key: str | Sequence[str], weight: str = "__rows") -> DataFrame:
    """Rows per key, combined map-side before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))
