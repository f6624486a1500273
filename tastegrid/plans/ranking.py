"""Top-n and exact percentile plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_n(n: int, maximum: int | None = None) -> int:
    """Guard for list lengths: at least 1, at most ``maximum`` when one is set."""
    if n < 1 or (maximum is not None and n > maximum):
        upper = "" if maximum is None else f" and at most {maximum}"
        raise ValueError(f"n must be at least 1{upper}, got {n}")
    return n


def top_n_per_key(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key. Spark cuts each map task to n rows per key before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def value_counts(df: DataFrame, value: str, freq: str = "__freq") -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias(freq))


def exact_percentile(df: DataFrame, value: str, p) -> DataFrame:
    """One-row frame ``p`` with the exact, linearly interpolated percentile(s) of ``value``.

    Values are counted first, so the final task holds one entry per distinct value and not
    one per row. ``p`` is a fraction or a list of fractions.
    """
    fractions = F.array(*[F.lit(float(x)) for x in p]) if isinstance(p, (list, tuple)) else F.lit(float(p))
    return value_counts(df, value).agg(F.percentile(value, fractions, F.col("__freq")).alias("p"))
