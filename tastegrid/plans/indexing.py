"""Dense integer ids for keys that do not fit an integer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INT_MAX = (1 << 31) - 1


def fits_int(df: DataFrame, *columns: str) -> bool:
    """True when every id column lies in the integer range: one row for the driver."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    row = ends.first()
    return all(v is None or -INT_MAX - 1 <= v <= INT_MAX for v in row)


def dense_index(df: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """(column, idx): ids 0.. for the distinct values of ``column``.

    Values are hashed into buckets and numbered inside each; a running total over the
    ``buckets`` bucket sizes gives the offsets. Depends on the values only.
    """
    ids = df.select(column).distinct().withColumn("__b", F.pmod(F.xxhash64(column), F.lit(buckets)))
    sizes = ids.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        "__b",
        (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__offset"),
    )
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(column)) - 1
    return (
        ids.withColumn("__i", inside)
        .join(offsets, "__b")
        .select(column, (F.col("__offset") + F.col("__i")).cast("int").alias("idx"))
    )
