"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# The white space of every contract here, as a regular expression class body.
BLANK = r"\x20\x09-\x0D"
# Bytes of text (or of results) that a Python task gathers before it hands them on.
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def column_values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def emit(
    rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int], limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``limit`` bytes by ``weigh``, so that one batch stays small."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) + 64
        if size >= limit:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def only_kept(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each document in ``kept`` (``id``, and ``h``: xxhash64 of the text), with all columns.

    A document is an id with a text, told from others by 64-bit hashes of both. Repeated rows are thinned before
    the shuffle, so they make no hot task, and the join reuses the window's partitions at every size: texts move
    once. The columns travel as one struct: none can clash with the names used here.
    """
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(F.col(id_col)).alias("i"),
        F.xxhash64(text_of(text_col)).alias("h"),
    )
    order = Window.partitionBy("i", "h").orderBy("h")
    single = row.withColumn("n", F.row_number().over(order)).where("n = 1")
    wanted = kept.select(F.xxhash64("id").alias("i"), "h")
    return single.join(wanted.hint("merge"), ["i", "h"], "left_semi").select("row.*")
