"""Exact deduplication by recipes of content-defined chunks, in DataFrame operations only.

A text is normalised (each run of white space to one space) and cut where its content says so: at the first
sentence or clause end after ``SHORTEST`` characters, or after ``LONGEST`` if none comes. Equal texts are cut
alike. The chunks, not the documents, are shuffled once: distinct chunks are gathered by hash with their whole
content, which proves each hash to be the identifier of one content. Should two contents share a hash, they get
numbers. A document's recipe is the ordered list of its chunks' identifiers, and documents with equal recipes
are equal. From there on only recipes move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import BLANK, only_kept, text_of
from tastegrid.sources.session import materialize

SHORTEST = 512
LONGEST = 8192


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Single spaces, the common case, match nothing."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{BLANK}]*|\x20[{BLANK}]+", " ")


def chunks_of(text: Column) -> Column:
    pattern = rf"(?s).{{{SHORTEST},{LONGEST}}}?(?:(?<=[.!?,;:]) |\z)|.{{1,{LONGEST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _recipes(docs: DataFrame, identify: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """(id, h, sha, recipe, marks) of every document: an id with a text; h is a hash of the raw text.

    ``marks`` is empty but for documents with a chunk whose hash another chunk shares.
    """
    cut = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"), normalised(text_of(text_col)).alias("norm")
    ).withColumn("chunks", chunks_of(F.col("norm")))
    plain = cut.select("id", "h", F.sha2("norm", 256).alias("sha"), F.transform("chunks", identify).alias("recipe"))
    plain = materialize(plain.distinct(), "recipes")

    parts = cut.select("id", "h", F.posexplode("chunks").alias("at", "chunk")).withColumn("chunk_id", identify(F.col("chunk")))
    contents = parts.groupBy("chunk_id", "chunk").agg(F.count(F.lit(1)).alias("uses")).select("chunk_id")
    shared = materialize(contents.groupBy("chunk_id").count().where("count > 1").select("chunk_id"), "shared")

    # Normally empty from here on: chunks that share a hash get numbers by content.
    alike = parts.join(shared, "chunk_id", "left_semi").select("id", "h", "at", "chunk_id", "chunk")
    alike = materialize(alike, "alike")
    numbers = alike.select("chunk_id", "chunk").distinct()
    numbers = numbers.withColumn("no", F.row_number().over(Window.partitionBy("chunk_id").orderBy("chunk")))
    marks = (
        alike.join(numbers, ["chunk_id", "chunk"])
        .groupBy("id", "h")
        .agg(F.array_sort(F.collect_set(F.struct("at", "no"))).alias("marks"))
    )
    marks = materialize(marks, "marks").alias("m")
    same = F.col("p.id").eqNullSafe(F.col("m.id")) & (F.col("p.h") == F.col("m.h"))
    return plain.alias("p").join(marks, same, "left").select("p.*", F.col("m.marks").alias("marks"))


def _groups(recipes: DataFrame) -> DataFrame:
    """Every document with ``least`` (id and h of the first of its group, null ids last) and ``group_size``."""
    recipes = recipes.withColumn("marks", F.coalesce("marks", F.expr("cast(array() as array<struct<at:int,no:int>>)")))
    recipes = materialize(recipes, "documents")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("least")
    groups = recipes.groupBy("recipe", "marks").agg(first, F.count(F.lit(1)).alias("group_size"))
    return recipes.join(materialize(groups, "groups"), ["recipe", "marks"])


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    identify: Callable[[Column], Column] = chunk_hash,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every document, dropped ones too.

    Texts are equal when their normalised forms are; null counts as empty, and all empty texts are equal (white
    space alone is one space, which is not empty). Of equal texts the smallest id stays, null ids last, and on
    equal ids one raw text. Rows that repeat id and text are one document with one row. ``text_sha256`` is the
    digest of the normalised text. Other columns are not read. ``identify`` hashes a chunk; tests pass a poor one.
    """
    return _groups(_recipes(docs, identify, id_col, text_col)).select(
        F.col("id").alias(id_col),
        F.col("least.id").alias("keep_id"),
        "group_size",
        (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the first document of each group; one row of each document."""
    kept = _groups(_recipes(docs, chunk_hash, id_col, text_col)).select("least.id", "least.h").distinct()
    return only_kept(docs, materialize(kept, "kept"), id_col, text_col)
