"""Mixing sources to target weights by Poisson replication, in DataFrame operations.

Each source has a mean repetition rate: its target share of the mixture over its share of the corpus. Each
document's count is the inverse of the Poisson distribution with that mean at a uniform number hashed from the
seed and the document, so a retried task repeats it. Documents are exploded by their counts and shuffled globally
by another hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import text_of
from tastegrid.sources.session import materialize

# A rate above this is drawn as the sum of equal smaller rates, whose tables stay short and exact.
LARGEST_RATE = 16.0
# Entries of a table of cumulative probabilities: beyond them less than 2**-52 is left at the largest rate.
TABLE = 72
UNIFORM_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 (exclusive) in steps of 2**-52, from a hash of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, UNIFORM_DIGITS), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(
    docs: DataFrame, weights: Mapping[str, float] | None, smoothing: float, epochs: float, source_col: str, text_col: str
) -> DataFrame:
    """(source, rate) of every source.

    A document weighs its characters and one more, so that empty ones count. Without ``weights`` a source's
    target is its share to the power ``smoothing``; with them, a source that they don't name gets 0.
    """
    weighed = docs.select(F.col(source_col).cast("string").alias("source"), (F.length(text_of(text_col)) + 1).cast("long").alias("size"))
    sizes = materialize(weighed.groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    if weights is None:
        target = F.pow(F.col("size").cast("double"), F.lit(float(smoothing)))
    elif not weights or any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights are zero or more, and not all zero")
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        target = F.when(F.col("source").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0)))
    aimed = sizes.withColumn("target", target)
    sums = aimed.agg(F.sum("size").alias("all_size"), F.sum("target").alias("all_target"))
    rate = F.col("target") / F.col("all_target") * F.col("all_size") / F.col("size") * F.lit(float(epochs))
    return aimed.crossJoin(F.broadcast(sums)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def tables(rates: DataFrame) -> DataFrame:
    """(source, rate, draws, cdf): a Poisson variable of the rate is the sum of ``draws`` of the table's."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE).cast("int"))
    split = rates.withColumn("draws", draws).withColumn("part", F.col("rate") / F.col("draws"))
    start = F.struct(
        F.exp(-F.col("part")).alias("p"), F.exp(-F.col("part")).alias("sum"), F.array(F.exp(-F.col("part"))).alias("all")
    )

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("part") / k
        return F.struct(p.alias("p"), (state["sum"] + p).alias("sum"), F.concat(state["all"], F.array(state["sum"] + p)).alias("all"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), start, step, lambda s: s["all"])
    return split.withColumn("cdf", cdf).drop("part")


def copies(seed: int, key: Column) -> Column:
    """Each draw counts the table's entries up to its uniform number: the inverse of the distribution."""

    def draw(total: Column, i: Column) -> Column:
        u = uniform(F.lit(str(seed)), key, i.cast("string"))
        return total + F.size(F.filter("cdf", lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), draw)


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    smoothing: float = 0.5,
    epochs: float = 1.0,
    seed: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(row, copy, copies, rate, order_key): every document as often as drawn, globally shuffled.

    ``row`` is a struct of all columns of ``docs``, so no name can clash. ``epochs`` is the mixture's expected
    size in sizes of the corpus. Rows go to partitions by a hash of id, text and copy, and lie in its order
    there: ``order_key`` gives one global random order. Counts follow id and seed alone, so rows with equal ids
    share their count. A null source is a source of its own (with ``weights`` it gets nothing); a null id
    counts as the empty string. A source with rate zero leaves, and an empty table gives an empty one.
    """
    table = materialize(tables(rates(docs, weights, smoothing, epochs, source_col, text_col)), "rates")
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
    ).alias("d")
    drawn = (
        rows.join(table.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("row", "id", "rate", copies(seed, key).alias("copies"))
        .where("copies > 0")
    )
    exploded = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = uniform(F.lit(str(seed)), F.lit("order"), key, F.col("copy").cast("string"))
    keyed = exploded.select("row", "copy", "copies", "rate", order.alias("order_key"), F.xxhash64("row").alias("h"))
    return keyed.repartition("order_key", "h").sortWithinPartitions("order_key", "h").drop("h")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of ``docs``; a document drawn n times has n rows."""
    return mix(docs, **options).select("row.*")
