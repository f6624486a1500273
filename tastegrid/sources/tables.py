"""Rating and item tables: schemas, scans, and the views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions import epoch_seconds, pair_bucket

RATINGS_SCHEMA = T.StructType(
    [
        T.StructField("userId", T.LongType()),
        T.StructField("movieId", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
MOVIES_SCHEMA = T.StructType(
    [
        T.StructField("movieId", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("genres", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of ``schema``; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _scan(spark: SparkSession, path: str, fmt: str, schema: T.StructType, keys, limit) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = conform(reader.load(path), schema)
    return df.orderBy(*keys).limit(limit) if limit else df


def load_movies(spark: SparkSession, path: str, limit: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Item scan of three columns. ``limit`` (0 or None: all) takes the first rows by id."""
    return _scan(spark, path, fmt, MOVIES_SCHEMA, ["movieId"], limit)


def load_ratings(spark: SparkSession, path: str, limit: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Rating scan of four columns. ``limit`` (0 or None: all) takes the first rows by key and time."""
    return _scan(spark, path, fmt, RATINGS_SCHEMA, ["userId", "movieId", "timestamp", "rating"], limit)


def sample_pairs(ratings: DataFrame, percent: int, seed: int = 42) -> DataFrame:
    """Fair, repeatable sample: about ``percent`` of the (user, item) pairs, by hash."""
    return ratings.where(pair_bucket("userId", "movieId", seed, 100) < percent)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings view: order lines as ratings of parts by customers."""
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_shipdate"
    )
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5).cast("double") * 0.5).alias("rating"),
        epoch_seconds("l_shipdate").alias("timestamp"),
    )


def star_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item view: parts with type and name words as genres."""
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("title"),
        F.concat("p_type", F.lit("|"), F.replace("p_name", F.lit(" "), F.lit("|"))).alias("genres"),
    )


def shape_baskets(lines: DataFrame) -> DataFrame:
    """Order lines as ratings of parts by *orders*: most histories are shorter than five."""
    return lines.select(
        F.col("l_orderkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5).cast("double") * 0.5).alias("rating"),
        epoch_seconds("l_shipdate").alias("timestamp"),
    )


def star_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_baskets(_table(spark, sf_dir, "lineitem"))


def star_basket_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("userId"))


def star_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("userId"))


def shape_submissions(events: DataFrame) -> DataFrame:
    """Events as rating submissions; ``error`` events keep a raw value and are mostly invalid."""
    return events.select(
        "event_id",
        F.timestamp_seconds(epoch_seconds("ts")).alias("ts"),
        epoch_seconds("ts").alias("timestamp"),
        F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").cast("bigint").alias("movieId"),
        F.when(F.col("event_type") == "error", F.col("value"))
        .otherwise(F.least(F.lit(5.0), F.ceil(F.col("value") / 10).cast("double") * 0.5))
        .alias("rating"),
    )


def star_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_submissions(_table(spark, sf_dir, "events"))


def _stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int) -> DataFrame:
    return (
        spark.readStream.schema(_table(spark, sf_dir, name).schema)
        .option("pathGlobFilter", f"{name}*.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(sf_dir)
    )


def stream_submissions(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The same submissions as a stream over the events file."""
    return shape_submissions(_stream(spark, sf_dir, "events", files_per_batch))


def stream_baskets(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The basket ratings as a stream over the order lines."""
    return shape_baskets(_stream(spark, sf_dir, "lineitem", files_per_batch))


def star_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
