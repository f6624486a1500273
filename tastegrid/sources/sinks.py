"""Writers: rating history, run metrics, tuned parameters and recommendation tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions import is_valid_rating
from tastegrid.sources.tables import RATINGS_SCHEMA, conform

# Fixed defaults for a missing parameter file or entry.
TUNED_DEFAULTS = {"n_factors": 100, "n_epochs": 20, "lr_all": 0.006, "reg_all": 0.025}


def append_ratings(
    history: DataFrame, submissions: DataFrame, path: str | None = None, min_movie_id: int = 1
) -> DataFrame:
    """Per submitting user: ratings_submitted and total_ratings after the append.

    Only valid rows count. With ``path`` they are appended there in the rating schema.
    """
    valid = submissions.where(is_valid_rating("rating", "movieId", min_movie_id))
    if path:
        conform(valid, RATINGS_SCHEMA).write.mode("append").parquet(path)
    new = valid.groupBy("userId").agg(F.count(F.lit(1)).alias("ratings_submitted"))
    old = history.groupBy("userId").agg(F.count(F.lit(1)).alias("before"))
    return new.join(old, "userId", "left").select(
        "userId",
        "ratings_submitted",
        (F.col("ratings_submitted") + F.coalesce("before", F.lit(0))).alias("total_ratings"),
    )


def append_metrics(spark: SparkSession, metrics: Mapping, path: str, fmt: str = "json") -> None:
    """Append one row of (nested) run metrics with the write time."""
    import json

    text = json.dumps(metrics)
    schema = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
    row = spark.range(1).select(F.from_json(F.lit(text), schema).alias("m")).select("m.*")
    row.withColumn("timestamp", F.current_timestamp()).write.mode("append").format(fmt).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; a path that can't be read, for instance for want of rights, raises."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_tuned(spark: SparkSession, path: str | None) -> dict:
    """The tuned parameters of the latest row at ``path``; defaults fill what is missing.

    ``path`` is a table of JSON lines, as :func:`append_metrics` writes it, or a file with one JSON object over
    several lines. The content tells which: a line that is no object of its own means the latter.
    """
    if not path or not _exists(spark, path):
        return dict(TUNED_DEFAULTS)
    fields = [T.StructField(k, T.DoubleType()) for k in TUNED_DEFAULTS]
    schema = T.StructType([*fields, T.StructField("timestamp", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    broken = lines.where(~F.trim("value").rlike(r"^\{.*\}$")).limit(1).count() > 0
    rows = spark.read.schema(schema).json(path, multiLine=broken).orderBy(F.desc_nulls_last("timestamp"))
    row = rows.select(*[F.coalesce(k, F.lit(float(v))).alias(k) for k, v in TUNED_DEFAULTS.items()]).first()
    if row is None:
        return dict(TUNED_DEFAULTS)
    return {k: type(TUNED_DEFAULTS[k])(row[k]) for k in TUNED_DEFAULTS}


def write_recommendations(recs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Recommendation table, partitioned by type."""
    recs.write.mode(mode).partitionBy("recommendation_type").parquet(path)


def nested_lists(recs: DataFrame) -> DataFrame:
    """One row per user with its ordered list as an array of structs."""
    item = F.struct("rank", "movieId", "title", "genres", "score")
    return recs.groupBy("userId", "num_ratings", "recommendation_type").agg(
        F.array_sort(F.collect_list(item)).alias("recommendations")
    )
