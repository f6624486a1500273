"""Column expressions shared by the operators (no UDFs)."""

from tastegrid.functions.columns import (
    activity_class,
    bayesian_average,
    blend_score,
    clip_rating,
    cosine,
    day_index,
    dot,
    epoch_seconds,
    genre_match,
    genre_set,
    genre_tokens,
    is_valid_rating,
    jaccard,
    norm,
    pair_bucket,
    service_tier,
    utc_datetime,
)

__all__ = [
    "activity_class",
    "bayesian_average",
    "blend_score",
    "clip_rating",
    "cosine",
    "day_index",
    "dot",
    "epoch_seconds",
    "genre_match",
    "genre_set",
    "genre_tokens",
    "is_valid_rating",
    "jaccard",
    "norm",
    "pair_bucket",
    "service_tier",
    "utc_datetime",
]
