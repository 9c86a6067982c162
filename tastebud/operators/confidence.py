"""Implicit-feedback confidences: log1p of counts or of recency-decayed counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interaction_confidence(interactions: DataFrame) -> DataFrame:
    """log1p(rows) per (user, item); duplicates are summed before the log."""
    return (interactions.select("customer_id", "article_id").dropna()
            .groupBy("customer_id", "article_id").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("weight")))


def recency_confidence(interactions: DataFrame, half_life_days: float) -> DataFrame:
    """log1p(sum(exp(-ln2/half_life * age_days))), age from the latest ``event_ts``.

    The latest timestamp is a scalar subquery over the given rows (callers
    pass all rows for the factor model, catalog rows for the content model).
    """
    if half_life_days <= 0:
        raise ValueError("half_life_days must be positive")
    df = interactions.select("customer_id", "article_id", "event_ts").dropna()
    mx = df.select(F.max("event_ts")).scalar()
    age_days = F.timestamp_diff("MICROSECOND", F.col("event_ts"), mx) / F.lit(86_400_000_000.0)  # zone-free
    decay = math.log(2.0) / half_life_days
    w = F.exp(F.lit(-decay) * age_days)
    return df.groupBy("customer_id", "article_id").agg(F.log1p(F.sum(w)).alias("weight"))


def confidence(interactions: DataFrame, half_life_days: float | None = None) -> DataFrame:
    """Recency weighting only when asked *and* ``event_ts`` exists, else counts."""
    if half_life_days is not None and "event_ts" in interactions.columns:
        return recency_confidence(interactions, half_life_days)
    return interaction_confidence(interactions)
