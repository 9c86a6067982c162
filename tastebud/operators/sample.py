"""Row caps and user samples that are *features* of the reference (not shortcuts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastebud.functions.numeric import uniform


def tail_limit(df: DataFrame, n: int) -> DataFrame:
    """Keep the *last* n rows in file order (max_train_rows); n <= 0 keeps all.

    Processed files are sorted by (customer_id, event_ts, article_id) and the
    training frame is train then validation, so "last" = highest in
    (split order, customer_id, event_ts, article_id). ``orderBy.limit`` plans
    as a distributed TakeOrderedAndProject (top-n per partition, then merge).
    """
    if n <= 0:
        return df
    so = F.when(F.col("split") == "train", 0).otherwise(1)
    return (df.withColumn("_so", so)
            .orderBy(F.desc("_so"), F.desc("customer_id"), F.desc("event_ts"), F.desc("article_id"))
            .limit(n).drop("_so"))


def first_n_users(truth: DataFrame, n: int) -> DataFrame:
    """Baseline evaluation users: the first n in sorted id order."""
    users = truth.select("customer_id").distinct()
    return users.orderBy("customer_id").limit(n) if n > 0 else users


def sample_users(truth: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n users without replacement, ordered by md5(seed | id): repartition-stable."""
    users = truth.select("customer_id").distinct()
    if n <= 0:
        return users
    return users.orderBy(uniform(seed, "customer_id"), "customer_id").limit(n)
