"""Ranking metrics over long tables: (customer_id, rank, article_id) vs truth pairs.

Per-user values are computed by joins and windows bounded by the list length
k, then macro-averaged; nothing is collected per user on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("ndcg_at_k", "map_at_k", "hit_rate_at_k")


def _check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be greater than zero")


def dedupe_topk(recs: DataFrame, k: int) -> DataFrame:
    """First occurrence of each item per user, re-ranked 1.., cut to k."""
    _check_k(k)
    firsts = recs.groupBy("customer_id", "article_id").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy("customer_id").orderBy("_r")
    return (firsts.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= k).select("customer_id", "rank", "article_id"))


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    m = F.least(n_relevant, F.lit(k))
    return F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0),
                       lambda acc, r: acc + F.lit(1.0) / F.log2(r + 1))


def per_user_metrics(recs: DataFrame, truth: DataFrame, k: int,
                     rec_users: DataFrame | None = None) -> DataFrame:
    """ndcg / ap / hit per evaluated user.

    Evaluated users = users with a recommendation *call* (``rec_users``,
    default: users present in ``recs``) that also have a non-empty truth set.
    A user with an empty list scores 0; a user with no call is excluded.
    """
    top = dedupe_topk(recs, k)
    called = (rec_users if rec_users is not None else recs).select("customer_id").distinct()
    sizes = truth.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_truth"))
    users = called.join(sizes, "customer_id")
    hits = top.join(truth.select("customer_id", "article_id"), ["customer_id", "article_id"])
    w = Window.partitionBy("customer_id").orderBy("rank")
    hits = hits.withColumn("hits_so_far", F.row_number().over(w))
    agg = hits.groupBy("customer_id").agg(
        F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("hits_so_far") / F.col("rank")).alias("prec_sum"),
        F.count(F.lit(1)).alias("n_hits"))
    j = users.join(agg, "customer_id", "left")
    denom = F.least(F.col("n_truth"), F.lit(k)).cast("double")
    return j.select(
        "customer_id",
        (F.coalesce("dcg", F.lit(0.0)) / ideal_dcg(F.col("n_truth"), k)).alias("ndcg_at_k"),
        (F.coalesce("prec_sum", F.lit(0.0)) / denom).alias("map_at_k"),
        F.when(F.coalesce("n_hits", F.lit(0)) > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit_rate_at_k"))


def evaluate_rankings(recs: DataFrame, truth: DataFrame, k: int,
                      rec_users: DataFrame | None = None) -> DataFrame:
    """One row: k, users_evaluated, macro ndcg / map / hit (zeros when nobody)."""
    pu = per_user_metrics(recs, truth, k, rec_users)
    return pu.agg(
        F.lit(k).cast("long").alias("k"),
        F.count(F.lit(1)).alias("users_evaluated"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def catalog_coverage(recs: DataFrame, catalog_size: int | Column, k: int) -> DataFrame:
    """Distinct items shown in any top-k list / catalog size."""
    if isinstance(catalog_size, int) and catalog_size <= 0:
        raise ValueError("catalog_size must be greater than zero")
    size = F.lit(catalog_size) if isinstance(catalog_size, int) else catalog_size
    top = dedupe_topk(recs, k)
    return top.agg((F.count_distinct("article_id") / size.cast("double")).alias("catalog_coverage_at_k"))


def fresh_metrics(recs: DataFrame, fresh: DataFrame, k: int,
                  rec_users: DataFrame | None = None) -> DataFrame:
    """fresh coverage, mean fresh share of each list, share of users with a fresh item."""
    top = dedupe_topk(recs, k)
    fr = fresh.select("article_id").distinct().withColumn("_fresh", F.lit(1))
    n_fresh = fr.select(F.count(F.lit(1))).scalar()
    tagged = top.join(fr, "article_id", "left")
    per_user = tagged.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_fresh", F.lit(0))).alias("nf"))
    called = (rec_users if rec_users is not None else recs).select("customer_id").distinct()
    pu = called.join(per_user, "customer_id", "left")
    share = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("nf") / F.col("n")).otherwise(F.lit(0.0))
    exposed = tagged.where(F.col("_fresh") == 1).select(F.count_distinct("article_id")).scalar()
    return pu.agg(
        F.when(n_fresh > 0, exposed / n_fresh).otherwise(F.lit(0.0)).alias("fresh_coverage_at_k"),
        F.when(n_fresh > 0, F.coalesce(F.avg(share), F.lit(0.0))).otherwise(F.lit(0.0)).alias("fresh_share_at_k"),
        F.when(n_fresh > 0, F.coalesce(F.avg(F.when(F.coalesce("nf", F.lit(0)) > 0, 1.0).otherwise(0.0)), F.lit(0.0)))
         .otherwise(F.lit(0.0)).alias("users_with_fresh_hit_at_k"))


# Cumulative Poisson(1) probabilities of 0, 1, ... 8.
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(9)]


# Odd multipliers of the counter generator; the last two belong to its mixing steps.
USER_STEP, SAMPLE_STEP, SEED_STEP, MIX_1, MIX_2 = 2654435769, 2246822519, 3266489917, 2146121005, 2221713035
BLOCK_CELLS = 1_000_000  # users x samples of one weight block


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit counter turned into 32 random bits."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX_1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MIX_2)
    return x ^ (x >> np.uint32(16))


def poisson_weights(users: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Poisson(1) draws (users x samples) by inversion (9 at most), from counters of user, sample and seed."""
    counter = (users.astype(np.uint32) * np.uint32(USER_STEP))[:, None] + (
        np.arange(samples, dtype=np.uint32) * np.uint32(SAMPLE_STEP) + np.uint32(seed * SEED_STEP % 2**32))[None, :]
    cuts = np.ceil(np.array(POISSON) * 2.0**32).astype(np.uint64).astype(np.uint32)  # u < p as whole numbers
    return np.searchsorted(cuts, mixed(counter).ravel(), side="right").reshape(counter.shape).astype(float)


def resampled_means(per_user: DataFrame, keys: list[str], samples: int, seed: int) -> DataFrame:
    """Weighted metric means per key and sample; a user has the same weight under every key.

    A task makes the weights of its users in blocks and multiplies them with the
    metric columns; one row of partial sums per key and sample leaves it.
    """
    names = [f"k{i}" for i in range(len(keys))]
    user = F.conv(F.substring(F.md5(F.col("customer_id").cast("string")), 1, 8), 16, 10).cast("long").alias("user")
    rows = per_user.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], user,
                           *[F.col(m).cast("double").alias(m) for m in METRICS])
    schema = T.StructType([*[f for f in rows.schema if f.name in names], T.StructField("b", T.IntegerType()), T.StructField("w", T.DoubleType()),
                           *[T.StructField(m, T.DoubleType()) for m in METRICS]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        step = max(1, BLOCK_CELLS // samples)
        for batch in batches:
            for key, part in batch.groupby(names, dropna=False) if names else [((), batch)]:
                total = sums.setdefault(key if isinstance(key, tuple) else (key,), np.zeros((samples, 1 + len(METRICS))))
                for at in range(0, len(part), step):
                    block = part.iloc[at:at + step]
                    values = np.column_stack([np.ones(len(block)), block[list(METRICS)].to_numpy(float)])
                    total += poisson_weights(block["user"].to_numpy(), samples, seed).T @ values
        for key, total in sums.items():
            out = pd.DataFrame(total, columns=["w", *METRICS])
            out.insert(0, "b", np.arange(samples))
            for n, k in zip(reversed(names), reversed(key)):
                out.insert(0, n, k)
            yield out

    total = rows.mapInPandas(run, schema).groupBy(*names, "b").agg(F.sum("w").alias("w"), *[F.sum(m).alias(m) for m in METRICS])
    return total.where(F.col("w") > 0).select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "b",
                                              *[(F.col(m) / F.col("w")).alias(m) for m in METRICS])


def bootstrap_ci(per_user: DataFrame, samples: int = 1000, confidence: float = 0.95,
                 seed: int = 42) -> DataFrame:
    """Percentile intervals of the macro metrics over user resamples.

    Poisson bootstrap: in sample b a user counts as often as a Poisson(1) draw
    says, which follows from seed, b and the user's id. Users are neither numbered
    nor joined; weighted sums per sample are formed where the users lie, so what is
    shuffled has one row per sample and task.
    """
    if samples <= 0:
        raise ValueError("samples must be greater than zero")
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must be between zero and one")
    means = resampled_means(per_user, [], samples, seed)
    tail = (1.0 - confidence) / 2.0
    q = means.agg(*[F.percentile(m, F.array(F.lit(tail), F.lit(1.0 - tail))).alias(m) for m in METRICS])
    return q.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m)[0], F.lit(0.0)).alias("lower"),
                 F.coalesce(F.col(m)[1], F.lit(0.0)).alias("upper"))
        for m in METRICS])).alias("x")).select("x.*")
