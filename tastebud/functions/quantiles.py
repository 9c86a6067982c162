"""Exact quantiles by counting: no percentile buffer, no task that holds a whole key.

Distinct values are counted (partial sums before the shuffle), range-partitioned
by key and value, and written once. What lies before a partition's part of a key
is a sum over partitions; running counts within partitions then say at which
positions a value stands, and a quantile is read off the two values around its
position. A key of any share of the rows is spread over as many range partitions
as its distinct values fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastebud.session import stored


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, c, _pid): rows per distinct value (nulls left out), sorted within written range partitions."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    order = [F.col(k) for k in (*keys, value)]
    ranged = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("_pid", F.spark_partition_id()), "counts")


def quantiles_of(counts: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, n, q) of ``value_counts``; q is the array of linearly interpolated quantiles, as doubles."""
    parts = counts.groupBy("_pid", *keys).agg(F.sum("c").alias("_part"))
    whole, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pid", *keys, F.sum("_part").over(whole).alias("n"),
                         F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_before"))  # a row per partition of a key
    running = Window.partitionBy("_pid", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = (counts.withColumn("_upto", F.sum("c").over(running))
            .join(parts.withColumnsRenamed({c: f"_r_{c}" for c in ("_pid", *keys)}),
                  [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in ("_pid", *keys)]))
    end = F.col("_before") + F.col("_upto")
    v, out = F.col(value).cast("double"), []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n") - 1)
        for name, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            out.append(F.max(F.when((end - F.col("c") <= at) & (at < end), v)).alias(f"{name}{i}"))
    picked = rows.groupBy(*keys, "n").agg(*out)
    between = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n") - 1)
        share = position - F.floor(position)
        between.append(F.when(share == 0, F.col(f"lo{i}")).otherwise((1 - share) * F.col(f"lo{i}") + share * F.col(f"hi{i}")))
    return picked.select(*keys, "n", F.array(*between).alias("q"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    return quantiles_of(value_counts(df, keys, value), keys, value, probs)
