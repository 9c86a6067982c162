"""Distributed dense positions over a total order (no single-partition window)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastebud.session import checkpoint_dir


FEW_ROWS = 10_000  # rows that may go through the driver: a few MB, also as vectors


def dealt(df: DataFrame, how: str = "merge", rows: int | None = None) -> DataFrame:
    """``df`` as the side of a join that is dealt out by key at every size, never sent whole through the driver.

    Tables that grow with the input (catalog, users, weights) are read from files
    a tenth of their size in memory or less; judged by those, Spark takes them
    for small and collects them in the driver. ``merge`` spills where a partition
    is large, ``shuffle_hash`` spares the sort where it holds narrow distinct keys. A table known to have
    but ``FEW_ROWS`` is left to Spark.
    """
    return df if rows is not None and rows <= FEW_ROWS else df.hint(how)


SPREAD_ROWS = 50_000  # rows of one task where a row costs much more than its bytes


def spread(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` of so many ``rows`` in tasks of about ``SPREAD_ROWS``.

    A file is read by as many tasks as its bytes fill, and catalogs are small files
    of very many rows: their text is cleaned after the rows are spread.
    """
    pieces = -(-(rows or 0) // SPREAD_ROWS)
    return df.repartition(pieces) if pieces > 1 else df


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", start: int = 0) -> DataFrame:
    """Add ``name`` = position of each row in ``order`` (must be a total order).

    ``row_number().over(orderBy)`` pulls every row into one task. Instead the
    rows are range-partitioned, sorted within partitions and written once to
    shared storage with their partition number and position in it. Counts per
    partition (one row each), their running sums and the rows themselves are all
    read from that one table: range bounds drawn twice, or partitions joined by
    the adaptive planner, can't make them disagree.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = (ranged.withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/index-{uuid.uuid4().hex}"
    tagged.write.parquet(path)
    tagged = df.sparkSession.read.schema(tagged.schema).parquet(path)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")  # one row per partition: bounded
    return out.withColumn(name, (F.col("_off") + F.col("_local") + F.lit(start)).cast("long")).drop("_pid", "_local", "_off")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", top_n: int | None = None) -> DataFrame:
    """Add ``name`` = 1, 2, ... in ``order`` (a total order) within each key, without sorting a key in one task.

    With ``top_n`` Spark keeps the best n of every task before the shuffle
    (window group limit). A whole ranking is the distance of a row's dense
    position from the first of its key; the firsts are one row per key.
    """
    if top_n is not None:
        by = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(by).cast("long")).where(F.col(name) <= top_n)
    placed = dense_index(df, [*[F.col(k) for k in keys], *order], "_place")
    firsts = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return placed.join(firsts, keys).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
