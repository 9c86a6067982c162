"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tastebud.session import checkpoint_dir

# Rows of one Arrow batch handed to Python; texts may be very long, so a batch
# is kept far below Spark's default of 10,000 rows.
ARROW_ROWS = 512
ARROW_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in rows and bytes (never raises them)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends at committed files."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
