"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning: AQE converts a sort-merge join to a broadcast join only
# when the *measured* shuffle output of one side is below this threshold, so
# every data-derived dimension table gets a size-checked broadcast with the
# sort-merge join as the fallback beyond it.
AQE_BROADCAST_BYTES = 64 * 1024 * 1024


def get_session(master: str | None = None, app: str = "tastebud",
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or int(os.environ.get("TASTEBUD_SHUFFLE_PARTITIONS", "8"))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(AQE_BROADCAST_BYTES))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if not os.environ.get("SPARK_DRIVER_MEMORY_SET"):
        builder = builder.config("spark.driver.memory", os.environ.get("TASTEBUD_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage; we never invent a
    machine-local folder there. Only a local-mode session (tests, bench) with
    the setting unset gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tastebud-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read back: lineage ends at committed files."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
