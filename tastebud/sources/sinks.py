"""Processed-table sinks: write once to shared storage, skip when already present."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tastebud.session import checkpoint_dir

PROCESSED_TABLES = ("interactions_clean", "items_clean", "customers_clean", "customer_map", "item_map",
                    "popularity", "seen", "preprocess_summary")
# Splits read as tables of their own: partitions of interactions_clean.
SPLIT_TABLES = {"interactions_train": "train", "interactions_val": "val", "interactions_test": "test"}
LAYOUT_VERSION = "3"


def exists(spark: SparkSession, path: str) -> bool:
    """True when a parquet table is readable at ``path`` (public API, no FS internals)."""
    try:
        spark.read.parquet(path).schema  # noqa: B018 - resolves the footer only
        return True
    except AnalysisException:
        return False


def committed(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its ``_SUCCESS`` marker, on whatever file system the path names."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def outputs_present(spark: SparkSession, out_dir: str, names=PROCESSED_TABLES) -> bool:
    return all(committed(spark, f"{out_dir}/{n}") and exists(spark, f"{out_dir}/{n}") for n in names)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None,
                sort_by: list[str] | None = None) -> None:
    """Parquet write; optionally range-sorted (a stable file order) and split-partitioned."""
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


INPUTS = {"events": ("events", "part", "customer"), "orders": ("orders", "lineitem", "part", "customer")}


def input_version(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the name, size and time of every file below ``paths``, on whatever file system they name."""
    found = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def processed_dir(spark: SparkSession, sf_dir: str, adapter: str) -> str:
    """A folder under the shared checkpoint location, keyed by the input files and the adapter.

    Changed input gets a folder of its own, so stale tables are never read.
    """
    version = input_version(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in INPUTS[adapter]])
    key = hashlib.sha256(f"{version}|{adapter}|{LAYOUT_VERSION}".encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark).rstrip('/')}/processed/{adapter}-{key}"
