"""Versioned folders: all tables of a run go to a new version, one manifest makes it current.

``base/versions/<name>/<table>`` holds the tables, ``base/manifests/<name>`` one
row per table. A manifest is the last thing a run writes, and it counts once its
own ``_SUCCESS`` is there: a run that dies between two tables leaves the version
before it current and whole. Readers follow the newest manifest.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

KEPT = 2  # published versions that stay: the current one and the one its last readers may hold
UNFINISHED_MS = 24 * 3600 * 1000  # age from which an unpublished version counts as abandoned


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _finished(spark: SparkSession, folder: str) -> bool:
    fs, at = _file_system(spark, f"{folder}/_SUCCESS")
    return fs.exists(at)


def new_version(base: str) -> str:
    """A name that sorts after those given before; its folder is ``base/versions/<name>``."""
    return f"{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex[:8]}"


def folder(base: str, version: str) -> str:
    return f"{base}/versions/{version}"


def published(spark: SparkSession, base: str) -> list[str]:
    """Published versions, oldest first."""
    return [n for n in _names(spark, f"{base}/manifests") if _finished(spark, f"{base}/manifests/{n}")]


def current(spark: SparkSession, base: str) -> str | None:
    """The folder of the newest published version, if there is any."""
    names = published(spark, base)
    return folder(base, names[-1]) if names else None


def publish(spark: SparkSession, base: str, version: str, tables: tuple[str, ...] | list[str]) -> str:
    """Make a version current; every table must have been committed. Older versions expire."""
    missing = [t for t in tables if not _finished(spark, f"{folder(base, version)}/{t}")]
    if missing:
        raise ValueError(f"tables not written: {', '.join(missing)}")
    manifest = spark.createDataFrame([(version, t) for t in tables], "version string, table string")
    manifest.coalesce(1).write.parquet(f"{base}/manifests/{version}")
    expire(spark, base)
    return folder(base, version)


def manifest(spark: SparkSession, base: str) -> DataFrame | None:
    names = published(spark, base)
    return spark.read.parquet(f"{base}/manifests/{names[-1]}") if names else None


def expire(spark: SparkSession, base: str, keep: int = KEPT) -> list[str]:
    """Delete all but the last ``keep`` published versions, and unpublished ones of long ago."""
    names = published(spark, base)
    now, gone = time.time_ns() // 1_000_000, []
    for n in _names(spark, f"{base}/versions"):
        abandoned = n not in names and now - int(n.split("-")[0]) > UNFINISHED_MS
        if n in names[:-keep] or abandoned:
            for part in ("manifests", "versions"):  # the manifest first: no reader follows it any more
                fs, at = _file_system(spark, f"{base}/{part}/{n}")
                fs.delete(at, True)
            gone.append(n)
    return gone
