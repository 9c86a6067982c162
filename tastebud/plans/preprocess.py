"""Preprocess stage: raw tables -> processed parquet tables (written once).

Mirrors the reference's stage boundary: later stages read only processed
tables. Interactions are written partitioned by split (so reading one split
prunes the others) and range-sorted by (customer_id, event_ts, article_id). The
tables of a run and its summary become current together, by one manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastebud.operators import clean as C
from tastebud.operators import popularity as P
from tastebud.session import stored
from tastebud.sources import versions as V
from tastebud.sources.sinks import PROCESSED_TABLES, SPLIT_TABLES, outputs_present, write_table

_HANDLES: dict[tuple[str, str, str], DataFrame] = {}
_CURRENT: dict[tuple[str, str], str] = {}


def run_preprocess(spark: SparkSession, raw_tx: DataFrame, raw_items: DataFrame, raw_customers: DataFrame,
                   out_dir: str, force: bool = False) -> bool:
    """Write all processed tables as a new version; skip the whole stage when every output exists.

    Returns True when the stage ran, False when it was skipped.
    """
    if not force and is_ready(spark, out_dir):
        return False
    version = V.new_version(out_dir)
    out = V.folder(out_dir, version)
    n_items, n_customers = raw_items.count(), raw_customers.count()
    write_table(C.clean_items(raw_items, rows=n_items), f"{out}/items_clean")
    write_table(C.clean_customers(raw_customers, rows=n_customers), f"{out}/customers_clean")
    items, customers = spark.read.parquet(f"{out}/items_clean"), spark.read.parquet(f"{out}/customers_clean")
    raw_rows, anchor = C.split_anchor(raw_tx)
    # Written once: bounds of the sorted table, its rows and the counts of rejected ones are all read from there.
    labelled = stored(C.windowed_interactions(raw_tx, items, anchor), "labelled")
    write_table(C.kept_interactions(labelled), f"{out}/interactions_clean", partition_by="split",
                sort_by=["customer_id", "event_ts", "article_id"])
    clean = spark.read.schema(C.kept_interactions(labelled).schema).parquet(f"{out}/interactions_clean")
    train = clean.where("split = 'train'")
    users, item_map = C.build_id_maps(train)
    write_table(users, f"{out}/customer_map")
    write_table(item_map, f"{out}/item_map")
    write_table(P.popularity(train), f"{out}/popularity")
    write_table(P.seen_pairs(train), f"{out}/seen")
    write_table(_summary(spark, raw_rows, clean, labelled, n_items, items, n_customers, customers), f"{out}/preprocess_summary")
    V.publish(spark, out_dir, version, PROCESSED_TABLES)
    _CURRENT.pop((spark.sparkContext.applicationId, out_dir), None)
    return True


def _summary(spark: SparkSession, raw_rows: int, clean: DataFrame, labelled: DataFrame, n_items: int, items: DataFrame,
             n_customers: int, customers: DataFrame) -> DataFrame:
    """The 14 counters of a run, one row; kept rows are counted in the table written."""
    kept = {r["split"]: r["count"] for r in clean.groupBy("split").count().collect()}  # at most three
    lost: dict[str, int] = {}
    for r in C.reject_counts(labelled).collect():  # at most nine
        lost[r["reject_reason"]] = lost.get(r["reject_reason"], 0) + r["n_rows"]
    counters = {"interactions_raw_rows": raw_rows, **{f"interactions_{s}_rows": kept.get(s, 0) for s in C.SPLITS},
                "interactions_clean_rows": sum(kept.values()), "interactions_dropped_missing": lost.get("missing", 0),
                "interactions_dropped_invalid_price": lost.get("invalid_price", 0), "interactions_deduplicated": 0,
                "interactions_dropped_orphan_items": lost.get("orphan", 0), "items_raw_rows": n_items,
                "items_clean_rows": items.count(), "items_with_images": items.where("has_image").count(),
                "customers_raw_rows": n_customers, "customers_clean_rows": customers.count()}
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{c} long" for c in counters))


def current_version(spark: SparkSession, out_dir: str) -> str | None:
    """The folder of the current version; a session looks again only after its own run of the stage."""
    key = (spark.sparkContext.applicationId, out_dir)
    if key not in _CURRENT:
        at = V.current(spark, out_dir)
        if at is None:
            return None
        _CURRENT[key] = at
    return _CURRENT[key]


def is_ready(spark: SparkSession, out_dir: str) -> bool:
    at = current_version(spark, out_dir)
    return at is not None and outputs_present(spark, at)


def read_processed(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A processed table of the current version; the handle (file listing, schema) is reused per session."""
    if name in SPLIT_TABLES:
        return read_processed(spark, out_dir, "interactions_clean").where(F.col("split") == SPLIT_TABLES[name])
    if name not in PROCESSED_TABLES:
        raise KeyError(name)
    at = current_version(spark, out_dir)
    if at is None:
        raise FileNotFoundError(f"no version of {out_dir} has been published")
    key = (spark.sparkContext.applicationId, at, name)
    if key not in _HANDLES:
        _HANDLES[key] = spark.read.parquet(f"{at}/{name}")
    return _HANDLES[key]
